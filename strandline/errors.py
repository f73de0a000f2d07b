"""Exceptions of the library."""


class StrandlineError(Exception):
    """Base of all errors raised here."""


class NotFound(StrandlineError):
    """No row has the key that was asked for."""


class UnknownEdgeLinks(StrandlineError):
    """An edge names a link that is not in the graph."""


class UnknownEdgeSource(StrandlineError):
    """An edge starts at a vertex that is not in the graph."""


class InvalidMessageDestination(StrandlineError):
    """A message goes to a vertex that is not in the graph."""


class MissingLinkID(StrandlineError):
    """A document has no link id."""


class NegativeCost(StrandlineError):
    """An edge of a shortest-path graph has a cost below zero."""


class NoPartitionData(StrandlineError):
    """The number of partitions is not known yet."""


class CommitConflict(StrandlineError):
    """Another writer has rewritten the same rows meanwhile."""
