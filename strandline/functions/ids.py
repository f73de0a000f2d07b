"""Identifiers and their partition ranges."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StrandlineError
from ..schemas import LAST_ID, NIL_ID


def uuid_of(text: Column) -> Column:
    """A UUID that depends on the text alone, so retried tasks and reruns agree."""
    h = F.md5(text.cast("binary"))
    return F.concat_ws("-", *[F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def link_id(url: Column) -> Column:
    return uuid_of(url)


def edge_id(src: Column, dst: Column) -> Column:
    return uuid_of(F.concat(src, F.lit(">"), dst))


def uuid_from_bytes(value: Column) -> Column:
    """Canonical form of 16 bytes; anything else is the nil UUID."""
    h = F.lower(F.hex(value))
    parts = F.concat_ws("-", *[F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.length(value) == 16, parts).otherwise(F.lit(NIL_ID))


def _number(uuid: str) -> int:
    return int(uuid.replace("-", ""), 16)


def _uuid(number: int) -> str:
    h = f"{number:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def partition_bounds(n: int, start: str = NIL_ID, end: str = LAST_ID) -> list[str]:
    """Upper bounds of ``n`` equal ranges of [start, end]; the last is ``end``."""
    if n <= 0:
        raise StrandlineError("number of partitions must be at least 1")
    low, high = _number(start), _number(end)
    if low >= high:
        raise StrandlineError("range start must be below range end")
    width = (high - low + 1) // n if n > 1 else 0
    return [_uuid(low + width * i) for i in range(1, n)] + [end]


def partition_extent(i: int, n: int, start: str = NIL_ID, end: str = LAST_ID) -> tuple[str, str]:
    """[from, to) of partition ``i``."""
    bounds = partition_bounds(n, start, end)
    if not 0 <= i < n:
        raise StrandlineError("partition index out of range")
    return (start if i == 0 else bounds[i - 1]), bounds[i]


def partition_of(uuid: str, n: int) -> int:
    return min(bisect_right(partition_bounds(n)[:-1], uuid), n - 1)


def partition_index(column: Column, n: int, start: str = NIL_ID, end: str = LAST_ID) -> Column:
    """Which of ``n`` ranges an id falls in: a count of the bounds at or below it, so no join; null outside all."""
    inner = partition_bounds(n, start, end)[:-1]
    index = F.size(F.filter(F.array(*[F.lit(b) for b in inner]), lambda b: b <= column)) if inner else F.lit(0)
    return F.when((column >= start) & (column < end), index)
