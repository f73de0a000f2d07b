"""An inverted index in segments that follows the log of the documents.

What was committed since the last refresh becomes a segment of its own; segments
never change.  Documents that a newer segment replaces are listed as gone from
the older one, and the sizes that BM25 needs are sums over segments less what is
gone.  Four segments of about one size are merged, so a document is rewritten a
logarithmic number of times.

A segment numbers its documents by PageRank, then id; ``1 << WINDOW_BITS`` numbers
are a window.  Postings are blocks of one term, field and window, with the
largest frequency and smallest length among them, and every window has its
largest and smallest PageRank: bounds of every hit's score, whatever the sizes of
the index are by then.  A search for the best k reads the blocks of the most
promising windows, and then those of every window whose bound reaches the k-th
hit; other windows are not read.  PageRanks are kept beside the postings by
window, so new ones rewrite neither postings nor numbers.

The index has a log as the tables have, one entry for each refresh or merge,
which two writers at once cannot both create.  A search stays at the entry that
it began with.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.blocks import FIELDS, PACKED, indexed
from ..functions.let import let
from ..ship import ship
from ..sources.deltalog import KEPT as CHANGES_KEPT
from ..sources.deltalog import DeltaTable, Log
from .index import B, K1
from .postings import shifted

WINDOW_BITS = 10
BUCKETS = 16
FANOUT = 4
PROBE = 16
LISTED = 2048
DEALT = 2
KEPT = 4
BLOCK = "field string, term string, win long, docs array<int>, tfs array<int>, lengths array<int>, positions array<array<int>>, n int, tf_max int, len_min int, seg string, bucket int"
DOC = "docno long, win long, link_id string, title long, content long, seg string"
RANK = "seg string, win long, docno long, pagerank double, txn string"
BOUND = "seg string, win long, rank_max double, rank_min double, txn string"
DEAD = "seg string, win long, docno long, title long, content long, txn string"


@dataclass
class Entry:
    """A version of the index: its segments (name: documents and terms), and the folders of what is gone and of PageRanks."""

    version: int = -1
    upto: int = -1
    segments: dict[str, list[int]] = field(default_factory=dict)
    gone: dict[str, list[int]] = field(default_factory=dict)
    dead: list[str] = field(default_factory=list)
    ranks: list[str] = field(default_factory=list)

    def sizes(self) -> tuple[int, int, int]:
        """Live documents, and terms of their titles and contents."""
        return tuple(sum(s[i] - self.gone.get(name, [0, 0, 0])[i] for name, s in self.segments.items()) for i in range(3))


@dataclass
class Found:
    """Hits in order, the number of all, and how many windows hold the terms and were read."""

    hits: list
    total: int
    windows: int
    read: int


class SegmentedIndex:
    """The index below ``root`` of the documents in ``documents`` (see :class:`DeltaTable`), at one version."""

    def __init__(self, spark: SparkSession, root: str, documents: DeltaTable, version: int | None = None, fanout: int = FANOUT, window_bits: int = WINDOW_BITS) -> None:
        ship(spark)
        self.spark, self.root, self.log, self.table, self.fanout, self.bits = spark, root.rstrip("/"), Log(spark, root), documents, fanout, window_bits
        found = self.log.versions()
        self.entry = Entry(**self.log.read_entry(found[-1] if version is None else version)) if found else Entry()

    # ---- writing

    def refresh(self) -> SegmentedIndex:
        """Index what the documents' log has that the index has not."""
        while True:
            latest = self.table.state().version
            if self.entry.upto >= latest:
                return self
            lost = self.entry.version < 0 or self.entry.upto < latest - CHANGES_KEPT
            made = self._rebuilt(latest) if lost or self._replaced(latest) else self._followed(latest)
            if self._commit(made):
                self._merge()

    def _commit(self, made: Entry) -> bool:
        """Whether the entry is the next one; if another writer was first, its version is taken up."""
        made.version = self.entry.version + 1
        done = self.log.create_entry(made.version, vars(made))
        self.entry = made if done else Entry(**self.log.read_entry(self.log.versions()[-1]))
        if done:
            self._vacuum()
        return done

    def _replaced(self, latest: int) -> bool:
        return any(self.table.read_entry(v).get("replaces") for v in self.table.versions() if self.entry.upto < v <= latest)

    def _rebuilt(self, latest: int) -> Entry:
        numbered = self._numbered(self.table.read(version=latest).select("link_id", "title", "content", "pagerank"))
        seg, sizes = self._segment(numbered)
        self._remove_work(numbered)
        return Entry(upto=latest, segments={seg: sizes} if sizes[0] else {}, ranks=[seg])

    def _followed(self, latest: int) -> Entry:
        """The present entry and what was committed since."""
        rows = self.table.changes(self.entry.upto, latest)
        # texts and scores in one grouping, so that texts are dealt by id once
        text, score = F.struct("_v", "indexed_at", "url", "title", "content"), F.struct("_v", "pagerank")
        per = rows.groupBy("link_id").agg(F.max(F.when(F.col("indexed_at").isNotNull(), text)).alias("t"), F.max(F.when(F.col("pagerank").isNotNull(), score)).alias("p")).where("t is not null or p is not null")
        before = self.live_docs().join(self.ranks(), ["seg", "win", "docno"])
        old = before.select("link_id", "seg", "win", "docno", F.col("title").alias("old_title"), F.col("content").alias("old_content"), "pagerank")
        named = old.select("link_id", *[F.col(c).alias(f"old_{c}") for c in ("seg", "win", "docno")], "old_title", "old_content", "pagerank")
        met = per.join(named, "link_id", "left").where("t is not null or old_seg is null")  # replaced texts, new ones, and scores of unknown documents
        shown = lambda c: F.coalesce(F.when(F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(F.lit("")), F.lit("")).alias(c)
        numbered = self._numbered(met.select("link_id", shown("title"), shown("content"), F.coalesce("p.pagerank", "pagerank", F.lit(0.0)).alias("pagerank"), "old_seg", "old_win", "old_docno", "old_title", "old_content"))
        seg, sizes = self._segment(numbered)
        e = self.entry
        made = Entry(upto=latest, segments={**e.segments, **({seg: sizes} if sizes[0] else {})}, gone=dict(e.gone), dead=list(e.dead), ranks=[*e.ranks, seg])
        gone = numbered.where("old_seg is not null").select(F.col("old_seg").alias("seg"), F.col("old_win").alias("win"), F.col("old_docno").alias("docno"), F.col("old_title").alias("title"), F.col("old_content").alias("content"))
        lost = gone.groupBy("seg").agg(F.count(F.lit(1)), F.sum("title"), F.sum("content")).collect()  # one row for each segment
        if lost:
            name = uuid.uuid4().hex
            gone.sort("seg", "win").write.parquet(f"{self.root}/dead/txn={name}")
            made.dead.append(name)
            for s, *n in lost:
                made.gone[s] = [a + b for a, b in zip(made.gone.get(s, [0, 0, 0]), n, strict=True)]
        given = rows.where("pagerank is not null").groupBy("link_id").agg(F.max(score).alias("p")).select("link_id", F.col("p.pagerank").alias("given"))
        if not given.isEmpty():  # PageRanks come as whole passes: all are written anew, by window
            name = uuid.uuid4().hex
            kept = old.join(numbered.select("link_id"), "link_id", "left_anti").join(given, "link_id", "left").select("seg", "win", "docno", F.coalesce("given", "pagerank").alias("pagerank"))
            own = self._read("ranks", RANK, [f"txn={seg}"]).select("seg", "win", "docno", "pagerank")
            self._write_ranks(name, kept.unionByName(own))
            made.ranks = [name]
        self._remove_work(numbered)
        return made

    def _work(self, df: DataFrame) -> DataFrame:
        """``df`` written, so that everything made from it agrees."""
        path = f"{self.root}/work/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found._strandline_work = path
        return found

    def _remove_work(self, df: DataFrame) -> None:
        self.log.remove(df._strandline_work[len(self.root) + 1 :])

    def _numbered(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``docno``, ascending from the largest PageRank on, and its window."""
        order = [F.desc("pagerank"), F.asc("link_id")]
        ranked = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("docno", F.monotonically_increasing_id())
        return self._work(ranked.withColumn("win", F.shiftright("docno", self.bits)))

    def _segment(self, numbered: DataFrame) -> tuple[str, list[int]]:
        """Write a segment of numbered documents (link_id, title, content, pagerank): its name, documents and terms."""
        seg = uuid.uuid4().hex
        # files hold whole windows in order, so the tasks that read them make the blocks and no text is shuffled
        blocks = numbered.select("win", self._offset(), *[X.spaced(F.col(f)).alias(f) for f in FIELDS]).mapInArrow(indexed, PACKED)
        self._write_blocks(seg, blocks, numbered.count())
        sizes = numbered.select("docno", "win", "link_id", *[F.size(X.tokens(F.col(f))).cast("long").alias(f) for f in FIELDS])
        return seg, self._finish(seg, numbered, sizes)

    def _finish(self, seg: str, numbered: DataFrame, sizes: DataFrame) -> list[int]:
        sizes.sortWithinPartitions("docno").write.option("compression", "zstd").parquet(f"{self.root}/docs/seg={seg}")
        self._write_ranks(seg, numbered.select(F.lit(seg).alias("seg"), "win", "docno", "pagerank"))
        n, *total = self._read("docs", DOC, [f"seg={seg}"]).agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f), F.lit(0)) for f in FIELDS]).first()
        return [n, *total]

    def _offset(self) -> Column:
        """A document's number in its window."""
        return F.col("docno").bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int").alias("doc")

    def _write_blocks(self, seg: str, packed: DataFrame, documents: int) -> None:
        """Write the packed blocks (field, term, win, p) of so many documents."""
        # parts of a bucket by term and window, more of them for more documents; ranges would make all blocks twice, once for their sample
        parts = documents // (DEALT * 64 << self.bits) + 1
        dealt = packed.withColumn("bucket", _bucket(F.col("term"))).repartition(BUCKETS * parts, "bucket", F.pmod(F.xxhash64("term", "win"), F.lit(parts))).sortWithinPartitions("bucket", "term", "field", "win")
        opened = dealt.select("field", "term", "win", "bucket", F.slice("p", F.lit(2), F.get("p", F.lit(0))).alias("docs"), F.slice("p", F.get("p", F.lit(0)) + 2, F.get("p", F.lit(0))).alias("lengths"), _unpacked(F.col("p")).alias("positions"))
        blocks = opened.select("field", "term", "win", "docs", F.transform("positions", F.size).alias("tfs"), "lengths", "positions", F.size("docs").alias("n"), F.array_max(F.transform("positions", F.size)).alias("tf_max"), F.array_min("lengths").alias("len_min"), "bucket")
        blocks.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/blocks/seg={seg}")

    def _write_ranks(self, name: str, ranks: DataFrame) -> None:
        ranks.repartitionByRange("seg", "win").sortWithinPartitions("seg", "win").write.parquet(f"{self.root}/ranks/txn={name}")
        stored = self._read("ranks", RANK, [f"txn={name}"])
        bounds = stored.groupBy("seg", "win").agg(F.max("pagerank").alias("rank_max"), F.min("pagerank").alias("rank_min"))
        bounds.sort("seg", "win").write.parquet(f"{self.root}/bounds/txn={name}")

    def _merge(self) -> None:
        """Merge segments of one tier while there are ``fanout`` of them."""
        while True:
            tiers: dict[int, list[str]] = {}
            for seg, sizes in self.entry.segments.items():
                tiers.setdefault(int(math.log(max(sizes[0], 1), self.fanout)), []).append(seg)
            due = next((names for names in tiers.values() if len(names) >= self.fanout), None)
            if due is None or not self._commit(self._merged(due)):
                return

    def _merged(self, names: list[str]) -> Entry:
        """The present entry with some segments made into one, from their postings, without what is gone."""
        seg = uuid.uuid4().hex
        own = F.col("seg").isin(names)
        live = self.live_docs().where(own).join(self.ranks(), ["seg", "win", "docno"])
        numbered = self._numbered(live.select("link_id", *FIELDS, "pagerank", F.col("seg").alias("old_seg"), F.col("docno").alias("old_docno")))
        old = self._read("blocks", BLOCK, [f"seg={s}" for s in names])
        zipped = F.inline(F.arrays_zip("docs", "tfs", "lengths", "positions"))
        spread = old.select("field", "term", F.col("seg").alias("old_seg"), "win", zipped).select("field", "term", "old_seg", (F.shiftleft("win", self.bits) + F.col("docs")).alias("old_docno"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"), "positions")
        postings = spread.join(numbered.select("old_seg", "old_docno", "win", "docno"), ["old_seg", "old_docno"])
        listed = postings.groupBy("field", "term", "win").agg(F.sort_array(F.collect_list(F.struct(self._offset(), "length", "positions"))).alias("d"))
        self._write_blocks(seg, listed.select("field", "term", "win", _packed(F.col("d")).alias("p")), numbered.count())
        sizes = self._finish(seg, numbered, numbered.select("docno", "win", "link_id", *FIELDS))
        self._remove_work(numbered)
        e = self.entry
        made = Entry(upto=e.upto, segments={s: n for s, n in e.segments.items() if s not in names}, gone={s: n for s, n in e.gone.items() if s not in names}, ranks=[*e.ranks, seg])
        if sizes[0]:
            made.segments[seg] = sizes
        if made.gone:
            name = uuid.uuid4().hex
            self.dead().where(~own).sort("seg", "win").write.parquet(f"{self.root}/dead/txn={name}")
            made.dead = [name]
        return made

    def _vacuum(self) -> None:
        """Remove what the last ``KEPT`` versions do not read."""
        versions = self.log.versions()
        entries = {v: Entry(**self.log.read_entry(v)) for v in versions}
        used = lambda e: {("seg", s) for s in e.segments} | {("dead", d) for d in e.dead} | {("ranks", r) for r in e.ranks}
        needed = set().union(*(used(entries[v]) for v in versions[-KEPT:]))
        for v in versions[:-KEPT]:
            for kind, name in used(entries[v]) - needed:
                for folder in {"seg": (f"docs/seg={name}", f"blocks/seg={name}"), "dead": (f"dead/txn={name}",), "ranks": (f"ranks/txn={name}", f"bounds/txn={name}")}[kind]:
                    self.log.remove(folder)
            self.log.remove(f"log/{v:012d}.json")

    # ---- reading

    def _read(self, kind: str, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/{f}" for f in folders])

    def _segments(self) -> list[str]:
        return [f"seg={s}" for s in self.entry.segments]

    def _of_present(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("seg").isin(list(self.entry.segments))) if self.entry.segments else df.limit(0)

    def docs(self) -> DataFrame:
        return self._read("docs", DOC, self._segments())

    def dead(self) -> DataFrame:
        """(seg, win, docno, title, content) of documents that newer segments replace."""
        return self._of_present(self._read("dead", DEAD, [f"txn={d}" for d in self.entry.dead])).drop("txn")

    def ranks(self) -> DataFrame:
        """(seg, win, docno, pagerank), by window."""
        return self._of_present(self._read("ranks", RANK, [f"txn={r}" for r in self.entry.ranks])).drop("txn")

    def pageranks(self) -> DataFrame:
        """(link_id, pagerank) of every live document."""
        return self.live_docs().join(self.ranks(), ["seg", "win", "docno"]).select("link_id", "pagerank")

    def bounds(self) -> DataFrame:
        return self._of_present(self._read("bounds", BOUND, [f"txn={r}" for r in self.entry.ranks])).drop("txn")

    def _without_dead(self, df: DataFrame) -> DataFrame:
        return df.join(self.dead().select("seg", "win", "docno"), ["seg", "win", "docno"], "left_anti") if self.entry.gone else df

    def live_docs(self) -> DataFrame:
        return self._without_dead(self.docs())

    def documents(self, keys: list[str] | None = None) -> DataFrame:
        """The stored documents as of this version, or those of some ids."""
        return self.table.read(version=self.entry.upto, keys=keys)

    def blocks(self, terms: list[str]) -> DataFrame:
        """Blocks of the terms; buckets and row groups of others are not read."""
        found = self._read("blocks", BLOCK, self._segments())
        return found.where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in terms]) & F.col("term").isin(*terms))

    def counts(self, terms: list[str]) -> tuple[dict[tuple[str, str], int], int]:
        """Live documents of each (field, term), and of any of the terms."""
        found = self.blocks(terms).select("field", "term", "seg", "win", "docs")
        if self.entry.gone:
            offset = F.col("docno").bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")
            dead = self.dead().groupBy("seg", "win").agg(F.collect_set(offset).alias("dead"))
            found = found.join(dead, ["seg", "win"], "left").withColumn("docs", F.when(F.col("dead").isNull(), F.col("docs")).otherwise(F.array_except("docs", "dead"))).drop("dead")
        # one row for each window: its documents with any of the terms, and how many each term has
        per = found.groupBy("seg", "win").agg(F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("any"), F.collect_list(F.struct("field", "term", F.size("docs").alias("n"))).alias("each"))
        names = [(f, t) for f in FIELDS for t in terms]
        own = lambda f, t: F.sum(F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + F.when((x["field"] == f) & (x["term"] == t), x["n"]).otherwise(0)))
        row = per.agg(F.sum("any"), *[own(f, t) for f, t in names]).first()
        return {name: n or 0 for name, n in zip(names, row[1:], strict=True)}, row[0] or 0

    def _impact(self, df: dict[tuple[str, str], int], tf: Column, length: Column) -> Column:
        """BM25 of one posting; it grows with ``tf`` and falls with ``length``."""
        n, *totals = self.entry.sizes()
        weights, averages = {}, dict(zip(FIELDS, (max(t / n, 1e-9) if n else 1e-9 for t in totals), strict=True))
        for name, d in df.items():
            weights[name] = math.log1p((n - d + 0.5) / (d + 0.5))
        pick = lambda table, of: reduce(lambda c, item: c.when(of(item[0]), F.lit(item[1])), list(table.items())[1:], F.when(of(next(iter(table))), F.lit(next(iter(table.values())))))
        idf = pick(weights, lambda name: (F.col("field") == name[0]) & (F.col("term") == name[1]))
        average = pick(averages, lambda f: F.col("field") == f)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))

    def _scored(self, terms: list[str], df: dict, windows: Column | DataFrame | None = None) -> DataFrame:
        """(seg, win, docno, score) of live documents with any of the terms, in some windows or all."""
        found = self.blocks(terms)
        found = found.join(windows.select("seg", "win"), ["seg", "win"], "left_semi") if isinstance(windows, DataFrame) else found.where(windows) if windows is not None else found
        spread = found.select("field", "term", "seg", "win", F.inline(F.arrays_zip("docs", "tfs", "lengths")))
        hits = spread.select("field", "seg", "win", (F.shiftleft("win", self.bits) + F.col("docs")).alias("docno"), self._impact(df, F.col("tfs").cast("double"), F.col("lengths").cast("double")).alias("s"))
        # a window's blocks meet in one place, and every posting of a document is in one window
        best = hits.groupBy("seg", "win", "docno", "field").agg(F.sum("s").alias("score")).groupBy("seg", "win", "docno").agg(F.max("score").alias("score"))
        return self._without_dead(best)

    def scores(self, terms: list[str]) -> DataFrame:
        """(link_id, score): BM25 of each field, the better one, over all documents with any of the terms."""
        terms = list(dict.fromkeys(terms))
        if not terms or not self.entry.segments:
            return self.spark.createDataFrame([], "link_id string, score double")
        return self._scored(terms, self.counts(terms)[0]).join(self.docs(), ["seg", "win", "docno"]).select("link_id", "score")

    def _phrase(self, terms: list[str]) -> DataFrame:
        """(seg, win, docno): live documents in which the terms follow each other in one field."""
        names = list(dict.fromkeys(terms))
        spread = self.blocks(names).select("field", "term", "seg", "win", F.inline(F.arrays_zip("docs", "positions")))
        wide = spread.groupBy("seg", "win", "docs", "field").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(names)])
        starts = [shifted(f"p{names.index(t)}", i) for i, t in enumerate(terms)]
        found = wide.where(F.size(reduce(F.array_intersect, starts)) > 0)
        return self._without_dead(found.select("seg", "win", (F.shiftleft("win", self.bits) + F.col("docs")).alias("docno")).distinct())

    def phrase(self, terms: list[str]) -> DataFrame:
        if not terms or not self.entry.segments:
            return self.spark.createDataFrame([], "link_id string")
        return self._phrase(terms).join(self.docs(), ["seg", "win", "docno"]).select("link_id")

    def _bounded(self, terms: list[str], df: dict, blend: str | None) -> DataFrame:
        """(seg, win, ub_rank, ub_score, rank_min): what no hit of a window exceeds, for windows with any of the terms."""
        header = self.blocks(terms).select("field", "term", "seg", "win", self._impact(df, F.col("tf_max").cast("double"), F.col("len_min").cast("double")).alias("s"))
        # a window of very long texts has a term's block in parts
        score = header.groupBy("seg", "win", "field", "term").agg(F.max("s").alias("s")).groupBy("seg", "win", "field").agg(F.sum("s").alias("s")).groupBy("seg", "win").agg((F.max("s") * (1 + 1e-9)).alias("ub_score"))
        met = score.join(self.bounds(), ["seg", "win"])
        s, r = F.col("ub_score"), F.col("rank_max")
        rank = {None: r, "sum": s + r, "multiply": F.greatest(s * (s + r), F.lit(0.0))}[blend]
        return met.select("seg", "win", (rank if blend is None else rank + F.abs(rank) * 1e-9).alias("ub_rank"), "ub_score", "rank_min")

    def _hits(self, terms: list[str], df: dict, blend: str | None, windows, phrase: list[str] | None) -> DataFrame:
        """(link_id, score, rank_score) of the hits in some windows."""
        hits = self._scored(terms, df, windows)
        if phrase is not None:
            hits = hits.join(self._phrase(phrase), ["seg", "win", "docno"], "left_semi")
        near = lambda frame: frame.where(windows) if isinstance(windows, Column) else frame
        met = hits.join(near(self.ranks()), ["seg", "win", "docno"]).join(near(self.docs()).select("seg", "win", "docno", "link_id"), ["seg", "win", "docno"])
        s, r = F.col("score"), F.col("pagerank")
        return met.select("link_id", "score", {None: r, "sum": s + r, "multiply": s * (s + r)}[blend].alias("rank_score"))

    def top(self, terms: list[str], k: int, blend: str | None = None, phrase: list[str] | None = None, after: tuple[float, float, str] | None = None) -> Found:
        """The first ``k`` hits by (rank_score, score) descending and id, those after a hit ``(rank_score, score, link_id)`` if given.

        ``terms`` are distinct; with ``phrase``, terms in order, only documents with that phrase are hits.
        """
        if not terms or not self.entry.segments:
            return Found([], 0, 0, 0)
        df, total = self.counts(terms)
        if phrase is not None:
            total = self._phrase(phrase).count()
        order = [F.desc("rank_score"), F.desc("score"), F.asc("link_id")]
        beyond = lambda frame: frame
        wins = self._bounded(terms, df, blend)
        if after is not None:
            rank, score, last = after
            tied = (F.col("score") < score) | (F.col("score") == score) & (F.col("link_id") > last)
            later = (F.col("rank_score") < rank) | (F.col("rank_score") == rank) & tied
            beyond = lambda frame: frame.where(later)
            if blend is None:  # pages before lie in windows of larger PageRanks
                wins = wins.where(F.col("rank_min") <= rank)
        every = wins.count()
        probe = PROBE
        while True:
            first = wins.orderBy(F.desc("ub_rank"), F.desc("ub_score"), "seg", "win").limit(probe).collect()  # a few dozen windows
            best = beyond(self._hits(terms, df, blend, _among(first), phrase)).orderBy(*order).limit(k).collect() if first else []
            if len(best) >= k or len(first) == every or probe >= LISTED:
                break
            probe *= 8
        if len(first) == every:
            return Found(best, total, every, every)
        # every window that could hold a hit before the k-th
        rest = wins
        if len(best) >= k:
            worst = best[-1]
            ahead, equal = F.col("ub_rank") > worst.rank_score, F.col("ub_rank") == worst.rank_score
            reach = ahead | equal & (F.col("ub_score") >= worst.score) if blend is None else ahead | equal
            rest = wins.where(reach)
        listed = rest.select("seg", "win").limit(LISTED + 1).collect()
        seen = {(w.seg, w.win) for w in first}
        if len(listed) <= LISTED and {(w.seg, w.win) for w in listed} <= seen:
            return Found(best, total, every, len(first))
        windows = _among(listed) if len(listed) <= LISTED else rest
        best = beyond(self._hits(terms, df, blend, windows, phrase)).orderBy(*order).limit(k).collect()
        read = len(seen | {(w.seg, w.win) for w in listed}) if len(listed) <= LISTED else rest.count()
        return Found(best, total, every, read)


def _packed(d: Column) -> Column:
    """A block as one array for the shuffle: its size, documents, lengths, and positions, of which the first of a document is -1 - itself."""
    marked = F.flatten(F.transform(d["positions"], lambda ps: F.transform(ps, lambda p, i: F.when(i == 0, -1 - p).otherwise(p))))
    return F.concat(F.array(F.size(d)), d["doc"], d["length"], marked)


def _unpacked(p: Column) -> Column:
    """The positions of each document of a packed block."""

    def cut(flat: Column) -> Column:
        starts = F.filter(F.transform(flat, lambda _, i: i), lambda i: F.get(flat, i) < 0)
        own = lambda at, end: F.transform(F.slice(flat, at + 1, end - at), lambda x: F.when(x < 0, -1 - x).otherwise(x))
        return let(starts, lambda found: F.transform(found, lambda at, k: own(at, F.coalesce(F.get(found, k + 1), F.size(flat)))))

    return let(F.slice(p, 2 + 2 * F.get(p, F.lit(0)), F.size(p)), cut)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _among(windows: list) -> Column:
    """Whether a row lies in one of the windows, as comparisons that reach the Parquet reader."""
    by: dict[str, list[int]] = {}
    for w in windows:
        by.setdefault(w.seg, []).append(w.win)
    return reduce(lambda a, b: a | b, [(F.col("seg") == s) & F.col("win").isin(n) for s, n in by.items()], F.lit(False))
