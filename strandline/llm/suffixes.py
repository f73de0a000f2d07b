"""Duplicate byte strings by bucket-pointer refinement (operator 10).

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is marked.  A bucket is a set of text positions whose next bytes agree.
Buckets start from short q-grams and are refined by sorting on the bucket
identifiers of later offsets; only those that still hold two positions go on.

1. *q-gram buckets.*  Each string of ``length`` bytes is filed under the
   smallest-ranked q-gram that it contains; equal strings choose the same one.
   So only those q-grams (one in about 150 positions) are grouped across the
   cluster, not every position.  Buckets of one position are settled: no string
   filed there repeats.
2. *Dealing.*  Strings of a live bucket whose q-gram lies within the same
   ``BAND`` bytes of their start share a core of ``length - BAND`` bytes.  They
   are dealt by the bucket and that core, with the text slices around them.
3. *Refinement* (:func:`refined`), in whole buckets.  Positions are bucketed by
   their q-gram; a bucket of h bytes is sorted on the pairs of its positions'
   own identifier and that of the position h bytes on, which gives buckets of 2h
   bytes, whose identifiers the next pass sorts on, up to ``length``.  A
   position alone in its bucket, or whose later position is, drops out.
4. *Bytes decide.*  Members of a last bucket are compared byte by byte with its
   first, in runs; should hashes of q-grams have met by chance, the bytes
   themselves are the buckets.

q-gram buckets of more than ``HEAVY`` texts, such as a passage in a third of all
texts, are refined on the identifiers of all offsets at once: their strings are
dealt one by one by a 64-bit hash of the whole, so no task gathers such a
bucket.

Only the text slices around live positions travel.  Equal slices of one batch
are sent once, with a mark, which bounds what a much-copied passage puts into
one bucket; equal texts are one text from the start, by their SHA-256.

Defined results: null and empty texts have no bytes; a text shorter than
``length`` keeps all; repeated rows remove each other wholly where long enough;
matches never cross texts.  Other columns are not read, and an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import save, shuffle_partitions

LENGTH = 400
GRAM = 100
BAND = 152
HEAVY = 20_000
_RANK_BITS = np.uint64(0xFFFFFF)
_FLUSH_BYTES = 2 << 20


def chosen_grams(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, grams): the starts of all strings inside one text, the place of the q-gram that each is filed under, and all q-grams' identifiers."""
    grams = tk.Hasher(data).grams(gram)
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), grams
    place = np.arange(len(grams), dtype=np.uint64)
    width = length - gram + 1
    best = np.empty(0, np.uint64)
    ranked = tk.mix(grams)
    if len(grams) > int(_RANK_BITS):
        # a text beyond 16 MB: positions are ranked in two halves of the word, block by block
        step = 1 << 23
        parts = []
        for lo in range(0, len(grams) - width + 1, step):
            hi = min(lo + step + width - 1, len(grams))
            low = tk.sliding_min((ranked[lo:hi] & ~_RANK_BITS) | (_RANK_BITS - np.arange(hi - lo, dtype=np.uint64)), width)
            parts.append((_RANK_BITS - (low & _RANK_BITS)).astype(np.int64) + lo)
        at = np.concatenate(parts)
    else:
        best = tk.sliding_min((ranked & ~_RANK_BITS) | (_RANK_BITS - place), width)
        at = (_RANK_BITS - (best & _RANK_BITS)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(at)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(at)) + length <= offsets[text + 1])
    return inside, at[inside], grams


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("bytes", F.col("text").cast("binary")).withColumn("k", F.unhex(F.sha2("bytes", 256)))


def _bucket_entries(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(v, k, twice): q-gram buckets of each text, and whether the text alone holds two positions of it."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for lo, _, data, offsets in tk.chunks(batch.column(1)):
                _, at, grams = chosen_grams(data, offsets, length, gram)
                at = np.unique(at)
                text = np.searchsorted(offsets, at, side="right") - 1
                value = grams[at]
                order = np.lexsort((value, text))
                value, text = value[order], text[order]
                first = np.ones(len(value), dtype=bool)
                first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                start = np.flatnonzero(first)
                twice = np.diff(np.append(start, len(value))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(value[start])), keys.take(pa.array(lo + text[start])), pa.array(twice)], ["v", "k", "twice"])

    return texts.select("k", "bytes").mapInArrow(run, "v long, k binary, twice boolean")


def _runs(starts: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of maximal runs of consecutive starts with equal keys."""
    if len(starts) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(starts)) - 1


def _members(value: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which (value, text) are in the texts' lists."""
    count = np.asarray(pc.list_value_length(lists))
    held = np.asarray(lists.flatten()).view(np.uint64) ^ tk.mix(np.repeat(np.arange(len(lists)), count).astype(np.uint64))
    return np.isin(value ^ tk.mix(text.astype(np.uint64)), held)


def _single_strings(hasher: tk.Hasher, starts: np.ndarray, text: np.ndarray, offsets: np.ndarray, dids: np.ndarray, length: int) -> pa.RecordBatch:
    """Strings of heavy buckets, by their own identifiers: one of each, marked if the batch has more; the others are settled."""
    key = hasher.spans(starts, starts + length)
    order = np.lexsort((starts, key))
    same = key[order][1:] == key[order][:-1]
    first, alone = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    first[order[1:]] = ~same
    alone[order[1:]] &= ~same
    alone[order[:-1]] &= ~same
    did = dids[text]
    n = np.where(first & ~alone, -1, 1)
    ck = np.where(first, tk.signed(key), tk.signed(tk.mix(did.view(np.uint64) + starts.astype(np.uint64))))
    slices = pa.array([b"" if f else None for f in first.tolist()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ck), pa.array(did), pa.array(starts - offsets[text]), pa.array(n), slices], ["ck", "did", "at", "n", "slice"])


def _slices(live_texts: DataFrame, length: int, gram: int, band: int) -> DataFrame:
    """(ck, did, at, n, slice): strings at did's bytes at .. at+n-1, by their core; without a slice, repeats that are settled already."""

    def run(batches):
        for batch in batches:
            dids, live, heavy = np.asarray(batch.column(0)), batch.column(2), batch.column(3)
            for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                starts, at, grams = chosen_grams(data, offsets, length, gram)
                text = np.searchsorted(offsets, starts, side="right") - 1
                value = grams[at]
                hasher = tk.Hasher(data)
                crowded = _members(value, text, heavy[lo:hi])
                if crowded.any():
                    yield _single_strings(hasher, starts[crowded], text[crowded], offsets, dids[lo:hi], length)
                keep = _members(value, text, live[lo:hi]) & ~crowded
                starts, at, text = starts[keep], at[keep], text[keep]
                part = (at - starts) // band
                first, last = _runs(starts, at, part)
                begin, end, head = starts[first], starts[last], at[first]
                zone = part[first]
                # all strings of a zone hold the bytes from head - zone*band to head - (zone+1)*band + 1 + length
                low = head - zone * band
                core = hasher.spans(low, np.minimum(low - band + 1 + length, len(data)))
                whole = hasher.spans(begin, end + length)
                order = np.lexsort((begin, whole))
                again = np.zeros(len(order), dtype=bool)
                again[1:] = whole[order][1:] == whole[order][:-1]
                sole = np.ones(len(order), dtype=bool)
                sole[:-1] &= ~again[1:]
                sole[1:] &= ~again[1:]
                body = data.tobytes()
                spans = list(zip(begin.tolist(), (end + length).tolist(), strict=True))
                for i in np.flatnonzero(again).tolist():  # by their bytes as well
                    (a, z), (p, q) = spans[order[i]], spans[order[i - 1]]
                    if body[a:z] != body[p:q]:
                        again[i] = False
                        sole[i] = sole[i - 1] = True
                settled, single = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool)
                settled[order], single[order] = again, sole
                # the first of equal slices goes on, marked by a negative length if there are more
                slices = [None if s else body[b:e] for s, (b, e) in zip(settled.tolist(), spans, strict=True)]
                width = (end - begin + 1) * np.where(single | settled, 1, -1)
                key = np.where(settled, tk.signed(tk.mix(dids[lo + text[first]].view(np.uint64) + begin.astype(np.uint64))), tk.signed(core + zone.astype(np.uint64)))
                rows = [pa.array(key), pa.array(dids[lo + text[first]]), pa.array(begin - offsets[text[first]]), pa.array(width), pa.array(slices, pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["ck", "did", "at", "n", "slice"])

    return live_texts.select("did", "bytes", "live", "heavy").mapInArrow(run, "ck long, did long, at long, n long, slice binary")


def _pointers(keys: np.ndarray) -> np.ndarray:
    """Numbers of the buckets of equal keys; -1 for a key that stands alone."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    number = np.zeros(len(keys), dtype=np.int64)
    np.cumsum(~same, out=number[1:])
    alone = np.ones(len(keys), dtype=bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    number[alone] = -1
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = number
    return out


def refined(grams: np.ndarray, starts: np.ndarray, gram: int, length: int) -> np.ndarray:
    """Buckets of ``length`` bytes of the starts, from the names of the q-grams at all positions; -1 for a start alone in its bucket."""
    shifts = []
    size = gram
    while size < length:
        shifts.append(min(size, length - size))
        size += shifts[-1]
    wanted = [starts]
    for shift in reversed(shifts):  # a pass needs its positions and those later by its shift
        wanted.append(np.union1d(wanted[-1], wanted[-1] + shift))
    at = wanted.pop()
    pointer = np.full(int(at[-1]) + 1 if len(at) else 0, -1, dtype=np.int64)
    pointer[at] = _pointers(grams[at])
    for shift in shifts:
        at = wanted.pop()
        own, later = pointer[at], pointer[at + shift]
        live = (own >= 0) & (later >= 0)
        new = np.full(len(at), -1, dtype=np.int64)
        new[live] = _pointers((own[live].astype(np.uint64) << np.uint64(32)) | later[live].astype(np.uint64))
        pointer[at] = new
    return pointer[starts]


def _by_bytes(body: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """:func:`refined` by the bytes themselves."""
    names: dict[bytes, int] = {}
    bucket = np.array([names.setdefault(body[s : s + length], len(names)) for s in starts.tolist()], dtype=np.int64)
    bucket[np.bincount(bucket, minlength=1)[bucket] < 2] = -1
    return bucket


def _confirmed(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Whether each start shares its bucket with another; the members' bytes are compared with the first member's."""
    hit = bucket >= 0
    at, b, o = starts[hit], bucket[hit], owner[hit]
    if len(at) == 0:
        return hit
    _, first, back = np.unique(b, return_index=True, return_inverse=True)
    head = at[first][back]
    lo, hi = _runs(at, o, head - at)
    body = data.tobytes()
    for a, z, h in zip(at[lo].tolist(), (at[hi] + length).tolist(), head[lo].tolist(), strict=True):
        if a != h and body[a:z] != body[h : h + z - a]:
            return _by_bytes(body, starts, length) >= 0
    return hit


def _repeats(slices: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(did, at, n): runs of starts of strings met twice."""
    names = ["did", "at", "n"]

    def settle(group: pa.Table):
        slice_ = group.column("slice").combine_chunks()
        empty = np.asarray(slice_.is_null())
        did, at, n = (np.asarray(group.column(c)) for c in names)
        if empty.any():
            yield pa.RecordBatch.from_arrays([pa.array(did[empty]), pa.array(at[empty]), pa.array(n[empty])], names)
        size = np.asarray(pc.fill_null(pc.binary_length(slice_), -1))
        keyed = np.flatnonzero(size == 0)
        if len(keyed):  # strings dealt by their own identifiers
            ck = np.asarray(group.column("ck"))[keyed]
            _, back, times = np.unique(ck, return_inverse=True, return_counts=True)
            met = keyed[(times[back] > 1) | (n[keyed] < 0)]
            yield pa.RecordBatch.from_arrays([pa.array(did[met]), pa.array(at[met]), pa.array(np.abs(n[met]))], names)
        some = np.flatnonzero(size > 0)
        if len(some) == 0:
            return
        did, at, n = did[some], at[some], n[some]
        body = tk.binary(slice_.take(pa.array(some)))
        offsets = np.frombuffer(body.buffers()[1], dtype=np.int64)[: len(body) + 1]
        data = np.frombuffer(body.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        many = n < 0
        n = np.abs(n)
        total = int(n.sum())
        owner = np.repeat(np.arange(len(n)), n)
        start = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        place = offsets[:-1][owner] + start
        hit = _confirmed(data, place, refined(tk.Hasher(data).grams(gram), place, gram, length), owner, length)
        hit |= many[owner]
        o, s = owner[hit], start[hit]
        first, last = _runs(s, o)
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(did[o[first]]), pa.array(at[o[first]] + s[first]), pa.array(s[last] - s[first] + 1)], names)

    def run(batches):
        # rows come sorted on ck; whole buckets are settled some megabytes at a time
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.nbytes
            if held >= _FLUSH_BYTES:
                table = pa.Table.from_batches(waiting)
                ck = np.asarray(table.column("ck"))
                cut = int(np.searchsorted(ck, ck[-1], side="left"))
                if cut:
                    yield from settle(table.slice(0, cut))
                    waiting = table.slice(cut).to_batches()
                    held = sum(b.nbytes for b in waiting)
        if waiting:
            yield from settle(pa.Table.from_batches(waiting))

    dealt = slices.repartition(parts, "ck").sortWithinPartitions("ck")
    return dealt.mapInArrow(run, "did long, at long, n long")


def covered(at: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings starting at at .. at+n-1."""
    order = np.argsort(at, kind="stable")
    begin, end = at[order], (at + n - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(begin[first].tolist(), reach[np.append(first[1:], len(begin)) - 1].tolist(), strict=True))


def whole_words(body: bytes, ranges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The ranges cut down to whole words, of those that hold ``least`` of them or more."""
    out = []
    for begin, end in ranges:
        if begin and not body[begin - 1 : begin].isspace():
            while begin < end and not body[begin : begin + 1].isspace():
                begin += 1
        if end < len(body) and not body[end : end + 1].isspace():
            while end > begin and not body[end - 1 : end].isspace():
                end -= 1
        while begin < end and body[begin : begin + 1].isspace():  # the blank before stays between what is left
            begin += 1
        if len(body[begin:end].split()) >= least:
            out.append((begin, end))
    return out


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, band: int = BAND, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): every document's doc_id, n_bytes, k and copies; and for each text k that loses bytes, spans and the kept text, of whole characters.

    With ``least_words`` only the whole words of runs that hold so many are removed.
    """
    if not 0 < gram <= length - band:
        raise ValueError("gram and band must leave a core: 0 < gram <= length - band")
    spark = documents.sparkSession
    parts = 2 * shuffle_partitions(spark)
    rows = save(_texts(documents).select("doc_id", "k", F.octet_length("bytes").cast("long").alias("n_bytes")), "texts")
    long = _texts(documents).where(F.octet_length("bytes") >= length)
    entries = save(_bucket_entries(long, length, gram), "buckets")
    living = entries.groupBy("v").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("texts")).where("lo <> hi or twice").select("v", (F.col("texts") > HEAVY).alias("crowded"))
    # written, as it is read twice with different columns
    live = entries.join(living, "v").groupBy("k").agg(F.collect_set("v").alias("vs"), F.collect_set(F.when(F.col("crowded"), F.col("v"))).alias("crowded"))
    live = save(live, "live")
    first = long.join(live.select("k").hint("shuffle_hash"), "k", "left_semi").groupBy("k").agg(F.first("bytes").alias("bytes"))
    packed = live.select("k", F.xxhash64("k").alias("did"), F.col("vs").alias("live"), F.col("crowded").alias("heavy"))
    texts = save(first.join(packed, "k").select("k", "did", "bytes", "live", "heavy"), "live")
    hits = _repeats(_slices(texts, length, gram, band), length, gram, parts)
    spans = hits.groupBy("did").agg(F.collect_list(F.struct("at", "n")).alias("hits"))

    def cut(batches):
        for batch in batches:
            keys, bodies, hits = batch.column(0), batch.column(1), batch.column(2)
            out = []
            for i in range(batch.num_rows):
                body = bodies[i].as_py()
                found = hits[i].values
                ranges = covered(np.asarray(found.field("at")), np.asarray(found.field("n")), length)
                if least_words:
                    ranges = whole_words(body, ranges, least_words)
                ends = [0, *(e for _, e in ranges)]
                kept = b"".join(body[a:b] for a, b in zip(ends, [*(s for s, _ in ranges), len(body)], strict=True))
                out.append((keys[i].as_py(), len(body) - len(kept), len(ranges), kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "n_removed", "n_spans", "kept", "kept_sha256"])

    done = texts.select("did", "k", "bytes").join(spans, "did").select("k", "bytes", "hits").mapInArrow(cut, "k binary, n_removed long, n_spans long, kept string, kept_sha256 string")
    return rows, done


def report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text (of whole characters) of every document."""
    rows, done = removals(documents, length)
    texts = _texts(documents).select("doc_id", "k", "text", F.octet_length("bytes").cast("long").alias("n_bytes"))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("k").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = texts.join(copies, "k", "left").join(done, "k", "left")
    gone = F.col("copies").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("k")))).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.coalesce("kept", "text")).alias("text"),
    )


def cut_texts(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, band: int = BAND, least_words: int = 0) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text``; every row stays, ``n_chars`` (if there) follows the text.

    A character of which some bytes were removed goes with them.  With
    ``least_words`` whole words go, of repeated runs that hold so many.
    """
    rows, done = removals(documents, length, gram, band, least_words)
    copies = rows.where(F.col("n_bytes") >= length).groupBy("k").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("k").alias("_sl_k"), F.lit(True).alias("_sl_copied"))
    changed = done.select(F.col("k").alias("_sl_c"), F.col("kept").alias("_sl_text"))
    keyed = documents.withColumn("_sl_id", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)))
    joined = keyed.join(copies, F.col("_sl_id") == F.col("_sl_k"), "left").join(changed, F.col("_sl_id") == F.col("_sl_c"), "left")
    copied = F.col("_sl_copied")
    if least_words:
        copied = copied & (F.size(F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")) >= least_words)
    text = F.when(copied, F.lit("")).when(F.col("_sl_c").isNotNull(), F.col("_sl_text")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(copied | F.col("_sl_c").isNotNull(), F.char_length(text)).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns])

