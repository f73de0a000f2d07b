"""Blocks of postings, made in Arrow batches inside the tasks that read the documents.

A packed block is one array of numbers: how many documents it has, the documents,
their lengths, and their positions one after the other, of which the first of a
document is -1 - itself.

Parcels are all blocks that one task sends to another, as compressed Arrow streams of
blocks, postings and positions: in a shuffle, numbers this short take a fraction of the
room that a row for each block would take.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FIELDS = ("title", "content")
PACKED = "field string, term string, win long, p array<int>"
OPENED = "field string, term string, win long, docs array<int>, tfs array<int>, lengths array<int>, positions array<int>"
PARCEL = "task int, blocks binary, postings binary, positions binary"
HELD = 16 << 20  # bytes of text whose blocks are made at once; a larger window makes its blocks in parts
STEPPED = ("docs", "positions")
SHORT = ("tfs", "lengths", "n")


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of documents (win, doc, title, content: terms with one space between them) that come by window."""
    for rows in _windows(batches):
        for name, terms, win, starts, docs, lengths, first, position in _postings(rows):
            position[first] = -1 - position[first]
            fields = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(starts), np.int32)), pa.array([name])).dictionary_decode()
            yield pa.RecordBatch.from_arrays([fields, terms, pa.array(win), _blocks(starts, np.append(first, len(position)), docs, lengths, position)], names=["field", "term", "win", "p"])


def parcels(batches: Iterator[pa.RecordBatch], buckets: int, parts: int, tasks: int) -> Iterator[pa.RecordBatch]:
    """The blocks of such documents for the tasks that hold the terms' buckets; a bucket is in ``parts`` by term and window."""
    for rows in _windows(batches):
        made = list(_postings(rows))
        if not made:
            continue
        names, terms, wins, starts, docs, lengths, firsts, positions = zip(*made, strict=True)
        sizes = [len(s) for s in starts]
        term, win, position = pa.concat_arrays(terms), np.concatenate(wins), np.concatenate(positions)
        n = np.concatenate([np.diff(np.append(s, len(d))) for s, d in zip(starts, docs, strict=True)])
        tf = np.concatenate([np.diff(np.append(f, len(p))) for f, p in zip(firsts, positions, strict=True)])
        hashed = np.array([zlib.crc32(t.encode()) for t in term.to_pylist()], np.int64)
        task = ((hashed % buckets * parts + (hashed // buckets + win) % parts) % tasks).astype(np.uint16 if tasks <= 1 << 16 else np.int32)
        of_posting = np.repeat(task, n)
        to = np.unique(task)
        by_block, by_posting, by_position = ((np.argsort(t, kind="stable"), np.searchsorted(np.sort(t), to)) for t in (task, of_posting, np.repeat(of_posting, tf)))
        blocks = _sliced({"field": np.repeat(names, sizes), "term": term, "win": win, "n": n}, *by_block)
        postings = _sliced({"docs": np.concatenate(docs), "tfs": tf, "lengths": np.concatenate(lengths)}, *by_posting)
        placed = _sliced({"positions": position}, *by_position)
        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *[pa.array(list(s), pa.binary()) for s in (blocks, postings, placed)]], names=["task", "blocks", "postings", "positions"])


def _sliced(columns: dict, order: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Columns in an order, cut into streams; numbers that ascend for long are the steps between them."""
    ordered = {name: c.take(pa.array(order)) if isinstance(c, pa.Array) else c[order] for name, c in columns.items()}
    for at, end in zip(starts, np.append(starts[1:], len(order)), strict=True):
        cut = {name: c[at:end] for name, c in ordered.items()}
        made = pa.table({name: _steps(c) if name in STEPPED else _short(c) if name in SHORT else c for name, c in cut.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(made)
        yield sink.getvalue().to_pybytes()


def _short(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in two bytes where they fit, else in four."""
    return values.astype(np.uint16 if values.max(initial=0) < 1 << 16 else np.uint32)


def _steps(values: np.ndarray) -> np.ndarray:
    """Each number less the one before, modulo what the type holds, so that a running sum in this type gives them back."""
    short = _short(values)
    return np.diff(short, prepend=short.dtype.type(0))


def unparcelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of parcels (blocks, postings, positions), the first position of each document being -1 - itself."""
    for batch in batches:
        for parcel in zip(*batch.columns, strict=True):
            blocks, postings, placed = (pa.ipc.open_stream(stream.as_buffer()).read_all() for stream in parcel)
            column = lambda t, name: _whole(t[name]).to_numpy()
            summed = lambda t, name: np.cumsum(column(t, name), dtype=column(t, name).dtype).astype(np.int32)
            tfs, position = column(postings, "tfs").astype(np.int32), summed(placed, "positions")
            ends = np.append(0, np.cumsum(tfs))
            position[ends[:-1]] = -1 - position[ends[:-1]]
            at = np.append(0, np.cumsum(column(blocks, "n"), dtype=np.int64))
            lists = [(at, summed(postings, "docs")), (at, tfs), (at, column(postings, "lengths").astype(np.int32)), (ends[at], position)]
            found = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in lists]
            yield pa.RecordBatch.from_arrays([*[_whole(blocks[c]) for c in ("field", "term", "win")], *found], names=["field", "term", "win", "docs", "tfs", "lengths", "positions"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in whole windows of ``HELD`` bytes of text, or a larger window in parts."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        while held.num_rows > 1:
            sizes = sum(pc.binary_length(_whole(held[f])).to_numpy().astype(np.int64) for f in FIELDS)
            fit = max(int(np.searchsorted(np.cumsum(sizes), HELD, "right")), 1)
            if fit == held.num_rows:
                break
            wins = _whole(held["win"]).to_numpy()
            before = int(np.flatnonzero(wins[: fit + 1] != wins[fit])[-1]) + 1 if wins[0] != wins[fit] else fit
            yield held.slice(0, before)
            held = held.slice(before).combine_chunks()
    if held is not None:
        yield held


def _postings(rows: pa.Table) -> Iterator[tuple]:
    """For each field with terms: name; term, window and first posting of each block; document, length and first position of each posting; positions."""
    wins, docs = _whole(rows["win"]).to_numpy(), _whole(rows["doc"]).to_numpy()
    for name in FIELDS:
        text = _whole(rows[name])
        lists = pc.split_pattern(text, " ")
        sizes = np.diff(lists.offsets.to_numpy())
        terms = lists.flatten()
        none = pc.equal(text, "").to_numpy(zero_copy_only=False)
        if none.any():  # an empty text splits into one empty term
            sizes[none] = 0
            terms = terms.filter(pc.not_equal(terms, ""))
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        codes = coded.indices.to_numpy()
        # documents and positions ascend already, so a stable sort by term is all; short numbers are sorted by digits
        order = np.argsort(codes.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else codes, kind="stable")
        codes, row, position = codes[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], _within(sizes).astype(np.int32)[order]
        first = _changes(codes, row)
        code, row = codes[first], row[first]
        win = wins[row]
        starts = _changes(code, win)
        yield name, coded.dictionary.take(pa.array(code[starts])), win[starts], starts, docs[row], sizes[row], first, position


def _blocks(starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, lengths: np.ndarray, marked: np.ndarray) -> pa.ListArray:
    """Packed blocks that begin at the postings ``starts``; posting i has ``marked[ends[i]:ends[i + 1]]``."""
    n = np.diff(np.append(starts, len(docs)))
    m = np.diff(np.append(ends[starts], ends[-1]))
    offsets = np.concatenate([[0], np.cumsum(1 + 2 * n + m)])
    out = np.empty(offsets[-1], np.int32)
    out[offsets[:-1]] = n
    at = np.repeat(offsets[:-1] + 1, n) + _within(n)
    out[at] = docs
    out[at + np.repeat(n, n)] = lengths
    out[np.repeat(offsets[:-1] + 1 + 2 * n, m) + _within(m)] = marked
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before in any key."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew for each of the sizes."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
