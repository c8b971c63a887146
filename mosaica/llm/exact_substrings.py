"""Exact substring dedup: every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.

Anchors: each window of ``length`` bytes has one minimizer, the least hash among its substrings of half the length (leftmost on
ties), so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are a context: about 51 windows
of 200 bytes. Only (anchor hash, context hash, place) is sorted over the whole corpus. A context that occurs twice is repeated
throughout; an anchor that occurs once is in no repeated window; what is left are the edges of repeated passages.

Edges: the distinct contexts of an anchor, a very repetitive collection, get a run-length index: the Burrows-Wheeler transform of
their texts, cut to runs, with the longest common prefixes sampled at run ends only (elsewhere they follow from the sample
before: one less for each step). Match lengths are streamed from the samples in text order, and windows with a long match are
marked. Anchors with more than ``most_contexts`` contexts are counted by hashes of their single windows instead, which needs no
group in one task.

Scale: the order is dealt out by range, so copies of a passage in a third of all documents are spread over tasks; rows at the
tasks' borders are compared in a small second pass. Indexes are built over at most about 2 ** 20 bytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_BLOCK = 8 << 20
_INDEXED = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    m, size = a, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(a) - w + 1], m[w - size : w - size + len(a) - w + 1])


def contexts(sums: np.ndarray, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the row at bytes lo to hi: anchor hash, start of its first window (from lo), number of windows, for each context."""
    k = length // 2
    out = []
    for block in range(lo, hi - length + 1, _BLOCK):
        windows = min(_BLOCK, hi - length + 1 - block)
        starts = np.arange(block, block + windows + length - k)
        h = common.range_hashes(sums, starts, starts + k)
        least = _least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        out.append((h[(least[first] & _LOW).astype(np.int64)], first + (block - lo), np.diff(np.concatenate([first, [windows]]))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(ids: pa.Array, sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for each row from its id and whole text; rows alike in both share it."""
    ids = np.array([0x5A17 if x is None else x for x in ids.to_pylist()], np.int64).view(np.uint64)
    return common.mix(common.range_hashes(sums, offsets[:-1], offsets[1:]) ^ common.mix(ids + np.uint64(1)))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = common.text_bytes(batch.column(1))
    for a, b in common.slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sums = common.prefix_hashes(part)
        yield part, own, sums, _keys(batch.column(0)[a:b], sums, own)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, sums, keys in _rows(batch):
                cols = [[], [], [], []]
                for i in range(len(keys)):
                    if own[i + 1] - own[i] >= length:
                        anchor, start, n = contexts(sums, own[i], own[i + 1], length)
                        cols[0].append(anchor)
                        cols[1].append(common.range_hashes(sums, start + own[i], start + own[i] + n + length - 1))
                        cols[2].append(np.full(len(n), keys[i], np.uint64))
                        cols[3].append((start << 8 | n).view(np.uint64))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in cols], ["anchor", "context", "doc", "place"])

    return run


_PLACES = ["anchor", "context", "doc", "place"]


def _judged(rows: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    """Kinds of the rows at ``which``, by their neighbours: 1 whole repeat; 2 edge; 3 a whole repeat's first row, for edges to be held against."""
    near = rows[0][1:] == rows[0][:-1]
    same = near & (rows[1][1:] == rows[1][:-1])
    no = np.zeros(1, bool)
    before, after = np.concatenate([no, same]), np.concatenate([same, no])
    kind = np.where(before | after, 1, np.where(np.concatenate([no, near]) | np.concatenate([near, no]), 2, 0))
    some, first = which[kind[which] > 0], which[(after & ~before)[which]]
    at = np.concatenate([some, first])
    kinds = np.concatenate([kind[some], np.full(len(first), 3)])
    return pa.RecordBatch.from_arrays([pa.array(rows[c][at]) for c in range(4)] + [pa.array(kinds, pa.int32())], [*_PLACES, "kind"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows: kinds of all but a task's first and last row; those (0) and their neighbours (-1) as they are."""

    def border(rows: np.ndarray, kinds: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in range(4)] + [pa.array(kinds, pa.int32())], [*_PLACES, "kind"])

    held, seen = np.zeros((4, 0), np.int64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(4)])], axis=1)
        before, seen = seen, seen + batch.num_rows
        if before < 3 <= seen:
            yield border(rows[:, :2], [0, -1])
        # Judged so far: places 1 to before - 2 of the task; held begins at place max(0, before - 2).
        shift = max(0, before - 2)
        which = np.arange(max(1, before - 1), seen - 1) - shift
        if len(which):
            yield _judged(rows, which)
        held = rows[:, -2:]
    if seen == 1:
        yield border(held, [0])
    elif seen == 2:  # both are first or last: each goes out once
        yield border(held, [0, 0])
    elif seen:
        yield border(held, [-1, 0])


def _compare_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of the tasks' first and last rows, among all of them and their neighbours; one task, a few rows for each task before."""
    rows = [np.stack([b.column(i).to_numpy() for i in range(5)]) for b in batches if b.num_rows]
    if rows:
        rows = np.concatenate(rows, axis=1)
        yield _judged(rows[:4], np.flatnonzero(rows[4] == 0))


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; at most 2 ** 21 symbols, all suffixes different."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    index, k, n = np.arange(len(rank), dtype=np.int64), 1, len(rank)
    while True:
        later = np.zeros(n, np.int64)
        later[:-k] = rank[k:]
        key = rank << 42 | later << 21 | index
        key.sort()
        order = key & ((1 << 21) - 1)
        high = key >> 21
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (high[1:] != high[:-1]).astype(np.int64)]))
        rank, k = fresh, 2 * k
        if rank[order[-1]] == n or k >= n:
            return order


def run_length_index(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, places in the order where a run of the transform begins, and the common prefix sampled at each of them."""
    order = sorted_suffixes(symbols)
    last = np.where(order > 0, symbols[order - 1], -1)
    heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(common.mix(symbols.astype(np.uint64)) * common.powers(common._BASE, len(symbols)), out=sums[1:])
    x, y = order[heads], order[np.maximum(heads - 1, 0)]
    room = len(symbols) - np.maximum(x, y)
    inverse = common.powers(common._BASE_INVERSE, len(symbols) + 1)
    low, high = np.zeros(len(heads), np.int64), np.minimum(room, 512)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[x + mid] - sums[x]) * inverse[x] == (sums[y + mid] - sums[y]) * inverse[y]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    low[0] = 0
    return order, heads, low


def repeated(texts: list[bytes], groups: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For all windows of all texts (a text's own, in order): whether another window of its group is equal."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    symbols = np.zeros(ends[-1], np.int64)
    text = np.ones(ends[-1], bool)
    text[ends - 1] = False
    symbols[text] = np.frombuffer(b"".join(texts), np.uint8) + (np.repeat(groups, sizes) << 8)
    symbols[~text] = (int(groups.max()) + 1 << 8) + np.arange(len(texts))  # a separator of its own for each text
    order, heads, sampled = run_length_index(symbols)
    # Streamed in text order: at a sample its value, else one less than before.
    sample_at = np.zeros(len(symbols), np.int64)
    value = np.zeros(len(symbols), np.int64)
    sample_at[order[heads]] = order[heads]
    value[order[heads]] = sampled
    sample_at = np.maximum.accumulate(sample_at)
    match = value[sample_at] - (np.arange(len(symbols)) - sample_at)
    own = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(own, starts, 1)
    np.add.at(own, starts + windows, -1)
    own = np.cumsum(own[:-1]) > 0
    alike = np.empty(len(symbols), np.int64)
    alike[order] = np.cumsum(match[order] < length)
    count = np.bincount(alike[own], minlength=int(alike.max()) + 1)
    return count[alike[own]] >= 2


def _marks(length: int):
    """Over contexts sorted by anchor: byte ranges that edges' repeated windows cover."""

    def solve(held: list) -> pa.RecordBatch:
        groups = np.cumsum(np.concatenate([[0], [a[0] != b[0] for a, b in zip(held[1:], held, strict=False)]])).astype(np.int64)
        windows = np.array([r[2] & 255 for r in held], np.int64)
        hit = repeated([r[4] for r in held], groups, windows, length)
        row = np.repeat(np.arange(len(held)), windows)
        start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.array([r[2] >> 8 for r in held], np.int64), windows)
        hit &= np.repeat(np.array([r[3] == 2 for r in held], bool), windows)
        row, start = row[hit], start[hit]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
        ends = start[np.concatenate([new[1:] - 1, [len(row) - 1]])] + length if len(row) else start
        return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i in row[new]], pa.int64()), pa.array(start[new], pa.int64()), pa.array(ends, pa.int64())], ["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= _INDEXED and r[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4]) + 1
        if held:
            yield solve(held)

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, doc (the row's key), the text's bytes compressed: rows travel at a fraction of their size."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        docs, texts = [], []
        for part, own, _, keys in _rows(batch):
            docs.append(keys)
            raw = part.tobytes()
            texts += [squeeze.compress(raw[own[i] : own[i + 1]]) for i in range(len(keys))]
        docs = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(docs.view(np.int64)), pa.array(texts, pa.binary())], ["doc_id", "doc", "packed"])


def _cut_contexts(length: int, hot: bool):
    """Bytes of wanted contexts; with ``hot`` the hashes of their single windows instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = open_up.decompress(packed)
                sums = common.prefix_hashes(np.frombuffer(raw, np.uint8)) if hot else None
                for w in wanted:
                    start, n = w["place"] >> 8, w["place"] & 255
                    if not hot:
                        out.append((w["anchor"], doc, w["place"], w["kind"], raw[start : start + n + length - 1]))
                    else:
                        s = np.arange(start, start + n)
                        h = common.range_hashes(sums, s, s + length).view(np.int64)
                        out += [(int(x), doc, int(y), w["kind"], b"") for x, y in zip(h, s, strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "doc", "place", "kind", "text"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_up = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = open_up.decompress(packed)
            runs = merged([(s["start"], s["end"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((len(raw), [{"start": a, "end": b} for a, b in runs], b"".join(kept)))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(cols[2], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = 2000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte ranges, maximal), kept (the other bytes, in order).

    Strings are judged on the input; overlaps count, and matches never cross documents. Null text counts as empty. Repeated rows
    are documents of their own, so they repeat each other. Of equal minimizers the leftmost counts. A very long text is hashed in blocks, in arrays of
    some 40 times its bytes in one task. An empty table gives no rows; other columns are ignored. ``length`` is
    at most 256. Windows are told apart by 128 bits of hash, edges by their bytes.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "anchor long, context long, doc long, place long"
    anchors = base.mapInArrow(_anchors(length), schema)
    order = ["anchor", "context", "doc", "place"]
    judged = common.written(anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare, schema + ", kind int"), "judged")
    borders = judged.where("kind <= 0").repartitionByRange(1, *order).sortWithinPartitions(*order)
    both = judged.where("kind > 0").unionByName(borders.mapInArrow(_compare_borders, schema + ", kind int")).drop("context")
    groups = both.where("kind > 1").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    edges = both.where("kind > 1").join(groups, "anchor").withColumn("hot", F.col("n") > most_contexts)
    wanted = edges.groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "kind", "hot")).alias("wanted"))  # no longer than a document's contexts
    packed = base.mapInArrow(_packed_texts, "doc_id long, doc long, packed binary")
    met = packed.select("doc", "packed").join(wanted.hint("merge"), "doc")
    cut = "anchor long, doc long, place long, kind int, text binary"
    met = common.written(met, "edge_texts")
    cool = met.select("doc", "packed", F.filter("wanted", lambda w: ~w.hot).alias("w")).where("size(w) > 0").mapInArrow(_cut_contexts(length, False), cut)
    marks = cool.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_marks(length), "doc long, start long, end long")
    hot = met.select("doc", "packed", F.filter("wanted", lambda w: w.hot).alias("w")).where("size(w) > 0").mapInArrow(_cut_contexts(length, True), cut)
    counted = hot.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    single = hot.where("kind = 2").join(counted, "anchor").select("doc", F.col("place").alias("start"), (F.col("place") + length).alias("end"))
    whole = both.where("kind = 1").select("doc", F.shiftright("place", 8).alias("start"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(255) + (length - 1)).alias("end"))
    spans = whole.unionByName(marks).unionByName(single).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return packed.join(spans.hint("merge"), "doc", "left").select("doc_id", "packed", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns for each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return dedup(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
