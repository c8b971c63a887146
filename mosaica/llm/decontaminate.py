"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, run once over each text.

Normalised text is its words, A-Z lower-cased. A window is ``window`` consecutive words of an item; an item with fewer words, but not
none, is one window. A document word inside any occurrence of a window is hit, and hits carry character offsets of the original text.

The automaton's symbols are the benchmark's words, as numbers: it has at most ``window`` states a word of the benchmark, about 60 bytes each.
A text's words become numbers by their hashes, in arrays; only runs of words that all stand in the benchmark are walked, and a match
is compared with the window's own words, so equal hashes of different words can't hit. A match is the number of its window; items are
looked up once for each window that a document holds, however often it holds it.

Scale: documents are never shuffled. The benchmark's text is broadcast, behind a check of its size: past ``most_words`` words (0.6 GB of states
a worker) it is dealt into groups of that size and the documents are scanned once for each group, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Bytes to normalised bytes: lower-case words, all else a space.
_NORMAL = bytes((b + 32 if 65 <= b < 91 else b) if _WORD[b] else 32 for b in range(256))

LEAK = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


class Index:
    """The automaton, the hashes of its words (sorted, by number), and each window's words and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            w = [numbers.setdefault(x, len(numbers)) for x in (text or "").encode().translate(_NORMAL).split()]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(k)
        self.names = list(numbers)
        joined = b" ".join(self.names)
        hashes, _ = common.word_hashes(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ~_WORD)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.windows = list(found)
        self.items = [sorted(i for i in (items[k][0] for k in ks) if i is not None) for ks in found.values()]
        self.shortest = min(map(len, self.windows), default=0)
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, words in enumerate(self.windows):
            self.search.add_word(tuple(x + 1 for x in words), n)
        if self.windows:
            self.search.make_automaton()

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number plus one; 0 for words that the benchmark doesn't have."""
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == hashes, self.order[at] + 1, 0)

    def matches(self, symbols: np.ndarray, word) -> Iterator[tuple[int, int, int]]:
        """First word, end word and window of every match; ``word`` gives a text's word by its place, lower-cased."""
        edge = np.diff(np.concatenate([[0], (symbols > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < self.shortest:
                continue
            for end, n in self.search.iter(tuple(symbols[a:b].tolist())):
                words = self.windows[n]
                first = a + end + 1 - len(words)
                if all(word(first + i) == self.names[x] for i, x in enumerate(words)):
                    yield first, a + end + 1, n


_indexes: dict[int, Index] = {}


def _index(sent, window: int) -> Index:
    """A worker's index, built once for each broadcast."""
    if sent.id not in _indexes:
        _indexes.clear()
        _indexes[sent.id] = Index(sent.value, window)
    return _indexes[sent.id]


class _Sent:
    """A broadcast with a number that workers know it by."""

    def __init__(self, spark, items: list):
        self.broadcast = spark.sparkContext.broadcast(items)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _scan(sent: _Sent, window: int, at: int, before: int | None, names: list[str], into: str, kind: pa.DataType):
    """Kernel: appends or completes the struct of words, marks (ranges of hit words) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent, window)
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(at))
            done = []
            old = batch.column(before).to_pylist() if before is not None else None
            for a, b in common.slices(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = common.words(part, own, ~_WORD)
                hashes = common.range_hashes(common.prefix_hashes(part, common._BYTE_LOWER), starts, ends)
                symbols = index.symbols(hashes) if len(index.sorted) and len(hashes) else np.zeros(len(hashes), np.int64)
                raw = part.tobytes()
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    word = lambda k, lo=lo: raw[starts[lo + k] : ends[lo + k]].translate(_NORMAL)
                    met = list(index.matches(symbols[lo:hi], word)) if symbols[lo:hi].any() else []
                    row = {"n_words": hi - lo, "n_hit": 0, "items": [], "marks": [], "spans": []}
                    spans = [(x, y) for x, y, _ in met]
                    items = {x for n in {n for _, _, n in met} for x in index.items[n]}
                    if old is not None:
                        spans += [(m["a"], m["b"]) for m in old[a + i]["marks"]]
                        items |= set(old[a + i]["items"])
                    if spans:
                        merged = _merged(spans)
                        text = raw[own[i] : own[i + 1]]
                        row |= {"n_hit": sum(y - x for x, y in merged), "items": sorted(items), "marks": [{"a": x, "b": y} for x, y in merged]}
                        row["spans"] = _characters(text, [(int(starts[lo + x] - own[i]), int(ends[lo + y - 1] - own[i])) for x, y in merged])
                    done.append(row)
            rest = batch.columns if before is None else batch.columns[:before]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(done, kind)], [*names, into])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _characters(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte ranges, in order, as character ranges; the text is decoded once."""
    out, at, n = [], 0, 0
    for a, b in ranges:
        start = n + len(text[at:a].decode())
        n = start + len(text[a:b].decode())
        at = b
        out.append({"start": start, "end": n})
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, into: str = "leak", most_words: int = 1_000_000) -> DataFrame:
    """All input columns and ``into``: struct of n_words, n_hit, items (ids as strings, sorted), spans (character ranges of hit words).

    Null or empty text has no words. A null item text has no windows; the windows of an item without an id hit, but name no
    item; items with one text are all named. A column of the input named like ``into`` is replaced, no other is touched. A very long text
    takes arrays of some 40 times its bytes. Repeated rows each get their result; an empty documents or benchmark table works.
    Words are longest runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z.
    """
    docs = docs.drop(into)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    names, at = docs.columns, docs.columns.index(text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.size(F.split("t", " ")))).first()[0] or 0
    groups = max(1, -(-total // most_words))
    kept = common.fresh(names, "found")
    schema = T.StructType([*docs.schema.fields, T.StructField(kept, T.StructType.fromDDL(LEAK + ", marks array<struct<a:long,b:long>>"))])
    kind = to_arrow_schema(schema).field(kept).type
    frame, before = docs, None
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(groups)) == g)
        here = sorted(((r.id, r.t) for r in part.collect()), key=lambda x: (x[0] or "", x[1]))
        if g:
            frame, before = common.written(frame, "scanned"), len(names)
        frame = frame.mapInArrow(_scan(_Sent(docs.sparkSession, here), window, at, before, names, kept, kind), schema)
    return frame.withColumn(kept, F.struct(*(F.col(kept)[x.split()[0]].alias(x.split()[0]) for x in ("n_words", "n_hit", "items", "spans")))).withColumnRenamed(kept, into)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns for each document."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns whatever their names; null and empty texts stay, and all cases are as in ``scan``."""
    into = common.fresh(docs.columns, "leak")
    return scan(docs, benchmark, into=into, **options).where(F.col(into)["n_hit"] == 0).drop(into)
