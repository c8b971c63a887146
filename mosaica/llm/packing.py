"""Best-fit packing of token sequences: bin completion over the histogram of piece lengths, then every piece to its place.

Scale: the texts are read and tokenized once, without a shuffle. Only lengths are gathered on the driver, at most ``capacity``
counts however many documents there are; the packing is found over them. A piece's place follows from its rank among the
pieces of its length, which is its number within its own scan task plus the counts of earlier tasks, so no group meets in one
task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bins, common

_KEPT_WORDS = 400_000
#: Such characters aren't white space to the tokenizer, or are but not below.
_ODD = re.compile(r"[\x1c-\x1f]|<\|")
#: Chunks of these characters only are split here; all others go to the tokenizer as they are.
_PLAIN = re.compile(r"[!-~¡-¬®-ɏ]+")


def _byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


class WordTokens:
    """Ids of a lower-casing word BPE, by white-space chunk: chunks never share a token, so each is worked out once and kept.

    Results are those of ``tokenizers`` on the whole text: chunks of plain characters are split by the same pattern and given
    to the same model; any other chunk, or text with special tokens' marks, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.letters = _byte_letters()
        self.kept: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            got = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(self.parts) >= _KEPT_WORDS:
                self.parts.clear()
            self.parts[part] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and (chunk.isascii() or "İ" not in chunk):
            lower = chunk.lower()
            got = self._part(lower) if lower.isalpha() else b"".join(map(self._part, self.split(lower)))
        else:
            got = np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.kept) >= _KEPT_WORDS:
            self.kept.clear()
        self.kept[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept, chunk = self.kept.get, self._chunk
        return b"".join([kept(w) or chunk(w) for w in text.split()])


@cache
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part, nth: the scan task, and the number among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = _tokens(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.ids(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)] + [pa.array([part] * len(rows), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long")


def slots(patterns: list[bins.Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each run of equal slots, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for s in pattern:
            out.setdefault(s, []).append((used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + n
            offset += s
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}


def pack(docs: DataFrame, *, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; only longer ones are cut, into pieces of ``capacity`` ids. Null text counts as empty:
    one piece of one id. Repeated rows, and rows without an id, are documents of their own. Pieces of one length are interchangeable: ties go by
    scan task and order in it. A very long text is held with its ids in one task. An empty table gives no rows; other columns are ignored.
    """
    cut = common.written(pieces(docs, path, capacity, id_col, text_col), "pieces")
    per = common.written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = slots(bins.complete(counts, capacity))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranked = cut.join(per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for s in np.unique(lengths):
                at = np.flatnonzero(lengths == s)
                first, begin, off = places[int(s)]
                k = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at], offset[at] = begin[k] + ranks[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
