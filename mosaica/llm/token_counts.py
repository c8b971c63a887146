"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; dynamic programming carries the best score and its number of
pieces for every end, never the pieces. Ties go as in the tokenizer: a later-found path replaces a kept one only when its score is
greater, and starts are visited in ascending order, so the longest last piece wins. A character that no piece covers alone
counts as unknown, ten below the least score; unknown characters are then spelled as bytes where the vocabulary has all 256
byte pieces, else neighbouring ones fuse to one token.

White space becomes the vocabulary's space mark. No piece holds a mark behind another character, so the best paths of a text are
those of its chunks (a run of marks and what follows it), whose counts are worked out once and kept.

Scale: one pass over the texts, no shuffle; the automaton comes from the vocabulary file, and the kept counts are bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_KEPT = 400_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores of a sentencepiece model file, and whether it has all byte pieces. Control and byte pieces aren't matched."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    pieces = [(p.piece, p.score) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
    return pieces, sum(p.type == kinds.BYTE for p in model.pieces) == 256


class Counter:
    """Counts tokens of text under the unigram model of a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_fallback: bool):
        self.search = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.search.add_word(piece, (len(piece), score))
        if len(self.search):
            self.search.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1) or 1
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.spell = bytes_fallback
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.kept: dict[str, int] = {}
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def viterbi(self, text: str) -> int:
        """Tokens on the best path of a text whose white space is marked already."""
        n = len(text)
        if not n:
            return 0
        hits = self.search.iter(text) if len(self.search) else iter(())
        hit = next(hits, None)
        # Paths of the last ``span`` ends only: no piece reaches further back.
        span = min(self.longest, n) + 1
        best, count, unknown = [0.0] * span, [0] * span, [False] * span  # unknown: whether the path's last token is one
        here = 0
        for end in range(n):
            top, tokens, lost, single = None, 0, False, False
            while hit is not None and hit[0] == end:  # the longest first: the smallest start
                size, score = hit[1]
                single = single or size == 1
                at = (end + 1 - size) % span
                s = best[at] + score
                if top is None or s > top:
                    top, tokens, lost = s, count[at] + 1, False
                hit = next(hits, None)
            if not single:
                s = best[here] + self.unknown
                if top is None or s > top:
                    top, lost = s, True
                    tokens = count[here] + (len(text[end].encode()) if self.spell else 0 if unknown[here] else 1)
            here = (end + 1) % span
            best[here], count[here], unknown[here] = top, tokens, lost
        return count[here]

    def _chunk(self, chunk: str) -> int:
        got = self.viterbi(chunk)
        if len(self.kept) >= _KEPT:
            self.kept.clear()
        self.kept[chunk] = got
        return got

    def count(self, text: str) -> int:
        """Tokens of a raw text: a mark before it, and one for every space."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.apart or (not self.spell and text.isascii() is False and self._fuses(text)):
            return self.viterbi(text)
        kept, chunk = self.kept, self._chunk
        return sum([kept[c] if c in kept else chunk(c) for c in self.chunks(text)])

    def _fuses(self, text: str) -> bool:
        """Whether unknown characters could meet across chunks: only if the mark itself is unknown."""
        return not len(self.search) or MARK not in self.search


@cache
def counter(path: str) -> Counter:
    return Counter(*read_vocabulary(path))


def token_counts(docs: DataFrame, *, path: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """All input columns and ``into``: tokens of the whole text (long). Null or empty text has none; a column named like ``into`` is
    replaced, no other is touched; ties go as in the tokenizer (see the module); a very long text, with spaces or without, takes memory of its own length;
    repeated rows count alike; an empty table gives no rows.

    ``path`` is a sentencepiece file. One of a BPE model has merge ranks in place of log-probabilities: they are read as unigram scores, so
    counts are those of a unigram model over these pieces and scores, not of the BPE model."""
    docs = docs.drop(into).withColumn(text_col, F.col(text_col).cast("string"))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            counts = [tokens.count(t) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())]))
