"""Near-duplicate passages by compact windows.

A text is a row of tokens: its shingles (hashes of ``shingle`` consecutive words). A passage is a stretch of ``t`` tokens or more; two are near when
their sets have the similarity. No pair is left to chance:

1. Tokens of all texts are counted, as sorted blocks of 48 bits dealt into parts. A near passage consists of tokens that stand twice or more, but for
   a share, so all other stretches are dropped (``covered``: a sum over prefix minima, the widest stretches at once).
2. All texts order tokens alike: by how often they stand (in powers of two), then by hash. Of a passage's tokens those that are less than the least one
   that it shares with its partner aren't in the partner, so they are few: a token that is the least in no stretch with so few lesser ones
   can't be that one (``seeds_of``; a compact window, but with a share of lesser tokens in it). All others are seeds. Two near passages share a seed.
3. Stretches that share a seed are compared: first each with one lead, then places that no verified passage covers with the leads of their groups, until
   a round finds nothing new; at last all stretches of a group that haven't met, unless their texts are in one class already.
   So classes are whole; a place's spans come from the partners that it met.
4. A pair is verified on all tokens of both stretches: chains of equal runs in one order by their sums, and where no token stands twice in either,
   any order (``anywhere``). Stretches that repeat tokens in themselves *and* have them in another order are compared by their sets over
   maximal stretches, not over all.

Scale: tokens travel as some five bytes each, once; only stretches that may hold a near passage go on. A group is paired with leads, and only what no lead
settles is compared in the square of its number. Components run as star rounds over the links.
"""

from __future__ import annotations

import contextlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components

_LOW = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 23
#: Tokens that a task counts at once, compressed bytes of texts in a block.
_PART, _PACKED = 2_000_000, 2_000_000
#: Pairs of stretches that a worker holds at once, with their tokens.
_PAIRS = 500
#: Levels and scores of places without a token, or out of question.
_NONE, _FAR = -2, -(1 << 30)
#: Sums that are held at once when stretches are compared in any order.
_CELLS = 1 << 18


def tokens(part: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, one for each word, and each row's first word; the last ``shingle`` - 1 of a row cross its end and aren't tokens."""
    h, first = common.word_hashes(part, offsets)
    whole = common.shingle_hashes(h, shingle)
    return np.concatenate([whole, np.zeros(len(h) - len(whole), np.uint64)]), first


def windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of one row of hashes: place of the least token, first and end token of the stretch, for all of ``t`` tokens or more.

    The leftmost of equal tokens counts as the least. Places are those that are least of some t in a row; the ends are found by halving
    steps over minima of 1, 2, 4, ... tokens.
    """
    n = len(h)
    if n < t:
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(h, kind="stable")
    rank = np.empty(n, np.int32)  # no two alike: of equal tokens the leftmost ranks least
    rank[order] = np.arange(n, dtype=np.int32)
    levels = [rank]
    while 2 << len(levels) - 1 <= n:
        size = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-size], levels[-1][size:]))
    # least of each t in a row: minima of the largest power of two within t, from either end
    k = t.bit_length() - 1
    least = np.minimum(levels[k][: n - t + 1], levels[k][t - (1 << k) : t - (1 << k) + n - t + 1])
    places = np.sort(order[least[np.concatenate([[True], least[1:] != least[:-1]])]])
    v = rank[places]
    low, high = places.copy(), places + 1  # the stretch so far
    for level in range(len(levels) - 1, -1, -1):
        size, m = 1 << level, levels[level]
        can = low - size >= 0
        can[can] = m[low[can] - size] > v[can]
        low[can] -= size
        can = high + size <= n
        can[can] = m[high[can]] > v[can]
        high[can] += size
    wide = high - low >= t
    return places[wide], low[wide], high[wide]


def least_places(h: np.ndarray, t: int) -> np.ndarray:
    """Places that are the least of some t in a row: those that have a compact window. Hashes count by their 40 leading bits, then by place.

    ``h`` may hold rows one after the other with 0 between them; 0 is less than all, so no window crosses it, and it isn't returned.
    """
    if len(h) < t:
        return np.zeros(0, np.int64)
    out = []
    for base in range(0, len(h) - t + 1, _BLOCK):
        part = h[base : base + _BLOCK + t - 1]
        v = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        m, size = v, 1
        while size * 2 <= t:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        n = len(part) - t + 1
        least = np.minimum(m[:n], m[t - size : t - size + n])
        found = least[np.concatenate([[True], least[1:] != least[:-1]])]
        out.append((found[found > _LOW] & _LOW).astype(np.int64) + base)
    return np.unique(np.concatenate(out))


def _texts(least: int, shingle: int):
    """Kernel: id, words, key (128 bits of all words), of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(1))
            counts, keys = [], []
            for a, b in common.slices(offsets):
                h, first = common.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                place = common.mix(h ^ np.uint64(0x5851F42D4C957F2D))
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    counts.append(hi - lo)
                    order = np.arange(1, hi - lo + 1, dtype=np.uint64)
                    one, two = int(common.mix(h[lo:hi] + order * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)), int(common.mix(place[lo:hi] ^ order * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64))
                    keys.append(one.to_bytes(8, "big") + two.to_bytes(8, "big") if hi - lo >= least else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_words", "key"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = common.text_bytes(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["node", "packed"])


def stretches(flags: np.ndarray, cost: int) -> list[tuple[int, int]]:
    """All maximal stretches of positive sum, where a match counts 1 and any other token -cost (Ruzzo and Tompa's, over runs; linear)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    kept: list[tuple[int, int, int, int]] = []  # first, end, sum before, sum after
    total = last = 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        total -= cost * (a - last)
        now = (a, b, total, total + b - a)
        total, last = total + b - a, b
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= now[2]:
                j -= 1
            if j < 0 or kept[j][3] >= now[3]:
                break
            now = (kept[j][0], now[1], kept[j][2], now[3])
            del kept[j:]
        kept.append(now)
    return [(a, b) for a, b, _, _ in kept]


def grown(flags: np.ndarray, a: int, b: int, percent: int) -> tuple[int, int]:
    """The stretch with the runs of matches beside it, as long as the matches are so many that equal sets of them would keep the similarity."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    i, j = int(np.searchsorted(ends, a, "right")) - 1, int(np.searchsorted(starts, b))  # the next runs on either side
    while True:
        options = ([(int(starts[i]), b, i - 1, j)] if i >= 0 else []) + ([(a, int(ends[j]), i, j + 1)] if j < len(starts) else [])
        # m of n tokens are alike, and the other text has n - m of its own as well: m of 2 n - m
        good = [(int(sums[q] - sums[p]) / (q - p), p, q, u, v) for p, q, u, v in options if 100 * int(sums[q] - sums[p]) >= percent * (2 * (q - p) - int(sums[q] - sums[p]))]
        if not good:
            return a, b
        _, a, b, i, j = max(good)


def covered(score: np.ndarray, t: int) -> np.ndarray:
    """Which places lie in a stretch of ``t`` or more whose scores sum to 0 or more."""
    n = len(score)
    if n < t:
        return np.zeros(n, bool)
    sums = np.concatenate([[0], np.cumsum(score)])
    ends = np.arange(t, n + 1)
    # the first start that is no higher than the end: where the falling minimum gets there
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums[t:], "left")
    good = starts <= ends - t
    edge = np.bincount(starts[good], minlength=n + 1) - np.bincount(ends[good], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def covered_once(score: np.ndarray, gap: np.ndarray, t: int) -> np.ndarray:
    """Which places may lie in a stretch of ``t`` or more whose distinct tokens have scores of 0 or more in all; ``gap``: how far back the same token stood, 0 for none.

    A stretch's first ``t`` tokens count exactly, each distinct one once. Of those after them, a token that stood no more than ``t`` before counts nothing,
    and one that stood earlier counts nothing if its score is negative: it may be in the stretch already. Without repeats this is ``covered``.
    """
    n = len(score)
    if n < t:
        return np.zeros(n, bool)
    # a place is its token's first in the stretches that start after the place before, and up to itself
    first = np.arange(n) - np.where(gap > 0, np.minimum(gap, t), t) + 1
    heads = np.cumsum(np.bincount(np.maximum(first, 0), score, n) - np.concatenate([[0], score[:-1]]))[: n - t + 1]
    sums = np.concatenate([[0.0], np.cumsum(np.where((gap == 0) | (score > 0) & (gap > t), score, 0), dtype=float)])
    # the last end that is no lower than it must be: where the maximum of all later ends gets there
    later = np.maximum.accumulate(sums[::-1])[::-1]
    ends = np.searchsorted(-later, heads - sums[t:], "right") - 1
    starts = np.arange(n - t + 1)
    good = ends >= starts + t
    edge = np.bincount(starts[good], minlength=n + 1) - np.bincount(ends[good], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def gaps(v: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their tokens, and how far back the same token stood in the same row, 0 for none."""
    order = np.argsort(v, kind="stable")
    back = np.diff(order, prepend=0)
    back[:1] = 0
    back[1:][(v[order[1:]] != v[order[:-1]]) | (row[order[1:]] != row[order[:-1]])] = 0
    gap = np.empty(len(v), np.int64)
    gap[order] = back
    return order, gap


def _shrunk(v: np.ndarray) -> bytes:
    """Sorted whole numbers as the byte planes of their differences, compressed."""
    return zstandard.compress(np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unshrunk(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _six(v: np.ndarray) -> bytes:
    return v.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: rows of (node, packed) get a block, a number that some megabytes of texts in a row share."""
    for batch in batches:
        sizes = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
        block, last = np.zeros(len(sizes), np.int64), None
        for i, size in enumerate(sizes.tolist()):
            part = (size // _PACKED, i // 16384)
            if part != last:
                last, name = part, secrets.randbits(62)
            block[i] = name
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)], ["node", "packed", "block"])


def _unpacked(packed: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit tokens of texts one after the other, which places hold none (the last of each row), and each row's first place."""
    raw = [zstandard.decompress(x) for x in packed]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])
    parts = [tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in common.slices(offsets)]
    h, sizes = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)]), np.concatenate([np.zeros(1, np.int64), *(np.diff(f) for _, f in parts)])
    first = np.cumsum(sizes)
    none = np.zeros(len(h), bool)
    for k in range(1, shingle):
        at = first[1:] - k
        none[at[at >= first[:-1]]] = True
    return h >> np.uint64(16), none, first


def _counted(shingle: int, parts: int):
    """Kernel over (node, packed, block): the tokens of each block and in how many of its texts they stand, dealt into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, packed = batch.column(2).to_numpy(), batch.column(1).to_pylist()
            cut = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                v, none, first = _unpacked(packed[a:b], shingle)
                order, gap = gaps(v, np.repeat(np.arange(b - a), np.diff(first)))
                v = v[order][(~none & (gap == 0))[order]]
                new = np.flatnonzero(np.diff(v, prepend=~v[:1]))
                v, n = v[new], np.diff(new, append=len(v))
                part = (v % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers sort in linear time
                order = np.argsort(part, kind="stable")
                bound = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, order[bound[p] : bound[p + 1]]) for p in range(parts) if bound[p] < bound[p + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int64()), pa.array([int(block[a])] * len(rows), pa.int64()), pa.array([_shrunk(v[at]) for _, at in rows], pa.binary()), pa.array([zstandard.compress(n[at].astype(np.uint32).tobytes(), 1) for _, at in rows], pa.binary())],
                    ["part", "block", "tokens", "counts"],
                )

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of each block's tokens in one part those that stand in two texts or more, with a level that rises with their number."""
    rows = [(_unshrunk(v), np.frombuffer(zstandard.decompress(n), np.uint32)) for v, n in zip(table.column("tokens").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    own, number = np.unique(np.concatenate([v for v, _ in rows]), return_inverse=True)
    total = np.bincount(number, np.concatenate([n for _, n in rows]), len(own))
    level = np.log2(total).astype(np.uint8)
    out, at = [], 0
    for v, _ in rows:
        mine = level[number[at : at + len(v)]]
        at += len(v)
        out.append((_shrunk(v[mine > 0]), zstandard.compress(mine[mine > 0].tobytes(), 1)))
    return pa.table({"block": table.column("block"), "tokens": pa.array([x for x, _ in out], pa.binary()), "levels": pa.array([x for _, x in out], pa.binary())})


def _walled(gap: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Gaps without those that reach over a place without a token."""
    place = np.arange(len(level))
    return np.where(place - gap > np.maximum.accumulate(np.where(level == _NONE, place, -1)), gap, 0)


def seeds_of(level: np.ndarray, gap: np.ndarray, t: int, percent: int) -> np.ndarray:
    """Which tokens can be the least that two near passages share; ``level``: -1 for tokens in no other text, ``gap``: how far back the same token stood in the text, 0 for none.

    Of a passage's distinct tokens (100 - ``percent``) % at most aren't in the other, and all that are less than the least shared one are among them.
    """
    found = np.zeros(len(level), bool)
    at, near, gap = np.arange(len(level)), level != _NONE, _walled(gap, level)
    for k in np.unique(level[level >= 0]):
        if 3 * near.sum() < 2 * len(at):  # where no passage lies now, none lies at higher levels: a place beside each stretch is enough
            kept = near.copy()
            kept[1:] |= near[:-1]
            at, level, gap, near = at[kept], np.where(near, level, _NONE)[kept], gap[kept], near[kept]
            gap = _walled(gap, level)
        near = covered_once(np.where(level == _NONE, _FAR, np.where(level < k, -percent, 100 - percent)), gap, t)
        found[at[near & (level == k)]] = True
        if not near.any():
            break
    return found


def _dense(t: int, shingle: int, percent: int):
    """Kernel over a block's texts and its repeated tokens: the stretches whose tokens are so often repeated that a near passage may lie there, with their seeds."""

    def run(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        node, start, out = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        h, c, ends = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int32)
        known = np.concatenate([np.zeros(0, np.uint64), *(_unshrunk(x) for x in repeated.column("tokens").to_pylist())])
        if len(known) and texts.num_rows:
            v, none, first = _unpacked(texts.column("packed").to_pylist(), shingle)
            of = np.frombuffer(b"".join(zstandard.decompress(x) for x in repeated.column("levels").to_pylist()), np.uint8)
            known, where = np.unique(known, return_index=True)
            order, gap = gaps(v, np.repeat(np.arange(len(first) - 1), np.diff(first)))
            gap[none] = 0
            at = np.empty(len(v), np.int64)
            at[order] = np.minimum(np.searchsorted(known, v[order]), len(known) - 1)
            level = np.where(known[at] == v, of[where][at].astype(np.int64) * 4 + (v & np.uint64(3)).astype(np.int64), -1)
            inside = covered_once(np.where(none, _FAR, np.where(level >= 0, 100 - percent, -percent)), gap, t)
            level[~inside] = _NONE
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
            low, high = edge[::2], edge[1::2]
            row = np.searchsorted(first, low, "right") - 1
            seed = np.flatnonzero(seeds_of(level, gap, t, percent))
            node, start = texts.column("node").to_numpy()[row], low - first[row]
            out = [_six(v[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            h, c = v[seed].astype(np.int64), (seed - first[np.searchsorted(first, seed, "right") - 1]).astype(np.int32)
            ends = np.concatenate([[0], np.searchsorted(seed, high)]).astype(np.int32)
        seeds = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h), pa.array(c)], ["h", "c"]))
        return pa.table({"node": pa.array(node), "s": pa.array(start), "tokens": pa.array(out, pa.binary()), "seeds": seeds})

    return run


class _Text:
    """A stretch's tokens, and where each stands."""

    def __init__(self, raw: bytes):
        self.x = _unsix(raw)
        self.own, number = np.unique(self.x, return_inverse=True)
        self.there = np.sort(number.astype(np.int64) << 32 | np.arange(len(self.x)))
        place = self.there & 0xFFFFFFFF
        self.gap = np.zeros(len(self.x), np.int64)  # how far back the same token stood, 0 for none
        self.gap[place[1:]] = np.where(np.diff(self.there >> 32) == 0, np.diff(place), 0)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    u, v = np.unique(x), np.unique(y)
    both = len(u) + len(v) - len(np.union1d(u, v))
    return 100 * both >= percent * (len(u) + len(v) - both)


def chains(x: np.ndarray, y: _Text, kind: np.ndarray, flags: np.ndarray, cost: float) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each equal run the chains of runs that end with it, longest first: first and end token in x and in y.

    A token of a run counts 1, one between two runs -cost in either text, but for those that both texts have and one of them has twice: they
    are in no run and count nothing. Sums of 0 or more are the similarities that suffice, if no token stands twice. A run follows the one
    by which the sum is the best.
    """
    once = np.diff(np.concatenate([np.flatnonzero(np.diff(y.there >> 32, prepend=-1)), [len(y.there)]]))[kind] == 1
    _, number, times = np.unique(x, return_inverse=True, return_counts=True)
    once &= times[number] == 1
    at = np.flatnonzero(flags & once)
    if not len(at):
        return
    free = np.zeros(len(y.x), bool)
    free[y.there[np.isin(y.there >> 32, kind[flags & ~once])] & 0xFFFFFFFF] = True
    price = [np.concatenate([[0], np.cumsum(~k)]) for k in (flags & ~once, free)]
    j = y.there[np.searchsorted(y.there, kind[at] << 32)] & 0xFFFFFFFF
    order = np.lexsort((at, j - at))
    at, j = at[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(j) != 1)]))
    size = np.diff(np.concatenate([new, [len(at)]]))
    runs = np.array([at[new], at[new] + size, j[new], j[new] + size, size])
    p, p2, q, q2, size = runs[:, np.argsort(runs[0], kind="stable")]
    total, before, step = size.astype(float), np.full(len(p), -1), np.zeros(len(p))
    # what lies farther back than this is too far for any sum
    firsts = np.searchsorted(price[0][p], price[0][p] - len(at) / cost - int(size.max()))
    for k in range(1, len(p)):
        f = int(firsts[k])
        if f >= k:
            continue
        gaps = price[0][p[k]] - price[0][p2[f:k]] + price[1][q[k]] - price[1][np.minimum(q2[f:k], q[k])]
        sums = np.where(q2[f:k] <= q[k], total[f:k] - cost * gaps, -np.inf)
        best = int(np.argmax(sums))
        if sums[best] > -np.inf:
            before[k], step[k] = f + best, sums[best] - total[f + best]
            total[k] += max(0.0, sums[best])
    for k in range(len(p) - 1, -1, -1):
        found, at_, score = [(int(p[k]), int(p2[k]), int(q[k]), int(q2[k]))], k, float(size[k])
        while before[at_] >= 0 and (score >= 0 or total[at_] > size[at_]):
            score += step[at_] + size[before[at_]]
            at_ = int(before[at_])
            if score >= 0:
                found.append((int(p[at_]), int(p2[k]), int(q[at_]), int(q2[k])))
        yield found[::-1]


def anywhere(x: np.ndarray, y: np.ndarray, t: int, percent: int) -> tuple[int, int, int, int] | None:
    """Near stretches of ``t`` tokens or more of two texts, their tokens in any order, if there are any; none of a text's tokens should stand twice.

    m of the tokens of two stretches are alike: 100 m >= percent (a + b - m) says that a sum over the second is high enough, so for each first
    stretch the best second one is a greatest sum. First both texts lose the places where no near stretch can lie, and most have none left.
    """
    inside = [np.ones(len(x), bool), np.ones(len(y), bool)]
    while True:
        left = inside[0].sum() + inside[1].sum()
        for k, (v, w) in enumerate(((x, y), (y, x))):
            score = np.where(np.isin(v, w[inside[1 - k]]), 100 - percent, -percent)
            inside[k] = covered(np.where(inside[k], score, _FAR), t)
            if not inside[k].any():
                return None
        if inside[0].sum() + inside[1].sum() == left:
            break
    runs = [np.flatnonzero(np.diff(np.concatenate([[0], k.astype(np.int8), [0]]))).reshape(-1, 2).tolist() for k in inside]
    for a, b in runs[0]:
        for c, d in runs[1]:
            own, where = np.unique(x[a:b], return_index=True)
            at = np.minimum(np.searchsorted(own, y[c:d]), len(own) - 1)
            place = np.where(own[at] == y[c:d], where[at], b - a)  # in x
            if (np.diff(place[place < b - a]) > 0).all():
                continue  # in one order: chains have found it
            rows = max(1, _CELLS // (d - c))
            for p in range(b - a - t + 1):
                for q in range(p + t, b - a + 1, rows):
                    ends = np.arange(q, min(q + rows, b - a + 1))
                    score = np.where((place >= p) & (place < ends[:, None]), 100, -percent)
                    sums = np.zeros((len(ends), d - c + 1), np.int64)
                    # m (100 + percent) - percent (a + b), in which a token alike counts 100 of both
                    np.cumsum(score, axis=1, out=sums[:, 1:])
                    least = np.minimum.accumulate(sums[:, : d - c - t + 1], axis=1)
                    best = sums[:, t:] - least - percent * (ends - p)[:, None]
                    k = int(np.argmax(best))
                    e, v = divmod(k, best.shape[1])
                    if best[e, v] >= 0:
                        return a + p, a + int(ends[e]), c + int(np.argmin(sums[e, : v + 1])), c + v + t
    return None


def verified_passages(x: _Text, y: _Text, t: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """First and end token in x and in y of the near passages of two stretches."""
    kind = np.searchsorted(y.own, x.x)
    kind[kind == len(y.own)] = 0
    flags = y.own[kind] == x.x
    single = len(y.own) == len(y.x) and len(x.own) == len(x.x)
    if single and 100 * int(flags.sum()) < percent * t:
        return
    # most have no stretch in which enough tokens are alike, on one side or the other
    inside = covered_once(np.where(flags, 100 - percent, -percent), x.gap, t)
    if not inside.any():
        return
    alike = np.zeros(len(y.own), bool)
    alike[kind[flags & inside]] = True
    hit = np.zeros(len(y.x), bool)
    hit[(y.there & 0xFFFFFFFF)[alike[y.there >> 32]]] = True
    if not covered_once(np.where(hit, 100 - percent, -percent), y.gap, t).any():
        return
    done: list[tuple[int, int, int, int]] = []

    def good(p: int, q: int, u: int, v: int) -> bool:
        if q - p < t or v - u < t or any(a <= p and q <= b and c <= u and v <= d for a, b, c, d in done):
            return False
        if _similar(x.x[p:q], y.x[u:v], percent):
            done.append((p, q, u, v))
            return True
        return False

    def wide(a: int, b: int, n: int) -> list[tuple[int, int]]:
        return [(a, b)] if b - a >= t else [] if 100 * (b - a) < percent * t // 2 else list(dict.fromkeys([(max(0, min(a, n - t)), max(0, min(a, n - t)) + t), (max(0, b - t), max(0, b - t) + t)]))

    for options in chains(x.x, y, kind, flags, percent / (100 - percent)):
        tries = ((a, b, c, d) for p, q, u, v in options for a, b in wide(p, q, len(x.x)) for c, d in wide(u, v, len(y.x)))
        if hit := next((w for w in tries if good(*w)), None):
            yield hit
    # passages whose parts stand in another order, or repeat tokens
    for cost in () if single else (4, 8):
        for a, b in stretches(flags, cost):
            mine = [w for w in dict.fromkeys((grown(flags, a, b, percent), (a, b))) if w[1] - w[0] >= t]
            if not mine:
                continue
            hit = np.zeros(len(y.x), bool)
            hit[y.there[np.isin(y.there >> 32, kind[a:b][flags[a:b]])] & 0xFFFFFFFF] = True
            for c, d in stretches(hit, cost):
                tries = ((*m, *n) for m in mine for n in dict.fromkeys(((c, d), grown(hit, c, d, percent))) if n[1] - n[0] >= t)
                if found := next((w for w in tries if good(*w)), None):
                    yield found
    if single and not done and (found := anywhere(x.x, y.x, t, percent)) and good(*found):
        yield found


def _verify(t: int, shingle: int, percent: int):
    """Kernel over (node, s, lead, ls, tokens of both): verified passages, as rows of node, partner, first and end word; one row for either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for node, s, lead, ls, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lead, ls) != last:  # rows come by lead
                    last, y = (lead, ls), _Text(q)
                for a, b, low, high in verified_passages(_Text(p), y, t, percent):
                    out += [(node, lead, s + a, s + b + shingle - 1), (lead, node, ls + low, ls + high + shingle - 1)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "partner", "start", "end"])

    return run


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are made in here send their workers ``_PAIRS`` rows at once: a row with the tokens of two long texts is large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(_PAIRS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _still_open(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Seeds outside the verified passages of their text."""
    spans = found.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # no more than a text has verified passages
    inside = F.exists("spans", lambda s: (s.start <= F.col("c")) & (F.col("c") < s.end))
    return seeds.join(spans, "node", "left").where(~F.coalesce(inside, F.lit(False))).drop("spans")


def passages(docs: DataFrame, names: DataFrame, *, least: int, shingle: int, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """node, partner, start, end (words): verified near-duplicate passages, a row for either side; and links a, b that join the same classes. docs: doc, text; names: doc, node (which stands for equal texts)."""
    spark, t = docs.sparkSession, least - shingle + 1
    stand = names.where("doc = node").select("node")
    texts = docs.mapInArrow(_packed, "node long, packed binary").join(stand.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    texts = common.written(texts.mapInArrow(_blocked, "node long, packed binary, block long"), "texts")
    parts = 1 + words // _PART
    counts = texts.mapInArrow(_counted(shingle, parts), "part long, block long, tokens binary, counts binary")
    repeated = counts.groupBy("part").applyInArrow(_repeated, "block long, tokens binary, levels binary")
    dense = texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_dense(t, shingle, percent), "node long, s long, tokens binary, seeds array<struct<h:bigint,c:int>>")
    dense = common.written(dense, "dense")
    every = dense.select("node", "s", F.explode("seeds").alias("x")).select("x.h", "x.c", "node", "s")
    shared = every.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("h")
    seeds = common.written(every.join(shared.hint("merge"), "h", "left_semi"), "seeds")
    side = ["node", "s", "lead", "ls"]

    def verified(pairs: DataFrame) -> DataFrame:
        mine, other = dense.select("node", "s", F.col("tokens").alias("p")), dense.select(F.col("node").alias("lead"), F.col("s").alias("ls"), F.col("tokens").alias("q"))
        both = pairs.select(side).join(mine.hint("merge"), ["node", "s"]).join(other.hint("merge"), ["lead", "ls"]).select(*side, "p", "q")
        with _small_batches(spark):
            found = common.written(both.mapInArrow(_verify(t, shingle, percent), "node long, partner long, start long, end long"), "passages")
        spark._jvm.System.gc()  # lets go of the shuffles of rounds that are over
        return found

    def untried(pairs: DataFrame) -> DataFrame:
        """Pairs of stretches that haven't met, either way round."""
        back = tried.select(F.col("lead").alias("node"), F.col("ls").alias("s"), F.col("node").alias("lead"), F.col("s").alias("ls"))
        return pairs.join(tried.unionByName(back), side, "left_anti")

    def led(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.min(F.struct("node", "s")).alias("l")).select("h", F.col("l.node").alias("lead"), F.col("l.s").alias("ls"))

    met = seeds.join(led(seeds), "h").where("node <> lead").groupBy(side).agg(F.count("*").alias("n"))
    best = met.withColumn("k", F.row_number().over(W.partitionBy("node", "s").orderBy(F.col("n").desc(), "lead", "ls"))).where("k = 1")
    tried = common.written(best.select(side), "tried")
    found = verified(tried)
    while True:
        # Places that no verified passage covers meet their group's lead, and the least of those that are left.
        open_ = common.written(_still_open(seeds, found), "open")
        leads = led(seeds).unionByName(led(open_)).distinct()
        pairs = common.written(untried(open_.join(leads, "h").where("node <> lead").select(side).distinct()), "pairs")
        if pairs.isEmpty():
            break
        fresh = verified(pairs)
        tried = common.written(tried.unionByName(pairs), "tried")
        if not fresh.limit(1).count():
            break
        found = common.written(found.unionByName(fresh), "passages")
    # All other pairs of a group whose texts aren't in one class yet: one of them at least is outside the group's largest class.
    component = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    classed = seeds.join(component.withColumnRenamed("id", "node"), "node", "left").select("h", "node", "s", F.coalesce("component", "node").alias("component"))
    mixed = classed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    classed = common.written(classed.join(mixed, "h", "left_semi").distinct(), "classed")
    sizes = classed.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "component")).alias("top"))
    classed = common.written(classed.join(sizes.select("h", F.col("top.component").alias("top")), "h"), "classed")
    outside = classed.where("component <> top").select("h", "node", "s", F.col("component").alias("own"))
    others = classed.select("h", F.col("node").alias("lead"), F.col("s").alias("ls"), "component", "top")
    pairs = outside.join(others, "h").where("own <> component and (component = top or node < lead)").select(side).distinct()
    pairs = common.written(untried(pairs), "pairs")
    fresh = verified(pairs)
    links = component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(fresh.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    return common.written(found.unionByName(fresh), "passages"), links


def near_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_words, n_near (words in passages that stand in another row too), spans (of words, merged), n_partners, class_id, kept.

    A passage is ``least`` words or more; two are near when 100 * intersection >= percent * union of their sets of ``shingle``-word shingles.
    n_partners: distinct texts with which a passage was verified (a text's copies count once; at least one when the text stands twice). class_id is the smallest id reachable over shared passages; kept
    says whether that is the row's own. Null, empty and shorter texts have no passage. Rows with equal words share all results, and are near each other throughout; rows that share an id as well. A row
    without an id is compared only by way of an equal text with an id, and has a null class. A very long text takes arrays of some 200 times its bytes in one
    task. Ties of equal tokens go to the leftmost. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = common.written(base.mapInArrow(_texts(least, shingle), "doc_id long, n_words long, key binary"), "keys")
    named = keyed.where("key is not null and doc_id is not null")
    groups = common.written(named.groupBy("key").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("copies")), "groups")
    names = common.written(named.join(groups, "key").groupBy(F.col("doc_id").alias("doc")).agg(F.min("node").alias("node")), "names")
    words = keyed.agg(F.sum("n_words")).first()[0] or 0
    found, links = passages(base.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text"), names, least=least, shingle=shingle, percent=percent, words=words)
    component = components(links).withColumnRenamed("id", "node")
    per = found.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"), F.count_distinct("partner").alias("partners"))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = F.aggregate(
        "s", start, lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x.start), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x.end).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    )
    known = groups.join(per.select("node", joined.alias("s"), "partners"), "node", "left").join(component, "node", "left")
    out = keyed.join(known, "key", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    spans = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("s", start))
    cls = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select(
        "doc_id", "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_near"), spans.alias("spans"), (F.coalesce("partners", F.lit(0)) + F.when(F.col("copies") > 1, 1).otherwise(0)).cast("long").alias("n_partners"),
        cls.alias("class_id"), F.coalesce(F.col("doc_id") == cls, F.lit(True)).alias("kept"),
    )
