"""MinHash near-duplicate detection with an LSH forest.

Every document becomes the set of its distinct 4-word shingles (operator default five; the query states its own). Equal sets
are one class from the start. Each class gets ``trees`` labels of ``depth`` 32-bit min-hashes, and each tree is one order of
all classes sorted by label. Neighbours in such an order that share a longest common prefix of at least ``least`` values are
candidates: where a region of the order is dense, the nearest neighbours share longer prefixes, so the depth adapts itself,
and the number of candidates of this first pass stays ``ahead`` times the rows. Candidates are confirmed on the full sets.

The window is no bound on what is found. A region (rows of one tree that share ``least`` values) of more than ``ahead`` + 1 rows
that still lies in several components is completed: rounds hold one row of its largest component and one of the others, those
whose labels are most common there (the original of many copies), against all its rows; when these no longer help, or few
pairs are left, every pair of rows of different components is compared. What can't change a component isn't compared.

Scale: an order is dealt out by range and sorted, so a region of any size (a third of all rows) is split over tasks; the few
rows at the borders of the tasks are joined up in a second small pass. The completion deals a region into blocks of ``_BLOCK``
rows against blocks. Nothing holds a group in one task. Connected components run as large-star/small-star rounds over the
confirmed links. A large family of texts that share regions but no link is compared pair by pair, in the square of its size.

A pair with similarity 0.8 shares two leading values in one of 16 trees with probability 1 - 0.36 ** 16 = 1 - 8e-8, and as many
of all min-hashes as the completion asks for with probability 1 - 1e-7 at least; the candidate step can miss a link with
about those probabilities.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 7
#: Rows in a block of a region that is compared pair by pair.
_BLOCK = 128


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; of all its words if they are fewer; none without words."""
    data, offsets = common.text_bytes(column)
    for a, b in common.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        h, first = common.word_hashes(part, offsets[a : b + 1] - offsets[a])
        whole = common.shingle_hashes(h, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(whole[lo : hi - n + 1])
            elif hi > lo:
                yield common.mix(common.shingle_hashes(h[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def min_hashes(s: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions, as 32 bits."""
    out = np.full(len(multipliers), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), 512):
        block = s[at : at + 512, None] * multipliers[None, :]
        block += offsets[None, :]
        np.minimum(out, block.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def signed(df: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """doc_id, n_shingles, key (128 bits that stand for the set), sig (all min-hashes)."""
    rng = np.random.default_rng(SEED)
    k = trees * depth
    multipliers = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for s in sets_of(batch.column(1), n):
                sizes.append(len(s))
                if len(s):
                    keys.append(int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(common.mix(s).sum(dtype=np.uint64)).to_bytes(8, "big"))
                    sigs.append(min_hashes(s, multipliers, shifts).tobytes())
                else:
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary")


def _neighbours(ahead: int, least: int, percent: int, border: bool):
    """Over rows sorted by (label, id, n): candidate pairs, and with ``border`` the first and last rows as they came."""

    def pairs(label: np.ndarray, ids: np.ndarray, sizes: np.ndarray, new: int) -> pa.RecordBatch:
        a, b, at = [], [], []
        for j in range(1, min(ahead, len(ids) - 1) + 1):
            i = np.arange(max(0, new - j), len(ids) - j)
            alike = (label[i, : 1 + 4 * least] == label[i + j, : 1 + 4 * least]).all(axis=1) & (ids[i] != ids[i + j])
            small, large = np.minimum(sizes[i], sizes[i + j]), np.maximum(sizes[i], sizes[i + j])
            i = i[alike & (100 * small >= percent * large)]
            a.append(np.minimum(ids[i], ids[i + j]))
            b.append(np.maximum(ids[i], ids[i + j]))
            at.append((label[i] == label[i + j]).cumprod(axis=1).sum(axis=1))
        a, b, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, at))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(at, pa.int32()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())], ["a", "b", "shared", "label", "n"])

    def edge(label: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int32()), pa.array([x.tobytes() for x in label], pa.binary()), pa.array(sizes, pa.int64())], ["a", "b", "shared", "label", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = common.text_bytes(batch.column(0))
            now = data.reshape(batch.num_rows, -1), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if tail is None and border:
                yield edge(*(x[:ahead] for x in now))
            new = 0 if tail is None else len(tail[1])
            both = now if tail is None else tuple(np.concatenate(x) for x in zip(tail, now, strict=True))
            yield pairs(*both, new)
            tail = tuple(x[-ahead:] for x in both)
        if tail is not None and border:
            yield edge(*tail)

    return run


def candidates(reps: DataFrame, trees: int, depth: int, ahead: int, least: int, percent: int) -> DataFrame:
    """Distinct pairs a < b of neighbours in any of the sorted orders: a, b, seen (in how many), shared (bytes, the longest)."""
    rows = reps.select(
        F.explode(F.expr(f"transform(sequence(0, {trees - 1}), t -> concat(unhex(lpad(hex(t), 2, '0')), substring(sig, int(t) * {4 * depth} + 1, {4 * depth})))")).alias("label"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")
    )
    schema = "a long, b long, shared int, label binary, n long"
    dealt = rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id")
    found = common.written(dealt.mapInArrow(_neighbours(ahead, least, percent, True), schema), "neighbours")
    borders = found.where("b is null").select("label", F.col("a").alias("id"), "n").distinct().repartitionByRange(1, "label", "id").sortWithinPartitions("label", "id")
    crossing = borders.mapInArrow(_neighbours(ahead, least, percent, False), schema)
    both = found.where("b is not null").select("a", "b", "shared").unionByName(crossing.select("a", "b", "shared"))
    return both.groupBy("a", "b").agg(F.count("*").alias("seen"), F.max("shared").alias("shared"))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left, right = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def _regions(reps: DataFrame, label: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """Each row in each tree: region (tree and leading values), label, id, n, component so far."""
    rows = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tree = f"transform(sequence(0, {trees - 1}), t -> concat(unhex(lpad(hex(t), 2, '0')), substring(sig, int(t) * {4 * depth} + 1, {4 * depth})))"
    return rows.select(F.explode(F.expr(tree)).alias("label"), "id", "n", "component").withColumn("region", F.substring("label", 1, 1 + 4 * least))


def _unsettled(rows: DataFrame, ahead: int) -> DataFrame:
    """Regions in several components that the window can't have covered: region, rows, top (component with most rows), strays, apart (pairs)."""
    by = rows.groupBy("region", "component").agg(F.count("*").alias("k"))
    by = by.groupBy("region").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "component")).alias("top"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"))
    by = by.where((F.col("rows") > ahead + 1) & (F.col("top.k") < F.col("rows")))
    return by.select("region", "rows", F.col("top.component").alias("top"), (F.col("rows") - F.col("top.k")).alias("strays"), ((F.col("rows").cast("double") * F.col("rows") - F.col("squares")) / 2).alias("apart"))


def _led(inside: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of a region's leading rows, one in its largest component and one outside, with its rows of other components."""
    sides = inside.withColumn("main", F.col("component") == F.col("top"))
    common_label = sides.groupBy("region", "main", "label").agg(F.count("*").alias("k")).groupBy("region", "main").agg(F.max(F.struct("k", "label")).alias("m")).select("region", "main", "m.label")
    score = sides.join(common_label, ["region", "main", "label"], "left_semi").groupBy("id").agg(F.count("*").alias("score"))
    lead = sides.join(score, "id", "left").groupBy("region", "main").agg(F.max(F.struct(F.coalesce("score", F.lit(0)).alias("score"), (-F.col("id")).alias("order"), "id", "n", "component")).alias("l"))
    lead = lead.select("region", F.col("l.id").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.component").alias("lead_component"))
    met = inside.select("region", "id", "n", "component").join(lead, "region")
    met = met.where((F.col("component") != F.col("lead_component")) & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")))
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _agreeing(percent: int, k: int) -> int:
    """How many of k min-hashes a pair at ``percent`` shares with probability 1 - 1e-7 at least."""
    p, below = percent / 100, 0.0
    for t in range(k):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > 1e-7:
            return t
    return k


def _blocks_compared(trees: int, depth: int, least: int, percent: int):
    """Over rows sorted by (region, i, j): pairs of a stray row and any row of another component whose min-hashes agree enough."""
    enough = _agreeing(percent, trees * depth)

    def group(tree: int, left: np.ndarray, own: np.ndarray, ids: np.ndarray, sizes: np.ndarray, component: np.ndarray, sig: np.ndarray):
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        for at in range(0, len(x), 64):
            i = x[at : at + 64]
            for start in range(0, len(y), 256):
                j = y[start : start + 256]
                ok = component[i][:, None] != component[j][None, :]
                ok &= ~own[j][None, :] | (ids[i][:, None] < ids[j][None, :])  # two strays meet twice
                ok &= 100 * np.minimum(sizes[i][:, None], sizes[j][None, :]) >= percent * np.maximum(sizes[i][:, None], sizes[j][None, :])
                p, q = np.nonzero(ok)
                p, q = i[p], j[q]
                same = sig[p] == sig[q]
                take = same.sum(axis=1) >= enough
                first = same.reshape(len(p), trees, depth)[:, :, :least].all(axis=2).argmax(axis=1)  # a pair counts in its first tree
                take &= first == tree
                yield np.minimum(ids[p], ids[q])[take], np.maximum(ids[p], ids[q])[take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):  # None: the last group ends
            if batch is not None:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            elif held is None:
                return
            else:
                table = held
            table = table.combine_chunks()
            key = common.text_bytes(table["key"].chunk(0))[0].reshape(table.num_rows, -1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), *([table.num_rows] if batch is None else [])]
            sig = common.text_bytes(table["sig"].chunk(0))[0].reshape(table.num_rows, -1).view(np.uint32)
            left, own = (table[c].to_numpy().astype(bool) for c in ("left", "own"))
            ids, sizes, component = (table[c].to_numpy() for c in ("id", "n", "component"))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in itertools.pairwise(bounds):
                for x, y in group(int(key[lo, 0]), *(v[lo:hi] for v in (left, own, ids, sizes, component, sig))):
                    a.append(x)
                    b.append(y)
            held = table.slice(bounds[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _apart(inside: DataFrame, reps: DataFrame, trees: int, depth: int, least: int, percent: int) -> DataFrame:
    """Pairs a < b of all rows of different components in a region; each is compared in blocks, once over all trees."""
    own = F.col("component") != F.col("top")
    rows = inside.select("region", "id", "n", "component", own.alias("own"), F.ceil(F.col("strays") / _BLOCK).cast("int").alias("down"), F.ceil(F.col("rows") / _BLOCK).cast("int").alias("across"))
    rows = rows.join(reps.select(F.col("doc_id").alias("id"), "sig"), "id")
    every, dealt = (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))), (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    columns = ["region", "i", "j", "left", "own", "id", "n", "component", "sig"]
    left = rows.where("own").withColumn("i", dealt("down")).withColumn("j", every("across")).withColumn("left", F.lit(True)).select(columns)
    right = rows.withColumn("j", dealt("across")).withColumn("i", every("down")).withColumn("left", F.lit(False)).select(columns)
    key = F.concat("region", F.unhex(F.lpad(F.hex("i"), 8, "0")), F.unhex(F.lpad(F.hex("j"), 8, "0")))
    both = left.unionByName(right).withColumn("key", key).drop("region", "i", "j")
    return both.repartition("key").sortWithinPartitions("key").mapInArrow(_blocks_compared(trees, depth, least, percent), "a long, b long")


def completed(reps: DataFrame, links: DataFrame, sets_for, *, trees: int, depth: int, ahead: int, least: int, percent: int) -> DataFrame:
    """id, component over the links and all that the window has left out; ``sets_for`` makes the sets of a table of ids."""
    sets, before = None, math.inf
    while True:
        label = common.written(components(links), "labels")
        rows = _regions(reps, label, trees, depth, least)
        regions = common.written(_unsettled(rows, ahead), "regions")
        apart, members = regions.agg(F.sum("apart"), F.sum("rows")).first()
        if not apart:
            return label
        inside = common.written(rows.join(regions, "region"), "inside")
        if sets is None:  # components only grow, so later rounds need no other ids
            sets = sets_for(inside.select("id").distinct())
        led = apart > 8 * members and apart <= 0.9 * before
        pairs = _led(inside, percent) if led else _apart(inside, reps, trees, depth, least, percent)
        links = links.unionByName(common.written(confirmed(pairs, sets, percent), "links_more"))
        if not led:
            return components(links)
        before = apart


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, trees: int = 16, depth: int = 5, ahead: int = 4, least: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    Two documents are linked when 100 * intersection >= percent * union of their sets. Null or empty text, or text without
    words: size 0, linked with nothing. Rows that share an id count as one document; a row without an id is linked with
    nothing, kept, and has a null component_id. A pair at the very percentage is linked; a very long text takes arrays of some 50 times its
    bytes in one task. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = common.written(signed(base, shingle, trees, depth), "signatures")
    known = sigs.where("key is not null and doc_id is not null")
    reps = common.written(known.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r"), F.count("*").alias("members")).select("key", "r.*", "members"), "classes")
    pairs = common.written(candidates(reps, trees, depth, ahead, least, percent), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets_of(batch.column(1), shingle)], pa.binary())], ["id", "members"])

    def sets_for(ids: DataFrame) -> DataFrame:
        wanted = base.join(ids.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")  # alike at every size
        return common.written(wanted.mapInArrow(members, "id long, members binary"), "sets")

    sets = sets_for(ids)
    # First each document with the partner that it met most often; then all other candidates that still lie apart.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("seen", "shared", F.col("a") * -1)).alias("a"))
    first = common.written(confirmed(best, sets, percent), "links_1")
    up = first.select(F.col("b").alias("id"), F.col("a").alias("top"))  # a forest: every id has one smaller partner
    for _ in range(2):
        up = up.join(up.select(F.col("id").alias("top"), F.col("top").alias("next")), "top", "left").select("id", F.coalesce("next", "top").alias("top"))
    rest = pairs.join(up.select(F.col("id").alias("a"), F.col("top").alias("ta")), "a", "left").join(up.select(F.col("id").alias("b"), F.col("top").alias("tb")), "b", "left")
    rest = rest.where(F.coalesce("ta", "a") != F.coalesce("tb", "b")).join(best, ["a", "b"], "left_anti")
    links = first.unionByName(confirmed(rest, sets, percent))
    label = completed(reps, common.written(links, "links"), sets_for, trees=trees, depth=depth, ahead=ahead, least=least, percent=percent)
    found = reps.join(label, reps.doc_id == label.id, "left").where("members > 1 or component is not null").select("key", F.coalesce("component", "doc_id").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "key").join(found, "key", "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_class(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with their own columns, whatever their names, one of each class: that with the smallest id. Rows that share an id stay together.

    Null, empty and wordless texts and rows without an id stay; an empty table stays empty; other cases as in ``classes``.
    """
    name = common.fresh(docs.columns, "gone")
    gone = classes(docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
