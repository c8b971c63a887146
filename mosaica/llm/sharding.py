"""Sharding by histogram sort, in DataFrame functions only: shards hold nearly equal bytes.

Documents are ordered by (hash of the text, hash of the id, a serial number), so equal texts stand together and any group of them can be
cut. Exact bytes and rows below candidate key boundaries are counted over all partitions; the cells that hold a wanted splitter are
probed again with finer boundaries, until every splitter lies within the tolerance or between two neighbouring rows. Then rows
are exchanged once, by (shard, key).

Scale: only the splitters between shards are refined, so a round gathers at most (shards - 1) x probes counts, whatever the rows. Slots are a
row's number in its task of the one exchange, less that of the shard's first row there, plus the shard's rows in the tasks before;
the table of these offsets has a row for each task and shard border. Every count reads a narrow table of keys and sizes, not the texts.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

PROBES = 256
KEY = ["h", "d", "s"]


def _counts() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, and the key: h, d, s (parts rows that are alike in both), and bucket (h's 12 leading bits)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.xxhash64(text)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        h.alias("h"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("d"), F.monotonically_increasing_id().alias("s"), F.shiftright(h, 52).cast("int").alias("bucket"),
    )


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """First key of each shard but the first, in order; shards past the last row have none. ``tolerance`` is a share of a shard's mean bytes."""
    spark = keys.sparkSession

    def boundaries(rows, before: int) -> list:
        out = []
        for r in sorted(rows, key=lambda r: r.low):
            out.append((tuple(r.low), tuple(r.high), before, r.bytes, r.n))
            before += r.bytes
        return out

    known = boundaries(keys.groupBy("bucket").agg(*_counts()).collect(), 0)  # at most 4,096 rows
    if not known:
        return []
    total = known[-1][2] + known[-1][3]
    wanted = [total * j / shards for j in range(1, shards)]
    while True:
        starts, probed = [k[2] for k in known], set()
        for t in wanted:
            i = bisect_right(starts, t) - 1
            low, high, before, size, _ = known[i]
            if min(t - before, before + size - t) > tolerance * total / shards and low != high:
                probed.add(i)
        if not probed:
            break
        cells = []
        for i in probed:
            low, high = known[i][:2]
            level = next(k for k in range(3) if low[k] != high[k])
            cells.append((i, low[0] >> 52, level, known[i][4] <= PROBES, *low, *high, low[level], -(-(high[level] - low[level] + 1) // PROBES)))
        small = spark.createDataFrame(cells, "cell int, bucket int, level int, few boolean, h0 long, d0 long, s0 long, h1 long, d1 long, s1 long, base long, step long")
        inside = (F.struct(*KEY) >= F.struct("h0", "d0", "s0")) & (F.struct(*KEY) <= F.struct("h1", "d1", "s1"))
        met = keys.join(F.broadcast(small), "bucket").where(inside)  # at most a cell for each splitter
        # Integer division: a double would lose low bits of a 64-bit key. The distance may pass 2 ** 63 only within a bucket of 2 ** 52.
        probe = F.expr("(case level when 0 then h when 1 then d else s end - base) div step")
        counted: dict[int, list] = {}
        row = F.when(F.col("few"), F.struct(*KEY))  # a cell of so few rows is told apart at once
        for r in met.groupBy("cell", probe.alias("probe"), row.alias("row")).agg(*_counts()).collect():  # at most splitters x probes rows
            counted.setdefault(r.cell, []).append(r)
        known = [y for i, k in enumerate(known) for y in (boundaries(counted[i], k[2]) if i in probed else [k])]
    starts, out = [k[2] for k in known], []
    for t in wanted:
        i = bisect_right(starts, t) - 1
        if i + 1 < len(known) and known[i + 1][2] - t < t - known[i][2]:
            i += 1
        out.append(known[i][0])
    return out


def placed(keys: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """The keys' rows with shard and slot."""
    cut = splitters(keys, shards, tolerance)
    own = F.lit(0)
    for key in cut:
        own = own + (F.struct(*KEY) >= F.struct(*(F.lit(x).cast("long").alias(k) for k, x in zip(KEY, key, strict=True)))).cast("int")
    order = ["shard", *KEY]
    # monotonically_increasing_id: the task in the high 31 bits, the row's number there in the low 33.
    dealt = keys.withColumn("shard", own).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = common.written(dealt.select("doc_id", "size", "text_crc32", "shard", F.shiftright("at", 33).cast("int").alias("task"), F.expr("at & 8589934591").alias("nth")), "dealt")
    tasks = dealt.groupBy("shard", "task").agg(F.min("nth").alias("first"), F.count("*").alias("n"))  # a row for each task and border of shards
    before = W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = tasks.select("shard", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return dealt.join(F.broadcast(offsets), ["shard", "task"]).withColumn("slot", F.col("offset") + F.col("nth"))


def shard(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard (from 0), slot (gapless from 0 in its shard), grown_shard (null).

    Null or empty text has no bytes. Shards' bytes differ from the mean by at most the tolerance and one document at either end, so a
    very long text may leave shards uneven or empty. Ties of the key are broken by the reading order: repeated rows each get a slot and
    may be parted; rows without an id are ordered as any other. An empty table gives no rows; other columns are ignored.
    """
    keys = common.written(keyed(docs, id_col, text_col), "keys")
    return placed(keys, shards, tolerance).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
