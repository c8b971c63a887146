"""Line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation, so a line that stands
everywhere costs one small sketch a task. Lines whose estimate lies well over ``min_sites`` are boilerplate, lines well below aren't,
and those between get an exact distinct count. Boilerplate lines are removed from all documents, but for documents that are
copies: where spread lines hold at least half of the characters the whole document recurs, which is for near-dedup to settle, so
it is left as it is and no content is lost.

Scale: lines travel as 8-byte hashes with the site, never as text. The hashes of boilerplate lines are handed to all tasks
while there are at most ``most_handed`` (8 bytes each); beyond that the documents' hashes are joined with them instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_BLANK = " \t\x0b\x0c\r"
#: The sketches' error is below 7 % at 2 ** 8 slots; this many times that is near the threshold.
LG_SLOTS, NEAR = 8, 0.3


def _hashes(text) -> F.Column:
    """Hashes of the lines that hold a word."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    return F.transform(lines, lambda x: F.xxhash64(x))


def spread_lines(docs: DataFrame, *, min_sites: int, site_col: str, text_col: str) -> DataFrame:
    """h: hashes of the lines that stand on at least ``min_sites`` different sites (null sites aren't counted)."""
    lines = docs.select(F.col(site_col).alias("site"), F.explode(F.array_distinct(_hashes(F.col(text_col)))).alias("h")).where("site is not null")
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(LG_SLOTS)).alias("s"))
    estimates = common.written(sketches.select("h", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= (1 - NEAR) * min_sites), "spread")
    near = estimates.where(F.col("n") <= (1 + NEAR) * min_sites).select("h")
    exact = lines.join(near, "h").groupBy("h").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    return estimates.where(F.col("n") > (1 + NEAR) * min_sites).select("h").unionByName(exact.select("h"))


def _cut(handed: np.ndarray | None, at: int, names: list[str], into: str):
    """Kernel: cuts the lines whose hashes are handed; without ``handed`` each row brings its own in the column behind ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, results = [], []
            own = batch.column(len(names)).to_pylist() if handed is None else None
            for row, text in enumerate(batch.column(at).to_pylist()):
                spread = handed if own is None else np.sort(np.array(own[row] or [], np.int64))
                lines = (text or "").split("\n")
                words = [bool(x.strip(_BLANK)) for x in lines]
                hit = np.zeros(len(lines), bool)
                if len(spread):
                    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in lines], np.uint64).view(np.int64)
                    i = np.searchsorted(spread, h)
                    hit = (spread[np.minimum(i, len(spread) - 1)] == h) & np.array(words)
                cut = sum(len(x) for x, y in zip(lines, hit, strict=True) if y)
                whole = sum(len(x) for x, y in zip(lines, words, strict=True) if y)
                if cut and 2 * cut < whole:
                    texts.append("\n".join(x for x, y in zip(lines, hit, strict=True) if not y))
                    results.append({"n_lines": sum(words), "n_removed": int(hit.sum()), "copied": False})
                else:
                    texts.append(text)
                    results.append({"n_lines": sum(words), "n_removed": 0, "copied": cut > 0})
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(results, _RESULT)], [*names, into])

    return run


_RESULT = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("copied", pa.bool_())])


def dedup(docs: DataFrame, *, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", into: str = "lines", most_handed: int = 2_000_000) -> DataFrame:
    """All input columns, the text without boilerplate lines, and ``into``: struct of n_lines (that hold a word), n_removed, copied.

    copied: spread lines hold at least half of the characters, so the document is left whole. Lines are told apart by 64-bit
    hashes of all their characters; blank lines always stay. Null text stays null with no lines; an empty one has none. A line on just
    ``min_sites`` sites is spread. A column named like ``into`` is replaced, no other is touched; a very long text is split in one worker. Repeated
    rows are treated alike; an empty table gives no rows. Both ways of handing out the hashes give the same rows.
    """
    docs = docs.drop(into).withColumn(text_col, F.col(text_col).cast("string"))
    names = docs.columns
    at = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType.fromDDL("n_lines long, n_removed long, copied boolean"))])
    spread = common.written(spread_lines(docs, min_sites=min_sites, site_col=site_col, text_col=text_col), "boilerplate")
    if spread.count() <= most_handed:
        handed = np.sort(np.array([r.h for r in spread.collect()], np.int64))
        return docs.mapInArrow(_cut(handed, at, names, into), schema)
    key, size, met = (common.fresh(names, x) for x in ("key", "size", "met"))
    marked = docs.withColumn(key, F.xxhash64(text_col)).withColumn(size, F.length(text_col))
    hashes = docs.select(F.xxhash64(text_col).alias(key), F.length(text_col).alias(size), F.explode(F.array_distinct(_hashes(F.col(text_col)))).alias("h")).distinct().join(spread, "h")
    hits = hashes.groupBy(key, size).agg(F.collect_list("h").alias(met))  # no longer than a document's own lines
    rows = marked.join(hits, [key, size], "left").select(*(F.col(f"`{c}`") for c in names), met)
    return rows.mapInArrow(_cut(None, at, names, into), schema)


def without_boilerplate(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """The documents with their own columns, whatever their names, and the lines cut; ``chars_col`` gets the new length where lines went. Cases as in ``dedup``."""
    names, lines = docs.columns, common.fresh(docs.columns, "lines")
    out = dedup(docs, text_col=text_col, into=lines, **options)
    if chars_col in names:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(lines)["n_removed"] > 0, F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.select(*(F.col(f"`{c}`") for c in names))
