"""Kernels work off a batch some rows at a time, and give what they gave before."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaica.functions import batches, screening, urls
from mosaica.operators import convert

ROWS = 5000


def _counting():
    """A kind of text, and how many of its kind are held."""
    n = [0]

    class Text(str):
        def __init__(self, *_):
            n[0] += 1

        def __del__(self):
            n[0] -= 1

    return Text, n


def test_slices_hold_every_row_once():
    rows = ["a" * 10, None, "", "b" * 500, "é" * 20, *["c"] * 9]
    for column in (pa.array(rows), pa.array(rows).cast(pa.large_string()), pa.array(["x", *rows]).slice(1), pa.array([r and r.encode() for r in rows])):
        found = list(batches.slices(column, 45, 4))
        assert [i for a, n in found for i in range(a, a + n)] == list(range(len(rows)))
        assert all(n <= 4 and (n == 1 or sum(len(x.as_py() if isinstance(x.as_py(), bytes) else (x.as_py() or "").encode()) for x in column.slice(a, n)) <= 45) for a, n in found)
    assert list(batches.slices(pa.array([], pa.string()))) == []


def test_a_kernel_holds_some_rows_of_a_batch(spark):
    made, n = _counting()

    def held(t):
        return {"text": made(t), "held": n[0]}

    rows = spark.range(ROWS, numPartitions=1).select("id", F.col("id").cast("string").alias("t")).select("id", "t", batches.kernel(held, "struct<text:string,held:int>")("t").alias("k")).collect()
    assert len(rows) == ROWS and all(r.k.text == r.t for r in rows)
    assert max(r.k.held for r in rows) <= batches.MOST_ROWS + 1


def test_conversion_holds_some_rows_of_a_batch(spark):
    made, n = _counting()

    def held(content, media_type):
        return convert.Converted(made(content.decode()), [], n[0])

    registry = convert.standard()
    registry.offer("held@1", held)
    units = spark.range(ROWS, numPartitions=1).select("id", F.lit("text/plain").alias("media_type"), F.col("id").cast("string").cast("binary").alias("content"))
    rows = convert.convert(units, registry.chosen({"text/plain": "held@1"})).select("id", "converted.text", "converted.source_length").collect()
    assert sorted((r.id, r.text) for r in rows) == [(i, str(i)) for i in range(ROWS)]
    assert max(r.source_length for r in rows) <= batches.MOST_ROWS + 1


@pytest.mark.parametrize("query", ["text_cleanse", "cleanse_segments", "find_urls", "signature_findings", "align_lines"])
def test_queries_use_such_kernels(spark, tmp_path, query):
    from mosaica.plans import map_queries, registry, text_queries  # noqa: F401

    spark.sql("select 1L as doc_id, 'see https://e.test/?utm_x=1' as text").write.parquet(str(tmp_path / "documents.parquet"))
    plan = registry.QUERIES[query](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    assert " run(" in plan or "[run(" in plan


def test_nulls_through_kernels(spark):
    rows = spark.createDataFrame([(0, None), (1, "x"), (2, "https://e.test/?utm_a=1 " + "A" * 40)], "i int, t string")
    got = rows.select("i", urls.cleansing(F.col("t")).alias("c"), urls.urls(F.col("t")).alias("u"), screening.found(F.col("t")).alias("f")).orderBy("i").collect()
    assert got[0].c is None and got[0].u is None and got[0].f == []
    assert got[1].c.text == "x" and got[1].u == [] and got[2].c.text == "https://e.test/ " + "A" * 40 and len(got[2].u) == 1


def test_composition_runs_the_kernel_once_before_it(spark, tmp_path):
    from mosaica.plans import map_queries

    spark.sql("select 1L as doc_id, 'see https://e.test/?utm_x=1' as text").write.parquet(str(tmp_path / "documents.parquet"))
    assert "Python" not in map_queries.compose_maps(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
