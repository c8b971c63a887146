"""The relational reading orders against the kernels."""

import random

import pytest

from mosaica.operators import kernels as K
from mosaica.operators import reading

SCHEMA = "page int, n int, text string, x double, y double"


@pytest.mark.parametrize("order", ["rows", "columns"])
def test_pages_read_as_by_the_kernel_without_python(spark, order):
    rng = random.Random(3)
    pages = {p: [(i, f"t{i}", float(rng.randrange(0, 120, 4)), rng.random() * 40) for i in range(rng.randrange(1, 40))] for p in [*range(30), None]}
    runs = spark.createDataFrame([(p, *r) for p, rows in pages.items() for r in rows], SCHEMA)
    found = reading.ordered(runs, ["page"], order)
    assert {r.page: r.text for r in found.collect()} == {p: K.ordered_text(K.ORDERS[order]([K.Placed(*r[1:]) for r in rows])) for p, rows in pages.items()}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_null_texts_are_not_there(spark):
    runs = spark.createDataFrame([(1, 0, None, 0.0, 90.0), (1, 1, "a", 0.0, 50.0), (1, 2, None, 9.0, 50.0), (1, 3, "b", 0.0, 10.0), (2, 0, None, 0.0, 0.0)], SCHEMA)
    assert {r.page: r.text for r in reading.ordered(runs, ["page"]).collect()} == {1: "a\nb", 2: None}


@pytest.mark.parametrize("name", ["reading_order_rows", "reading_order_columns"])
def test_queries_hand_no_page_to_python(spark, tmp_path, name):
    from mosaica.plans import map_queries

    spark.sql("select 1L as event_id, 2L as user_id, 'a' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    assert "Python" not in getattr(map_queries, name)(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
