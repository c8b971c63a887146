"""The changes by day, and histories that are followed through moves, at the size of tables: no task and no group takes all."""

from datetime import datetime, timedelta

from mosaica.operators import history
from mosaica.plans import registry

SCHEMA = "entry_seq long, path string, op string, hash string, previous string"


def test_days_are_numbered_without_bringing_all_changes_to_one_task(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=5 * i), i % 7, ("view", "error", "click")[i * i % 3]) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = registry.decorated(spark, str(tmp_path), "changes")
    want = spark.sql(registry.DECORATED["changes"], events=events)
    assert found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "rank" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_moves_are_followed_family_by_family(spark):
    tied = [(1, "a", "added", "h", None), (2, "a", "removed", None, "h"), (2, "b", "added", "h", None), (3, "b", "changed", "i", "h"), (4, "b", "removed", None, "i"), (4, "c", "added", "i", None)]
    alone = [x for p in range(50) for x in ((1, f"p{p}", "added", f"q{p}", None), (3, f"p{p}", "changed", f"r{p}", f"q{p}"), (5, f"p{p}", "removed" if p % 2 else "changed", None, f"r{p}"))]
    found = history.blame_followed(spark.createDataFrame(tied + alone, SCHEMA))
    got = {r.path: tuple(r)[1:] for r in found.collect()}
    assert got == {"c": (1, 4, 3, ["b", "a"])} | {f"p{p}": (1, 5, 2, []) for p in range(0, 50, 2)}
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_families_go_on_over_batches():
    import pyarrow as pa

    rows = [("f", 1, 1, "a", None, None), ("f", 2, 0, "a", "b", None), ("f", 2, 1, "b", None, "a"), ("f", 3, 2, "b", None, None), ("g", 2, 2, "x", None, None)]
    names = ["family", "entry_seq", "step", "path", "new", "old"]
    parts = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))], pa.schema([(n, pa.int64() if n in ("entry_seq", "step") else pa.string()) for n in names])) for r in rows]
    got = [tuple(r.values()) for b in history._followed(iter(parts), 1) for r in b.to_pylist()]
    assert got == [("b", 1, 3, 2, ["a"]), ("x", None, 2, 1, [])]
