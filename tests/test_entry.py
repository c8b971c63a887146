"""The driver's contract: imports without a session, with and without the training-data operators; queries equal their SQL at the smallest scale."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def _said(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_entry_imports_in_a_fresh_process_without_a_session():
    n, _ = _said(ROOT)
    assert int(n) >= 60


def test_entry_imports_without_the_training_data_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "mosaica", tmp_path / "mosaica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, pipeline = _said(tmp_path)
    assert int(n) >= 60 and pipeline == "False"


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dict):
        return tuple(map(_value, v.values()))
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def _own() -> list[str]:
    from mosaica.plans import corpus_queries, map_queries, registry, text_queries  # noqa: F401

    return sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", _own())
def test_query_equals_its_sql(spark, duck, name):
    from mosaica.plans import registry

    df, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted((tuple(_value(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(_value(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert all(not (isinstance(x, float) and math.isnan(x)) for r in got for x in r)
