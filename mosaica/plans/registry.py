"""Queries by name, and the DuckDB SQL of each. A query reads its whole tables; decorations are SQL that both engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Tables with the features that the given ones lack, as SQL for both engines.
DECORATED = {
    "crlf": "select doc_id, replace(text, chr(10), case when doc_id % 2 = 0 then chr(13) || chr(10) else chr(13) end) as text from {documents}",
    "linked": "select doc_id, text || ' see https://e.test/p/' || cast(doc_id as string) || '?utm_source=a&id=' || cast(doc_id as string) || '&ref=z.' as text from {documents}",
    "both": "select doc_id, replace(text || ' see https://e.test/p/' || cast(doc_id as string) || '?utm_source=a&id=' || cast(doc_id as string) || '&ref=z.', chr(10), case when doc_id % 2 = 0 then chr(13) || chr(10) else chr(13) end) as text from {documents}",
    "fronted": """
        select doc_id, case doc_id % 5 when 0 then '---' || chr(10) || 'title: "Doc: ' || cast(doc_id as string) || '"' || chr(10) || 'layer: fact' || chr(10) || '---' || chr(10) || text
          when 1 then '# Doc ' || cast(doc_id as string) || chr(10) || chr(10) || text when 2 then '---' || chr(10) || 'tags: x' || chr(10) || '...' || chr(10) || '## Under ' || chr(10) || text
          when 3 then '---' || chr(10) || 'title:' || chr(10) || '---' || chr(10) || '# No' || chr(10) || text else text end as text from {documents}""",
    "keyed": """
        select doc_id, case doc_id % 7 when 0 then text || ' ' || 'gh' || 'p_' || repeat('a', 36) || '.' when 1 then text || ' x' || 'gh' || 'p_' || repeat('b', 36) when 2 then text || ' ' || 'gh' || 'p_' || repeat('c', 10)
          when 3 then text || ' ' || 'AK' || 'IA' || repeat('Z', 16) else text end as text from {documents}""",
    "paged": """
        select doc_id, '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><h1>Doc ' || cast(doc_id as string) || '</h1><p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><footer>made by us</footer></body></html>' as text
        from {documents}""",
    "snapshot2": """
        select case when doc_id % 13 = 0 then 'moved/' else 'd/' end || cast(doc_id as string) as path, case when doc_id % 7 = 0 then text || '!' else text end as text from {documents} where doc_id % 11 <> 0
        union all select 'new/' || cast(doc_id as string), 'New ' || cast(doc_id as string) from {documents} where doc_id % 17 = 0""",
    "snapshot1": "select 'd/' || cast(doc_id as string) as path, text from {documents}",
    "changes": """
        with last as (select day, path, hash from (select cast(ts as date) as day, 'u/' || cast(user_id as string) as path, case when event_type = 'error' then null else event_type end as hash,
            row_number() over (partition by cast(ts as date), user_id order by event_id desc) as k from {events}) where k = 1),
          was as (select *, lag(hash) over (partition by path order by day) as previous from last)
        select cast(dense_rank() over (order by day) as bigint) as entry_seq, path, case when previous is null then 'added' when hash is null then 'removed' else 'changed' end as op, hash, previous
        from was where not (hash is null and previous is null) and (hash is null or previous is null or hash <> previous)""",
}


def sql(name: str) -> str:
    """A decoration as a DuckDB subquery."""
    return "(" + DECORATED[name].replace("{documents}", "documents").replace("{events}", "events") + ")"


def decorated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A decoration as a DataFrame."""
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "events") if "{" + t + "}" in DECORATED[name]}
    if name == "changes":
        return _numbered(spark.sql(DECORATED[name].replace(_ENTRY, "day"), **given))
    return spark.sql(DECORATED[name], **given)


_ENTRY = "cast(dense_rank() over (order by day) as bigint) as entry_seq"


def _numbered(dated: DataFrame) -> DataFrame:
    """Changes with their days numbered. The SQL's rank would bring all rows into one task; here the days, which are few, are ranked by themselves."""
    days = dated.select(F.col("day").alias("on")).distinct().select("on", F.row_number().over(W.orderBy(F.asc_nulls_last("on"))).cast("long").alias("entry_seq"))
    return dated.join(F.broadcast(days), F.col("day").eqNullSafe(F.col("on"))).select("entry_seq", "path", "op", "hash", "previous")


def query(oracle: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
