"""Tracking parameters of URLs: one URL a row natively, and URLs inside texts by a kernel that only rows with a URL reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaica import dims
from mosaica.functions import batches
from mosaica.functions.text import content_hash
from mosaica.operators import kernels
from mosaica.operators.maps import SEGMENT


def query_span(url: Column) -> Column:
    """struct of start (of the question mark) and end (before a fragment), from 0; null without a query."""
    mark = F.locate("?", url)
    hash_ = F.instr(F.substring(url, mark, F.length(url)), "#")
    return F.when(mark > 0, F.struct((mark - 1).alias("start"), F.when(hash_ > 0, mark + hash_ - 2).otherwise(F.length(url)).alias("end")))


def query(url: Column) -> Column:
    """The text of the query after the question mark; null without one."""
    span = query_span(url)
    return F.substring(url, span["start"] + 2, span["end"] - span["start"] - 1)


def rule_of(name: Column, pack: dims.Ruleset = dims.CORE) -> Column:
    """struct of id and kind of the rule that claims a name, null if none: a literal map, then prefixes in order of precedence."""
    rule = "struct<id:string,kind:string>"
    none = F.lit(None).cast(rule)
    if not pack.rules:
        return none
    pairs = [x for r in pack.rules if r.match == "exact" for x in (F.lit(r.value), F.struct(F.lit(r.id).alias("id"), F.lit(r.kind).alias("kind")))]
    found = [F.create_map(*pairs)[name]] if pairs else []
    for r in sorted((r for r in pack.rules if r.match == "prefix"), key=lambda r: r.precedence):
        found.append(F.when(name.startswith(r.value), F.struct(F.lit(r.id).alias("id"), F.lit(r.kind).alias("kind"))))
    return F.coalesce(*found, none)


def _name(part: Column) -> Column:
    return F.substring_index(part, "=", 1)


def _claimed(name: Column, pack: dims.Ruleset) -> Column:
    exact, prefixes = [r.value for r in pack.rules if r.match == "exact"], [r.value for r in pack.rules if r.match == "prefix"]
    hit = name.isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        hit = hit | name.startswith(p)
    return hit


def cleansed(url: Column, pack: dims.Ruleset = dims.CORE) -> Column:
    """The URL without claimed parameters; the query goes with its question mark when nothing is left of it."""
    span = query_span(url)
    parts = F.split(query(url), "&")
    kept = F.filter(parts, lambda p: ~_claimed(_name(p), pack))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    new = F.concat(F.substring(url, F.lit(1), span["start"]), rest, F.substring(url, span["end"] + 1, F.length(url)))
    return F.when(span.isNull() | (F.size(kept) == F.size(parts)), url).otherwise(new)


def removals(df: DataFrame, keys: list[str], url_col: str, pack: dims.Ruleset = dims.CORE) -> DataFrame:
    """keys, rule, kind, start, end, characters, hash: one row a parameter that a rule takes; never its value."""
    url = F.col(url_col)
    parts = df.where(url.contains("?")).select(*keys, query_span(url)["start"].alias("mark"), F.split(query(url), "&").alias("parts"))
    each = parts.select(*keys, "mark", "parts", F.posexplode("parts").alias("i", "part"))
    start = F.col("mark") + 1 + F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.lit(0), lambda n, p: n + F.length(p) + 1)
    each = each.withColumn("rule", rule_of(_name(F.col("part")), pack)).where("rule is not null and part <> ''")
    return each.select(*keys, F.col("rule.id").alias("rule"), F.col("rule.kind").alias("kind"), start.alias("start"), (start + F.length("part")).alias("end"), F.length("part").alias("characters"), content_hash(F.col("part")).alias("hash"))


def claims(names: DataFrame, rules: DataFrame, name_col: str = "name") -> DataFrame:
    """names with the rule and kind that take precedence, null if none: the join form, on a broadcast table of rules (one pack: some dozens of rows)."""
    n, r = names.alias("n"), F.broadcast(rules).alias("r")
    meets = F.when(F.col("r.match") == "exact", F.col(f"n.{name_col}") == F.col("r.value")).otherwise(F.col(f"n.{name_col}").startswith(F.col("r.value")))
    order = W.partitionBy(f"n.{name_col}").orderBy(F.when(F.col("r.match") == "exact", 0).otherwise(1), -F.length("r.value"), "r.id")
    met = n.select(name_col).distinct().alias("n").join(r, meets).select(F.col(f"n.{name_col}").alias(name_col), F.col("r.id").alias("rule"), F.col("r.kind").alias("kind"), F.row_number().over(order).alias("k"))
    return names.join(met.where("k = 1").drop("k"), name_col, "left")


def has_url(text: Column) -> Column:
    return text.contains("http://") | text.contains("https://")


_SPANS = "array<struct<start:int,end:int>>"
_CLEANSED = f"struct<text:string,segments:array<{SEGMENT}>,removals:array<struct<rule:string,kind:string,start:int,end:int,characters:int,hash:string>>>"


def urls(text: Column) -> Column:
    """Array of start, end of all URLs of a text; texts without one don't reach the kernel."""

    def find(t):
        return None if t is None else [{"start": a, "end": b} for a, b in kernels.urls(t)]

    return F.coalesce(batches.kernel(find, _SPANS)(F.when(has_url(text), text)), F.when(text.isNotNull(), F.array().cast(_SPANS)))


def cleansing(text: Column, pack: dims.Ruleset = dims.CORE) -> Column:
    """struct of the cleansed text, its map and its removals. Rows without a URL get the identity map natively."""
    import hashlib

    def clean(t):
        if t is None:
            return None
        edits, taken = kernels.cleansing(t, pack)
        out, segments = kernels.rewritten(t, edits)
        return {"text": out, "segments": [s._asdict() for s in segments], "removals": [{"rule": r, "kind": k, "start": a, "end": b, "characters": b - a, "hash": "sha256:" + hashlib.sha256(x.encode()).hexdigest()} for r, k, a, b, x in taken]}

    n = F.length(text)
    one = F.array(F.struct(F.lit(0).alias("out_start"), n.alias("out_end"), F.lit(0).alias("src_start"), n.alias("src_end"), F.lit("verbatim").alias("kind"), F.lit(None).cast("string").alias("rule")))
    same = F.struct(text.alias("text"), F.when(n > 0, one).otherwise(F.array().cast(f"array<{SEGMENT}>")).alias("segments"), F.array().cast("array<struct<rule:string,kind:string,start:int,end:int,characters:int,hash:string>>").alias("removals"))
    return F.coalesce(batches.kernel(clean, _CLEANSED)(F.when(has_url(text), text)), F.when(text.isNotNull(), same))
