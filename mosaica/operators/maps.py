"""Maps as a table of segments, and what is asked of them, as joins, windows and aggregates.

A segments table has the key columns of a document, ``seq``, and out_start, out_end, src_start, src_end (int), kind, rule. Joins are
on the document's key, so they shuffle on it once; inside a document, ranges are compared. For dense maps of very large documents
use the linear kernels (``kernels.composed``) in ``convert``; both give the same segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = "struct<out_start:int,out_end:int,src_start:int,src_end:int,kind:string,rule:string>"
FIELDS = ["out_start", "out_end", "src_start", "src_end", "kind", "rule"]
TRACEABLE = ("verbatim", "transformed")


def exploded(df: DataFrame, keys: list[str], column: str = "segments") -> DataFrame:
    """An array of segments as rows."""
    return df.select(*keys, F.posexplode(column).alias("seq", "s")).select(*keys, "seq", *(f"s.{f}" for f in FIELDS))


def collected(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as one array a document, in order."""
    parts = F.sort_array(F.collect_list(F.struct("seq", *FIELDS)))
    return segments.groupBy(*keys).agg(F.transform(parts, lambda s: F.struct(*(s[f].alias(f) for f in FIELDS))).alias("segments"))


def _out() -> Column:
    return F.col("out_end") - F.col("out_start")


def traceable_in(segments: Column) -> Column:
    """Characters of an array of segments that lead to a source."""
    return F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + F.when(s.kind.isin(*TRACEABLE), s.out_end - s.out_start).otherwise(0))


def answered_in(segments: Column) -> Column:
    """Source units that an array of segments answers with, over all traceable characters."""
    width = lambda s: F.when(s.kind == "verbatim", F.lit(1)).otherwise(s.src_end - s.src_start).cast("long")
    return F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + F.when(s.kind.isin(*TRACEABLE), width(s) * (s.out_end - s.out_start)).otherwise(0))


def coverage(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, characters, traceable, answered, coverage (1 if empty), width (1 if nothing is traceable)."""
    led = F.col("kind").isin(*TRACEABLE)
    width = F.when(F.col("kind") == "verbatim", F.lit(1)).otherwise(F.col("src_end") - F.col("src_start")).cast("long")
    sums = segments.groupBy(*keys).agg(F.sum(_out()).alias("characters"), F.sum(F.when(led, _out()).otherwise(0)).alias("traceable"), F.sum(F.when(led, width * _out()).otherwise(0)).alias("answered"))
    return sums.select("*", ratio("traceable", "characters").alias("coverage"), ratio("answered", "traceable").alias("width"))


def ratio(over: str, under: str) -> Column:
    return F.when(F.col(under) == 0, F.lit(1.0)).otherwise(F.col(over) / F.col(under))


def merge(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Verbatim segments that continue each other joined to one: islands by a running count of breaks. seq is renumbered."""
    order = W.partitionBy(*keys).orderBy("seq")
    goes_on = (F.col("kind") == "verbatim") & (F.lag("kind").over(order) == "verbatim") & (F.lag("out_end").over(order) == F.col("out_start")) & (F.lag("src_end").over(order) == F.col("src_start"))
    marked = segments.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "island").agg(F.min("out_start").alias("out_start"), F.max("out_end").alias("out_end"), F.min("src_start").alias("src_start"), F.max("src_end").alias("src_end"), F.first("kind").alias("kind"), F.first("rule").alias("rule"))
    return out.select(*keys, (F.col("island") - 1).cast("int").alias("seq"), *FIELDS)


def _overlap(a: str, b: str, sides: tuple[str, str] = ("out", "out")) -> Column:
    """Both ranges have positions, and share one."""
    (x, y), (u, v) = (f"{a}.{sides[0]}_start", f"{a}.{sides[0]}_end"), (f"{b}.{sides[1]}_start", f"{b}.{sides[1]}_end")
    return (F.col(x) < F.col(v)) & (F.col(u) < F.col(y)) & (F.col(x) < F.col(y)) & (F.col(u) < F.col(v))


def compose(first: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """One map for two stages, as an interval join within each document; the segments of ``kernels.composed``.

    Verbatim stretches of ``later`` are carried through the segments of ``first`` that they overlap; segments of ``first`` without
    output go once, to the first stretch that touches them; all else of ``later`` takes the hull of its sources.
    """
    a, b = first.alias("a"), later.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    shift = F.col("b.out_start") - F.col("b.src_start")
    low, high = F.greatest("a.out_start", "b.src_start"), F.least("a.out_end", "b.src_end")
    exact, move = F.col("a.kind") == "verbatim", F.col("a.src_start") - F.col("a.out_start")
    own = [F.col(f"b.{k}").alias(k) for k in keys]
    verbatim = F.col("b.kind") == "verbatim"
    through = a.join(b, on & verbatim & _overlap("a", "b", ("out", "src"))).select(
        *own, F.col("b.seq").alias("at"), F.col("a.seq").alias("of"), (low + shift).alias("out_start"), (high + shift).alias("out_end"),
        F.when(exact, low + move).otherwise(F.col("a.src_start")).alias("src_start"), F.when(exact, high + move).otherwise(F.col("a.src_end")).alias("src_end"), F.col("a.kind").alias("kind"), F.col("a.rule").alias("rule"),
    )
    point = (F.col("a.out_start") == F.col("a.out_end")) & (F.col("b.src_start") <= F.col("a.out_start")) & (F.col("a.out_start") <= F.col("b.src_end"))
    met = a.join(b, on & verbatim & point).select(*own, F.col("a.seq").alias("of"), F.struct(F.col("b.seq").alias("at"), (F.col("a.out_start") + shift).alias("p"), *(F.col(f"a.{f}").alias(f) for f in ("src_start", "src_end", "kind", "rule"))).alias("s"))
    carried = met.groupBy(*keys, "of").agg(F.min_by("s", F.col("s.at")).alias("s")).select(*keys, F.col("s.at").alias("at"), "of", F.col("s.p").alias("out_start"), F.col("s.p").alias("out_end"), "s.src_start", "s.src_end", "s.kind", "s.rule")
    asked = later.where("kind <> 'verbatim'").select(*keys, F.col("seq").alias("range"), F.col("src_start").alias("start"), F.col("src_end").alias("end"), *(F.col(f).alias(f"own_{f}") for f in ("out_start", "out_end", "kind", "rule")))
    whole = resolve(first, asked, keys).select(*keys, F.col("range").alias("at"), F.lit(-1).alias("of"), F.col("own_out_start").alias("out_start"), F.col("own_out_end").alias("out_end"), F.coalesce("src_start", F.lit(0)).alias("src_start"), F.coalesce("src_end", F.lit(0)).alias("src_end"), F.col("own_kind").alias("kind"), F.col("own_rule").alias("rule"))
    every = through.unionByName(carried).unionByName(whole)
    order = W.partitionBy(*keys).orderBy("at", "out_start", "out_end", "of")
    return every.select(*keys, (F.row_number().over(order) - 1).alias("seq"), *FIELDS)


def _touches() -> Column:
    """Segment s bears on range r: overlap, or for a point any touch."""
    point = (F.col("r.start") == F.col("r.end")) & (F.col("s.out_start") <= F.col("r.start")) & (F.col("r.start") <= F.col("s.out_end"))
    return point | ((F.col("s.out_start") < F.col("r.end")) & (F.col("r.start") < F.col("s.out_end")) & (F.col("r.start") < F.col("r.end")) & (F.col("s.out_start") < F.col("s.out_end")))


def resolve(segments: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Every range (keys, range, start, end, further columns) with src_start, src_end: the hull of what it came from; null if nothing bears on it."""
    s, r = segments.alias("s"), ranges.alias("r")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    for x in on[1:]:
        on[0] = on[0] & x
    move, exact = F.col("s.src_start") - F.col("s.out_start"), F.col("s.kind") == "verbatim"
    low = F.when(exact, F.greatest("s.out_start", "r.start") + move).otherwise(F.col("s.src_start"))
    high = F.when(exact, F.least("s.out_end", "r.end") + move).otherwise(F.col("s.src_end"))
    hulls = r.join(s, on[0] & _touches()).groupBy(*(F.col(f"r.{c}").alias(c) for c in [*keys, "range"])).agg(F.min(low).alias("src_start"), F.max(high).alias("src_end"))
    return ranges.join(hulls, [*keys, "range"], "left")


def passed(segments: DataFrame, ranges: DataFrame, keys: list[str], inclusive_end: bool = False) -> DataFrame:
    """Every range with the kinds and rules that it passes through, in order of first meeting; removals inside it count.

    ``inclusive_end``: a segment that starts exactly at the range's end counts too (the in-memory variant of the question).
    """
    s, r = segments.alias("s"), ranges.alias("r")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    for x in on[1:]:
        on[0] = on[0] & x
    empty = F.col("s.out_start") == F.col("s.out_end")
    inside = (F.col("r.start") <= F.col("s.out_start")) & ((F.col("s.out_start") < F.col("r.end")) | ((F.col("r.start") == F.col("r.end")) & (F.col("s.out_start") == F.col("r.start"))))
    hit = F.when(empty, inside).otherwise(_touches())
    if inclusive_end:
        hit = hit | (F.col("s.out_start") == F.col("r.end"))
    met = r.join(s, on[0] & hit).groupBy(*(F.col(f"r.{c}").alias(c) for c in [*keys, "range"])).agg(F.sort_array(F.collect_list(F.struct("s.seq", "s.kind", "s.rule"))).alias("m"))
    named = met.select(*keys, "range", F.array_distinct(F.col("m.kind")).alias("kinds"), F.array_distinct(F.array_compact(F.col("m.rule"))).alias("rules"))
    return ranges.join(named, [*keys, "range"], "left").select(*ranges.columns, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("kinds", "rules")))


def faults(segments: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, fault: gap_or_overlap, backward, verbatim_length, removal_with_output, or short (seq null). ``lengths``: keys, characters, source_unit."""
    order = W.partitionBy(*keys).orderBy("seq")
    rows = segments.join(lengths.select(*keys, "source_unit"), keys).withColumn("before", F.coalesce(F.lag("out_end").over(order), F.lit(0)))
    found = F.array_compact(
        F.array(
            F.when(F.col("before") != F.col("out_start"), "gap_or_overlap"), F.when((F.col("out_end") < F.col("out_start")) | (F.col("src_end") < F.col("src_start")), "backward"),
            F.when((F.col("kind") == "verbatim") & (F.col("source_unit") == "characters") & (_out() != F.col("src_end") - F.col("src_start")), "verbatim_length"),
            F.when((F.col("kind") == "removal") & (_out() != 0), "removal_with_output"),
        )
    )
    each = rows.select(*keys, "seq", F.explode(found).alias("fault"))
    ends = segments.groupBy(*keys).agg(F.max_by("out_end", "seq").alias("reached"))
    short = lengths.join(ends, keys, "left").where(F.coalesce("reached", F.lit(0)) != F.col("characters")).select(*keys, F.lit(None).cast("int").alias("seq"), F.lit("short").alias("fault"))
    return each.unionByName(short)


def pack(df: DataFrame, keys: list[str], column: str = "segments") -> DataFrame:
    """keys, kinds, rules (each value once, in order of first use), rows of (out_length, src_start, src_end, kind, rule or null) by number."""
    named = df.select(*keys, F.col(column).alias("m"), F.array_distinct(F.col(column)["kind"]).alias("kinds"), F.array_distinct(F.array_compact(F.col(column)["rule"])).alias("rules"))
    row = lambda s: F.array(s.out_end - s.out_start, s.src_start, s.src_end, F.array_position(F.col("kinds"), s.kind).cast("int") - 1, F.when(s.rule.isNotNull(), F.array_position(F.col("rules"), s.rule).cast("int") - 1))
    return named.select(*keys, "kinds", "rules", F.transform("m", row).alias("rows"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The segments table of packed maps: output starts are a running sum of lengths. Names stand for their numbers before rows are sorted, so that no row carries its map's tables."""
    named = lambda r: F.struct(r[0].alias("w"), r[1].alias("src_start"), r[2].alias("src_end"), F.col("kinds")[r[3]].alias("kind"), F.when(r[4].isNotNull(), F.col("rules")[r[4]]).alias("rule"))
    rows = packed.select(*keys, F.posexplode(F.transform("rows", named)).alias("seq", "s")).select(*keys, "seq", "s.*")
    order = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("w").over(order).cast("int")
    return rows.withColumn("out_end", end).select(*keys, "seq", (F.col("out_end") - F.col("w")).alias("out_start"), *FIELDS[1:])


def read_sidecar(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Segments of stored maps (JSON strings) in either layout: rows of numbers with tables, or one object a segment."""
    numbers = F.from_json(body, "kinds array<string>, rules array<string>, segment_fields array<string>, segments array<array<int>>")
    objects = F.from_json(body, "segments array<struct<out:array<int>,src:array<int>,kind:string,rule:string>>")
    is_rows = F.get_json_object(body, "$.segments[0].kind").isNull()
    new = rows.where(is_rows).select(*keys, numbers.alias("n"))
    new = unpack(new.select(*keys, "n.kinds", "n.rules", F.col("n.segments").alias("rows")), keys)
    old = rows.where(~is_rows).select(*keys, F.posexplode(objects["segments"]).alias("seq", "s"))
    return new.unionByName(old.select(*keys, "seq", F.expr("s.out[0]").alias("out_start"), F.expr("s.out[1]").alias("out_end"), F.expr("s.src[0]").alias("src_start"), F.expr("s.src[1]").alias("src_end"), "s.kind", "s.rule"))


def ending_segments(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The map of making CRLF and CR line feeds: tokens by one regular expression, offsets by running sums. ``kernels.endings`` gives the same, for use inside a conversion."""
    tokens = df.select(*keys, F.posexplode(F.regexp_extract_all(text_col, F.lit("\r\n?|[^\r]+"), F.lit(0))).alias("seq", "t"))
    ends = F.startswith("t", F.lit("\r"))
    order = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    width, read = F.when(ends, 1).otherwise(F.length("t")), F.length("t")
    rows = tokens.select(*keys, "seq", F.sum(width).over(order).cast("int").alias("out_end"), F.sum(read).over(order).cast("int").alias("src_end"), width.alias("w"), read.alias("r"), ends.alias("e"))
    return rows.select(*keys, "seq", (F.col("out_end") - F.col("w")).alias("out_start"), "out_end", (F.col("src_end") - F.col("r")).alias("src_start"), "src_end", F.when(F.col("e"), "transformed").otherwise("verbatim").alias("kind"), F.when(F.col("e"), "line_ending").alias("rule"))
