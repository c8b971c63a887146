"""Reading order of placed strings as aggregates and joins; the text of ``kernels.in_rows`` and ``in_columns``, for tables of many pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floors(values: Column, apart: float) -> Column:
    """An array of distinct values as the floors of its clusters, in order (``kernels.floors``)."""
    first = F.array().cast("array<double>")
    return F.aggregate(F.sort_array(values), first, lambda known, v: F.when((F.size(known) == 0) | (v - F.element_at(known, -1) > apart), F.array_append(known, v)).otherwise(known))


def _floor(value: str, known: str) -> Column:
    return F.array_max(F.filter(known, lambda f: f <= F.col(value)))


def ordered(runs: DataFrame, keys: list[str], order: str = "rows", gap: float = 24.0, tolerance: float = 4.0) -> DataFrame:
    """keys, text of each page. ``runs``: keys, n (their order on the page), text, x, y (doubles; y counts upwards); null texts aren't there.

    Floors come from the distinct places of a page and are joined to its strings; lines are put together first, then pages of lines.
    """
    page = [F.col(k).alias(f"page_{k}") for k in keys]
    bases = runs.groupBy(*page).agg(F.collect_set("x").alias("xs"), F.collect_set("y").alias("ys")).select(*(f"page_{k}" for k in keys), floors(F.col("xs"), gap).alias("sides"), floors(F.col("ys"), tolerance).alias("bases"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"page_{k}"))
    side = F.lit(0.0) if order == "rows" else _floor("x", "sides")
    placed = runs.join(bases, on).select(*keys, "n", "text", "x", side.alias("side"), (-_floor("y", "bases")).alias("down"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("x", "n", "text")))), lambda r: r.text), " ")
    lines = placed.groupBy(*keys, "side", "down").agg(F.when(F.count("text") > 0, line).alias("line"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("side", "down", "line")))), lambda r: r.line), "\n")
    return lines.groupBy(*keys).agg(F.when(F.count("line") > 0, whole).alias("text"))
