"""Token/span overlap on exploded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Widths in characters: cells hold the ends of spans, ranges what lies between.
CELL = 32
RANGE = 1024


def cut(size: int, at: Column) -> Column:
    """Number of the place of this width that holds a position."""
    return F.floor(at / size).cast("bigint")


def places(size: int, first: Column, last: Column) -> Column:
    """Places first..last of one width as (width, number); none if first > last."""
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.struct(F.lit(size).alias("_size"), n.alias("_n")))


def filed_places(spans: DataFrame, keys: Sequence[str], cell: int = CELL, wide: int = RANGE) -> DataFrame:
    """``keys, idx, _from, _to, _size, _n``: the entries of spans that are not empty."""
    start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
    # Whole ranges of a span are low..high - 1.  Its cells are those before and after them.
    low, high = cut(wide, start + wide - 1), cut(wide, end)
    first, last, per = cut(cell, start), cut(cell, end - 1), wide // cell
    filed = F.when(low < high, F.concat(
        places(wide, low, high - 1), places(cell, first, low * per - 1), places(cell, high * per, last),
    )).otherwise(places(cell, first, last))
    return spans.filter((start < end) & F.col("idx").isNotNull()).select(
        *keys, F.col("idx").cast("bigint").alias("idx"), start.alias("_from"), end.alias("_to"), F.inline(filed)
    )


def first_overlaps(
    tokens: DataFrame, spans: DataFrame, keys: Sequence[str], cell: int = CELL, wide: int = RANGE
) -> DataFrame:
    """Token rows with ``span_idx``, the lowest ``idx`` among overlapping spans, or NULL.

    ``tokens``: keys, pos, start, end.  ``spans``: keys, idx, start, end.  Overlap is an
    equi-join on places of the text at two widths.  A span is filed under every range it
    covers whole, and under the cells of the at most two ranges it covers in part, so a
    span over a whole long text costs one entry per range.  For a covered place only the
    lowest index counts, which is found before the shuffle; spans that end inside a cell
    are kept by their clipped ends, at most ``cell * cell / 2`` of them per cell.  A token
    is joined on its range, mostly one, and looks into its cells there; the ranges of a
    long text spread over many tasks.  NULL keys and empty spans or tokens meet nothing.
    """
    if wide % cell:
        raise ValueError("a range must hold whole cells")
    start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
    size, number = F.col("_size"), F.col("_n")
    clip = filed_places(spans, keys, cell, wide).dropna(subset=list(keys)).select(
        *keys, "idx", F.when(size == wide, number).otherwise(cut(wide, number * cell)).alias("_range"),
        F.when(size == cell, number).alias("_cell"),
        F.greatest("_from", number * size).alias("_from"), F.least("_to", (number + 1) * size).alias("_to"),
    )
    lowest = clip.groupBy(*keys, "_range", "_cell", "_from", "_to").agg(F.min("idx").alias("_idx"))
    # One row per range: the lowest index that covers it, and the clipped spans of each cell.  All that
    # follows is per range, so rows are dealt by it once.
    cells = lowest.repartition(*keys, "_range").groupBy(*keys, "_range", "_cell").agg(F.collect_list(F.struct("_from", "_to", "_idx")).alias("_spans"))
    known = cells.groupBy(*keys, "_range").agg(
        F.min(F.when(F.col("_cell").isNull(), F.get("_spans", F.lit(0))["_idx"])).alias("_cover"),
        F.map_from_entries(F.collect_list(F.when(F.col("_cell").isNotNull(), F.struct("_cell", "_spans")))).alias("_cells"),
    )

    # A token that asks for nothing keeps one row with a NULL range.
    asked = F.when(start < end, F.sequence(cut(wide, start), cut(wide, end - 1)))
    rows = tokens.select(*keys, "pos", "start", "end", F.explode_outer(asked).alias("_range"))
    low, high = cut(cell, start), cut(cell, end - 1)
    none = F.array().cast("array<struct<_from:bigint,_to:bigint,_idx:bigint>>")
    near = F.when(low == high, F.col("_cells")[low]).otherwise(
        F.flatten(F.transform(F.sequence(low, high), lambda c: F.coalesce(F.col("_cells")[c], none)))
    )
    met = F.filter(near, lambda s: (start < s["_to"]) & (end > s["_from"]))
    first = F.array_min(F.transform(met, lambda s: s["_idx"]))
    hits = rows.join(known, [*keys, "_range"], "left").withColumn("_idx", F.least("_cover", F.when(F.col("_cells").isNotNull(), first)))
    # Repeated tokens come together where they were joined; only those of several ranges are moved again.
    kind = spans.schema["idx"].dataType
    once = hits.groupBy(*keys, "_range", "pos", "start", "end").agg(F.min("_idx").alias("_idx"))
    several = F.coalesce((start < end) & (cut(wide, start) < cut(wide, end - 1)), F.lit(False))
    apart = once.filter(several).groupBy(*keys, "pos", "start", "end").agg(F.min("_idx").alias("_idx"))
    columns = [*keys, "pos", "start", "end", F.col("_idx").cast(kind).alias("span_idx")]
    return once.filter(~several).select(*columns).unionByName(apart.select(*columns))
