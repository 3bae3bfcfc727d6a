"""Running values over long groups: each group is cut into slices of its order, so no task sorts a whole hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a slice of all groups together holds on average.
SLICE_ROWS = 1_000_000


def sliced(df: DataFrame, at: Column, rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """df with _slice, and how many slices there are: equal stretches of at (a number), as many as make about so many rows each; null stays first."""
    n, low, high = df.select(at.alias("_at")).agg(F.count("*"), F.min("_at"), F.max("_at")).first()
    parts = max(1, -(-n // rows))
    if parts == 1 or low is None or low == high:
        return df.withColumn("_slice", F.lit(0).cast("long")), 1
    return df.withColumn("_slice", F.coalesce(F.floor((at - F.lit(low)).cast("double") / (float(high - low) / parts)), F.lit(-1)).cast("long")), parts


def _beside(df: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """df with what is known of its slice; null groups meet too."""
    names = [*by, "_slice"]
    side = found.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(names)], *[c for c in found.columns if c not in names])
    same = reduce(lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(side[f"_by{i}"]) for i, c in enumerate(names)])
    return df.join(side, same, "left").drop(*[f"_by{i}" for i in range(len(names))])


def carried(cut: tuple[DataFrame, int], by: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """sliced() rows and, for each name -> (kind, column), what the slices of its group before, or behind, its own hold.

    Kinds: sum, min, max over all slices before; last or first: the last value before or the first one behind that isn't null, of a
    struct (order, value). Only a row for each group and slice meets in a window.
    """
    df, parts = cut
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*by).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    own = {"sum": F.sum, "min": F.min, "max": F.max, "last": F.max, "first": F.min}
    per = df.groupBy(*by, "_slice").agg(*[own[kind](c).alias(name) for name, (kind, c) in values.items()])
    if parts == 1:  # nothing is before or behind
        return df.withColumns({name: F.lit(None).cast(per.schema[name].dataType) for name in values})
    over = {"sum": (F.sum, before), "min": (F.min, before), "max": (F.max, before), "last": (lambda c: F.last(c, ignorenulls=True), before), "first": (lambda c: F.first(c, ignorenulls=True), behind)}
    found = per.select(*by, "_slice", *[over[kind][0](name).over(over[kind][1]).alias(name) for name, (kind, _) in values.items()])
    return _beside(df, found, by)


def running_total(df: DataFrame, by: list[str], order: list, at: Column, value: Column, name: str, rows: int = SLICE_ROWS) -> DataFrame:
    """df with the running total of value in each group, own row included. order decides inside a slice; at grows with it."""
    cut = carried(sliced(df.withColumn("_v", value), at, rows), by, {"_carry": ("sum", F.col("_v"))})
    w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(df.select(value.alias("v")).schema["v"].dataType)
    return cut.withColumn(name, F.coalesce("_carry", zero) + F.coalesce(F.sum("_v").over(w), zero)).drop("_carry", "_v", "_slice")
