"""Rows by their place: a distributed row index, columns attached by position, running counts over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Stage

#: Rows of a range that running_count totals by itself.
RANGE_ROWS = 1 << 16


def with_index(df: DataFrame, name: str = "index") -> DataFrame:
    """df with the place of each row, from 0, in the order of its partitions and of the rows in them.

    The rows are written once with their partition and place in it, so that they stay the same; counts of the partitions, a row
    for each, give what stands before. No window runs over the rows.
    """
    rows = Stage(df.sparkSession, "indexed")(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each partition
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def beside_by_place(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two frames side by side, row by row as they stand; an error if one has more rows. Of equal names b's count."""
    a, b = with_index(a, "_place"), with_index(b, "_place")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return a.drop(*[c for c in b.columns if c != "_place"]).join(b, "_place").drop("_place")


def add_column(df: DataFrame, name: str, values: list) -> DataFrame:
    """df with a column of given values, in order; an error if there are more or fewer values than rows."""
    made = df.sparkSession.createDataFrame([(v,) for v in values], [name]) if values else df.sparkSession.createDataFrame([], f"{name} string")
    return beside_by_place(df, made.coalesce(1))


def running_count(df: DataFrame, place: str, hit: Column, name: str) -> DataFrame:
    """df with the number of hits before each place; ranges of places are totalled first, so no task sees all rows."""
    rows = df.withColumns({"_r": F.floor(F.col(place) / RANGE_ROWS), "_h": F.when(hit, 1).otherwise(0)})
    totals = rows.groupBy("_r").agg(F.sum("_h").alias("_t"))
    before = totals.select("_r", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum("_h").over(Window.partitionBy("_r").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "_r").withColumn(name, F.col("_b") + own).drop("_r", "_h", "_b")
