"""Selecting rows: list tests, seeded selections, ordering rules, stop conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(values: Column, given: list, mode: str = "include") -> Column:
    """include: all values are given; include_all: exactly the given ones; exclude: none of them."""
    wanted = F.array(*[F.lit(v) for v in given])
    if mode == "include":
        return F.size(F.array_except(values, wanted)) == 0
    if mode == "include_all":
        return F.array_sort(F.array_distinct(values)) == F.array_sort(F.array_distinct(wanted))
    if mode == "exclude":
        return ~F.arrays_overlap(values, wanted)
    raise ValueError(mode)


def matches(text: Column, patterns: list[str], mode: str = "any") -> Column:
    """Whether any or all patterns stand in a text."""
    tests = F.array(*[F.regexp_like(text, F.lit(p)) for p in patterns])
    return F.exists(tests, lambda x: x) if mode == "any" else F.forall(tests, lambda x: x)


def apply_filter(df: DataFrame, test: Column, mode: str = "rows", inverse: bool = False, index: str | None = None) -> DataFrame:
    """A test's rows, a flag for each row, their number or their places (values of index)."""
    test = F.coalesce(~test if inverse else test, F.lit(inverse))
    if mode == "flags":
        return df.withColumn("passes", test)
    if mode == "count":
        return df.agg(F.count_if(test).alias("n"))
    kept = df.where(test)
    return kept.select(index) if mode == "index" else kept


def _drawn(digest: Column) -> Column:
    """The first 32 bits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def truncated(df: DataFrame, order: list, n: int, share: float = 0.05, least: int = 5, most: int = 50, seed: int = 0) -> DataFrame:
    """n parents drawn with replacement from the best share of rows, least to most of them."""
    best = max(least, min(most, int(n * share)))
    pool = df.orderBy(*order).limit(best).withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)
    size = pool.count()
    draws = df.sparkSession.range(n).select("id", F.pmod(_drawn(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))), F.lit(max(1, size))).cast("int").alias("_place"))
    return draws.join(F.broadcast(pool), "_place").drop("_place").withColumnRenamed("id", "draw")  # at most `most` rows


def tournament(df: DataFrame, value: str, key: str, n: int, share: float = 0.2, seed: int = 0, least: int = 3) -> DataFrame:
    """n times the best of a seeded sample of rows: a row enters round r if its hash with r falls under the share; the
    rows of the least hashes enter too, so that a round has at least so many."""
    rounds = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    rounds = rounds.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col(key).cast("string"))))
    enters = rounds.where(F.pmod(_drawn(F.col("_h")), F.lit(10_000)) < int(share * 10_000))
    # Spark keeps the least rows of each partition before it shuffles
    first = rounds.withColumn("_n", F.row_number().over(Window.partitionBy("draw").orderBy("_h", key))).where(F.col("_n") <= least).drop("_n")
    return enters.unionByName(first).groupBy("draw").agg(F.min(F.struct(value, key)).alias("b")).select("draw", f"b.{key}", f"b.{value}")


def stop_condition(df: DataFrame, value: str, finished: str, most: int, survival: int, least: int, exact: Column, margin: float = 0.001) -> DataFrame:
    """One row: completed rows, rows worse than the best since it finished, and whether a search should stop."""
    best = df.agg(F.min(F.struct(value, finished)).alias("b"))
    counts = df.crossJoin(F.broadcast(best)).agg(F.count(finished).alias("completed"), F.count_if(exact).alias("n_exact"), F.count_if((F.col(value) > F.col(f"b.{value}") + margin) & (F.col(finished) >= F.col(f"b.{finished}"))).alias("since_best"))  # one row
    return counts.withColumn("stop", (F.col("n_exact") >= least) & ((F.col("completed") > most) | (F.col("since_best") > survival)))


def oldest_pending(items: DataFrame, status: str, created: str, key: str, tags: Column | None = None) -> DataFrame:
    """The next work item: pending, with a matching tag, oldest first."""
    test = F.col(status) == "P"
    return items.where(test if tags is None else test & tags).orderBy(created, key).limit(1)


def even_sample(df: DataFrame, stratum: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of each stratum, by a seeded hash."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
