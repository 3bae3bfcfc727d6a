"""Counts, histograms and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import micros


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Values with their counts; the null group counts no values."""
    return df.groupBy(column).agg(F.count(column).alias("n"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def active_users(events: DataFrame, user: str, ts: str, unit: str) -> DataFrame:
    """Distinct users by day, week (from Monday) or month."""
    return events.groupBy(F.to_date(F.date_trunc(unit, ts)).alias("period")).agg(F.countDistinct(user).alias("users"))


def time_histogram(events: DataFrame, ts: str, hours: int = 2) -> DataFrame:
    """Counts in equal bins of about so many hours from the first to the last time; the last bin holds its end."""
    at = micros(ts)
    ends = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    bins = F.greatest(F.floor(F.floor((F.col("hi") - F.col("lo")) / 3.6e9) / hours), F.lit(1)).cast("long")
    placed = events.select(at.alias("at")).crossJoin(F.broadcast(ends.withColumn("bins", bins)))  # one row of ends
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("at") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1))
    return placed.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, function: str = "count", of: str | None = None, cumulative: bool = False) -> DataFrame:
    """count, sum, avg, min or max in equal bins of [low, high]; cumulative: running totals."""
    agg = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[function](F.col(of or value))
    out = df.where(F.col(value).between(low, high)).groupBy(F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("long").alias("bin")).agg(agg.alias("y"))
    return out.withColumn("y", F.sum("y").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))) if cumulative else out


def queue_stats(items: DataFrame, status: str, updated: str, now: str) -> DataFrame:
    """One row: counts by status P, R, C, F, E, the share of errors and how many run for over a day."""
    counts = items.agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in "PRCFE"], F.count_if((F.col(status) == "R") & (F.col(updated) <= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY"))).alias("long_running"))
    return counts.withColumn("error_percent", F.when(F.col("n_f") > 0, F.round(100 * F.col("n_e") / (F.col("n_e") + F.col("n_f")), 6)).otherwise(F.lit(0.0)))


def tag_stats(items: DataFrame, tags: str, status: str) -> DataFrame:
    """Counts by status for each tag, and a row for all items; an item of several tags counts for each."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in "PRCFE"]
    each = items.select(F.explode(tags).alias("tag"), status).groupBy("tag").agg(*counts)
    return each.unionByName(items.agg(*counts).withColumn("tag", F.lit("total")))


def ledger_sums(df: DataFrame, group: str, amount: str) -> DataFrame:
    """Exact decimal sums, and whether a group balances."""
    return df.groupBy(group).agg(F.sum(F.col(amount).cast("decimal(30,6)")).alias("total")).withColumn("balanced", F.col("total") == 0)


def pattern_counts(df: DataFrame, key: str, text: str, patterns: dict[str, float]) -> DataFrame:
    """How often each pattern stands in a text, in long form, with its weight."""
    items = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("weight"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n")) for p, w in patterns.items()])
    return df.select(key, F.explode(items).alias("c")).select(key, "c.*").where("n > 0")
