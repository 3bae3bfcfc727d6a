"""Time series: as-of lookups, interpolation, deltas, running best, status timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import SLICE_ROWS, carried, sliced


def micros(c: Column | str) -> Column:
    """Microseconds of a time, with or without a zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def best_so_far(df: DataFrame, value: str, order: list, by: list[str] = (), at: Column | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """The first row and every row strictly below all before it.

    at: a number that grows with the order; a long group is then cut into slices of it, and only the minima of slices meet.
    """
    if at is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_m", F.min(value).over(w)).where(F.col("_m").isNull() | (F.col(value) < F.col("_m"))).drop("_m")
    cut = carried(sliced(df, at, rows), list(by), {"_before": ("min", F.col(value))})
    w = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_m", F.least("_before", F.min(value).over(w)))
    return cut.where(F.col("_m").isNull() | (F.col(value) < F.col("_m"))).select(*[F.col(f"`{c}`") for c in df.columns])


def since_best(df: DataFrame, value: str, at: str, by: list[str], margin: float = 0.001) -> DataFrame:
    """For each group, rows that finished with or after the best one and are worse by more than a margin."""
    best = df.groupBy(*by).agg(F.min(F.struct(value, at)).alias("b"))
    return df.join(best, by).groupBy(*by).agg(F.count_if((F.col(value) > F.col(f"b.{value}") + margin) & (F.col(at) >= F.col(f"b.{at}"))).alias("since"))


def as_of_forward(prices: DataFrame, item: str, at: str, price: str, since: Column, gap_days: int = 180) -> DataFrame:
    """For each item its first price on or after a date, unless it is gap_days or more later."""
    first = prices.where(F.col(at) >= since).groupBy(item).agg(F.min(F.struct(at, price)).alias("f"))
    return first.select(item, F.col(f"f.{at}").alias("base_at"), F.col(f"f.{price}").alias("base_price")).where(micros("base_at") - micros(since) < gap_days * 86_400_000_000)


def _place(df: DataFrame) -> Column:
    """The time _t as a number that grows with it."""
    return micros("_t") if dict(df.dtypes)["_t"].startswith(("timestamp", "date")) else F.col("_t")


def as_of(events: DataFrame, points: DataFrame, by: list[str], at: str, value: str, rows: int = SLICE_ROWS) -> DataFrame:
    """events with the latest value of points at or before their time, by one union and one window; long groups are cut into
    slices of time, and of each slice only its last value goes on."""
    tagged = points.select(*by, F.col(at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_k"), F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("_e"))
    asked = events.select(*by, F.col(at).alias("_t"), F.lit(None).cast(points.schema[value].dataType).alias("_v"), F.lit(1).alias("_k"), F.struct("*").alias("_e"))
    both = tagged.unionByName(asked)
    cut = carried(sliced(both, _place(both), rows), list(by), {"_last": ("last", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))})
    w = Window.partitionBy(*by, "_slice").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_last._v"))).where("_k = 1").select("_e.*", F.col("_v").alias(f"as_of_{value}"))


def interpolate(asked: DataFrame, points: DataFrame, by: list[str], at: str, value: str, rows: int = SLICE_ROWS) -> DataFrame:
    """asked with value of points at their time, linear between neighbours and held at both ends; long groups are cut into slices of
    time, and of each slice only its first and last point go on."""
    p = points.select(*by, F.col(at).alias("_t"), F.struct(micros(at).alias("t"), F.col(value).cast("double").alias("v")).alias("_p"), F.lit(0).alias("_k"))
    q = asked.select(*by, F.col(at).alias("_t"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_k"))
    cut = carried(sliced(p.unionByName(q), micros("_t"), rows), list(by), {"_before": ("last", F.col("_p")), "_behind": ("first", F.col("_p"))})
    w = Window.partitionBy(*by, "_slice").orderBy("_t", "_k")
    own = {"_a": F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first("_p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}
    both = cut.withColumns({"_a": F.coalesce(own["_a"], "_before"), "_b": F.coalesce(own["_b"], "_behind")})
    share = (micros("_t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    inside = F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a.v")).otherwise(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))
    return both.where("_k = 1").select(*by, F.col("_t").alias(at), F.coalesce(inside, "_a.v", "_b.v").alias(value))


def deltas(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """df with the change of value from the row before, and in percent."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({"delta": F.col(value) - before, "delta_pct": F.when(before != 0, 100 * (F.col(value) - before) / before)})


def window_stats(prices: DataFrame, item: str, at: str, price: str) -> DataFrame:
    """First, least, greatest and last price of each item, and the change in percent."""
    s = prices.groupBy(item).agg(F.min_by(price, at).alias("start"), F.min(price).alias("low"), F.max(price).alias("high"), F.max_by(price, at).alias("latest"))
    return s.withColumn("change", 100 * (F.col("latest") - F.col("start")) / F.col("start"))


def buying_power(cpi: DataFrame, at: str, value: str) -> DataFrame:
    """What the last value of an index is worth at each time."""
    last = cpi.agg(F.max_by(value, at).alias("_last"))
    return cpi.crossJoin(F.broadcast(last)).withColumn("buying_power", F.col("_last") / F.col(value)).drop("_last")  # one row


def first_status(history: DataFrame, item: str, status: str, at: str, wanted: str) -> DataFrame:
    return history.where(F.col(status) == wanted).groupBy(item).agg(F.min(at).alias("first_at"))


def days_between(history: DataFrame, item: str, status: str, at: str, start: str, end: str) -> DataFrame:
    """Whole days from the first start to the first end of each item."""
    first = history.groupBy(item).agg(F.min(F.when(F.col(status) == start, F.col(at))).alias("s"), F.min(F.when(F.col(status) == end, F.col(at))).alias("e"))
    return first.where("s IS NOT NULL AND e IS NOT NULL").select(item, ((micros("e") - micros("s")) / 86_400_000_000).cast("long").alias("days"))


def staged_pivot(df: DataFrame, parent: str, stage: str, stages: list[str], value: str, order: str) -> DataFrame:
    """A row for each parent with the last value of each stage; missing stages are null."""
    return df.groupBy(parent).pivot(stage, stages).agg(F.max_by(value, order))
