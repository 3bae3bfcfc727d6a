"""Price series against earlier years and against inflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def years_before(at: Column, years: int) -> Column:
    """The same calendar day so many years ago; February 29 becomes 28 where there is none."""
    return F.add_months(at, -12 * years)


def year_deltas(prices: DataFrame, item: str, at: str, price: str, years: list[int], cpi: DataFrame | None = None) -> DataFrame:
    """(item, years, then, now, delta, percent, percent_real): the last price against the first one on or after the same day
    so many years before it. cpi (year, index) gives percent_real, the change without inflation, and None leaves it null.

    Prices and reference days meet by item only; the least later day is a partial aggregate, so no item is sorted.
    """
    last = prices.groupBy(item).agg(F.max(F.struct(F.col(at).cast("date").alias("day"), F.col(price).alias("now"))).alias("l")).select(item, "l.day", "l.now")
    asked = last.select(item, "now", "day", F.explode(F.array(*[F.lit(y) for y in years])).alias("years")).withColumn("since", F.expr("add_months(day, -12 * years)"))
    met = prices.select(item, F.col(at).cast("date").alias("then_day"), F.col(price).alias("then")).join(asked, item).where("then_day >= since")
    first = met.groupBy(item, "years", "now", "day").agg(F.min(F.struct("then_day", "then")).alias("f")).select(item, "years", "now", "day", "f.then_day", "f.then")
    out = first.withColumns({"delta": F.col("now") - F.col("then"), "percent": F.when(F.col("then") != 0, 100 * (F.col("now") - F.col("then")) / F.col("then"))})
    if cpi is None:
        return out.withColumn("percent_real", F.lit(None).cast("double"))
    index = lambda n: cpi.select(F.col("year").alias(f"_y{n}"), F.col("index").alias(f"_i{n}"))
    out = out.join(F.broadcast(index("a")), F.year("then_day") == F.col("_ya"), "left").join(F.broadcast(index("b")), F.year("day") == F.col("_yb"), "left")
    fair = F.col("then") * F.col("_ib") / F.col("_ia")
    return out.withColumn("percent_real", F.when(fair != 0, 100 * (F.col("now") - fair) / fair)).drop("_ya", "_yb", "_ia", "_ib")


def window_change(prices: DataFrame, item: str, at: str, price: str, years: int, cpi: DataFrame) -> DataFrame:
    """(item, start, low, high, latest, change, change_real) over the last so many years of each item's days.

    change is in percent from the first price in the window to the last, change_real against the first one in the last one's money
    (cpi: year, index); null where the first price or an index is 0 or missing. All are partial aggregates; no item is sorted.
    """
    last = prices.groupBy(item).agg(F.max(F.col(at).cast("date")).alias("_last"))
    inside = prices.withColumn("_day", F.col(at).cast("date")).join(last, item).where(F.col("_day") >= years_before(F.col("_last"), years))
    s = inside.groupBy(item).agg(F.min_by(price, "_day").alias("start"), F.min("_day").alias("_first"), F.min(price).alias("low"), F.max(price).alias("high"), F.max_by(price, "_day").alias("latest"), F.max("_day").alias("_end"))
    index = lambda n: cpi.select(F.col("year").alias(f"_y{n}"), F.col("index").alias(f"_i{n}"))
    # a row for each year
    s = s.join(F.broadcast(index("a")), F.year("_first") == F.col("_ya"), "left").join(F.broadcast(index("b")), F.year("_end") == F.col("_yb"), "left")
    fair = F.col("start") * F.col("_ib") / F.when(F.col("_ia") != 0, F.col("_ia"))
    percent = lambda base: F.when(base != 0, 100 * (F.col("latest") - base) / base)
    return s.select(item, "start", "low", "high", "latest", percent(F.col("start")).alias("change"), percent(fair).alias("change_real"))
