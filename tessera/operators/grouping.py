"""Grouping and stability: leader clusters and lower hulls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butina(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Leader clusters of a neighbour graph: the row with most neighbours (of equals the one with the larger key)
    and its free neighbours are a cluster, again and again. Rounds take all rows that beat every free neighbour and every
    neighbour of those, so that clusters far apart are found at once."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    degree = both.groupBy("x").agg(F.count("*").alias("d"))
    rows = nodes.select(F.col(key).alias("x")).join(degree, "x", "left").select("x", F.struct(F.coalesce("d", F.lit(0)).alias("d"), F.col("x").alias("i")).alias("rank"))
    free, done = rows.checkpoint(), None
    both = both.checkpoint()
    while free.take(1):
        live = both.join(free.select("x"), "x", "left_semi").join(free.select(F.col("x").alias("y"), F.col("rank").alias("ry")), "y")
        one = live.groupBy("x").agg(F.max("ry").alias("m"))
        near = free.join(one, "x", "left").select("x", "rank", F.greatest("rank", F.coalesce("m", "rank")).alias("m1"))
        two = live.join(near.select(F.col("x").alias("y"), "m1"), "y").groupBy("x").agg(F.max("m1").alias("m2"))
        lead = near.join(two, "x", "left").where((F.col("rank") == F.col("m1")) & (F.col("rank") >= F.coalesce("m2", "rank"))).select("x")
        own = lead.select("x", F.col("x").alias("cluster")).unionByName(live.select("x", "y").join(lead.withColumnRenamed("x", "y"), "y").select("x", F.col("y").alias("cluster"))).checkpoint()
        done = own if done is None else done.unionByName(own)
        free = free.join(own.select("x"), "x", "left_anti").checkpoint()
    return done.select(F.col("x").alias(key), "cluster") if done is not None else nodes.select(key, F.col(key).alias("cluster")).limit(0)


def _lower_hull(points: pd.DataFrame) -> pd.DataFrame:
    """The corners of the lower hull of points (system, x, y), one for each x."""
    hull: list[tuple[float, float]] = []
    points = points.sort_values("x")
    for x, y in zip(points["x"], points["y"], strict=True):
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) >= (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        hull.append((x, y))
    return pd.DataFrame(hull, columns=["x", "y"]).assign(system=points["system"].iloc[0])


def binary_hull(df: DataFrame, system: str, key: str, share: str, energy: str, slices: int = 64) -> DataFrame:
    """Energy above the lower hull of each two-part system: entries lie at a share in [0, 1] of the second part.

    The least energy at each share is taken first; hulls of slices of a system's shares are found apart and the hull of
    their corners is the system's, so no task holds a whole system. Systems without an entry at both ends are left out, as
    are entries without share or energy. formation is against the best entries at both ends.
    """
    rows = df.select(system, key, F.col(share).cast("double").alias("_x"), F.col(energy).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    least = rows.groupBy(F.col(system).alias("system"), F.col("_x").alias("x")).agg(F.min("_y").alias("y"))
    shape = "system {}, x double, y double".format(dict(least.dtypes)["system"])
    order = ["system", "x", "y"]
    corners = least.groupBy("system", F.pmod(F.xxhash64("x"), F.lit(slices))).applyInPandas(lambda pdf: _lower_hull(pdf)[order], shape)
    corners = corners.groupBy("system").applyInPandas(lambda pdf: _lower_hull(pdf)[order], shape)
    hulls = corners.groupBy("system").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_h")).where((F.col("_h")[0]["x"] == 0) & (F.element_at("_h", -1)["x"] == 1))
    both = rows.join(hulls, rows[system].eqNullSafe(hulls["system"])).drop("system") if system != "system" else rows.join(hulls, "system")
    # the corner at or before an entry's share, and the next one
    at = F.greatest(F.lit(1), F.least(F.size("_h") - 1, F.size(F.filter("_h", lambda p: p["x"] <= F.col("_x")))))
    both = both.withColumns({"_p": F.element_at("_h", at), "_q": F.element_at("_h", at + 1), "_l": F.element_at("_h", -1)})
    above = F.col("_y") - F.col("_p.y") - (F.col("_q.y") - F.col("_p.y")) * (F.col("_x") - F.col("_p.x")) / (F.col("_q.x") - F.col("_p.x"))
    both = both.withColumn("_a", F.when(F.abs(above) < 1e-12, 0.0).otherwise(above))
    return both.select(system, key, F.col("_a").alias("e_above_hull"), (F.col("_a") == 0).alias("is_stable"), (F.col("_y") - F.col("_h")[0]["y"] * (1 - F.col("_x")) - F.col("_l.y") * F.col("_x")).alias("formation"))
