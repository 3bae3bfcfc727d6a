"""Rows within a tolerance of each other: a distance join over grid cells, unique rows in order of a key, and pools of known rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Stage
from .vectors import BROADCAST_BYTES

#: Rows of either side that a task compares; larger cells are cut into pieces.
PIECE_ROWS = 8192
#: Values of a vector that make its cell.
AXES = 2


def _prepared(df: DataFrame, key: str, block: str | None, vector: str, metric: str) -> DataFrame:
    """(block, key, v): finite vectors as doubles, of length 1 for cosine."""
    v = F.col(vector).cast("array<double>")
    rows = df.select((F.col(block) if block else F.lit(0)).alias("block"), F.col(key).alias("key"), v.alias("v"))
    rows = rows.where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size("v") > 0))
    if metric == "cosine":
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
        rows = rows.withColumn("_n", size).where("_n > 0").withColumn("v", F.transform("v", lambda c: c / F.col("_n"))).drop("_n")
    elif metric != "l2":
        raise ValueError(f"no grid for {metric}")
    return rows


def _radius(tolerance: float, metric: str) -> float:
    """The l2 distance below which rows are within the tolerance; unit vectors with 1 - cos < t are nearer than sqrt(2 t)."""
    if tolerance <= 0:
        raise ValueError("a tolerance is greater than 0")
    return tolerance if metric == "l2" else math.sqrt(2 * tolerance)


def _axes(rows: DataFrame) -> list[int]:
    """The places whose values vary most: two rows differ in one value by no more than in all."""
    spread = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "at").limit(AXES)
    return [r["at"] for r in spread.collect()]


def _cell(v: Column, axes: list[int], radius: float) -> Column:
    return F.array(*[F.floor(F.coalesce(F.get(v, F.lit(a)), F.lit(0.0)) / radius) for a in axes])


def _around(cell: Column, axes: list[int]) -> Column:
    """A cell and those next to it."""
    return F.array(*[F.array(*[F.get(cell, F.lit(i)) + d for i, d in enumerate(step)]) for step in itertools.product((-1, 0, 1), repeat=len(axes))])


def with_near(left: DataFrame, right: DataFrame, radius: float, axes: list[int], earlier: bool = False) -> DataFrame:
    """The (block, key) of left's rows that have a row of right nearer than the radius; earlier: one with a smaller key.

    left's rows look into the cells around their own. Large cells are cut into pieces of PIECE_ROWS rows of either side, every
    piece of one meeting every piece of the other, so no task holds a whole cell. Distances are compared inside tasks: no pair
    is emitted, and a row that has met a near one is not compared further.
    """
    at = ["block", "cell"]
    looks = left.withColumn("cell", F.explode(_around(_cell(F.col("v"), axes, radius), axes)))
    holds = right.withColumn("cell", _cell(F.col("v"), axes, radius))
    count = looks.select(*at, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(holds.select(*at, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(*at).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    heavy = count.where((F.col("l") > PIECE_ROWS) | (F.col("r") > PIECE_ROWS)).select(*at, *[F.ceil(F.col(c) / PIECE_ROWS).cast("int").alias(f"_{c}") for c in "lr"])
    n = heavy.count()
    if n:
        heavy = F.broadcast(heavy) if n * 64 <= BROADCAST_BYTES else heavy
        looks, holds = looks.join(heavy, at, "left"), holds.join(heavy, at, "left")
    pieces = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(1)) if n else F.lit(1)
    own = lambda c: F.pmod(F.xxhash64("key"), pieces(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), pieces(c) - 1))
    looks = looks.select(*at, "key", "v", own("l").alias("i"), every("r").alias("j"))
    holds = holds.select(*at, "key", "v", every("l").alias("i"), own("r").alias("j"))
    holds = holds.toDF(*holds.columns)
    kinds = dict(left.dtypes)

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        found = a.select(["block", "key"]).slice(0, 0)
        if not a.num_rows or not b.num_rows:
            return found
        ka, kb = (t.column("key").to_numpy() for t in (a, b))
        va, vb = (_matrix(t.column("v").combine_chunks()) for t in (a, b))
        order = np.argsort(kb, kind="stable")
        kb, vb, hit = kb[order], vb[order], np.zeros(len(ka), bool)
        for lo in range(0, len(kb), 512):
            left_over = np.flatnonzero(~hit)
            if not len(left_over):
                break
            some, keys = vb[lo : lo + 512], kb[lo : lo + 512]
            for k in range(0, len(left_over), 1024):
                i = left_over[k : k + 1024]
                x = va[i]
                scale = (x**2).sum(axis=1)[:, None] + (some**2).sum(axis=1)
                maybe = scale - 2 * x @ some.T < radius * radius + 1e-9 * (scale + radius * radius)
                if earlier:
                    maybe &= keys < ka[i, None]
                p, q = np.nonzero(maybe)
                near = np.sqrt(((x[p] - some[q]) ** 2).sum(axis=1)) < radius
                hit[i[p[near]]] = True
        return a.select(["block", "key"]).filter(pa.array(hit))

    by = ["block", "cell", "i", "j"]
    return looks.groupBy(*by).cogroup(holds.groupBy(*by)).applyInArrow(met, f"block {kinds['block']}, key {kinds['key']}").distinct()


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _without(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col("block").alias("_b"), F.col("key").alias("_k")), F.col("block").eqNullSafe(F.col("_b")) & (F.col("key") == F.col("_k")), "left_anti")


def _unique(rows: DataFrame, radius: float) -> DataFrame:
    """(block, key) of the rows kept in order of key: those not within the radius of a row kept before."""
    # equal vectors are within any tolerance, so only the first of them can be kept
    first = rows.groupBy("block", "v").agg(F.min("key").alias("key")).select("block", "key", "v")
    stage = Stage(rows.sparkSession, "unique")
    open_rows = stage(first)
    axes = _axes(open_rows)
    kept = None
    while open_rows.take(1):
        cells = open_rows.withColumn("cell", _cell(F.col("v"), axes, radius))
        # first a row of each neighbourhood that is the first of its own cell and of all around it, and what is near those
        least = cells.groupBy("block", "cell").agg(F.min_by(F.struct("key", "v"), "key").alias("m"))
        seen = least.select("block", F.explode(_around(F.col("cell"), axes)).alias("cell"), F.col("m.key").alias("other")).groupBy("block", "cell").agg(F.min("other").alias("other"))
        lead = least.join(seen.select(F.col("block").alias("_b"), F.col("cell").alias("_c"), "other"), F.col("block").eqNullSafe(F.col("_b")) & (F.col("cell") == F.col("_c"))).where("m.key <= other").select("block", "m.key", "m.v")
        lead = stage(lead)
        rest = stage(_without(_without(open_rows, lead), with_near(open_rows, lead, radius, axes)))
        # then every row without an open earlier one near it, and what is near those
        late = stage(with_near(rest, rest, radius, axes, earlier=True))
        sure = stage(_without(rest, late))
        waiting = rest.join(late.select(F.col("block").alias("_b"), F.col("key").alias("_k")), F.col("block").eqNullSafe(F.col("_b")) & (F.col("key") == F.col("_k")), "left_semi")
        after = stage(_without(waiting, with_near(waiting, sure, radius, axes)))
        now = lead.select("block", "key").unionByName(sure.select("block", "key"))
        kept = now if kept is None else kept.unionByName(now)
        stage.drop(open_rows, rest, late)
        open_rows = after
    return first.select("block", "key").limit(0) if kept is None else kept


def greedy_unique(df: DataFrame, key: str, block: str | None, vector: str, tolerance: float, metric: str = "l2") -> DataFrame:
    """(block, key) of the rows kept in order of key within a block: those not within a tolerance of a row kept before.

    metric is l2 or cosine. Keys are unique; vectors of a block have one length; rows whose vector is null, empty or not
    finite (for cosine: or zero) are left out. Decisions are made in rounds, for all blocks at once: a row is kept when no
    undecided earlier row is near it, and goes when a kept one is. A block, however large, never meets in one task.
    """
    rows = _prepared(df, key, block, vector, metric)
    out = _unique(rows, _radius(tolerance, metric))
    return out.select(*([F.col("block").alias(block)] if block else []), F.col("key").alias(key))


def near_pool(df: DataFrame, pool: DataFrame, key: str, vector: str, tolerance: float, metric: str = "l2") -> DataFrame:
    """df with is_unique: no row of the pool is within the tolerance; null where the row has no usable vector."""
    a, b = (_prepared(x, key, None, vector, metric) for x in (df, pool))
    axes, radius = _axes(a), _radius(tolerance, metric)
    hits = with_near(a, b, radius, axes).select(F.col("key").alias("_k"), F.lit(True).alias("_near"))
    usable = a.select(F.col("key").alias("_u")).distinct()
    out = df.join(hits, df[key] == hits["_k"], "left").join(usable, df[key] == F.col("_u"), "left")
    return out.withColumn("is_unique", F.when(F.col("_u").isNotNull(), F.col("_near").isNull())).drop("_k", "_near", "_u")


def added_to_pool(df: DataFrame, pool: DataFrame, key: str, vector: str, tolerance: float, metric: str = "l2") -> DataFrame:
    """The rows of df that join the pool, checked in order of key: not within the tolerance of the pool or of one that joined before."""
    fresh = near_pool(df, pool, key, vector, tolerance, metric).where("is_unique").drop("is_unique")
    return fresh.join(greedy_unique(fresh, key, None, vector, tolerance, metric), key, "left_semi")


def refreshed_pool(pool: DataFrame, table: DataFrame, key: str, vector: str, created: str, tolerance: float, metric: str = "l2") -> DataFrame:
    """The pool with the unique rows of a table that were created after the pool's last one; an empty pool takes from all."""
    last = pool.agg(F.max(created)).first()[0]
    newer = table if last is None else table.where(F.col(created) > F.lit(last))
    return pool.unionByName(added_to_pool(newer.select(*pool.columns), pool, key, vector, tolerance, metric))


def stored_or_missing(asked: DataFrame, pool: DataFrame, pos: str, key: str, value: str) -> DataFrame:
    """(pos, key, value, is_stored) for each asked (pos, key), in the order of pos: the pool's value, or null where it has to be made."""
    have = pool.select(F.col(key).alias("_k"), F.col(value)).withColumn("is_stored", F.lit(True))
    out = asked.join(have, F.col(key) == F.col("_k"), "left").select(pos, key, value, F.coalesce("is_stored", F.lit(False)).alias("is_stored"))
    return out.orderBy(pos)
