"""Stability of compositions of any number of parts: lower hulls by linear programs over the stable set, with decompositions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import Stage

#: Compositions of a system that a task prunes, or solves, at a time.
PIECE_ROWS = 2000
#: Energies nearer than this are equal.
CLOSE = 1e-9


def lowest(target: np.ndarray, columns: np.ndarray, cost: np.ndarray) -> tuple[float, list[int], np.ndarray]:
    """(value, basis, amounts): the least cost of mixing columns to the target, by the simplex method.

    columns starts with the unit vectors, which are the first basis. The column with the least reduced cost enters; after many
    steps the first one with a negative cost does, which cannot go round in circles.
    """
    k = len(target)
    basis, inverse, amounts = list(range(k)), np.eye(k), target.astype(float).copy()
    for step in range(10_000):
        reduced = cost - (cost[basis] @ inverse) @ columns
        reduced[basis] = 0.0
        enter = int(reduced.argmin()) if step < 200 else int((reduced < -1e-12).argmax())
        if reduced[enter] >= -1e-12:
            break
        change = inverse @ columns[:, enter]
        ratio = np.where(change > 1e-12, amounts / np.where(change > 1e-12, change, 1.0), np.inf)
        least = ratio.min()
        leave = min((i for i in range(k) if ratio[i] <= least + 1e-15), key=lambda i: basis[i])
        inverse[leave] /= change[leave]
        amounts[leave] = least
        for i in range(k):
            if i != leave:
                inverse[i] -= change[i] * inverse[leave]
                amounts[i] = max(0.0, amounts[i] - change[i] * least)
        basis[leave] = enter
    return float(cost[basis] @ amounts), basis, amounts


def _shares(parts: Column, composition: Column) -> Column:
    """Shares of the parts, rounded so that equal compositions are equal numbers."""
    amounts = F.transform(parts, lambda p: composition[p].cast("double"))
    whole = F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(amounts, lambda x: F.round(x / whole, 12))


def _name(shares: Column) -> Column:
    return F.array_join(F.transform(shares, lambda x: x.cast("string")), ",")


def _subsets(parts: Column) -> Column:
    """The names of all subsets of the parts but the empty one, in order of the parts."""
    one = lambda sets, p: F.concat(sets, F.transform(sets, lambda s: F.when(s == "", p).otherwise(F.concat(s, F.lit("-"), p))))
    return F.filter(F.aggregate(parts, F.array(F.lit("")), one), lambda s: s != "")


def _padded(parts: Column, own: Column, shares: Column) -> Column:
    """Shares of a subset's parts in the order of all parts."""
    return F.transform(parts, lambda p: F.coalesce(F.try_element_at(F.map_from_arrays(own, shares), p), F.lit(0.0)))


def hull(df: DataFrame, key: str, composition: str, energy: str) -> DataFrame:
    """(key, system, e_above_hull, is_stable, formation, decomposes_to) for each entry.

    composition is a map of parts to amounts (not positive ones are left out), energy the entry's whole energy; what comes out is
    for one unit of amount. A system is a set of parts; its entries are those whose parts lie in it. formation is against the
    lowest entry of each pure part, e_above_hull against the cheapest mixture of entries, and decomposes_to names that mixture
    as (key, amount) by key; it is empty for stable entries (e_above_hull of 0, but for rounding). Of entries of one composition the
    lowest is used in mixtures, of equal ones the one with the smaller key. Entries without parts or energy are left out, and so
    are those of systems of which a pure part has no entry.

    An entry mixes only entries of its own parts' subsets, so each system is solved by itself. Compositions that form at a loss are
    dropped first; the others are pruned in pieces to those on their piece's hull, until a system fits one piece or nothing more goes.
    A task then solves a piece of the compositions of a system against its stable ones.
    """
    kinds, arrow_key = dict(df.dtypes), to_arrow_type(df.schema[key].dataType)
    rows = df.select(F.col(key).alias("key"), F.map_filter(F.col(composition), lambda p, x: x > 0).alias("c"), F.col(energy).cast("double").alias("e")).where("size(c) > 0 AND e IS NOT NULL AND NOT isnan(e)")
    rows = rows.withColumn("parts", F.array_sort(F.map_keys("c")))
    total = F.aggregate(F.map_values("c"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = rows.select("key", "parts", F.array_join("parts", "-").alias("system"), _shares(F.col("parts"), F.col("c")).alias("x"), (F.col("e") / total).alias("e")).withColumn("at", _name(F.col("x")))
    stage = Stage(df.sparkSession, "hull")
    best = stage(rows.groupBy("system", "at").agg(F.first("parts").alias("parts"), F.first("x").alias("x"), F.min(F.struct("e", "key")).alias("b")).select("system", "at", "parts", "x", "b.e", "b.key"))
    # every system with the pure entries of its parts
    systems = best.groupBy("system").agg(F.first("parts").alias("all_parts"))
    pure = best.where(F.size("parts") == 1).select(F.col("parts")[0].alias("part"), F.struct("key", "e").alias("p"))
    ends = systems.select("system", "all_parts", F.explode("all_parts").alias("part")).join(pure, "part").groupBy("system").agg(F.first("all_parts").alias("all_parts"), F.sort_array(F.collect_list(F.struct("part", "p"))).alias("ends"))
    ends = stage(ends.where(F.size("ends") == F.size("all_parts")).select("system", "all_parts", F.transform("ends", lambda z: z["p"]["key"]).alias("pure_keys"), F.transform("ends", lambda z: z["p"]["e"]).alias("pure_e")))
    formed = lambda x: F.col("e") - F.aggregate(F.zip_with(x, "pure_e", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # what may be mixed in each system: compositions of its subsets that form at a gain
    within = ends.select("system", "all_parts", "pure_e", F.explode(_subsets(F.col("all_parts"))).alias("sub"))
    fits = within.join(best.select(F.col("system").alias("sub"), "parts", "x", "e", "key"), "sub").where(F.size("parts") > 1)
    fits = fits.withColumn("x", _padded(F.col("all_parts"), F.col("parts"), F.col("x"))).withColumn("f", formed(F.col("x"))).where(F.col("f") < -CLOSE).select("system", "key", "x", "f")
    stable = stage(fits)

    def on_hull(t: pa.Table) -> pa.Table:
        x, f = _matrix(t.column("x").combine_chunks()), t.column("f").to_numpy()
        columns, cost = np.hstack([np.eye(x.shape[1]), x.T]), np.append(np.zeros(x.shape[1]), f)
        # lower than every mixture of the others, or of the others and itself
        return t.filter(pa.array([f[i] <= lowest(x[i], columns, cost)[0] + CLOSE for i in range(len(f))]))

    shape = f"system string, key {kinds[key]}, x array<double>, f double"
    while True:
        sizes = stable.groupBy("system").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("n"))
        before, many = stable.count(), sizes.where("n > 1").count()
        pieces = stable.join(sizes, "system").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("n")))
        after = stage(pieces.select("system", "key", "x", "f", "piece").groupBy("system", "piece").applyInArrow(lambda t: on_hull(t.drop_columns("piece")), shape))
        left = after.count()
        stage.drop(stable)
        stable = after
        if not many or left == before:
            break

    def solved(targets: pa.Table, phases: pa.Table) -> pa.Table:
        if not targets.num_rows:
            return _solution(arrow_key, targets).slice(0, 0)
        x = _matrix(targets.column("x").combine_chunks())
        keys = targets.column("pure_keys")[0].as_py() + phases.column("key").to_pylist()
        columns, cost = np.eye(x.shape[1]), np.zeros(x.shape[1])
        if phases.num_rows:
            columns, cost = np.hstack([columns, _matrix(phases.column("x").combine_chunks()).T]), np.append(cost, phases.column("f").to_numpy())
        values, mixtures = [], []
        for t in x:
            value, basis, amounts = lowest(t, columns, cost)
            values.append(value)
            mixtures.append(sorted(({"key": keys[b], "amount": float(a)} for b, a in zip(basis, amounts, strict=True) if a > CLOSE), key=lambda m: m["key"]))
        return _solution(arrow_key, targets, values, mixtures)

    goals = best.join(ends, "system").select("system", "at", "x", "pure_keys", F.pmod(F.xxhash64("at"), F.lit(16)).cast("int").alias("piece"))
    phases = stable.select("system", "key", "x", "f", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("piece"))
    found = goals.groupBy("system", "piece").cogroup(phases.groupBy("system", "piece")).applyInArrow(solved, f"system string, at string, h double, mix array<struct<key:{kinds[key]},amount:double>>")
    out = rows.join(ends.select("system", "pure_e"), "system").join(found, ["system", "at"]).withColumn("f", formed(F.col("x")))
    above = F.col("f") - F.col("h")
    out = out.withColumn("a", F.when(F.abs(above) < CLOSE, 0.0).otherwise(above))
    return out.select(F.col("key").alias(key), "system", F.col("a").alias("e_above_hull"), (F.col("a") == 0).alias("is_stable"), F.col("f").alias("formation"), F.when(F.col("a") == 0, F.array().cast(f"array<struct<key:{kinds[key]},amount:double>>")).otherwise(F.col("mix")).alias("decomposes_to"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _solution(kind: pa.DataType, targets: pa.Table, values: list | None = None, mixtures: list | None = None) -> pa.Table:
    mix = pa.list_(pa.struct([("key", kind), ("amount", pa.float64())]))
    n = targets.num_rows
    return pa.table({"system": targets.column("system"), "at": targets.column("at"), "h": pa.array(values or [0.0] * n, pa.float64()), "mix": pa.array(mixtures or [[]] * n, mix)})
