"""Estimates for compositions: oxidation states that balance, radii, volumes and least distances of the parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an element table that a radius may come from, by the name of the method.
RADII = {"atomic": "atomic_radius", "atomic_calculated": "atomic_radius_calculated", "van_der_waals": "van_der_waals_radius", "metallic": "metallic_radius"}


def amounts(formula: Column) -> Column:
    """A formula without brackets as an array of (symbol, amount), a symbol once, in the order of first mention; no number counts as 1."""
    symbols = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*[.]?[0-9]*)"), F.lit(1))
    numbers = F.transform(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*[.]?[0-9]*)"), F.lit(2)), lambda n: F.coalesce(n.try_cast("double"), F.lit(1.0)))
    pairs = F.arrays_zip(symbols.alias("symbol"), numbers.alias("amount"))
    total = lambda s: F.aggregate(F.filter(pairs, lambda p: p["symbol"] == s), F.lit(0.0), lambda a, p: a + p["amount"])
    return F.transform(F.array_distinct(symbols), lambda s: F.struct(s.alias("symbol"), total(s).alias("amount")))


def _parts(df: DataFrame, key: str, formula: str) -> DataFrame:
    """(key, at, symbol, amount): a row for each part."""
    return df.select(key, F.posexplode(amounts(F.col(formula))).alias("at", "part")).select(key, "at", "part.symbol", "part.amount")


def oxidation_guesses(df: DataFrame, key: str, formula: str, states: DataFrame) -> DataFrame:
    """(key, states): for each composition the oxidation state of every part, as symbol -> state, so that all charges sum to 0.

    states (symbol, state, weight) has the states that an element may take; of the balanced choices the one with the greatest sum of
    weights stands, ties to the lesser states from the first part on. Null if no choice balances or an element has no states.
    Formulas are brought to charges of least whole amounts by the caller; amounts may be broken. Parts are added one after the other,
    and of the choices with the same charge so far only the best one goes on, so the work follows the number of distinct charges,
    not of choices.
    """
    of = states.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("state", F.col("weight").cast("double").alias("weight")))).alias("may"))
    parts = _parts(df, key, formula).join(F.broadcast(of), "symbol", "left")  # a row for each element
    listed = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "symbol", "amount", "may"))).alias("parts"), F.count_if(F.col("may").isNull()).alias("unknown"))
    open_ = F.array(F.struct(F.lit(0.0).alias("charge"), F.lit(0.0).alias("weight"), F.array().cast("array<int>").alias("chosen")))
    better = lambda a, b: (a["weight"] > b["weight"]) | ((a["weight"] == b["weight"]) & (a["chosen"] < b["chosen"]))

    def add(kept: Column, part: Column) -> Column:
        # charges are rounded, so that broken amounts meet
        grown = F.flatten(F.transform(kept, lambda k: F.transform(part["may"], lambda m: F.struct(F.round(k["charge"] + m["state"] * part["amount"], 6).alias("charge"), F.round(k["weight"] + m["weight"], 9).alias("weight"), F.concat(k["chosen"], F.array(m["state"].cast("int"))).alias("chosen")))))
        return F.filter(grown, lambda g: ~F.exists(grown, lambda o: (o["charge"] == g["charge"]) & better(o, g)))

    ends = F.aggregate("parts", open_, add)
    found = listed.withColumn("end", F.when(F.col("unknown") == 0, F.get(F.filter(ends, lambda e: e["charge"] == 0), F.lit(0))))
    return found.select(key, F.when(F.col("end").isNotNull(), F.map_from_arrays(F.transform("parts", lambda p: p["symbol"]), F.col("end.chosen"))).alias("states"))


def radii(df: DataFrame, key: str, formula: str, elements: DataFrame, how: str = "ionic", states: DataFrame | None = None, ionic: DataFrame | None = None) -> DataFrame:
    """(key, at, symbol, amount, radius): the radius of each part by a method; null where the tables have none.

    elements (symbol, atomic_radius, ...) has the columns of RADII; ionic takes the radius of the guessed state from ionic
    (symbol, state, radius), or the atomic one where that state is 0, has no radius or isn't found. The tables have a row for each element or state.
    """
    parts = _parts(df, key, formula)
    if how in RADII:
        return parts.join(F.broadcast(elements.select("symbol", F.col(RADII[how]).cast("double").alias("radius"))), "symbol", "left").select(key, "at", "symbol", "amount", "radius")
    if how != "ionic":
        raise ValueError(f"no radius method {how}")
    if states is None or ionic is None:
        raise ValueError("ionic radii need tables of states and of their radii")
    guessed = parts.join(oxidation_guesses(df, key, formula, states), key).withColumn("state", F.try_element_at("states", F.col("symbol")))
    own = guessed.join(F.broadcast(ionic.select("symbol", F.col("state").cast("int").alias("state"), F.col("radius").cast("double").alias("_ion"))), ["symbol", "state"], "left")
    both = own.join(F.broadcast(elements.select("symbol", F.col("atomic_radius").cast("double").alias("_atom"))), "symbol", "left")
    return both.select(key, "at", "symbol", "amount", F.coalesce(F.when((F.col("state") != 0) & (F.col("_ion") > 0), F.col("_ion")), "_atom").alias("radius"))


def volumes(parts: DataFrame, key: str, packing: float = 0.74) -> DataFrame:
    """(key, volume): of parts with radii, the volume of all spheres over the share of space that they fill; null if a radius is missing."""
    sphere = F.col("amount") * F.lit(4 / 3 * math.pi) * F.pow("radius", F.lit(3.0))
    return parts.groupBy(key).agg(F.when(F.count("radius") == F.count("*"), F.sum(sphere) / packing).alias("volume"))


def least_distances(parts: DataFrame, key: str, packing: float = 0.5) -> DataFrame:
    """(key, a, b, distance): for any two parts of a composition, themselves included, the sum of their radii times a factor; null if a
    composition lacks a radius. A composition has few parts, so the pairs are made inside its row."""
    listed = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "symbol", "radius"))).alias("p"), (F.count("radius") == F.count("*")).alias("whole"))
    pairs = listed.select(key, "p", "whole", F.explode("p").alias("x")).select(key, "whole", "x", F.explode("p").alias("y"))
    return pairs.select(key, F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b"), F.when(F.col("whole"), (F.col("x.radius") + F.col("y.radius")) * packing).alias("distance"))
