"""Nested data: JSON documents as VARIANT values, taken apart by path, laid out wide, merged deeply and put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Stage

#: Levels of objects that are taken apart; deeper ones are values.
DEPTH = 8


def leaves(df: DataFrame, key: str, document: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, value): the values of a document that aren't objects, with the names that lead to them, as JSON text.

    document is JSON text or VARIANT; text that isn't JSON, null and documents that are no object have no leaves. Arrays are
    values. Objects without names, and what lies deeper than depth, are values too.
    """
    v = F.col(document) if dict(df.dtypes)[document] == "variant" else F.try_parse_json(document)
    level = df.select(F.col(key).alias("_key"), F.array().cast("array<string>").alias("path"), v.alias("v")).where("v IS NOT NULL")
    for _ in range(depth):
        # objects are exploded, values go on as they are
        kind = F.schema_of_variant("v")
        level = level.withColumn("o", F.when(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.col("v")))
        inside = level.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("o").outer()).toDF("pos", "name", "inner"))
        is_object = F.col("o").isNotNull()
        level = inside.select("_key", F.when(is_object, F.concat("path", F.array("name"))).otherwise(F.col("path")).alias("path"), F.when(is_object, F.col("inner")).otherwise(F.col("v")).alias("v"))
    return level.where(F.size("path") > 0).select(F.col("_key").alias(key), "path", F.to_json("v").alias("value"))


def wide(df: DataFrame, key: str, document: str, named: Callable[[Column], Column] | None = None, names: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """A row for each key with a column for each path, as numbers; what a document lacks, or isn't a number, is 0.

    named makes a column's name from a path (joined by _ if not given); values of paths with one name are added up. names lists
    the columns; without it Spark looks for all there are, which have to be as few as columns can be.
    """
    named = named or (lambda p: F.array_join(p, "_"))
    cells = leaves(df, key, document, depth).select(F.col(key).alias("_key"), named(F.col("path")).alias("_name"), F.regexp_replace("value", '^"|"$', "").try_cast("double").alias("_value"))
    pivoted = cells.groupBy("_key").pivot("_name", names).agg(F.sum("_value")).withColumnRenamed("_key", "_k")
    return df.select(key).join(pivoted, F.col(key) == F.col("_k"), "left").drop("_k").fillna(0.0)


def assembled(rows: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(key, document): leaves (key, path, value as JSON text) put together as JSON objects, names in order."""
    rows = rows.select(key, "path", "value").repartition(key)  # once, for all levels
    for d in range(depth, 0, -1):
        name = F.to_json(F.array(F.element_at("path", -1)))
        below = F.size("path") == d
        text = F.when(below, F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.col("value"))).otherwise(F.col("value"))
        pieces = rows.select(key, F.when(below, F.slice("path", 1, d - 1)).otherwise(F.col("path")).alias("path"), below.alias("b"), F.struct(F.when(below, F.element_at("path", -1)).alias("n"), text.alias("t")).alias("p"))
        made = pieces.groupBy(key, "path").agg(F.max("b").alias("b"), F.sort_array(F.collect_list("p")).alias("p"))
        joined = F.array_join(F.transform("p", lambda p: p["t"]), ",")
        rows = made.select(key, "path", F.when(F.col("b"), F.concat(F.lit("{"), joined, F.lit("}"))).otherwise(joined).alias("value"))
    return rows.select(key, F.col("value").alias("document"))


def merged(df: DataFrame, key: str, base: str, over: str, depth: int = DEPTH) -> DataFrame:
    """(key, document): two documents as one. Objects are merged name by name, at any level down to depth; otherwise over's value
    wins, also where one has an object and the other a value. Keys are unique; one without leaves in either has no row. An empty
    object in over replaces a value, but not an object."""
    stage = Stage(df.sparkSession, "merged")
    low, high = stage(leaves(df, key, base, depth)), stage(leaves(df, key, over, depth))
    high = high.where("value != '{}'").unionByName(high.where("value = '{}'").join(_above(low, key), [key, "path"], "left_anti"))
    prefixes = lambda rows: rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("_start"), F.col("path").alias("_path"))
    # what stands at, or below, a place where over has a value
    below = prefixes(low).join(high.select(key, F.col("path").alias("_start")), [key, "_start"], "left_semi")
    # and values in the place of over's objects
    under = prefixes(high).where("_start != _path").select(key, F.col("_start").alias("path")).distinct()
    kept = low.join(below.select(key, F.col("_path").alias("path")).distinct(), [key, "path"], "left_anti").join(under, [key, "path"], "left_anti")
    return assembled(kept.unionByName(high), key, depth)


def _above(rows: DataFrame, key: str) -> DataFrame:
    """The paths of all objects that hold leaves."""
    return rows.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path")).distinct()
