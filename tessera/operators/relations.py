"""Joins, set differences, deduplication and merges by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(new: DataFrame, old: DataFrame, on: list[str]) -> DataFrame:
    """Rows of new whose key is not in old: what an incremental load adds."""
    return new.join(old.select(*on), on, "left_anti")


def known(df: DataFrame, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose keys exist in every other table."""
    return reduce(lambda d, o: d.join(o[0].select(o[1]), o[1], "left_semi"), others, df)


def keep_first(df: DataFrame, on: list[str], order: list, inverse: bool = False) -> DataFrame:
    """The first row of each key in an order; inverse: all others. An ascending order of columns takes a partial aggregate, so a hot
    key isn't sorted; of rows that are equal in it one counts."""
    if not inverse and all(isinstance(o, str) for o in [*on, *order]):
        first = df.groupBy(*on).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_first"))
        return first.select("_first.*")
    w = Window.partitionBy(*on).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n > 1" if inverse else "_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, on: list[str], update: list[str] | None = None) -> DataFrame:
    """old with the columns update of new where the key exists, and new's other rows; None leaves existing rows alone."""
    added = missing(new, old, on)
    if not update:
        return old.unionByName(added, allowMissingColumns=True)
    changes = new.select(*on, *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_hit"))
    merged = old.join(changes, on, "left").select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in old.columns])
    return merged.unionByName(added, allowMissingColumns=True)


def with_lookup(df: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """df with value from a lookup table; null where it has none."""
    return df.join(table.select(on, value), on, "left")


def delist(stored: DataFrame, listing: DataFrame, on: str, flag: str = "is_active") -> DataFrame:
    """stored with a flag for what the current listing still holds."""
    seen = listing.select(F.col(on).alias("_seen")).distinct()
    return stored.join(seen, stored[on] == seen["_seen"], "left").withColumn(flag, F.col("_seen").isNotNull()).drop("_seen")


def tagged_union(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """All rows with the name of their frame; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(column, F.lit(name)) for name, df in frames.items()])


def top_of_each(frames: dict[str, DataFrame], column: str, order: list, n: int, overall: int | None = None) -> DataFrame:
    """The first n rows of each frame, together; overall: the first of all of them again."""
    found = tagged_union({name: df.orderBy(*order).limit(n) for name, df in frames.items()}, column)
    return found if overall is None else found.orderBy(*order).limit(overall)


def quick_search(frames: dict[str, DataFrame], test: Column, order: list, n: int = 5) -> DataFrame:
    """The first n hits of each table with the table's number of hits; tables without hits are left out.

    Hits are counted by partial sums and the first ones taken by a top-n in each partition, so no table is sorted whole.
    """
    hits = {k: df.where(test) for k, df in frames.items()}
    counts = tagged_union({k: df.agg(F.count("*").alias("total_count")) for k, df in hits.items()}, "source_table")
    first = tagged_union({k: df.orderBy(*order).limit(n) for k, df in hits.items()}, "source_table")
    return first.join(F.broadcast(counts), "source_table")  # a row for each table


def in_given_order(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of ids in their order, repeats included; unknown ids are left out."""
    wanted = df.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, pos int")
    return wanted.join(df, key).orderBy("pos")


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An inner or left equi-join whose hot keys are spread over salts partitions; small is repeated once for each salt.

    Both sides are shuffled: Spark's estimate of small, from its compressed files, would broadcast tables whose repeated rows don't fit the driver.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"small's rows are repeated, so a {how} join would repeat those without a partner")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("merge"), [on, "_salt"], how).drop("_salt")


def salted_outer_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "full") -> DataFrame:
    """A right or full equi-join (small is the right side) whose hot keys are spread over salts partitions.

    Rows with a partner, and for a full join those of big without one, come from salted_join; the rows of small without one are joined
    against big's distinct keys, once each.
    """
    if how not in ("right", "full"):
        raise ValueError(f"{how} joins are salted_join's")
    met = salted_join(big, small, on, salts, "inner" if how == "right" else "left")
    alone = small.join(big.select(on).distinct().hint("merge"), on, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


#: Values up to which a list of values is written into the plan.
LISTED = 1000


def in_values(df: DataFrame, column: str, wanted: list | DataFrame, inverse: bool = False, most: int = 32 << 20) -> DataFrame:
    """Rows whose column has one of the values, or with inverse none of them; no values give no rows, or all.

    wanted is a list or a frame of one column. A list of up to LISTED values is a predicate that reaches the scan; others are semi-joins,
    broadcast if the measured values take up to most bytes. Nulls are in no list: a row whose column is null is neither in it nor, unless the list is empty, outside.
    """
    if isinstance(wanted, list):
        values = [v for v in dict.fromkeys(wanted) if v is not None]
        if not values:
            return df if inverse else df.where(F.lit(False))
        if len(values) <= LISTED:
            test = F.col(column).isin(values)
            return df.where(~test if inverse else test)
        wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"value {dict(df.dtypes)[column]}")
    keys = wanted.select(F.col(f"`{wanted.columns[0]}`").alias("_wanted")).where("_wanted IS NOT NULL").distinct()
    size = keys.agg(F.coalesce(F.sum(F.length(F.col("_wanted").cast("string")) + 16), F.lit(0))).first()[0]
    if not size:
        return df if inverse else df.where(F.lit(False))
    side = F.broadcast(keys) if size <= most else keys
    found = df.join(side, F.col(column) == F.col("_wanted"), "left_anti" if inverse else "left_semi")
    return found.where(F.col(column).isNotNull()) if inverse else found
