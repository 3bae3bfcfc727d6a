"""Edits and choices that users make on tables: bulk edits with comments and links, free ids and names, filters that fit a column."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chemical_system, subsystems
from ..sources.scratch import Stage


def bulk_edit(df: DataFrame, key: str, ids: list, form: dict[str, Any], links: dict[str, tuple[DataFrame, str, str]] | None = None, most: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(df, links) after a form for many rows: values that aren't None replace those of the rows with the ids.

    comments, and names that end in _comments, are put behind what is there, on a line of their own. <relation>__ids makes the
    rows be linked to exactly those ids: links has (table, own column, other column) of each relation. More ids than most are an error.
    """
    if most is not None and len(ids) > most:
        raise ValueError(f"{len(ids)} rows are more than {most}")
    hit, given, out = F.col(key).isin(list(ids)), {k: v for k, v in form.items() if v is not None}, {}
    changes = {}
    for c, v in given.items():
        if c.endswith("__ids"):
            table, own, other = (links or {})[c[:-5]]
            pairs = df.sparkSession.createDataFrame([(i, o) for i in ids for o in dict.fromkeys(v)], df.sparkSession.createDataFrame([], table.select(own, other).schema).schema)
            out[c[:-5]] = table.where(~F.col(own).isin(list(ids))).unionByName(pairs, allowMissingColumns=True)
        elif c == "comments" or c.endswith("_comments"):
            changes[c] = F.when(hit, F.concat_ws("\n", F.when(F.col(c) != "", F.col(c)), F.lit(v))).otherwise(F.col(c))
        else:
            changes[c] = F.when(hit, F.lit(v)).otherwise(F.col(c))
    return (df.withColumns(changes) if changes else df), out


def free_ids(df: DataFrame, key: str, make: Callable[[Column, int], Column], taken: DataFrame, name: str = "id", most: int = 50) -> DataFrame:
    """(key, name): a new id for each key, by make(key, draw): one that is taken, or that a smaller key has, is drawn again.

    Each draw only goes over keys that have no id yet. After so many draws without an end it is an error: there are too few ids.
    """
    stage = Stage(df.sparkSession, "ids")
    left, done = stage(df.select(key).distinct()), None
    for draw in range(most):
        drawn = left.select(key, make(F.col(key), draw).alias(name)).join(taken.select(F.col(taken.columns[0]).alias(name)), name, "left_anti")
        first = drawn.groupBy(name).agg(F.min(key).alias(key)).select(key, name)
        first = first if done is None else first.join(done.select(name), name, "left_anti").select(key, name)
        now = stage(first)
        done = now if done is None else done.unionByName(now)
        rest = stage(left.join(now.select(key), key, "left_anti"))
        if not rest.take(1):
            return done
        left = rest
    raise ValueError(f"no free ids after {most} draws")


def free_names(wanted: DataFrame, key: str, name: str, taken: DataFrame) -> DataFrame:
    """(key, suggested): the name itself if it isn't taken, else name-2, name-3, ... up to the first that isn't.

    A name's own numbers are looked up by its stem, so each wanted name meets only taken names that begin with it and a minus.
    """
    names = taken.select(F.col(taken.columns[0]).alias("_t")).distinct()
    numbered = names.select(F.regexp_extract("_t", "^(.*)-([0-9]+)$", 1).alias("_s"), F.regexp_extract("_t", "^(.*)-([0-9]+)$", 2).try_cast("int").alias("_n"))
    used = names.select(F.col("_t").alias("_s"), F.lit(1).alias("_n")).unionByName(numbered.where("_n >= 2")).groupBy("_s").agg(F.sort_array(F.collect_set("_n")).alias("_used"))
    met = wanted.select(key, F.col(name).alias("_w")).join(used, F.col("_w") == F.col("_s"), "left")
    # the first place where the sorted numbers leave out one, if the name itself is used
    gap = F.coalesce(F.get(F.filter(F.transform("_used", lambda n, i: F.when(n != i + 1, i + 1)), lambda n: n.isNotNull()), F.lit(0)), F.size("_used") + 1)
    used_itself = F.coalesce(F.array_contains("_used", 1), F.lit(False))
    return met.select(key, F.when(used_itself, F.concat_ws("-", "_w", gap.cast("string"))).otherwise(F.col("_w")).alias("suggested"))


def in_chemical_system(column: Column, system: str, with_subsystems: bool = True) -> Column:
    """Whether a name of parts joined by minus, in any order, is the system, or a subsystem of it."""
    wanted = chemical_system(F.lit(system))
    own = chemical_system(column)
    return F.array_contains(subsystems(wanted), own) if with_subsystems else own == wanted


def running_of_sources(sources: DataFrame, source: str, items: str, table: DataFrame, key: str, status: str, running: tuple[str, ...] = ("P", "R")) -> DataFrame:
    """(source, running, still_running): the number and the ids of each source's items that are pending or running, in order.

    items is an array of ids; unknown ids aren't running. A source without such items has 0.
    """
    live = table.where(F.col(status).isin(*running)).select(F.col(key).alias("_i"))
    met = sources.select(source, F.explode_outer(items).alias("_i")).join(live.withColumn("_on", F.lit(1)), "_i", "left")
    found = met.groupBy(source).agg(F.count("_on").alias("running"), F.sort_array(F.collect_set(F.when(F.col("_on") == 1, F.col("_i")))).alias("still_running"))
    return found


def with_both_ends(rows: DataFrame, dimension: DataFrame, key: str, ends: dict[str, str], known: str = "any") -> DataFrame:
    """rows with the dimension's columns once for each end, as <end>__<column>: ends maps an end's name to the column that refers to it.

    known: rows are kept if any end is in the dimension, if all are, or in any case (keep).
    """
    out, tests = rows, []
    for end, column in ends.items():
        side = dimension.select(*[F.col(c).alias(f"{end}__{c}") for c in dimension.columns])
        out = out.join(side, F.col(column) == F.col(f"{end}__{key}"), "left")
        tests.append(F.col(f"{end}__{key}").isNotNull())
    if known == "keep":
        return out
    if known not in ("any", "all"):
        raise ValueError(known)
    test = tests[0]
    for more in tests[1:]:
        test = test | more if known == "any" else test & more
    return out.where(test)


def filter_kinds(df: DataFrame, few: int = 10) -> DataFrame:
    """(column, kind, distinct): how a dashboard filters each column: a choice of values if it has fewer than few (approximately),
    a range for other numbers and times, text for the rest."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
    kinds = {c: "range" if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or t.startswith("decimal") else "text" for c, t in df.dtypes}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`") < few, "choice").otherwise(kinds[c]).alias("kind"), F.col(f"`{c}`").alias("distinct")) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def dashboard_filter(df: DataFrame, **values: Any) -> DataFrame:
    """df filtered by a dashboard's widgets: a pair is a range (either end may be None), a list a choice of values (an empty one
    asks for nothing), text or another value is matched exactly, None asks for nothing."""
    for c, v in values.items():
        if isinstance(v, tuple):
            low, high = v
            df = df if low is None else df.where(F.col(c) >= F.lit(low))
            df = df if high is None else df.where(F.col(c) <= F.lit(high))
        elif isinstance(v, list):
            df = df.where(F.col(c).isin(v)) if v else df
        elif v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def flagged_with_any_tag(df: DataFrame, flag: Column, tags: Column, wanted: list[str]) -> DataFrame:
    """Rows whose flag holds and that have one of the tags; without tags to look for, all rows whose flag holds."""
    return df.where(flag & F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))) if wanted else df.where(flag)


def parents_with_children(parents: DataFrame, children: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """parents that have children, with n_children and children: the values of order, sorted."""
    found = children.groupBy(F.col(parent).alias("_p")).agg(F.count(order).alias("n_children"), F.sort_array(F.collect_list(order)).alias("children"))
    return parents.join(found, F.col(key) == F.col("_p")).drop("_p").where("n_children > 0")


def first_matching(df: DataFrame, order: str, **equal: Any) -> DataFrame:
    """The first row, in an order, whose columns have all the given values; none if there is no such row."""
    for c, v in equal.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.orderBy(order).limit(1)


def linear_ramp(step: Column, first: float, last: float, steps: int) -> Column:
    """The value of a step (from 0) on the line from first to last over so many steps; held at both ends."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / F.lit(float(max(1, steps - 1)))))
    return F.lit(float(first)) + (float(last) - float(first)) * share


def cleaned(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Text with patterns replaced, in their order."""
    for find, put in patterns:
        text = F.regexp_replace(text, find, put)
    return text
