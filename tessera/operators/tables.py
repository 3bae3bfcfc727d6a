"""Tables as users see them: frames and pages, stored rows by their saved keys, bulk edits, work still to do."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import page_url


def to_frame(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """The columns asked for, in their order, or all but the excluded ones; the first limit rows."""
    out = df.select(*(columns or [c for c in df.columns if c not in exclude]))
    return out if limit is None else out.limit(limit)


def as_json(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """A row as a JSON object, nulls included."""
    return F.to_json(F.struct(*[c for c in df.columns if c not in exclude]), {"ignoreNullFields": "false"})


def page_json(df: DataFrame, order: list, page: int, size: int, url: str) -> DataFrame:
    """One row (count, next, previous, results): a page of rows as JSON objects, with links to its neighbours.

    A page before the first is the first, one behind the last the last; the other parameters of the URL stay in the links. The
    count is an aggregate; only the page's rows are sorted out and gathered.
    """
    n = df.count()
    page = min(max(page, 1), max(1, -(-n // size)))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], as_json(df).alias("_row")))).alias("r")).select(F.transform("r", lambda x: x["_row"]).alias("results"))
    link = lambda there, to: F.lit(page_url(url, to) if there else None).cast("string")
    return listed.select(F.lit(n).cast("long").alias("count"), link(n > page * size, page + 1).alias("next"), link(page > 1, page - 1).alias("previous"), "results")


def page_csv(df: DataFrame, columns: list[str], sep: str = ",", header: bool = False) -> DataFrame:
    """(line): rows as delimited text; values with the separator, quotes or line ends are quoted. header puts the names first."""
    special = "[" + re.escape(sep) + '"\r\n]'

    def cell(v: Column) -> Column:
        return F.when(v.rlike(special), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    lines = df.select(F.concat_ws(sep, *[cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("line"))
    names = df.sparkSession.range(1, numPartitions=1).select(F.concat_ws(sep, *[cell(F.lit(c)) for c in columns]).alias("line"))
    return names.unionByName(lines) if header else lines


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows of a Markdown table; bars are escaped and line ends become breaks."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>"), F.lit(""))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def summary_lines(df: DataFrame, key: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(key, summary): `name: value` lines of a row's columns in order of their names, without nulls, private (_) and excluded ones."""
    names = sorted(c for c in df.columns if c not in exclude and not c.startswith("_"))
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    return df.select(key, F.concat_ws("\n", *[line(c) for c in names]).alias("summary"))


def from_saved(tables: dict[str, tuple[DataFrame, str]], saved: DataFrame) -> DataFrame:
    """(pos, table, id, row) of saved references (table, id) to rows of several tables, in their given order (pos)."""
    found = [saved.where(F.col("table") == name).join(df.select(F.col(key).cast("long").alias("id"), as_json(df).alias("row")), "id") for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, found).select("pos", "table", "id", "row")


def fetch_by_priority(df: DataFrame, wanted: list[tuple[str, Any]]) -> DataFrame:
    """The one row that the first usable of (column, value) names; pairs with a null value are passed over."""
    for column, value in wanted:
        if value is not None:
            return df.where(F.col(column) == value).limit(1)
    raise ValueError("no value to fetch a row by")


def update_many(df: DataFrame, key: str, ids: list, values: dict[str, Any]) -> DataFrame:
    """df with the values that aren't None set in the rows of ids."""
    hit = F.col(key).isin(ids)
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def to_fill(df: DataFrame, columns: list[str], valid: Column | None = None) -> DataFrame:
    """Rows that still lack a value in one of the columns and are valid."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.where(lacks if valid is None else lacks & valid)


def update_column(df: DataFrame, name: str, made: Column, only_null: bool = False) -> DataFrame:
    """df with a new or replaced column; only_null keeps the values that are there."""
    return df.withColumn(name, F.coalesce(F.col(name), made) if only_null and name in df.columns else made)


def exists(df: DataFrame) -> DataFrame:
    """One row: whether df has any."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def null_bypass(value: Column, made: Column) -> Column:
    """made where value is not null, null elsewhere."""
    return F.when(value.isNotNull(), made)


def in_pool(df: DataFrame, pool: DataFrame, on: list[str]) -> DataFrame:
    """df with is_new: whether its row's fingerprint is not in the pool."""
    return df.join(pool.select(*on).distinct().withColumn("_known", F.lit(True)), on, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def beside(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The columns of two frames of the same rows side by side."""
    return a.join(b, key)


def chunked(values: Column, size: int) -> Column:
    """An array in pieces of size elements."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda i: F.slice(values, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def merged_maps(base: Column, over: Column) -> Column:
    """Two maps as one; the second one's values win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def flattened(clusters: DataFrame, members: str, cluster: str) -> DataFrame:
    """(cluster, key): a row for each member of a cluster."""
    return clusters.select(cluster, F.explode(members).alias("key"))


def unflattened(rows: DataFrame, cluster: str, key: str) -> DataFrame:
    """(cluster, members): the sorted members of each cluster."""
    return rows.groupBy(cluster).agg(F.sort_array(F.collect_list(key)).alias("members"))
