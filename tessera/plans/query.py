"""The query layer: filters over relations, named filters, ordering, limits and pages, from keywords, JSON or URLs."""

from __future__ import annotations

import inspect
import json
import math
from collections.abc import Callable
from typing import Any
from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import build, predicate, split_lookup, split_values
from .schema import Catalog

LIMIT, PAGE_SIZE = 10_000, 25
CONTROLS = ("order_by", "limit", "page", "page_size")


def order_columns(names: list[str] | str) -> list[Column]:
    """Ordering by names, descending after a minus; nulls last either way."""
    names = [names] if isinstance(names, str) else names
    return [F.col(f"`{n[1:]}`").desc_nulls_last() if n.startswith("-") else F.col(f"`{n}`").asc_nulls_last() for n in names]


class Query:
    """An unexecuted query on a table of a catalog; every method returns a new one."""

    def __init__(self, catalog: Catalog, table: str, df: DataFrame | None = None, ordered: bool = False, named: dict[str, Callable] | None = None):
        self.catalog, self.spec = catalog, catalog.spec(table)
        self.df = catalog.read(table) if df is None else df
        self.ordered, self.named = ordered, named or {}

    def _with(self, df: DataFrame, ordered: bool | None = None) -> Query:
        return Query(self.catalog, self.spec.name, df, self.ordered if ordered is None else ordered, self.named)

    def register(self, name: str, f: Callable[..., Query]) -> Query:
        """Adds a named filter f(query, ...); in configurations its name takes precedence over columns."""
        return Query(self.catalog, self.spec.name, self.df, self.ordered, self.named | {name: f})

    def relate(self, names: list[str], depth: int | None = None) -> Query:
        """The query with the columns that names reach over foreign keys, as relation__column; each relation is joined once."""
        df, joined = self.df, set()
        for name in names:
            spec, prefix, parts = self.spec, "", name.split("__")
            if depth is not None and len(parts) - 1 > depth:
                raise ValueError(f"{name} crosses more than {depth} relations")
            while parts[0] in spec.foreign:
                fk, path = spec.foreign[parts[0]], f"{prefix}{parts[0]}"
                if path not in joined and f"{path}__{fk.key}" not in df.columns:
                    other = self.catalog.read(fk.table)
                    df = df.join(other.select(*[F.col(c).alias(f"{path}__{c}") for c in other.columns]), F.col(f"`{prefix}{fk.column}`") == F.col(f"`{path}__{fk.key}`"), "left")
                joined.add(path)
                spec, prefix, parts = self.catalog.spec(fk.table), path + "__", parts[1:]
        return self._with(df)

    def filter(self, **lookups: Any) -> Query:
        own = self.df.columns
        plain = {k: v for k, v in lookups.items() if not (k.endswith("__ids") and k[:-5] in self.spec.bridges)}
        query = self.relate(list(plain))
        if plain:
            query = query._with(query.df.where(build(query.df.columns, plain)))
        for k, ids in lookups.items():
            if k not in plain:
                query = query.linked(k[:-5], ids)
        return query._with(query.df.select(*own))

    def exclude(self, **lookups: Any) -> Query:
        query = self.relate(list(lookups))
        return query._with(query.df.where(~F.coalesce(build(query.df.columns, lookups), F.lit(False))).select(*self.df.columns))

    def linked(self, relation: str, ids: list) -> Query:
        """Rows linked to every one of ids; none are linked to nothing."""
        b = self.spec.bridges[relation]
        links = self.catalog.read(b.table).select(F.col(b.own).alias(self.spec.key), F.col(b.other).alias("_other"))
        if not ids:
            return self._with(self.df.join(links, self.spec.key, "left_anti"))
        ids = list(dict.fromkeys(ids))
        full = links.where(F.col("_other").isin(ids)).groupBy(self.spec.key).agg(F.countDistinct("_other").alias("_n")).where(F.col("_n") == len(ids))
        return self._with(self.df.join(full, self.spec.key, "left_semi"))

    def tagged(self, tags: list[str], column: str = "tags") -> Query:
        """Rows that have all tags; an empty list stands for rows without tags."""
        test = F.size(column) == 0
        if tags:
            test = F.lit(True)
            for t in tags:
                test = test & F.array_contains(column, t)
        return self._with(self.df.where(test))

    def younger(self, cutoff: str, column: str, now: Any) -> Query:
        """Rows whose column is at most an hour, day, week, month or year before now."""
        hours = {"hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}[cutoff]
        return self._with(self.df.where(F.col(column) >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))))

    def values(self, *names: str) -> DataFrame:
        """Columns by name, over relations too."""
        return self.relate(list(names)).df.select(*[F.col(f"`{n}`") for n in names])

    def order_by(self, *names: str) -> Query:
        query = self.relate([n.lstrip("-") for n in names])
        return query._with(query.df.orderBy(*order_columns(list(names))).select(*self.df.columns), True)

    def limit(self, n: int | None) -> Query:
        return self._with(self.df if n is None else self.df.limit(n))

    def page(self, number: Any = 1, size: int = PAGE_SIZE, count: int | None = None) -> Query:
        """One page. Without an order the newest keys come first; a number that is not one is 1, one too large the last."""
        query = self if self.ordered else self.order_by("-" + self.spec.key)
        number = int(number) if str(number).lstrip("-").isdigit() else 1
        if number > 1:
            count = query.df.count() if count is None else count
            number = min(number, max(1, math.ceil(count / size)))
        return query._with(query.df.offset((max(number, 1) - 1) * size).limit(size))

    def distinct_on(self, *columns: str, order: list[str]) -> Query:
        from pyspark.sql import Window

        w = Window.partitionBy(*columns).orderBy(*order_columns(order))
        return self._with(self.df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))

    def update(self, test: Column, **values: Any) -> Query:
        return self._with(self.df.withColumns({c: F.when(test, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def from_config(self, config: dict, depth: int | None = None) -> Query:
        """A query from {filters, order_by, limit, page, page_size, paginate}: named filters first, the rest together. Pages are cut
        from the first LIMIT rows unless a limit is given; without pages all rows come, or as many as a given limit says."""
        query, plain = self, {}
        filters = config.get("filters", {})
        arguments = {p for f in self.named.values() for p in list(inspect.signature(f).parameters)[1:]}
        for name, value in filters.items():
            if depth is not None and name.count("__") > depth:
                raise ValueError(f"{name} crosses more than {depth} relations")
            if name in self.named:
                query = self.named[name](query, **value) if isinstance(value, dict) else self.named[name](query, value)
            elif name.endswith("__ids") and name[:-5] in self.spec.bridges:
                query = query.linked(name[:-5], value)
            elif name not in arguments:
                plain[name] = value
        query = query.filter(**plain) if plain else query
        if config.get("order_by"):
            order = config["order_by"]
            query = query.order_by(*([order] if isinstance(order, str) else order))
        paginate = config.get("paginate", True)
        query = query if query.ordered or not paginate else query.order_by("-" + self.spec.key)
        query = query.limit(config.get("limit", LIMIT if paginate else None))
        return query.page(config.get("page", 1), config.get("page_size", PAGE_SIZE)) if paginate else query

    def from_url(self, url: str) -> Query:
        return self.from_config(parse_url(url))

    def web(self) -> Query:
        """The query over what web users may see of the table; call it first, as it starts anew."""
        return self._with(self.catalog.read_web(self.spec.name), False)


def parse_url(url: str) -> dict:
    """A configuration from the parameters of a URL: values are JSON or else text, the last of several counts."""
    config: dict[str, Any] = {"filters": {}}
    for name, text in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        if name == "format":
            continue
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        config.update({name: value}) if name in CONTROLS else config["filters"].update({name: value})
    return config


def form_filters(form: dict[str, Any], ignored: tuple[str, ...] = ()) -> dict[str, Any]:
    """Lookups of a search form: empty and ignored fields are left out, id lists are parted."""
    return {k: split_values(v) if k.endswith("__in") and isinstance(v, str) else v for k, v in form.items() if k not in ignored and v not in (None, "", [])}


def page_url(url: str, page: int) -> str:
    parts = urlsplit(url)
    params = dict(parse_qsl(parts.query)) | {"page": str(page)}
    return parts._replace(query=urlencode(sorted(params.items()))).geturl()


def page_range(page: int, pages: int, around: int = 2, ends: int = 1) -> list[int | None]:
    """Page numbers around a page and at the ends; None stands for a gap."""
    shown = sorted({p for p in range(1, pages + 1) if abs(p - page) <= around or p <= ends or p > pages - ends})
    out: list[int | None] = []
    for p in shown:
        if out and out[-1] is not None and p - out[-1] > 1:
            out.append(None)
        out.append(p)
    return out


def scoped(df: DataFrame, label: str, config: str) -> DataFrame:
    """Rows of a saved filter (JSON lookups) with its label."""
    return df.where(build(df.columns, json.loads(config))).withColumn("scope_label", F.lit(label))


def frame_filter(df: DataFrame, limit: int | None = None, **lookups: Any) -> DataFrame:
    """Lookups on a plain DataFrame, where contains is a regular expression."""
    out = df.where(build(df.columns, lookups, frame=True, lenient=True))
    return out if limit is None else out.limit(limit)


__all__ = ["Query", "build", "form_filters", "frame_filter", "order_columns", "page_range", "page_url", "parse_url", "predicate", "scoped", "split_lookup"]
