"""Lookups: name__test=value pairs compiled into Column predicates."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_of(c: Column, values: Any) -> Column:
    values = list(values)
    return c.isin(values) if values else F.lit(False)


TESTS: dict[str, Callable[[Column, Any], Column]] = {
    "exact": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "iexact": lambda c, v: F.lower(c) == str(v).lower(),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "range": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "in": _one_of,
    "contains": lambda c, v: c.contains(v),
    "icontains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "startswith": lambda c, v: c.startswith(v),
    "istartswith": lambda c, v: F.lower(c).startswith(str(v).lower()),
    "endswith": lambda c, v: c.endswith(v),
    "iendswith": lambda c, v: F.lower(c).endswith(str(v).lower()),
    "regex": lambda c, v: c.rlike(v),
    "iregex": lambda c, v: c.rlike("(?i)" + v),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "has": lambda c, v: F.array_contains(c, v),
}
#: Parts of dates, as columns that further tests apply to.
PARTS: dict[str, Callable[[Column], Column]] = {
    "date": F.to_date,
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week": F.weekofyear,
    "day": F.dayofmonth,
    "week_day": F.dayofweek,
    "time": lambda c: F.date_format(c, "HH:mm:ss"),
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}
#: In frame mode contains and icontains are regular expressions.
FRAME_TESTS = TESTS | {"contains": TESTS["regex"], "icontains": TESTS["iregex"]}


def split_lookup(name: str, columns: list[str]) -> tuple[str, list[str]]:
    """The longest column that name starts with, and the tests behind it."""
    parts = name.split("__")
    for n in range(len(parts), 0, -1):
        if "__".join(parts[:n]) in columns:
            return "__".join(parts[:n]), parts[n:]
    raise KeyError(f"no column for {name}")


def predicate(column: Column, tests: list[str], value: Any, frame: bool = False, lenient: bool = False) -> Column:
    known = FRAME_TESTS if frame else TESTS
    for i, t in enumerate(tests):
        if t in PARTS:
            column = PARTS[t](column)
        elif t in known and i == len(tests) - 1:
            return known[t](column, value)
        elif not lenient:
            raise KeyError(f"unknown test {t}")
    return known["exact"](column, value)


def build(columns: list[str], lookups: dict[str, Any], frame: bool = False, lenient: bool = False) -> Column:
    """All lookups, joined by AND."""
    if not lookups:
        raise ValueError("at least one lookup is needed")
    found = []
    for name, value in lookups.items():
        column, tests = split_lookup(name, columns)
        found.append(predicate(F.col(f"`{column}`"), tests, value, frame, lenient))
    return reduce(lambda a, b: a & b, found)


def split_values(text: str) -> list[str]:
    """Values of a form field, parted by commas, blanks or line ends."""
    return [v for v in re.split(r"[,\s]+", text) if v]
