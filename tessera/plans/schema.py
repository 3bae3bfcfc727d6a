"""Declared tables: their relations, fragments of derived columns, and a registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ForeignKey:
    """name leads from column to the key of another table."""

    column: str
    table: str
    key: str


@dataclass(frozen=True)
class Bridge:
    """A many-to-many relation through a linking table."""

    table: str
    own: str
    other: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: str
    foreign: dict[str, ForeignKey] = field(default_factory=dict)
    bridges: dict[str, Bridge] = field(default_factory=dict)
    raw: tuple[str, ...] = ()
    derive: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    comments: dict[str, str] = field(default_factory=dict)
    archive_exclude: tuple[str, ...] = ()
    #: What web queries may see of the table; everything if it is None.
    visible: Callable[[DataFrame], DataFrame] | None = None

    def with_derived(self, df: DataFrame) -> DataFrame:
        """df with the derived columns of all fragments, in order; a later one wins."""
        return reduce(lambda d, f: d.transform(f), self.derive, df)

    def columns(self, df: DataFrame, relations: bool = False, exclude: tuple[str, ...] = ()) -> list[str]:
        names = [c for c in df.columns if c not in exclude]
        return names + (sorted([*self.foreign, *self.bridges]) if relations else [])

    def archive_columns(self, df: DataFrame) -> list[str]:
        """What an archive must hold: the key and the raw columns; the others can be derived again."""
        return sorted({self.key, *(c for c in self.raw if not c.startswith("--"))} & set(df.columns) - {c[2:] for c in self.raw if c.startswith("--")})

    def describe(self, df: DataFrame) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString(), "comment": self.comments.get(f.name, "")} for f in df.schema]


class Catalog:
    """Tables by name, read from a folder of Parquet files or given as DataFrames."""

    def __init__(self, specs: list[TableSpec], read: Callable[[str], DataFrame]):
        self.specs, self._read = {s.name: s for s in specs}, read

    def spec(self, name: str) -> TableSpec:
        found = [s for s in self.specs.values() if s.name == name or s.name.endswith("." + name)]
        if len(found) != 1:
            raise KeyError(f"{name}: {'no such table' if not found else 'more than one table'}")
        return found[0]

    def read(self, name: str) -> DataFrame:
        spec = self.spec(name)
        return spec.with_derived(self._read(spec.name))

    def read_web(self, name: str) -> DataFrame:
        """The rows of a table that web queries may see; their filters come on top."""
        visible = self.spec(name).visible
        return self.read(name) if visible is None else visible(self.read(name))
