"""Embedding whitening: covariance by sums of centred products over the upper triangle, generated as Spark SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries are counted in units of 1 / UNITS, behind OFFSET; those beyond LARGEST either way count as that.
UNITS, OFFSET, LARGEST = 1024, 100_000, float(1 << 50)
#: Dimensions whose products are columns of the aggregation; wider vectors take several rows of it.
COLUMNS = 64


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole_units(vector: Column) -> Column:
    """Entries as whole numbers: floor(UNITS * entry) + OFFSET."""
    bounded = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double")))
    return F.transform(vector, lambda c: F.floor(bounded(c) * UNITS).cast("long") + OFFSET)


@dataclass
class Whitening:
    """n vectors' sums, covariance (divisor n), and its unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def rank(self) -> int:
        """Components whose eigenvalue isn't 0 but for rounding."""
        least = self.values.max(initial=0) * len(self.values) * np.finfo(float).eps
        return int((self.values > least).sum())

    def centred(self) -> str:
        """SQL of a vector's entries less their means, from whole-number entries x."""
        return "array(" + ", ".join(f"x[{d}] - {s / self.n!r}D" for d, s in enumerate(self.sums)) + ")"

    def component(self, k: int) -> str:
        """SQL of a row's whitened place on component k, from centred entries c."""
        return f"({balanced([f'c[{d}] * {float(v)!r}D' for d, v in enumerate(self.vectors[:, k])], '({} + {})')}) / {float(np.sqrt(self.values[k]))!r}D"

    def deviation(self) -> str:
        """SQL of the sum of (n * x - S)^2 over the dimensions, from whole-number entries x; null beyond 64 bits."""
        if not all(-(1 << 63) < s < 1 << 63 for s in self.sums):
            return "CAST(NULL AS BIGINT)"
        off = f"zip_with(x, array({', '.join(f'{s}L' for s in self.sums)}), (a, s) -> try_subtract(try_multiply({self.n}L, a), s))"
        return f"aggregate({off}, 0L, (t, o) -> try_add(t, try_multiply(o, o)))"


def balanced(terms: list[str], join: str) -> str:
    """The terms joined pair by pair, so that expressions stay shallow."""
    while len(terms) > 1:
        terms = [join.format(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def units_of(df: DataFrame, vector: str, dims: int, key: str | None = None) -> DataFrame:
    """(_key, x): the whole-number entries of the vectors that have dims entries and only finite ones."""
    rows = df.where(finite(F.col(vector)) & (F.size(vector) == dims))
    return rows.select((F.col(key) if key else F.lit(None)).alias("_key"), whole_units(F.col(vector)).alias("x"))


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all finite vectors; None without any.

    The sums come first, in whole numbers. Then one aggregation sums (x_i - mean_i) * (x_j - mean_j) for every pair of dimensions
    once: SQL is generated for a block of COLUMNS dimensions i, and rows of the aggregation stand for the distances j - i round
    the dimensions, up to half of them, and for the blocks. Spark adds up in each partition; a number for each pair reaches the
    driver, where LAPACK decomposes the covariance. Only vectors of the most frequent length count (of equally frequent ones the longer).
    """
    sizes = df.where(finite(F.col(vector))).groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        return None
    dims, n = most[0]
    x = units_of(df, vector, dims)
    total = lambda f: x.selectExpr("array(" + ", ".join(f.format(d) for d in range(dims)) + ") AS s").first()[0]
    sums = total("try_sum(x[{}])")
    if None in sums:  # beyond 64 bits
        sums = [int(s) for s in total("sum(CAST(x[{}] AS DECIMAL(20,0)))")]
    out = Whitening(n, sums, np.zeros((dims, dims)), np.empty(0), np.empty(0))
    width = min(COLUMNS, dims)
    steps = x.selectExpr(f"{out.centred()} AS c").selectExpr("c", f"explode(sequence(0, {dims // 2})) AS step")
    blocks = steps.selectExpr("step", "c", f"concat(slice(c, step + 1, {dims}), slice(c, 1, step)) AS r", f"explode(sequence(0, {(dims - 1) // width})) AS block")
    cut = lambda a: f"slice({a}, block * {width} + 1, {width}) AS {a}"
    products = ", ".join(f"sum(get(c, {i}) * get(r, {i}))" for i in range(width))
    for row in blocks.selectExpr("step", "block", cut("c"), cut("r")).groupBy("step", "block").agg(F.expr(f"array({products})").alias("s")).collect():
        for i in range(row.block * width, min(dims, (row.block + 1) * width)):
            j = (i + row.step) % dims
            out.covariance[i, j] = out.covariance[j, i] = row.s[i - row.block * width] / n
    values, vectors = np.linalg.eigh(out.covariance)
    out.values, out.vectors = values[::-1], vectors[:, ::-1]
    return out


def identity_error(rows: DataFrame, names: list[str]) -> float:
    """The largest entry of the columns' covariance (centred, divisor n) less the identity."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = rows.agg(*[F.covar_pop(a, b) for a, b in pairs]).first()
    return max(abs(s - (a == b)) for (a, b), s in zip(pairs, found, strict=True))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each finite vector and each of the first components.

    The fit list is all vectors that are not null, hold neither null nor non-finite entries and have the most frequent length;
    others get no rows, and so do empty vectors. Repeated rows and null keys count and are returned like others. deviation is
    the exact sum of (n * x - S)^2 over the dimensions, null where it doesn't fit 64 bits. Fewer dimensions than components give
    as many as there are; components without variance (of equal vectors, of one row) are left out, as nothing can be scaled to
    variance 1. Equal eigenvalues may have any basis; signs are arbitrary, but the same for all rows. Further columns are ignored.
    """
    kind = dict(df.dtypes)[key]
    shape = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vector)
    count = min(components, model.rank) if model else 0
    if not count:
        return df.sparkSession.createDataFrame([], shape)
    x = units_of(df, vector, len(model.sums), key)
    names = [f"w{k}" for k in range(count)]
    placed = [f"{model.component(k)} AS {names[k]}" for k in range(count)]
    rows = x.selectExpr("_key", f"{model.deviation()} AS deviation", f"{model.centred()} AS c").selectExpr("_key", "deviation", *placed)
    error = identity_error(rows, names)
    total = float(np.trace(model.covariance))
    parts = [F.struct(F.lit(k + 1).alias("component"), F.col(names[k]).alias("whitened"), F.lit(float(model.values[k]) / total).alias("explained")) for k in range(count)]
    each = rows.select("_key", "deviation", F.explode(F.array(*parts)).alias("_p"))
    return each.select(F.col("_key").alias(key), "_p.component", F.lit(model.n).cast("long").alias("n"), "deviation", "_p.whitened", "_p.explained", F.lit(error).alias("identity_error"))
