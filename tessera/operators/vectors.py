"""Similarity of vectors and bit fingerprints: metrics, top-k, partitioned search, pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import Stage

#: Measured bytes up to which a side is broadcast.
BROADCAST_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _sum_of(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


METRICS = {
    "l1": lambda a, b: _sum_of(a, b, lambda x, y: F.abs(x.cast("double") - y)),
    "l2": lambda a, b: F.sqrt(_sum_of(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))),
    "inner": lambda a, b: dot(a, b),
    "cosine": lambda a, b: F.when((length(a) > 0) & (length(b) > 0), 1 - dot(a, b) / (length(a) * length(b))),
    "hamming": lambda a, b: _sum_of(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)),
    "jaccard": lambda a, b: 1 - tanimoto(to_words(a), to_words(b)),
}


def to_words(v: Column) -> Column:
    """The signs of a vector as bits, in words of 32."""
    word = lambda j: F.aggregate(F.transform(F.slice(v, j * 32 + 1, 32), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1), word)


def _bits(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def tanimoto(a: Column, b: Column) -> Column:
    """Common bits by all bits of two fingerprints; 0 where neither has any."""
    every = _bits(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(every > 0, _bits(a, b, lambda x, y: x.bitwiseAND(y)) / every).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    ones = _bits(a, a, lambda x, y: x.bitwiseAND(y)) + _bits(b, b, lambda x, y: x.bitwiseAND(y))
    return F.when(ones > 0, 2 * _bits(a, b, lambda x, y: x.bitwiseAND(y)) / ones).otherwise(F.lit(0.0))


def holds_bits(a: Column, probe: Column) -> Column:
    """Whether all bits of the probe are set: the screen before an exact substructure match."""
    return F.forall(F.zip_with(a, probe, lambda x, y: x.bitwiseAND(y) == y), lambda x: x)


def top_k(df: DataFrame, key: str, distance: Column, k: int) -> DataFrame:
    """The k nearest rows; partial top-k in each partition, then of all."""
    return df.select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def similar(df: DataFrame, similarity: Column, cutoff: float | None = 0.5, order: bool = True) -> DataFrame:
    out = df.withColumn("similarity", similarity)
    out = out.where(F.col("similarity") >= cutoff) if cutoff else out
    return out.orderBy(F.desc("similarity")) if order else out


def nearest_queries(base: DataFrame, queries: DataFrame, key: str, vector: str, metric: str, k: int) -> DataFrame:
    """The k nearest base rows of each row of a stated set of queries, which is broadcast up to BROADCAST_BYTES."""
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    size = q.agg(F.coalesce(F.sum(F.size("_q") * 8 + 32), F.lit(0))).first()[0]
    q = F.broadcast(q) if size <= BROADCAST_BYTES else q
    scored = base.join(q, F.col(key) != F.col("query_id")).select("query_id", key, METRICS[metric](F.col(vector), F.col("_q")).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of either side that a task of tanimoto_pairs compares.
PAIR_ROWS = 4096


def _bit_matrix(words: pa.ListArray) -> np.ndarray:
    """Words of 32 bits as a matrix of zeros and ones."""
    flat = words.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    return np.unpackbits(flat.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").astype(np.float32)


def tanimoto_pairs(df: DataFrame, key: str, words: str, cutoff: float) -> DataFrame:
    """(a, b, similarity) of the pairs a < b at or over a cutoff above 0; keys are unique.

    Bit counts of such a pair differ by the cutoff's ratio at most, so rows are put in bands of that ratio and meet their own band
    and the next one. Bands are cut into pieces of PAIR_ROWS rows; a task compares two pieces by one product of bit matrices, and
    only pairs over the cutoff come out. Rows without bits, and null ones, have no pairs.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff is above 0 and at most 1")
    bits = _bits(F.col(words), F.col(words), lambda x, y: x.bitwiseAND(y))
    # a width a little over the ratio, so that rounding of logarithms loses no pair
    width = max(math.log(1 / cutoff), 0.05) * (1 + 1e-9)
    rows = df.select(F.col(key).alias("key"), F.col(words).alias("w"), bits.alias("n")).where("n > 0").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    # a band for each power of the ratio
    pieces = {r.band: -(-r.c // PAIR_ROWS) for r in rows.groupBy("band").agg(F.count("*").alias("c")).collect()}
    if not pieces:
        return df.sparkSession.createDataFrame([], f"a {dict(df.dtypes)[key]}, b {dict(df.dtypes)[key]}, similarity double")
    of = lambda band: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i in pieces.items() for x in i]), band), F.lit(0))
    own = rows.withColumn("piece", F.pmod(F.xxhash64("key"), of(F.col("band"))).cast("int"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    left = own.withColumn("to", F.explode(F.array("band", F.col("band") + 1))).withColumn("j", F.explode(up_to(of(F.col("to"))))).select("band", "to", F.col("piece").alias("i"), "j", "key", "w").where("band < to OR i <= j")
    right = own.withColumnRenamed("band", "to").withColumn("band", F.explode(F.array("to", F.col("to") - 1))).withColumn("i", F.explode(up_to(of(F.col("band"))))).select("band", "to", "i", F.col("piece").alias("j"), "key", "w").where("band < to OR i <= j")
    right = right.toDF(*right.columns)
    kind = to_arrow_type(df.schema[key].dataType)
    shape = pa.schema([("a", kind), ("b", kind), ("similarity", pa.float64())])

    def compared(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return shape.empty_table()
        same = some.column("band")[0] == some.column("to")[0] and some.column("i")[0] == some.column("j")[0]
        ka, kb, found = some.column("key").combine_chunks(), others.column("key").combine_chunks(), []
        y = _bit_matrix(others.column("w").combine_chunks())
        ny = y.sum(axis=1)
        for lo in range(0, some.num_rows, 512):
            x = _bit_matrix(some.column("w").slice(lo, 512).combine_chunks())
            both = (x @ y.T).astype(float)
            share = both / (x.sum(axis=1)[:, None] + ny - both)
            p, q = np.nonzero(share >= cutoff)
            first, second = ka.take(pa.array(p + lo)), kb.take(pa.array(q))
            less = pc.less(first, second)
            if same:  # each pair stands twice
                t = pa.table([first, second, share[p, q]], schema=shape).filter(less)
            else:
                t = pa.table([pc.if_else(less, first, second), pc.if_else(less, second, first), share[p, q]], schema=shape)
            found.append(t)
        return pa.concat_tables(found)

    by = ["band", "to", "i", "j"]
    key_type = dict(df.dtypes)[key]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compared, f"a {key_type}, b {key_type}, similarity double")


#: Keys in a range that clusters_of_equal numbers by itself.
KEY_RANGE = 1 << 16


def clusters_of_equal(df: DataFrame, key: str, value: str) -> DataFrame:
    """A number from 1 for each group of equal values, by its first key; keys are integers.

    First keys are numbered inside ranges of KEY_RANGE keys, behind the totals of the ranges before: only those totals, a row
    for each range, meet in one task.
    """
    firsts = df.groupBy(value).agg(F.min(key).alias("_first")).withColumn("_range", F.floor(F.col("_first") / KEY_RANGE))
    ranges = firsts.groupBy("_range").agg(F.count("*").alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = firsts.join(before, "_range").select(value, (F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_first"))).alias("cluster"))
    named = numbered.withColumnRenamed(value, "_value")
    return df.join(named, df[value].eqNullSafe(named["_value"])).select(df[key], F.col("cluster").cast("long").alias("cluster"))


def fit_partitions(df: DataFrame, key: str, vector: str, cells: int, sample: int = 20_000, seed: int = 1):
    """Cell centres for a partitioned index, by k-means on a sample of about so many rows, chosen by hash without sorting the table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample / max(1, df.count()))
    rows = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < share * (1 << 20)).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=cells, seed=seed).fit(rows)


def assign_cells(df: DataFrame, model, vector: str) -> DataFrame:
    """df with its cell: write it partitioned by cell, so that searches read a few cells only."""
    from pyspark.ml.functions import array_to_vector

    return model.setPredictionCol("cell").transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))).drop("features")


def search_cells(indexed: DataFrame, model, vector: str, query: list[float], key: str, k: int, probes: int) -> DataFrame:
    """The k nearest rows in the cells whose centres are nearest to the query, compared exactly."""
    near = sorted(range(len(model.clusterCenters())), key=lambda i: float(sum((a - b) ** 2 for a, b in zip(model.clusterCenters()[i], query, strict=True))))[:probes]
    q = F.array(*[F.lit(float(x)) for x in query])
    return top_k(indexed.where(F.col("cell").isin(near)), key, METRICS["l2"](F.col(vector), q), k)


#: Rows, and queries, that a task of nearest_in_cells compares.
CELL_ROWS, CELL_QUERIES = 1 << 14, 1 << 11


def rows_of(column: pa.ListArray) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest_of_block(x: np.ndarray, q: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) by l2 of the k nearest rows of x for each row of q, but rows marked as the same; the first of equal ones count.

    A product of matrices chooses the rows that can be among them, with an allowance for rounding; their distances are sums in the order
    of the dimensions, as METRICS has them.
    """
    squares, own = (x**2).sum(axis=1), (q**2).sum(axis=1)[:, None]
    about = own - 2 * (q @ x.T) + squares
    about[same] = np.inf
    bound = np.partition(about, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    # written so that what isn't a number is compared, too
    p, j = np.nonzero(~(about > (bound + 1e-9 * (own[:, 0] + squares.max()))[:, None]) & ~same)
    d = np.concatenate([np.empty(0), *[np.sqrt(np.cumsum((x[j[lo : lo + 32768]] - q[p[lo : lo + 32768]]) ** 2, axis=1)[:, -1]) for lo in range(0, len(p), 32768)]])
    order = np.lexsort((j, d, p))
    p, j, d = p[order], j[order], d[order]
    take = np.arange(len(p)) - np.searchsorted(p, p) < k
    return p[take], j[take], d[take]


def nearest_in_cells(rows: DataFrame, plan: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, distance): for each query the k nearest rows by l2, its own key excepted, of the cells that it reads.

    rows has cell, key and vector (of one length, null ones are left out), plan query_id, _q and cell: a row for each cell that a query reads.
    The rows and queries of a cell are cut into pieces of CELL_ROWS and CELL_QUERIES; a task compares two pieces by a product of
    matrices, and only the k best of each come out.
    """
    rows, plan = rows.where(F.col(vector).isNotNull()), plan.where("_q IS NOT NULL")
    # one number for each cell
    pieces = lambda df, n: {r.cell: -(-r.n // n) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    has, asks = pieces(rows, CELL_ROWS), pieces(plan, CELL_QUERIES)
    of = lambda found: F.coalesce(F.create_map(*[F.lit(x) for i in found.items() for x in i])[F.col("cell")] if found else F.lit(None), F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where(F.col("cell").isin(list(asks))).select("cell", F.col(key).alias("_k"), F.col(vector).alias("_v"), F.pmod(F.xxhash64(key), of(has)).cast("int").alias("_i"), spread(of(asks)).alias("_j"))
    right = plan.select("cell", "query_id", "_q", F.pmod(F.xxhash64("query_id"), of(asks)).cast("int").alias("_j"), spread(of(has)).alias("_i"))
    right = right.toDF(*right.columns)
    shape = pa.schema([("query_id", to_arrow_type(plan.schema["query_id"].dataType)), (key, to_arrow_type(rows.schema[key].dataType)), ("distance", pa.float64())])

    def best(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return shape.empty_table()
        some = some.take(pc.sort_indices(some, [("_k", "ascending")]))  # of equal rows the least key comes first
        keys, who = some.column("_k").combine_chunks(), asked.column("query_id").combine_chunks()
        x, q, out = rows_of(some.column("_v").combine_chunks()), rows_of(asked.column("_q").combine_chunks()), []
        ids, asks = keys.to_numpy(zero_copy_only=False), who.to_numpy(zero_copy_only=False)
        for lo in range(0, len(q), 64):
            p, j, d = _nearest_of_block(x, q[lo : lo + 64], asks[lo : lo + 64, None] == ids, k)
            out.append(pa.table([who.take(pa.array(p + lo)), keys.take(pa.array(j)), d], schema=shape))
        return pa.concat_tables(out)

    by = ["cell", "_i", "_j"]
    names = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for df, c in ((plan, "query_id"), (rows, key)))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, f"{names}, distance double")


def ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest of each query with their rank; of equal distances the smaller key comes first."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k)


def search_exactly(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, distance, rank): the result of nearest_queries by l2 for many queries, compared block by block."""
    plan = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"), F.lit(0).alias("cell"))
    return ranked(nearest_in_cells(base.select(F.lit(0).alias("cell"), key, vector), plan, key, vector, k), key, k)


def search_cells_exactly(indexed: DataFrame, queries: DataFrame, model, vector: str, key: str, k: int, probes: int) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of indexed for each query but itself, as nearest_queries by l2 has them.

    Each query is joined with the rows of its nearest cells (probes of them), then with those of further cells that can hold a
    nearer row: a row is at least as far as its cell's centre, less the cell's radius. A query with fewer than k rows so far
    reads all cells. The rows with their cells, and what the first cells gave, are written to the shared folder, as both are read more than once.
    """
    stage = Stage(indexed.sparkSession, "cells")
    indexed = stage(indexed.select("cell", key, vector))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    cells = indexed.sparkSession.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    radii = indexed.join(F.broadcast(cells), "cell").groupBy("cell").agg(F.max(METRICS["l2"](F.col(vector), F.col("centre"))).alias("radius"))
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    away = asked.crossJoin(F.broadcast(cells.join(radii, "cell"))).select("query_id", "_q", "cell", "radius", METRICS["l2"](F.col("_q"), F.col("centre")).alias("away"))
    plan = away.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("away", "cell")))
    first = stage(ranked(nearest_in_cells(indexed, plan.where(F.col("place") <= probes), key, vector, k), key, k))
    bound = first.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    # the allowance is for rounding; equal distances count, as the key decides between them
    further = plan.where(F.col("place") > probes).join(bound, "query_id", "left").where(F.col("bound").isNull() | (F.col("away") - F.col("radius") <= F.col("bound") * (1 + 1e-9) + 1e-9))
    return ranked(first.drop("rank").unionByName(nearest_in_cells(indexed, further, key, vector, k)), key, k)
