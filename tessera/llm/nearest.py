"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed, heaps merged."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A tile compares at most so many queries with so many rows; one side of a tile is all that a task holds of a table.
TILE_QUERIES, TILE_ROWS = 2048, 16384
#: Bytes of either side of a tile, as doubles: wide vectors have fewer rows in it.
TILE_BYTES = 64 << 20
#: Rows and queries of one matrix product inside a tile, and bytes of the pairs recomputed at once.
PRODUCT_QUERIES, PRODUCT_ROWS, PAIR_BYTES = 256, 4096, 32 << 20
#: Bytes of original vectors in a packed block.
BLOCK_BYTES = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all entries finite, one of them not 0."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm, error): int8 codes whose product with a row's scale is the row but for a vector of length error."""
    scale = np.abs(rows).max(axis=1) / 127
    scale[scale == 0] = 1e-300
    codes = np.clip(np.rint(rows / scale[:, None]), -127, 127).astype(np.int8)
    with np.errstate(over="ignore"):
        error = np.sqrt(((rows - codes * scale[:, None]) ** 2).sum(axis=1))
        norm = np.sqrt((rows**2).sum(axis=1))
    return codes, scale, norm, error * (1 + 1e-9)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, entries added in their order: the same value wherever a pair is met."""
    total = a[:, 0] * b[:, 0]
    for d in range(1, a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Tile:
    """The k best rows of each query over the row blocks that it is shown."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.codes, self.scale, self.norm, self.error = quantised(rows)
        # products of codes are whole numbers that a float of this size holds exactly
        self.kind = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def show(self, ids: np.ndarray, rows: np.ndarray) -> None:
        ids, rows = self._without_copies(ids, rows)
        for at in range(0, len(ids), PRODUCT_ROWS):
            part = slice(at, at + PRODUCT_ROWS)
            codes, scale, norm, error = quantised(rows[part])
            codes = codes.astype(self.kind).T
            for lo in range(0, len(self.ids), PRODUCT_QUERIES):
                self._product(slice(lo, lo + PRODUCT_QUERIES), ids[part], rows[part], codes, scale, norm, error)

    def _without_copies(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal rows the k + 1 with the smallest ids: no query's nearest can hold another (it may own one of them)."""
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], np.ascontiguousarray(rows[order]) + 0.0
        _, group, count = np.unique(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_inverse=True, return_counts=True)
        if count.max(initial=0) <= self.k + 1:
            return ids, rows
        by = np.argsort(group, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        return ids[place <= self.k], rows[place <= self.k]

    def _product(self, q: slice, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, scale: np.ndarray, norm: np.ndarray, error: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            about = (self.codes[q].astype(self.kind) @ codes).astype(np.float64)
            about *= self.scale[q, None] * scale
            # |ab - a'b'| <= |a - a'| |b| + |a'| |b - b'|, and |a'| <= |a| + |a - a'|
            off = self.error[q, None] * norm + (self.norm[q] + self.error[q])[:, None] * error
            off += (np.abs(about) + off) * 1e-9
            most = about + off
            about -= off
        np.nan_to_num(most, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        np.nan_to_num(about, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        at = np.minimum(np.searchsorted(ids, self.ids[q]), len(ids) - 1)
        own = np.flatnonzero(ids[at] == self.ids[q])
        most[own, at[own]] = about[own, at[own]] = -np.inf
        bar = self.least[q].copy()
        if len(ids) > self.k:
            # so many rows reach this for certain
            bar = np.maximum(bar, np.partition(about, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        x, y = np.nonzero((most >= bar[:, None]) & (most > -np.inf))
        x += q.start
        step = max(64, PAIR_BYTES // (8 * rows.shape[1]))
        for lo in range(0, len(x), step):
            self._recompute(x[lo : lo + step], y[lo : lo + step], ids, rows)

    def _recompute(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            score = exact_products(self.rows[x], rows[y])
        good = (score >= self.least[x]) & ~np.isnan(score)
        for i, s, k in zip(x[good].tolist(), score[good].tolist(), ids[y[good]].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -k))
            elif (s, -k) > heap[0]:
                heapq.heapreplace(heap, (s, -k))
            else:
                continue
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def table(self, schema: pa.Schema) -> pa.Table:
        found = [(q, -k, s) for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for s, k in heap]
        return pa.table(list(map(list, zip(*found, strict=True))) or [[], [], []], schema=schema)


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Blocks (dims, n, ids, vectors, and the same of the query rows) of vectors of one length; of rows with one key the first counts."""
    kind = "f4" if dict(df.dtypes)[vector] == "array<float>" else "f8"

    def run(batches):
        last, ids, asked, parts, size = None, [], [], [], 0

        def block():
            v, i, a = np.concatenate(parts), np.concatenate(ids), np.concatenate(asked)
            return pa.RecordBatch.from_pydict({"dims": [v.shape[1]], "n": [len(i)], "n_queries": [int(a.sum())], "ids": [i.tobytes()], "vectors": [v.tobytes()], "query_ids": [i[a].tobytes()], "query_vectors": [v[a].tobytes()]}, schema=_BLOCK)

        for b in batches:
            for lo in range(0, b.num_rows, 256):  # a slice has at most 256 rows, so blocks stay near their size
                piece = b.slice(lo, 256)
                k, v = piece.column(0).to_numpy(zero_copy_only=False), piece.column(1)
                new = np.ones(len(k), bool)
                new[0] = k[0] != last
                new[1:] = k[1:] != k[:-1]
                last = k[-1]
                # rows come by key, so the lengths may alternate: every length has its own rows of the piece
                width, flat, a = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(kind), piece.column(2).to_numpy(zero_copy_only=False)
                at = np.append(0, np.cumsum(width))[:-1]
                for w in np.unique(width[new]).tolist():
                    rows = np.flatnonzero(new & (width == w))
                    if parts and (parts[0].shape[1] != w or size >= BLOCK_BYTES):
                        yield block()
                        ids, asked, parts, size = [], [], [], 0
                    ids.append(k[rows]), asked.append(a[rows]), parts.append(flat[at[rows][:, None] + np.arange(w)])
                    size += parts[-1].nbytes
        if parts:
            yield block()

    common.small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("_id"), vector, "_asked").repartition("_id").sortWithinPartitions("_id", F.desc(vector), F.desc("_asked"))
    return rows.mapInArrow(run, "dims int, n long, n_queries long, ids binary, vectors binary, query_ids binary, query_vectors binary")


_BLOCK = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("n_queries", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("query_ids", pa.binary()), ("query_vectors", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _numbered(blocks: DataFrame, rows: str, most: int) -> DataFrame:
    """blocks with tile: consecutive blocks of one length and about most rows (fewer wide ones) share one; ranges of blocks are totalled first."""
    sized = blocks.withColumn("_range", F.pmod(F.xxhash64("ids"), F.lit(1 << 12)))
    totals = sized.groupBy("dims", "_range").agg(F.sum(rows).alias("_t"))
    before = totals.select("dims", "_range", F.coalesce(F.sum("_t").over(Window.partitionBy("dims").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    most = F.least(F.lit(most), F.greatest(F.lit(64), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dims")))))
    own = F.coalesce(F.sum(rows).over(Window.partitionBy("dims", "_range").orderBy(F.xxhash64("ids"), "ids").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.join(before, ["dims", "_range"]).withColumn("tile", F.floor((F.col("_o") + own) / most)).drop("_range", "_o")


def nearest(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row that queries holds for, itself left out.

    The nearest come first, of equal ones the smaller id; a query with fewer candidates gets all of them. score is the product
    of the original vectors in double precision, entries added in their order. Rows without a key, and vectors that are null,
    empty, all zero or hold null or non-finite entries take no part. Vectors of different lengths have no product and never
    meet. Of rows with one key the one with the greatest vector counts. Products that aren't numbers, as of terms infinite both
    ways, take no part. An empty table gives an empty result; further columns are ignored.

    Rows are packed into blocks. A tile joins up to TILE_QUERIES queries with up to TILE_ROWS rows: products of int8 codes give
    scores with a bound of their error, and pairs that can still be among the k best are recomputed from the original vectors
    and kept in a heap for each query. The heaps of all tiles of a query are merged by rank. Each block of rows is sent once for
    each tile of queries, and each query block once for each tile of rows: a stated query set against all rows, in blocks.
    """
    asked = df.where(F.col(key).isNotNull() & usable(F.col(vector))).withColumn("_asked", F.coalesce(queries, F.lit(False)))
    blocks = common.staged(_packed(asked.select(key, vector, "_asked"), key, vector), "blocks")
    kind = "f4" if dict(df.dtypes)[vector] == "array<float>" else "f8"
    rows = _numbered(blocks.select("dims", "n", "ids", "vectors"), "n", TILE_ROWS).withColumnRenamed("tile", "row_tile")
    asks = blocks.where("n_queries > 0").select("dims", "n_queries", F.col("query_ids").alias("ids"), F.col("query_vectors").alias("vectors"))
    asks = _numbered(asks, "n_queries", TILE_QUERIES).withColumnRenamed("tile", "query_tile")
    row_tiles, query_tiles = (x.groupBy("dims").agg((F.max(t) + 1).alias("_tiles")) for x, t in ((rows, "row_tile"), (asks, "query_tile")))
    # one row for each length of vectors
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias(n)
    left = rows.join(query_tiles, "dims").select("dims", "row_tile", each("query_tile"), "ids", "vectors")
    right = asks.join(row_tiles, "dims").select("dims", each("row_tile"), "query_tile", "ids", "vectors")
    right = right.toDF(*right.columns)  # columns of its own beside left's

    def tile(some: pa.Table, ask: pa.Table) -> pa.Table:
        if not some.num_rows or not ask.num_rows:
            return _FOUND.empty_table()
        dims = some.column("dims")[0].as_py()
        read = lambda t, c, dtype: np.concatenate([np.frombuffer(x.as_py(), dtype) for x in t.column(c)])
        vectors = lambda t: read(t, "vectors", kind).reshape(-1, dims).astype(np.float64)
        best = Tile(read(ask, "ids", np.int64), vectors(ask), k)
        best.show(read(some, "ids", np.int64), vectors(some))
        return best.table(_FOUND)

    by = ["dims", "row_tile", "query_tile"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
