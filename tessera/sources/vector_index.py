"""Stored vector indexes of a datastore: cells of an inverted file, vectors as product-quantised codes, shards that commit one by one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CHUNK_SIZE
from ..operators import vectors
from ..operators.vectors import METRICS, rows_of
from .datastore import Datastore
from .scratch import Stage, file_system, names

#: Codes of a cell, and queries, that one task compares.
PIECE_ROWS, PIECE_QUERIES = 1 << 17, 1 << 10


@dataclass(frozen=True)
class IndexSpec:
    """How a column of vectors is indexed.

    cells: centres of the inverted file; parts: pieces of a vector, each with a codebook of at most codes (256) centres; probes:
    cells that a search reads; rerank: candidates for each row asked for, compared exactly; train_rows: the bound of the sample
    that centres are fitted on (every row is indexed); chunks_per_shard: chunks that are built and committed together.
    """

    name: str
    vector: str
    cells: int = 64
    parts: int = 16
    codes: int = 256
    probes: int = 16
    rerank: int = 4
    train_rows: int = 20_000
    chunks_per_shard: int = 8
    iterations: int = 15
    seed: int = 1


def centres_of(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """At most k centres of the rows of x by Lloyd's steps from seeded distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(iterations):
        near = nearest_centre(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=col, minlength=k) for col in x.T], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


class Codebook:
    """Cell centres and, for each part of a vector, the centres that its codes stand for."""

    def __init__(self, cells: np.ndarray, parts: list[np.ndarray]):
        self.cells, self.parts = cells, parts
        self.cuts = np.cumsum([0, *(p.shape[1] for p in parts)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes): the nearest cell, and a byte for each part of what is left."""
        cell = nearest_centre(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([nearest_centre(rest[:, a:b], p) for p, a, b in zip(self.parts, self.cuts, self.cuts[1:], strict=False)], axis=1).astype(np.uint8)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded rows of a cell, by a table for each part."""
        rest, total = queries - self.cells[cell], np.zeros((len(queries), len(codes)))
        for i, p in enumerate(self.parts):
            part = rest[:, self.cuts[i] : self.cuts[i + 1]]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ p.T + (p**2).sum(axis=1)
            total += table[:, codes[:, i]]
        return total


class VectorIndex:
    """An index under the datastore's folder: indexes/<name>/template, and shards/shard=<first>-<last>/cell=<n>/.

    Vectors are finite and of one length; rows whose vector is null are left out. A shard is written beside as <shard>.partial and
    renamed when it is whole, so a build that was stopped goes on with the shards that are missing.
    """

    def __init__(self, store: Datastore, spec: IndexSpec):
        self.store, self.spec, self.spark = store, spec, store.spark
        self.root = f"{store.root}/indexes/{spec.name}"
        self._book: Codebook | None = None

    # the template

    def train(self, rebuild: bool = False) -> None:
        """Fits and stores the centres, unless they are stored.

        Cells come from Spark's k-means over a sample of about train_rows rows chosen by hash. The codebooks come from what is
        left of the sample's vectors: a task fits one part's codebook, on the sample's pieces for that part.
        """
        if not rebuild and "template" in names(self.spark, self.root):
            return
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = self.store.df.select("datastore_id", F.col(self.spec.vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
        n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        if not n or dims % self.spec.parts:
            raise ValueError(f"{self.spec.name}: {n} vectors of {dims} values can't be cut into {self.spec.parts} parts")
        share = min(1.0, self.spec.train_rows / n)
        sample = rows.where(F.pmod(F.xxhash64(F.lit(self.spec.seed), "datastore_id"), F.lit(1 << 20)) < share * (1 << 20))
        model = KMeans(k=self.spec.cells, seed=self.spec.seed).fit(sample.select(array_to_vector("v").alias("features")))
        cells = np.array(model.clusterCenters())
        width, codes, steps, seed = dims // self.spec.parts, min(256, self.spec.codes), self.spec.iterations, self.spec.seed

        def left(batches):
            for b in batches:
                x = rows_of(b.column(0))
                x = x - cells[nearest_centre(x, cells)]
                for i in range(x.shape[1] // width):
                    piece = np.ascontiguousarray(x[:, i * width : (i + 1) * width])
                    yield pa.RecordBatch.from_pydict({"number": [i] * len(x), "piece": pa.array(list(piece), pa.list_(pa.float64()))}, schema=pa.schema([("number", pa.int32()), ("piece", pa.list_(pa.float64()))]))

        def fitted(t: pa.Table) -> pa.Table:
            # rows come in no order, and centres must not depend on it
            x = rows_of(t.column("piece").combine_chunks())
            found = centres_of(x[np.lexsort(x.T)], codes, steps, seed)
            return pa.table({"kind": ["part"] * len(found), "number": t.column("number").slice(0, 1).to_pylist() * len(found), "code": list(range(len(found))), "centre": list(found)}, schema=_TEMPLATE)

        parts = sample.select("v").mapInArrow(left, "number int, piece array<double>").groupBy("number").applyInArrow(fitted, "kind string, number int, code int, centre array<double>")
        first = self.spark.createDataFrame([("cell", i, 0, [float(c) for c in x]) for i, x in enumerate(cells)], parts.schema)
        self._commit(first.unionByName(parts).coalesce(1), "template", rebuild)
        self._book = None

    def codebook(self) -> Codebook:
        if self._book is None:
            # at most cells + parts * 256 rows
            found = sorted(self.spark.read.parquet(f"{self.root}/template").collect())
            parts = sorted({r.number for r in found if r.kind == "part"})
            self._book = Codebook(np.array([r.centre for r in found if r.kind == "cell"]), [np.array([r.centre for r in found if r.kind == "part" and r.number == i]) for i in parts])
        return self._book

    def _commit(self, df: DataFrame, name: str, replace: bool = False, by: list[str] | None = None) -> None:
        """df as <name>.partial, renamed to <name> when it is written."""
        fs, path = file_system(self.spark, self.root)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{name}.partial")
        if replace:
            fs.delete(path(f"{self.root}/{name}"), True)
        if not fs.rename(path(f"{self.root}/{name}.partial"), path(f"{self.root}/{name}")):
            raise OSError(f"{self.root}/{name} is there already")

    # shards

    def planned(self) -> dict[str, list[int]]:
        """Shard -> its chunks, from the datastore's chunks in their order."""
        keys = sorted(int(n.split("=")[1]) for n in names(self.spark, f"{self.store.root}/live") if n.startswith("chunk_key="))
        cut = [keys[i : i + self.spec.chunks_per_shard] for i in range(0, len(keys), self.spec.chunks_per_shard)]
        return {f"{c[0]}-{c[-1]}": c for c in cut}

    def built(self) -> list[str]:
        return [n.split("=")[1] for n in names(self.spark, f"{self.root}/shards") if not n.endswith(".partial")]

    def pending(self) -> dict[str, list[int]]:
        """What build() has still to do."""
        have = set(self.built())
        return {n: c for n, c in self.planned().items() if n not in have}

    def build(self, most: int | None = None) -> int:
        """Encodes and commits pending shards (at most so many), each by a Spark job over its chunks; returns how many were built."""
        self.train()
        book, kind = self.codebook(), self.spec.vector
        todo = list(self.pending().items())[:most]

        def encoded(batches):
            for b in batches:
                if b.num_rows:
                    cell, codes = book.encode(rows_of(b.column(1)))
                    yield pa.RecordBatch.from_pydict({"cell": cell, "datastore_id": b.column(0), "codes": [c.tobytes() for c in codes]}, schema=pa.schema([("cell", pa.int32()), ("datastore_id", pa.int64()), ("codes", pa.binary())]))

        for name, chunks in todo:
            rows = self.store.df.where(F.col("chunk_key").isin(chunks)).select("datastore_id", F.col(kind).cast("array<double>").alias("v")).where("v IS NOT NULL")
            self._commit(rows.mapInArrow(encoded, "cell int, datastore_id long, codes binary"), f"shards/shard={name}", by=["cell"])
        return len(todo)

    def load(self, mode: str = "scan") -> DataFrame:
        """(cell, datastore_id, codes, shard) of all shards: read at each search (scan), or kept in the executors' memory (memory)."""
        if mode not in ("scan", "memory"):
            raise ValueError(f"no mode {mode}")
        if not self.built():
            raise FileNotFoundError(f"{self.root} has no shards; build() makes them")
        rows = self.spark.read.option("basePath", f"{self.root}/shards").parquet(*[f"{self.root}/shards/shard={n}" for n in self.built()])
        return rows.persist() if mode == "memory" else rows

    # searches

    def search(self, queries: DataFrame, k: int, key: str = "datastore_id", probes: int | None = None, rerank: int | None = None, codes: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, datastore_id, <the store's key>, distance): the k nearest rows by l2 for each query but its own row.

        queries has key and the index's vector column. A query meets the codes of its nearest cells, in pieces: each task gives
        the best k * rerank of its piece, the best of all pieces and shards are compared by their original vectors. Results
        are approximate where a near row lies in a cell that isn't probed, or its code is worse than that of so many others;
        search_exactly has no such loss.
        """
        book, most = self.codebook(), k * (rerank or self.spec.rerank)
        probes = min(probes or self.spec.probes, len(book.cells))
        asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(self.spec.vector).cast("array<double>").alias("q")).where("q IS NOT NULL")

        def probed(batches):
            for b in batches:
                if b.num_rows:
                    x = rows_of(b.column(1))
                    away = (book.cells**2).sum(axis=1) - 2 * x @ book.cells.T
                    near = np.argsort(away, axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(len(x)), probes))
                    yield pa.RecordBatch.from_pydict({"query_id": b.column(0).take(at), "q": b.column(1).take(at), "cell": pa.array(near.ravel(), pa.int32())}, schema=pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("cell", pa.int32())]))

        rows = self.load() if codes is None else codes
        plan = asked.mapInArrow(probed, "query_id long, q array<double>, cell int")
        # one number for each cell: how many tasks share its rows, and its queries
        pieces = lambda df, n: {r.cell: -(-r.n // n) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        asks, has = pieces(plan.select("cell"), PIECE_QUERIES), pieces(rows.where(F.col("cell").isin(list(range(len(book.cells))))).select("cell"), PIECE_ROWS)
        of = lambda found, default=1: F.coalesce(F.create_map(*[F.lit(x) for i in found.items() for x in i])[F.col("cell")] if found else F.lit(None), F.lit(default))
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = rows.where(F.col("cell").isin(list(asks))).select("cell", "datastore_id", "codes", F.pmod(F.xxhash64("datastore_id"), of(has)).cast("int").alias("piece"), spread(of(asks)).alias("asks"))
        right = plan.select("cell", "query_id", "q", F.pmod(F.xxhash64("query_id"), of(asks)).cast("int").alias("asks"), spread(of(has)).alias("piece"))

        def best(codes: pa.Table, asks: pa.Table) -> pa.Table:
            if not codes.num_rows or not asks.num_rows:
                return _FOUND.empty_table()
            ids = codes.column("datastore_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, packed = ids[order], np.frombuffer(b"".join(codes.column("codes").to_pylist()), np.uint8).reshape(len(order), -1)[order]
            who, x, cell = asks.column("query_id").to_numpy(), rows_of(asks.column("q").combine_chunks()), codes.column("cell")[0].as_py()
            out = []
            for lo in range(0, len(who), 32):
                d = book.distances(x[lo : lo + 32], cell, packed)
                d[ids == who[lo : lo + 32, None]] = np.inf
                take = np.argsort(d, axis=1, kind="stable")[:, :most]
                near = np.take_along_axis(d, take, axis=1).ravel()
                real = near < np.inf
                out.append((np.repeat(who[lo : lo + 32], take.shape[1])[real], ids[take.ravel()][real], near[real]))
            return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_FOUND)

        by = ["cell", "piece", "asks"]
        right = right.toDF(*right.columns)
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "query_id long, datastore_id long, about double")
        first = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("about", "datastore_id"))).where(F.col("place") <= most)
        return self._reranked(first.select("query_id", "datastore_id"), asked, k)

    def _reranked(self, candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest candidates of each query by their original vectors, which are looked up in their chunks."""
        at = candidates.withColumn("chunk_key", F.floor(F.col("datastore_id") / CHUNK_SIZE).cast("int"))
        stored = self.store.df.select("chunk_key", "datastore_id", F.col(self.store.key).alias("_key"), F.col(self.spec.vector).alias("_v"))
        met = at.join(stored, ["chunk_key", "datastore_id"]).join(asked, "query_id")
        scored = met.select("query_id", "datastore_id", "_key", METRICS["l2"](F.col("_v"), F.col("q")).alias("distance"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "datastore_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "datastore_id", F.col("_key").alias(self.store.key), "distance")

    def search_exactly(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, datastore_id, distance) by comparing every query with every row; the index isn't used."""
        found = vectors.search_exactly(self.store.df, queries, "datastore_id", self.spec.vector, k)
        return found.select("query_id", "rank", "datastore_id", "distance")

    def recall(self, queries: DataFrame, k: int, **how: int) -> float:
        """The share of the true k nearest rows that search finds, over all queries."""
        return _shared(self.search_exactly(queries, k), self.search(queries, k, **how))[0]

    def search_reaching(self, queries: DataFrame, k: int, least: float) -> tuple[DataFrame, float]:
        """(what search gives, its recall): probes and rerank are doubled until the recall over these queries, which are compared with every
        row once, is at least so much and each has as many rows as there are. With all cells and rows the search is exact, so it ends."""
        stage, probes, rerank = Stage(self.spark, "search"), self.spec.probes, self.spec.rerank
        true, cells, n = stage(self.search_exactly(queries, k)), len(self.codebook().cells), self.load().count()
        while True:
            found = stage(self.search(queries, k, probes=probes, rerank=rerank))
            recall, missing = _shared(true, found)
            if recall >= least and not missing or probes >= cells and k * rerank >= n:
                stage.drop(true)
                return found, recall
            stage.drop(found)
            probes, rerank = 2 * probes, 2 * rerank


def _shared(true: DataFrame, found: DataFrame) -> tuple[float, int]:
    """The share of true's rows that were found, and by how many found has fewer rows."""
    both = true.select("query_id", "datastore_id", F.lit(1).alias("_true")).join(found.select("query_id", "datastore_id", F.lit(1).alias("_hit")), ["query_id", "datastore_id"], "full")
    of, hit, have = both.agg(F.count("_true"), F.count(F.when(F.col("_true") == F.col("_hit"), 1)), F.count("_hit")).first()
    return (hit / of if of else 1.0), of - have


_TEMPLATE = pa.schema([("kind", pa.string()), ("number", pa.int32()), ("code", pa.int32()), ("centre", pa.list_(pa.float64()))])
_FOUND = pa.schema([("query_id", pa.int64()), ("datastore_id", pa.int64()), ("about", pa.float64())])
