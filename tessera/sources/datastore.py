"""Partitioned datastores: chunk keys, ids, pruned lookups, point updates and promotion."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import CHUNK_SIZE, chunk_key
from ..plans.query import frame_filter
from .scratch import names


def _stretches(some: list[int], all_keys: list[int]) -> list[list[int]]:
    """Keys in runs that no other key of the store interrupts."""
    place, out = {k: i for i, k in enumerate(all_keys)}, []
    for k in some:
        if out and place[k] == place[out[-1][-1]] + 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


class Datastore:
    """A folder of Parquet chunks under live/, with staging/ and old/ beside it; chunk_key is the partition column."""

    def __init__(self, spark: SparkSession, root: str, key: str, chunks: int, indexes: tuple = ()):
        self.spark, self.root, self.key, self.chunks = spark, root.rstrip("/"), key, chunks
        self.indexes = {spec.name: spec for spec in indexes}

    def index(self, name: str):
        """The vector index of a registered specification."""
        from .vector_index import VectorIndex

        return VectorIndex(self, self.indexes[name])

    def filter_similar(self, index: str, like: DataFrame, count: int = 50, limit: int | None = None, **lookups: Any) -> DataFrame:
        """Rows among the count nearest to like (one row with the index's vector column) that pass the lookups, with distance,
        nearest first. Only the chunks of those ids are read; limit bounds what is left after the lookups."""
        ix = self.index(index)
        asked = like.select(F.lit(-1).cast("long").alias("_id"), ix.spec.vector)
        near = ix.search(asked, count, "_id").select("datastore_id", "distance").collect()  # count rows
        if not near:
            return self.df.withColumn("distance", F.lit(None).cast("double")).limit(0)
        found = self.spark.createDataFrame([tuple(r) for r in near], "datastore_id long, distance double")
        rows = self.df.where(F.col("chunk_key").isin(sorted({r.datastore_id // CHUNK_SIZE for r in near})))
        return frame_filter(rows.join(F.broadcast(found), "datastore_id"), None, **lookups).orderBy("distance", "datastore_id").limit(limit or count)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/live")

    def with_keys(self, df: DataFrame) -> DataFrame:
        """df with chunk_key, and datastore_id: the row's place in its chunk behind the chunk's first id."""
        keyed = df.withColumn("chunk_key", chunk_key(F.col(self.key), self.chunks))
        place = F.row_number().over(Window.partitionBy("chunk_key").orderBy(self.key)) - 1
        return keyed.withColumn("datastore_id", place + F.col("chunk_key").cast("long") * CHUNK_SIZE)

    def stage(self, df: DataFrame, compression: str = "zstd") -> None:
        """Writes chunks to staging, a file for each."""
        self.with_keys(df).repartition("chunk_key").write.mode("overwrite").option("compression", compression).partitionBy("chunk_key").parquet(f"{self.root}/staging")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def promote(self) -> bool:
        """staging becomes live, and live old; nothing happens if staging is missing."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/staging")):
            return False
        # live is missing only between two renames, and whatever was old goes last
        gone = f"{self.root}/gone-{uuid.uuid4().hex}"
        for source, target in (("old", gone), ("live", f"{self.root}/old")):
            if fs.exists(path(f"{self.root}/{source}")):
                fs.rename(path(f"{self.root}/{source}"), path(target))
        done = fs.rename(path(f"{self.root}/staging"), path(f"{self.root}/live"))
        fs.delete(path(gone), True)
        return done

    def chunk_files(self) -> list[str]:
        """The files of all chunks, sorted."""
        return sorted(self.df.inputFiles())

    def chunk(self, chunk_key: int) -> DataFrame:
        """The rows of one chunk, read from its folder alone; a missing chunk is an error."""
        fs, path = self._fs()
        where = f"{self.root}/live/chunk_key={chunk_key}"
        if not fs.exists(path(where)):
            raise FileNotFoundError(where)
        return self.spark.read.option("basePath", f"{self.root}/live").parquet(where)

    def drop_columns(self, *gone: str) -> DataFrame:
        return self.df.drop(*gone)

    def repartition(self, columns: list[str], out: str, values: list | None = None) -> None:
        """All rows, or those whose first column has one of the values, written by the columns; values a run has already
        written are replaced and others stay, so batches of values can be repeated."""
        df = self.df if values is None else self.df.where(F.col(columns[0]).isin(values))
        df.repartition(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(out)

    def process(self, make: Callable[[DataFrame], DataFrame], out: str, batch: int = 100) -> int:
        """make() over the chunks that out has not yet, in batches of chunks; returns how many were done. make() keeps chunk_key.

        A batch is written beside and renamed to rows/<first>-<last>, which is all that marks its chunks as done; a repeated run
        goes on after the last whole batch. processed() reads the rows.
        """
        fs, path = self._fs()
        keys, done = self.chunk_keys(), [tuple(map(int, n.split("=")[1].split("-"))) for n in names(self.spark, f"{out}/rows") if n.startswith("batch=")]
        left = [k for k in keys if not any(a <= k <= b for a, b in done)]
        for at in range(0, len(left), batch):
            # chunks that are done may lie between, so a batch ends before them
            for some in _stretches(left[at : at + batch], keys):
                beside = f"{out}/partial-{uuid.uuid4().hex}"
                make(self.df.where(F.col("chunk_key").isin(some))).repartition("chunk_key").write.partitionBy("chunk_key").parquet(beside)
                fs.mkdirs(path(f"{out}/rows"))
                if not fs.rename(path(beside), path(f"{out}/rows/batch={some[0]}-{some[-1]}")):
                    raise OSError(f"{out}/rows/batch={some[0]}-{some[-1]}")
        return len(left)

    def processed(self, out: str) -> DataFrame:
        """What process() has written, chunk by chunk."""
        return self.spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")

    def sampled(self, n: int = 1000, seed: int = 0) -> DataFrame:
        """n random rows, the same ones for the same seed."""
        return self.df.orderBy(F.md5(F.concat(F.col("datastore_id").cast("string"), F.lit(f":{seed}"))), "datastore_id").limit(n)

    def _chunks_of(self, values: list) -> list[int]:
        keyed = self.spark.createDataFrame([(str(v),) for v in values], "v string").select(chunk_key(F.col("v"), self.chunks).alias("c")).distinct()
        return [r.c for r in keyed.collect()]

    def filter(self, limit: int | None = None, **lookups: Any) -> DataFrame:
        """Lookups; one on the key or the datastore id first reduces the scan to the chunks of its values."""
        df, test = self.df, None
        for name, of in ((self.key, self._chunks_of), ("datastore_id", lambda v: sorted({int(x) // CHUNK_SIZE for x in v}))):
            values = [lookups[n] for n in (name, f"{name}__exact") if n in lookups] or lookups.get(f"{name}__in")
            if values:
                test = F.col("chunk_key").isin(of(list(values)))
                break
        return frame_filter(df if test is None else df.where(test), limit, **lookups)

    def update(self, ids: list[int], **values: Any) -> None:
        """Sets columns of rows by datastore id; only their chunks are rewritten."""
        hit: Column = F.col("datastore_id").isin(ids)
        self.rewrite(lambda df: df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}), sorted({int(i) // CHUNK_SIZE for i in ids}))

    def update_rows(self, changes: DataFrame) -> None:
        """Sets columns of rows from changes (datastore_id and new values): null leaves the old value. Only chunks with a change are rewritten."""
        changed = [c for c in changes.columns if c != "datastore_id"]
        chunks = [r.c for r in changes.select(F.floor(F.col("datastore_id") / CHUNK_SIZE).cast("int").alias("c")).distinct().collect()]  # at most the number of chunks
        new = changes.select("datastore_id", *[F.col(c).alias(f"_new_{c}") for c in changed])
        self.rewrite(lambda df: df.join(new, "datastore_id", "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns]), chunks)

    def update_column(self, name: str, made: Column, only_null: bool = False, batch: int = 1000) -> None:
        """A new or replaced column in all chunks, so many at a time; only_null keeps the values that are there."""
        keys = self.chunk_keys()
        for at in range(0, len(keys), batch):
            self.rewrite(lambda df: df.withColumn(name, F.coalesce(F.col(name), made) if only_null and name in df.columns else made), keys[at : at + batch])

    def drop_column(self, *gone: str) -> None:
        """All chunks without some columns."""
        self.rewrite(lambda df: df.drop(*gone), self.chunk_keys())

    def chunk_keys(self) -> list[int]:
        """The keys of all chunks, from the names of their folders."""
        return sorted(int(n.split("=")[1]) for n in names(self.spark, f"{self.root}/live") if n.startswith("chunk_key="))

    def rewrite(self, make: Callable[[DataFrame], DataFrame], chunks: list[int]) -> None:
        """make() over some chunks, which are replaced one by one once all of them are written; make() keeps chunk_key.

        The new chunks are written under swap-<id>/new, and a ready file says that they are whole. Then each old chunk makes way for
        the new one by two renames. A run lost before the ready file changes nothing; repair() ends one lost later.
        """
        if not chunks:
            return
        self.repair()
        fs, path = self._fs()
        swap = f"{self.root}/swap-{uuid.uuid4().hex}"
        part = self.df.where(F.col("chunk_key").isin(chunks))
        make(part).repartition("chunk_key").write.partitionBy("chunk_key").parquet(f"{swap}/new")
        fs.create(path(f"{swap}/ready")).close()
        self._finish(swap)

    def _finish(self, swap: str) -> None:
        fs, path = self._fs()
        for name in [n for n in names(self.spark, f"{swap}/new") if n.startswith("chunk_key=")]:
            live, old = path(f"{self.root}/live/{name}"), path(f"{swap}/old/{name}")
            if fs.exists(live) and not fs.exists(old):
                fs.mkdirs(path(f"{swap}/old"))
                fs.rename(live, old)
            fs.rename(path(f"{swap}/new/{name}"), live)
        fs.delete(path(swap), True)

    def repair(self) -> int:
        """Ends chunk swaps that a lost run left whole, and drops unfinished ones; returns how many were ended. Not while another writes."""
        fs, path = self._fs()
        swaps, ended = [n for n in names(self.spark, self.root) if n.startswith("swap-")], 0
        for n in swaps:
            if fs.exists(path(f"{self.root}/{n}/ready")):
                self._finish(f"{self.root}/{n}")
                ended += 1
            else:
                fs.delete(path(f"{self.root}/{n}"), True)
        return ended

    def rename(self, **new: str) -> DataFrame:
        return self.df.withColumnsRenamed(new)

    def get_row(self, id_: int) -> DataFrame:
        """The row of a datastore id, read from its chunk alone; no row for an unknown one."""
        return self.df.where((F.col("chunk_key") == int(id_) // CHUNK_SIZE) & (F.col("datastore_id") == int(id_)))

    def schema(self):
        """The columns of the chunks, from the footer of one file."""
        return self.df.schema
