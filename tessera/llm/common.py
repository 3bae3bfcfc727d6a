"""Pieces that the corpus operators share: staging, running totals, column handling and Arrow maps."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many bytes of measured keys; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20
#: Rows that a bucket of a running total holds on average.
BUCKET_ROWS = 1000
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: a cut of the lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the staged tables that these frames read directly; for tables whose rows stand in a later one."""
    for df in frames:
        files = df.inputFiles()[:1] if df is not None else []
        for owner, path in [x for x in _staged if any(f"/{x[1].rsplit('/', 1)[1]}/" in f for f in files)]:
            _delete(owner, path)
            _staged.remove((owner, path))


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does once the driver's JVM has collected their plans; these are
    free when the events of their end have been heard, hence the second time."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def release(spark: SparkSession) -> None:
    """Deletes what this session has staged; call it once the results are written."""
    for owner, path in [x for x in _staged if x[0] is spark]:
        _delete(spark, path)
        _staged.remove((owner, path))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python by rows and bytes, for tables with very long texts; the bounds stay set,
    as plans read them when they run."""
    for name, most in (("maxRecordsPerBatch", 500), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """df's columns but for those that would clash with names (Spark ignores case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def arrow_columns(df: DataFrame, inputs: Sequence[str], fields: list[T.StructField], make: Callable, keep: Sequence[str] | None = None) -> DataFrame:
    """df with new columns that make() computes from Arrow arrays of the inputs, batch by batch.

    make() is called once in each task and returns the function for the batches. An input column
    named like a new one is replaced.
    """
    small_batches(df.sparkSession)
    keep = without(df, [f.name for f in fields]) if keep is None else list(keep)
    need = list(dict.fromkeys([*keep, *inputs]))
    frame = df.select(*[F.col(f"`{c}`") for c in need])
    schema = T.StructType([*(frame.schema[c] for c in keep), *fields])
    names = schema.fieldNames()

    def run(batches):
        compute = make()
        for b in batches:
            if b.num_rows:
                new = compute(*(b.column(need.index(c)) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(b.column(need.index(c)) for c in keep), *new], names=names)

    return frame.mapInArrow(run, schema)


def restrict(df: DataFrame, on: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of df whose key is in keys (one column named on). Few keys are broadcast, so that df does not move."""
    return df.join(F.broadcast(keys) if n_keys * 16 <= BROADCAST_BYTES else keys, on, "left_semi")


def unit(h: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def group_key(c: Column) -> Column:
    """A key that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def running(df: DataFrame, group: str, at: Column, rows: Column, order: list, value: Column, name: str, ties: bool = False) -> DataFrame:
    """df with the running total of value in each group, over all rows before (ties: and with) the own one.

    at: the place in the order as a double in [0, 1), rows: the rows of the group. Buckets of about
    BUCKET_ROWS rows are totalled, the totals run in two levels, and each bucket runs by itself, so
    no task holds a whole group.
    """
    df = df.withColumns({"_b": F.floor(at * F.ceil(rows / F.lit(float(BUCKET_ROWS)))).cast("long"), "_w": value})
    sums = df.groupBy(group, "_b").agg(F.sum("_w").alias("_s")).withColumn("_c", F.floor(F.col("_b") / 1024))
    coarse = sums.groupBy(group, "_c").agg(F.sum("_s").alias("_cs"))
    coarse = coarse.select(group, "_c", F.coalesce(F.sum("_cs").over(Window.partitionBy(group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_co"))
    sums = sums.join(coarse, [group, "_c"]).select(group, "_b", (F.col("_co") + F.coalesce(F.sum("_s").over(Window.partitionBy(group, "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_o"))
    own = Window.partitionBy(group, "_b").orderBy(*order)
    own = own.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties else own.rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [group, "_b"]).withColumn(name, F.col("_o") + F.coalesce(F.sum("_w").over(own), F.lit(0))).drop("_b", "_w", "_o")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), staged; a component is named by its smallest node.

    Alternating large and small stars: each step links nodes to the least node around them, with
    joins and minima only, until nothing changes. Each step's edges are staged and the ones before deleted.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")

    def stars(e: DataFrame, all_around: bool) -> DataFrame:
        sides = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if all_around else e
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = sides.join(least, "a")
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if all_around else linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            out = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "labels")
            discard(edges)
            return out
        state, before = now, edges
        edges = staged(stars(stars(edges, True), False), "edges")
        discard(before)
