"""Results of workflow runs that lie in folders or zip archives, one for each run, beside folders of failed runs."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import _opened, read_archives
from .scratch import file_system

METADATA, RESULTS = "metadata.yaml", "results.json"
#: What a run's metadata has to say.
NEEDED = ("workflow", "run_id", "source")


def _entry(text: Column, name: str) -> Column:
    """The value of a `name: value` line of flat YAML, without quotes around it; null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    bare = F.regexp_replace(found, r"""^(['"])(.*)\1$""", "$2")
    return F.when((bare != "") & ~F.lower(bare).isin("null", "~"), bare)


def read_runs(spark: SparkSession, root: str, schema: T.StructType, mark: str = "task-", needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """(run, archived, needed ones, the schema's fields, failure): a row for each run under root, failed ones included.

    A run is a folder whose name contains the mark, at any depth, or a zip archive whose name does; of a run that is there as
    both, the folder counts. metadata.yaml is flat, results.json one object. failure says what a run lacks (no metadata,
    no <entry>, no results, broken results) and is null for whole ones; loaded() keeps those. Folders without either file have no row,
    further files aren't read from folders.
    """
    names = F.lit(METADATA), F.lit(RESULTS)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{METADATA},{RESULTS}}}").load(root)
    parts = F.split("path", "/")
    folders = whole.select(F.element_at(parts, -2).alias("run"), F.lit(False).alias("archived"), F.element_at(parts, -1).alias("file"), F.col("content").alias("body"))
    packed = read_archives(spark, root).where(F.col("archive").endswith(".zip"))
    packed = packed.select(F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.zip$", "").alias("run"), F.lit(True).alias("archived"), F.element_at(F.split("member", "/"), -1).alias("file"), "body").where(F.col("file").isin(METADATA, RESULTS))
    files = folders.unionByName(packed).where(F.col("run").contains(mark))
    # a run has two files, so its texts fit in a row
    text = lambda n: F.max(F.when(F.col("file") == n, F.col("body").cast("string")))
    runs = files.groupBy("run", "archived").agg(text(names[0]).alias("_meta"), text(names[1]).alias("_text"))
    runs = runs.groupBy("run").agg(F.min(F.struct("archived", "_meta", "_text")).alias("r")).select("run", "r.*")
    parsed = F.from_json("_text", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken"})
    read = runs.select("run", "archived", "_meta", "_text", *[_entry(F.col("_meta"), n).alias(n) for n in needed], parsed.alias("_r"))
    lacks = F.when(F.col("_meta").isNull(), "no metadata")
    for n in needed:
        lacks = lacks.when(F.col(f"`{n}`").isNull(), f"no {n}")
    lacks = lacks.when(F.col("_text").isNull(), "no results").when(F.col("_r").isNull() | F.col("_r._broken").isNotNull(), "broken results")
    return read.select("run", "archived", *needed, *[F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields], lacks.alias("failure"))


def loaded(runs: DataFrame) -> DataFrame:
    """Runs that can be loaded."""
    return runs.where("failure IS NULL").drop("failure")


def write_runs(df: DataFrame, root: str, run: str, metadata: str, results: str, archived: str) -> int:
    """Writes a folder, or where archived is true a zip archive, for each row: its metadata and results texts; null ones are left out. Returns how many.

    Files are written beside and renamed, so a repeated task leaves whole ones.
    """
    fs, path = file_system(df.sparkSession, root)
    fs.mkdirs(path(root))

    def write(batches):
        from pyspark import TaskContext

        store, at = _opened(root)
        attempt, n = TaskContext.get().taskAttemptId(), 0

        def put(name: str, body: bytes) -> None:
            with store.open_output_stream(f"{at}/{name}.{attempt}.partial") as out:
                out.write(body)
            store.move(f"{at}/{name}.{attempt}.partial", f"{at}/{name}")

        for b in batches:
            for name, packed, *texts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                files = [(f, t.encode()) for f, t in zip((METADATA, RESULTS), texts, strict=True) if t is not None]
                n += 1
                if packed:
                    body = io.BytesIO()
                    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                        for f, t in files:
                            z.writestr(f"{name}/{f}", t)
                    put(f"{name}.zip", body.getvalue())
                else:
                    store.create_dir(f"{at}/{name}")
                    for f, t in files:
                        put(f"{name}/{f}", t)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
            n = 0

    counted = df.select(run, archived, metadata, results).mapInArrow(write, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
