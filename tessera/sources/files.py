"""Readers and writers: archives, delimited text, record files, JDBC."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relations import missing
from ..plans.schema import TableSpec
from .scratch import Stage, delete, file_system


def read_archive(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet or CSV archive."""
    if path.rstrip("/").endswith("parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_archive(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns to Parquet, or to gzipped CSV with nested columns as JSON."""
    df = df.select(*columns) if columns else df
    if path.rstrip("/").endswith("parquet"):
        return df.write.mode("overwrite").parquet(path)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema]
    return df.select(*flat).write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').csv(path)


def archive(df: DataFrame, spec: TableSpec, folder: str, kind: str = "csv", columns: str | list[str] = "minimal", name: str | None = None, today: date | None = None) -> str:
    """Writes rows of a table as an archive in a folder and returns its path.

    columns: minimal (the key and the raw columns, from which the others can be derived again), full (all but those that spec
    excludes) or a list. kind: parquet, or csv for zips that hold a CSV with a header each. Without a name it is
    <table>-<columns>-<year>-<month>-<day>.parquet or .csv.zip. Both are folders of files, one for each partition of df.
    """
    if kind not in ("csv", "parquet"):
        raise ValueError(f"archives are csv or parquet, not {kind}")
    label = columns if isinstance(columns, str) else "custom"
    if isinstance(columns, str):
        columns = {"minimal": spec.archive_columns, "full": lambda d: spec.columns(d, exclude=spec.archive_exclude)}[columns](df)
    path = f"{folder.rstrip('/')}/{name or f'{spec.name}-{label}-{(today or date.today()):%Y-%m-%d}.' + ('parquet' if kind == 'parquet' else 'csv.zip')}"
    if kind == "parquet":
        df.select(*columns).write.mode("overwrite").parquet(path)
    else:
        _write_zipped_csv(df.select(*columns), path)
    return path


def _flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema])


def _write_zipped_csv(df: DataFrame, path: str) -> None:
    """A zip for each partition with rows, with one CSV in it, written batch by batch beside and renamed when it is whole."""
    from .readers import _opened

    delete(df.sparkSession, path)
    fs, where = file_system(df.sparkSession, path)
    fs.mkdirs(where(path))

    def run(batches):
        import zipfile

        import pyarrow as pa
        from pyarrow import csv
        from pyspark import TaskContext

        store, at = _opened(path)
        task, n, zipped, out = TaskContext.get(), 0, None, None
        beside, final = f"{at}/{task.partitionId():05d}.{task.taskAttemptId()}.partial", f"{at}/{task.partitionId():05d}.zip"
        for b in batches:
            if b.num_rows and zipped is None:
                out = store.open_output_stream(beside)
                zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                member = zipped.open(f"{task.partitionId():05d}.csv", "w", force_zip64=True)
            if b.num_rows:
                csv.write_csv(pa.Table.from_batches([b]), member, csv.WriteOptions(include_header=n == 0))
                n += b.num_rows
        if zipped is not None:
            member.close()
            zipped.close()
            out.close()
            store.move(beside, final)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    _flat(df).mapInArrow(run, "n long").agg(F.sum("n")).first()


def load_archive(spark: SparkSession, path: str, table: str, key: list[str], schema: T.StructType | None = None) -> int:
    """Appends an archive's rows whose keys the Parquet table has not; returns how many."""
    if path.rstrip("/").endswith(".csv.zip"):
        rows = read_zipped_csv(spark, path, schema or spark.read.parquet(table).schema)
    else:
        rows = read_archive(spark, path, schema)
    stage = Stage(spark, "loaded")
    new = stage(missing(rows, spark.read.parquet(table), key))
    new.write.mode("append").parquet(table)
    n = new.count()
    stage.drop(new)
    return n


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, head: str | None = None) -> DataFrame:
    """Tab-separated text, compressed or not; head drops header rows inside the data by the name of their first column."""
    df = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    return df if head is None else df.where(F.col(df.columns[0]) != head)


def read_records(spark: SparkSession, path: str, end: str = "$$$$\n") -> DataFrame:
    """Text records that end in a line, with their `> <KEY>` blocks as a map."""
    text = spark.read.option("lineSep", end).text(path).where(F.trim("value") != "")
    found = r"> +<([^>]+)>[^\n]*\n([^\n]*)"
    return text.select("value", F.map_from_arrays(F.regexp_extract_all("value", F.lit(found), 1), F.regexp_extract_all("value", F.lit(found), 2)).alias("tags"))


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 1000, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).option("fetchsize", fetch).options(**options).load()


def upload_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows of base64-encoded CSV uploads (data:...;base64,...) as delimited text, the header left out; a line end inside
    quotes is part of its row."""
    body = F.decode(F.unbase64(F.regexp_replace(column, "^[^,]*,", "")), "utf-8")
    rows = F.regexp_extract_all(body, F.lit(r'(?:[^"\r\n]++|"[^"]*+")++'), F.lit(0))
    return df.select(F.explode(F.slice(rows, 2, 1_000_000_000)).alias("line"))


def read_zipped_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the CSV files in zip archives, columns by name; a task reads an archive, member by member and batch by batch."""
    def rows(batches):
        import io
        import zipfile

        import pyarrow as pa
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        options = csv.ConvertOptions(column_types=want, include_columns=want.names, include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False)
        for b in batches:
            for body in b.column(0):
                with zipfile.ZipFile(io.BytesIO(body.as_py())) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        with z.open(name) as f:
                            for found in csv.open_csv(f, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=options):
                                yield pa.RecordBatch.from_arrays(found.columns, schema=want)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def page_text(df: DataFrame, html: str) -> DataFrame:
    """df with title and text of HTML: scripts, styles and tags removed, white space joined."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return df.withColumns({"title": F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "page_text": F.trim(F.regexp_replace(bare, r"\s+", " "))})
