"""Spark data sources for archives, line ranges and folder listings, written in Python; paths are those of pyarrow.fs (local, s3, hdfs)."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import file_system

PARTITION_BYTES = 32 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, endings: tuple[str, ...] = ("",)) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files under a folder, sorted; hidden and unfinished ones are left out."""
    store, at = _opened(path.replace("file:///", "/") if path.startswith("file:///") else path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    names = sorted((f.path, f.size, f.mtime) for f in found if f.type == fs.FileType.File and f.path.endswith(endings) and not f.base_name.startswith((".", "_")) and not f.path.endswith(".partial"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return names


@dataclass
class Members(InputPartition):
    """Members of an archive: (name, offset, size); offset is -1 where the archive's directory is asked, and members is None for
    an archive that can only be read from its start."""

    archive: str
    root: str
    members: list[tuple[str, int, int]] | None


@dataclass
class MemberRuns(InputPartition):
    """What one task reads: runs of members, of one archive or of several small ones."""

    runs: list[Members]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[MemberRuns]:
        """Members in runs of about so many bytes: those of zip and plain tar archives by their directory or headers; small archives
        share a task, compressed tars have one each."""
        store, out, tasks, filled = _opened(self.path)[0], [], [], 0
        for archive, *_ in _files(self.path, (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
            if not archive.endswith((".zip", ".tar")):
                out.append(Members(archive, self.path, None))
                continue
            with store.open_input_file(archive) as f:
                if archive.endswith(".zip"):
                    found = [(i.filename, -1, i.file_size) for i in zipfile.ZipFile(f).infolist() if not i.is_dir()]
                else:
                    found = [(m.name, m.offset_data, m.size) for m in tarfile.open(fileobj=f, mode="r:") if m.isfile()]
            run, size = [], 0
            for m in found:
                if run and size + m[2] > self.most:
                    out.append(Members(archive, self.path, run))
                    run, size = [], 0
                run.append(m)
                size += m[2]
            if run:
                out.append(Members(archive, self.path, run))
        for x in out:
            size = self.most if x.members is None else sum(m[2] for m in x.members)
            if not tasks or filled + size > self.most:
                tasks.append(MemberRuns([]))
                filled = 0
            tasks[-1].runs.append(x)
            filled += size
        return tasks or [MemberRuns([])]

    def read(self, partition: MemberRuns) -> Iterator[tuple]:
        for run in partition.runs:
            yield from self._members(run)

    def _members(self, partition: Members) -> Iterator[tuple]:
        store = _opened(partition.root)[0]
        with store.open_input_file(partition.archive) as f:
            if partition.members is None:
                with tarfile.open(fileobj=f, mode="r:*") as t:
                    for m in t:
                        if m.isfile():
                            yield partition.archive, m.name, m.size, t.extractfile(m).read()
                return
            directory = zipfile.ZipFile(f) if partition.archive.endswith(".zip") else None
            for name, at, size in partition.members:
                if directory:
                    yield partition.archive, name, size, directory.read(name)
                else:
                    f.seek(at)
                    yield partition.archive, name, size, f.read(size)


class ArchiveSource(DataSource):
    """(archive, member, size, body) of the files in zip and tar archives at a path, a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, size long, body binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("bytes", PARTITION_BYTES)))


@dataclass
class Range(InputPartition):
    file: str
    root: str
    start: int
    end: int


class LineReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Range]:
        out = [Range(f, self.path, at, min(size, at + self.most)) for f, size, _ in _files(self.path) for at in range(0, size, self.most)]
        return out or [Range("", self.path, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that start in the range; the last one is read to its end."""
        if not partition.file:
            return
        with _opened(partition.root)[0].open_input_file(partition.file) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            at = partition.start
            if at:
                # a line that starts exactly here follows the end of another
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.file, at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)


class LineSource(DataSource):
    """(file, offset, line) of text files: a partition for each range of bytes, so one large file is read by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("bytes", PARTITION_BYTES)))


class ListingReader(DataSourceReader):
    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def partitions(self) -> list[Range]:
        """One for each folder below the path, and one for the path's own files."""
        store, at = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(at))
        return [Range(at, self.path, 0, 0), *[Range(f.path, self.path, 1, 0) for f in found if f.type == fs.FileType.Directory]]

    def read(self, partition: Range) -> Iterator[tuple]:
        store = _opened(partition.root)[0]
        for f in sorted(store.get_file_info(fs.FileSelector(partition.file, recursive=bool(partition.start))), key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith(self.ending):
                yield f.path, f.base_name, f.size, f.mtime.replace(tzinfo=None) if f.mtime else None


class ListingSource(DataSource):
    """(path, name, size, modified) of all files under a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, name string, size long, modified timestamp_ntz"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], self.options.get("ending", ""))


def _load(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_archives(spark: SparkSession, path: str, bytes_: int = PARTITION_BYTES) -> DataFrame:
    """(archive, member, size, body): files of zip and tar archives. Members of one archive are spread over tasks by bytes;
    compressed tars, which can't be entered in the middle, take a task each. Folders in archives have no rows."""
    return _load(spark, ArchiveSource, path, bytes=bytes_)


def read_lines(spark: SparkSession, path: str, bytes_: int = PARTITION_BYTES) -> DataFrame:
    """(file, offset, line): lines with the byte they start at; a line belongs to the range it starts in."""
    return _load(spark, LineSource, path, bytes=bytes_)


def list_files(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """(path, name, size, modified) of the files under a folder whose names have the ending."""
    return _load(spark, ListingSource, path, ending=ending)


def members_with_values(members: DataFrame, values: DataFrame, key: str, place: int = 1) -> DataFrame:
    """Archive members with the row of a table of values: the key is a part of the member's file name, cut at `_` and its ending.

    Members without a row, and rows without a member, are left out.
    """
    stem = F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"\.[^.]*$", "")
    return members.withColumn(key, F.get(F.split(stem, "_"), F.lit(place))).join(values.withColumn(key, F.col(key).cast("string")), key)


def chunks_of_lines(lines: DataFrame, size: int, delimiter: str | None = None) -> DataFrame:
    """(chunk, entries): the entries of a file in runs of size, in order; an entry is a line, or the lines up to one with the
    delimiter, which is cut off. Lines must come from one file; an entry after the last delimiter counts if it isn't empty."""
    from ..operators.positions import running_count, with_index

    placed = with_index(lines.orderBy("file", "offset"), "place")
    if delimiter is None:
        entries = placed.select("place", F.col("line").alias("entry"))
    else:
        ended = running_count(placed, "place", F.col("line").contains(delimiter), "number")
        entries = ended.groupBy(F.col("number").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
        entries = entries.select("place", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(rf"\s*\Q{delimiter}\E\s*$"), F.lit("")).alias("entry")).where("trim(entry) <> ''")
    return entries.groupBy(F.floor(F.col("place") / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "entry"))).alias("l")).select("chunk", F.transform("l", lambda x: x["entry"]).alias("entries"))


def write_archives(df: DataFrame, path: str, name: str, body: str, kind: str = "tar") -> int:
    """Rows as members of archives, one archive for each partition of df that has rows; returns how many members there are.

    A task writes <number>.partial-<attempt> and renames it when it is whole, so a lost or repeated task leaves one whole archive.
    """
    if kind not in ("tar", "zip"):
        raise ValueError(kind)
    hadoop, where = file_system(df.sparkSession, path)
    hadoop.mkdirs(where(path))

    def run(batches):
        from pyspark import TaskContext

        store, at = _opened(path)
        task, count, archive = TaskContext.get(), 0, None
        beside, final = f"{at}/{task.partitionId():05d}.{kind}.{task.taskAttemptId()}.partial", f"{at}/{task.partitionId():05d}.{kind}"
        for b in batches:
            for member, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if archive is None:
                    out = store.open_output_stream(beside)
                    archive = tarfile.open(fileobj=out, mode="w|") if kind == "tar" else zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                data = data or b""
                if kind == "tar":
                    info = tarfile.TarInfo(member)
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
                else:
                    archive.writestr(member, data)
                count += 1
        if archive is not None:
            archive.close()
            out.close()
            store.move(beside, final)
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    rows = df.where(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(body).cast("binary"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def sync_folder(spark: SparkSession, source: str, target: str) -> int:
    """Copies the files under source that target lacks, or has with another size or an older date; returns how many were copied.

    Both are listed and compared as tables, and tasks copy the files, each beside and renamed when it is whole. Nothing is deleted.
    """
    hadoop, where = file_system(spark, target)
    hadoop.mkdirs(where(target))

    def listed(path: str, suffix: str) -> DataFrame:
        base = _opened(path)[1].rstrip("/")
        rows = list_files(spark, path).where(~F.col("name").endswith(".partial"))
        return rows.select(F.expr(f"substring(path, {len(base) + 2})").alias("file"), F.col("size").alias(f"size{suffix}"), F.col("modified").alias(f"modified{suffix}"))

    both = listed(source, "").join(listed(target, "_there"), "file", "left")
    todo = both.where("size_there IS NULL OR size_there <> size OR modified_there < modified").select("file")

    def copy(batches):
        (a, from_), (b, to) = _opened(source), _opened(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at = f"{to.rstrip('/')}/{name}"
                b.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with a.open_input_stream(f"{from_.rstrip('/')}/{name}") as i, b.open_output_stream(f"{at}.partial") as o:
                    while data := i.read(8 << 20):
                        o.write(data)
                b.move(f"{at}.partial", at)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return todo.repartition(tasks, "file").mapInArrow(copy, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def export_and_sync(df: DataFrame, spec, folder: str, target: str, kind: str = "parquet", columns: str | list[str] = "full") -> str:
    """Writes a dated archive in a folder, copies it to another store, and returns where it is there."""
    from .files import archive

    path = archive(df, spec, folder, kind, columns)
    there = f"{target.rstrip('/')}/{path.rsplit('/', 1)[1]}"
    sync_folder(df.sparkSession, path, there)
    return there
