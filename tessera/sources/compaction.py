"""Tables of files under manifests: appends by batch, small files merged inside partitions, readers that see old or new."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import file_system, names


#: The folder of a merged file, below its partition's.
BIN = "_bin"


@dataclass(frozen=True)
class Entry:
    """A file of the table, below its root, and the batches whose rows it holds, joined by +."""

    path: str
    size: int
    batches: str

    @property
    def folder(self) -> str:
        """Its partition: the name=value folders of its path."""
        return "/".join(p for p in self.path.split("/")[:-1] if "=" in p and not p.startswith(f"{BIN}="))


class ManifestTable:
    """Parquet files under root/data, partitioned by columns; root/manifests/<number>.json lists the files of each version.

    A version counts once its manifest has its name, which is the only change that readers see: a run that is lost before leaves
    files that no manifest lists. Two writers of one number can't both commit.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[str]):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in names(self.spark, f"{self.root}/manifests") if n.endswith(".json"))

    def entries(self, version: int | None = None) -> list[Entry]:
        """The files of a version, or of the last one."""
        have = self.versions()
        if not have:
            return []
        fs, path = file_system(self.spark, self.root)
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(path(f"{self.root}/manifests/{have[-1] if version is None else version:08d}.json"))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Entry(*e) for e in json.loads(text)]

    def df(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        files = [e.path for e in self.entries(version)]
        if not files:
            raise FileNotFoundError(f"{self.root} has no files")
        return self._read(files).drop(BIN)

    def _read(self, files: list[str]) -> DataFrame:
        """The rows of some files. Every commit has a folder of its own above the partitions, and is a scan of its own."""
        bases: dict[str, list[str]] = {}
        for f in files:
            bases.setdefault(f.split("/")[0], []).append(f"{self.root}/data/{f}")
        parts = [self.spark.read.option("basePath", f"{self.root}/data/{b}").parquet(*some) for b, some in sorted(bases.items())]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def _commit(self, entries: list[Entry], after: int) -> None:
        fs, path = file_system(self.spark, self.root)
        fs.mkdirs(path(f"{self.root}/manifests"))
        beside = f"{self.root}/manifests/{uuid.uuid4().hex}.partial"
        out = fs.create(path(beside))
        try:
            out.write(bytearray(json.dumps([[e.path, e.size, e.batches] for e in entries]).encode()))
        finally:
            out.close()
        if not fs.rename(path(beside), path(f"{self.root}/manifests/{after + 1:08d}.json")):
            raise RuntimeError(f"version {after + 1} was committed by another writer")

    def _written(self, df: DataFrame, name: str, batches: str, more: list[str]) -> list[Entry]:
        """df's files in a folder of this commit, one for each partition value and value of more."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*self.columns, *more).parquet(f"{self.root}/data/{name}")
        fs, path = file_system(self.spark, self.root)
        files, found = fs.listFiles(path(f"{self.root}/data/{name}"), True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-"):
                at = f.getPath().toString()
                found.append(Entry(at[at.index(f"/data/{name}/") + len("/data/") :], f.getLen(), batches))
        return sorted(found, key=lambda e: e.path)

    def append(self, df: DataFrame, batch: str) -> bool:
        """Adds df's rows as a batch; a batch that is there already is left alone, so a stopped load can be run again."""
        if "+" in batch:
            raise ValueError(batch)
        have, last = self.entries(), (self.versions() or [0])[-1]
        if batch in {b for e in have for b in e.batches.split("+")}:
            return False
        self._commit(have + self._written(df, f"{last + 1:08d}-{uuid.uuid4().hex}", batch, []), last)
        return True

    def append_files(self, paths: list[str], size: int = 5) -> int:
        """Parquet files in batches of size, in order of their names; returns how many batches were new."""
        paths = sorted(paths)
        cut = [paths[i : i + size] for i in range(0, len(paths), size)]
        return sum(self.append(self.spark.read.parquet(*some), f"{some[0].rsplit('/', 1)[-1]}..{some[-1].rsplit('/', 1)[-1]}") for some in cut)

    def bins(self, target: int) -> list[list[Entry]]:
        """Small files (under half the target) of each partition in bins of up to target bytes, largest first; a bin has two or more."""
        folders: dict[str, list[Entry]] = {}
        for e in self.entries():
            if e.size < target // 2:
                folders.setdefault(e.folder, []).append(e)
        out = []
        for _, files in sorted(folders.items()):
            open_bins: list[tuple[int, list[Entry]]] = []
            for e in sorted(files, key=lambda e: (-e.size, e.path)):
                for i, (size, some) in enumerate(open_bins):
                    if size + e.size <= target:
                        open_bins[i] = (size + e.size, [*some, e])
                        break
                else:
                    open_bins.append((e.size, [e]))
            out += [some for _, some in open_bins if len(some) > 1]
        return out

    def compact(self, target: int = 128 << 20) -> int:
        """Merges small files by bins of bytes inside their partitions, in one job with a file for each bin; returns how many
        files are gone. Readers have the old files until the new manifest stands, and vacuum() deletes them later."""
        bins, have, last = self.bins(target), self.entries(), (self.versions() or [0])[-1]
        if not bins:
            return 0
        merged = {e.path: i for i, some in enumerate(bins) for e in some}
        where = self.spark.createDataFrame(list(merged.items()), f"_file string, {BIN} int")
        # Spark gives paths as URIs
        path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
        rows = self._read(list(merged)).drop(BIN).withColumn("_file", F.element_at(F.split(path, "/data/"), -1))
        # a row for each small file
        rows = rows.join(F.broadcast(where), "_file").drop("_file")
        made = self._written(rows.repartition(len(bins), BIN), f"{last + 1:08d}-{uuid.uuid4().hex}", "", [BIN])
        of = lambda e: sorted({b for x in bins[int(e.path.split(f"{BIN}=")[1].split("/")[0])] for b in x.batches.split("+")})
        made = [Entry(e.path, e.size, "+".join(of(e))) for e in made]
        self._commit([e for e in have if e.path not in merged] + made, last)
        return len(merged) - len(made)

    def vacuum(self) -> int:
        """Deletes files that the last version hasn't, and older manifests; returns how many files went. Not while others read or write."""
        fs, path = file_system(self.spark, self.root)
        keep, last, gone = {e.path for e in self.entries()}, self.versions()[-1], 0
        files, found = fs.listFiles(path(f"{self.root}/data"), True), []
        while files.hasNext():
            at = files.next().getPath()
            found.append(at)
        for at in found:
            name = at.toString()
            if at.getName().startswith("part-") and name[name.index("/data/") + len("/data/") :] not in keep:
                gone += bool(fs.delete(at, False))
        for v in self.versions()[:-1]:
            fs.delete(path(f"{self.root}/manifests/{v:08d}.json"), False)
        assert self.versions() == [last]
        return gone
