"""Archives, line ranges, listings, positions, compaction: round trips, lost runs, empty inputs."""

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import positions
from tessera.sources import compaction, readers
from tessera.sources.compaction import ManifestTable


@pytest.mark.parametrize("kind", ["tar", "zip"])
def test_archives_round_trip(spark, tmp_path, kind):
    rows = [(f"d/rec_{i}.txt", f"body {i} é".encode() * i) for i in range(40)] + [("empty_40", None)]
    df = spark.createDataFrame(rows, "name string, body binary").repartition(3)
    assert readers.write_archives(df, f"file://{tmp_path}/a", "name", "body", kind) == 41
    assert len(list((tmp_path / "a").glob(f"*.{kind}"))) == 3 and not list((tmp_path / "a").glob("*.partial"))
    got = readers.read_archives(spark, f"file://{tmp_path}/a", 500)
    assert {(r.member, bytes(r.body)) for r in got.collect()} == {(n, b or b"") for n, b in rows}
    assert got.rdd.getNumPartitions() > 3
    values = spark.createDataFrame([("7", 1.5), ("40", 2.5), ("99", 3.5)], "k string, v double")
    met = readers.members_with_values(got, values, "k").select("k", "v", "size").collect()
    assert {tuple(r) for r in met} == {("7", 1.5, len(rows[7][1])), ("40", 2.5, 0)}
    with pytest.raises(ValueError):
        readers.write_archives(df, f"file://{tmp_path}/b", "name", "body", "rar")


def test_compressed_tar_and_nothing(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("m_1.cif")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
        t.addfile(tarfile.TarInfo("folder/"))
    got = readers.read_archives(spark, str(tmp_path)).where("member = 'm_1.cif'").collect()
    assert [bytes(r.body) for r in got] == [b"abc"]
    (tmp_path / "none").mkdir()
    assert readers.read_archives(spark, f"{tmp_path}/none").count() == 0 and readers.read_lines(spark, f"{tmp_path}/none").count() == 0
    assert readers.list_files(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="missing"):
        readers.read_archives(spark, f"{tmp_path}/missing").count()


def test_line_ranges(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 17) for i in range(500)] + ["", "é" * 40, "last without an end"]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    for most in (1, 7, 64, 10_000):
        got = readers.read_lines(spark, f"{tmp_path}/big.txt", most) if most > 1 else readers.read_lines(spark, f"{tmp_path}/big.txt", 33)
        assert [r.line for r in sorted(got.collect(), key=lambda r: r.offset)] == lines
    chunks = readers.chunks_of_lines(readers.read_lines(spark, f"{tmp_path}/big.txt", 400), 100).orderBy("chunk").collect()
    assert [x for r in chunks for x in r.entries] == lines and [len(r.entries) for r in chunks] == [100] * 5 + [3]
    (tmp_path / "r.sdf").write_text("".join(f"m{i}\nv\n$$$$\n" for i in range(7)))
    parts = readers.chunks_of_lines(readers.read_lines(spark, f"{tmp_path}/r.sdf", 10), 3, "$$$$").orderBy("chunk").collect()
    assert [r.entries for r in parts] == [["m0\nv", "m1\nv", "m2\nv"], ["m3\nv", "m4\nv", "m5\nv"], ["m6\nv"]]


def test_listing(spark, tmp_path):
    for name in ("a.csv", "sub/b.csv", "sub/deep/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(gzip.compress(name.encode()))
    got = {r.name: r for r in readers.list_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.csv", "b.csv", "c.txt"} and all(r.size > 0 and r.modified for r in got.values())
    assert sorted(r.name for r in readers.list_files(spark, f"file://{tmp_path}", ".csv").collect()) == ["a.csv", "b.csv"]


def test_positions(spark):
    df = spark.range(1000, numPartitions=7).withColumn("id", F.col("id") * 3)
    assert [(r.id, r.place) for r in positions.with_index(df, "place").orderBy("place").collect()] == [(3 * i, i) for i in range(1000)]
    made = positions.add_column(df, "v", [str(i) for i in range(1000)]).collect()
    assert {(r.id, r.v) for r in made} == {(3 * i, str(i)) for i in range(1000)}
    with pytest.raises(ValueError):
        positions.add_column(df, "v", [1])
    assert positions.add_column(df.limit(0), "v", []).count() == 0
    counted = positions.running_count(df, "id", F.col("id") % 2 == 0, "n").collect()
    assert all(r.n == (r.id // 3 + 1) // 2 for r in counted)
    two = positions.beside_by_place(df.limit(3).coalesce(1), spark.createDataFrame([(9,), (8,), (7,)], "id int").coalesce(1))
    assert [r.id for r in two.collect()] == [9, 8, 7]


def test_compaction_and_lost_runs(spark, tmp_path, monkeypatch):
    table = ManifestTable(spark, f"file://{tmp_path}/t", ["k"])
    with pytest.raises(FileNotFoundError):
        table.df()
    for i in range(4):
        assert table.append(spark.range(i * 30, i * 30 + 30).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).coalesce(1), f"b{i}")
    assert not table.append(spark.range(5).select(F.lit(0).alias("k"), F.col("id").alias("v")), "b2")
    rows = lambda: sorted((r.k, r.v) for r in table.df().collect())
    want, files = [(i % 3, i) for i in range(120)], len(table.entries())
    assert rows() == sorted(want) and files == 12
    commit = ManifestTable._commit
    monkeypatch.setattr(ManifestTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.compact(1 << 20)
    monkeypatch.setattr(ManifestTable, "_commit", commit)
    assert rows() == sorted(want) and len(table.entries()) == files  # the lost run changed nothing
    before = table.df()
    assert table.compact(1 << 20) == 9 and len(table.entries()) == 3 and rows() == sorted(want)
    assert sorted((r.k, r.v) for r in before.collect()) == sorted(want)  # a reader that started before still has its files
    assert not table.append(spark.range(5).select(F.lit(0).alias("k"), F.col("id").alias("v")), "b2")  # batches are still known
    assert table.compact(1 << 20) == 0 and len(table.versions()) == 5
    assert table.vacuum() > 12 and rows() == sorted(want) and table.versions() == [5]
    small = table.entries()[0].size
    assert table.bins(small) == [] and {e.folder for e in table.entries()} == {"k=0", "k=1", "k=2"}
    with pytest.raises(RuntimeError):
        table._commit([], 4)


def test_batches_of_files(spark, tmp_path):
    spark.range(40).withColumn("k", F.col("id") % 2).repartition(7).write.parquet(f"file://{tmp_path}/in")
    files = [f"file://{p}" for p in (tmp_path / "in").glob("part-*")]
    table = ManifestTable(spark, f"file://{tmp_path}/out", ["k"])
    assert table.append_files(files[:5], 2) == 3 and compaction.ManifestTable(spark, table.root, ["k"]).append_files(sorted(files[:5]), 2) == 0
    assert table.df().count() == spark.read.parquet(*files[:5]).count()


def test_compaction_of_odd_partition_values(spark, tmp_path):
    table = ManifestTable(spark, f"file://{tmp_path}/t", ["k"])
    for i in range(3):
        table.append(spark.createDataFrame([("a b+c/é", i), ("x=y", i), (None, i)], "k string, v int").coalesce(1), f"b{i}")
    want = sorted((str(r.k), r.v) for r in table.df().collect())
    assert table.compact(1 << 20) == 6 and sorted((str(r.k), r.v) for r in table.df().collect()) == want and len(want) == 9


def test_tsv_with_headers_inside(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\nid\tname\n2\t\n")
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("id\tname\n3\tz\n")
    got = files.read_tsv(spark, str(tmp_path), spark.createDataFrame([], "id string, name string").schema, head="id")
    assert sorted(tuple(r) for r in got.collect()) == [("1", "x"), ("2", None), ("3", "z")]


def test_jdbc_queries(spark):
    from tessera.sources import files

    url = "jdbc:derby:memory:shop;create=true"
    spark.range(50).select(F.col("id"), (F.col("id") * 2).alias("v")).write.jdbc(url, "things", "overwrite", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = files.read_jdbc(spark, url, 'SELECT * FROM things WHERE "id" >= 45', fetch=10, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in range(45, 50)]


def test_folders_are_synced(spark, tmp_path):
    from tessera.plans.schema import TableSpec

    for name in ("a.bin", "d/b.bin", "d/e/c c+%.bin"):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_bytes(name.encode() * 1000)
    source, target = f"file://{tmp_path}/from", f"file://{tmp_path}/to"
    assert readers.sync_folder(spark, source, target) == 3 and readers.sync_folder(spark, source, target) == 0
    (tmp_path / "from/d/b.bin").write_bytes(b"other")
    (tmp_path / "to/own.bin").write_bytes(b"kept")
    assert readers.sync_folder(spark, source, target) == 1
    assert (tmp_path / "to/d/b.bin").read_bytes() == b"other" and (tmp_path / "to/own.bin").exists() and (tmp_path / "to/d/e/c c+%.bin").stat().st_size == 13_000
    there = readers.export_and_sync(spark.range(7), TableSpec("t", "id"), f"file://{tmp_path}/out", f"file://{tmp_path}/store")
    assert spark.read.parquet(there).count() == 7


def test_release(spark):
    from tessera.sources import scratch

    path = scratch.new_path(spark, "gone")
    spark.range(3).write.parquet(path)
    mine = [x for x in scratch._made if x[1] != path]
    scratch._made[:] = [x for x in scratch._made if x[1] == path]
    scratch.release(spark)
    scratch._made[:] = mine
    assert scratch.names(spark, path) == []
