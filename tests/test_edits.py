"""Edits, archives, chunk swaps, comparisons: odd cases on small frames."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import compare, edits, prices, tables
from tessera.plans.query import Query
from tessera.plans.schema import Catalog, TableSpec
from tessera.sources import files
from tessera.sources.datastore import Datastore


def test_bulk_edit(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "old"), (3, "c", "")], "id int, name string, my_comments string")
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "thing int, tag int")
    out, linked = edits.bulk_edit(df, "id", [1, 2, 9], {"name": "n", "my_comments": "new", "tags__ids": [12, 12, 13], "x": None}, {"tags": (links, "thing", "tag")})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "n", "new"), (2, "n", "old\nnew"), (3, "c", "")]
    assert {tuple(r) for r in linked["tags"].collect()} == {(3, 11), *((i, t) for i in (1, 2, 9) for t in (12, 13))}
    assert edits.bulk_edit(df, "id", [1], {"name": None})[0].collect() == df.collect()
    with pytest.raises(ValueError):
        edits.bulk_edit(df, "id", [1, 2], {"name": "n"}, most=1)


def test_free_ids_and_names(spark):
    df = spark.createDataFrame([(i,) for i in range(20)] + [(3,)], "k int")
    small = lambda key, draw: F.pmod(F.xxhash64(key, F.lit(draw)), F.lit(30)).cast("string")
    taken = spark.createDataFrame([("0",), ("1",)], "t string")
    got = {r.k: r.id for r in edits.free_ids(df, "k", small, taken, most=200).collect()}
    assert len(got) == 20 == len(set(got.values())) and not {"0", "1"} & set(got.values())
    with pytest.raises(ValueError):
        edits.free_ids(df, "k", lambda key, draw: F.lit("7"), taken, most=3)
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None)], "k int, n string")
    used = spark.createDataFrame([("a",), ("a-2",), ("a-4",), ("b",), ("c-2",), ("a-x",), ("a-2",), (None,)], "n string")
    assert {r.k: r.suggested for r in edits.free_names(wanted, "k", "n", used).collect()} == {1: "a-3", 2: "b-2", 3: "c", 4: "d", 5: None}


def test_filters(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", f"t{i}") for i in range(40)], "n int, few string, many string")
    kinds = {r.column: r.kind for r in edits.filter_kinds(df).collect()}
    assert kinds == {"n": "range", "few": "choice", "many": "text"} and edits.dashboard_filter(df, n=(None, 3), few=["x"], many=None).count() == 2
    systems = spark.createDataFrame([("O-Si",), ("Si",), ("N-Si-O",), ("Fe",), (None,)], "s string")
    assert [r.s for r in systems.where(edits.in_chemical_system(F.col("s"), "Si-O")).collect()] == ["O-Si", "Si"]
    assert [r.s for r in systems.where(edits.in_chemical_system(F.col("s"), "Si-O", False)).collect()] == ["O-Si"]
    ends = spark.createDataFrame([(1, 2), (1, 9), (8, 9)], "a int, b int")
    people = spark.createDataFrame([(1, "p"), (2, "q")], "id int, name string")
    found = lambda known: sorted((r.a, r.b, r.s__name, r.t__name) for r in edits.with_both_ends(ends, people, "id", {"s": "a", "t": "b"}, known).collect())
    assert found("any") == [(1, 2, "p", "q"), (1, 9, "p", None)] and found("all") == [(1, 2, "p", "q")] and len(found("keep")) == 3
    with pytest.raises(ValueError):
        found("some")
    running = edits.running_of_sources(spark.createDataFrame([("s", [1, 2, 2, 7]), ("t", []), ("u", None)], "s string, i array<int>"), "s", "i", spark.createDataFrame([(1, "P"), (2, "R"), (7, "C")], "k int, st string"), "k", "st")
    assert {r.s: (r.running, list(r.still_running)) for r in running.collect()} == {"s": (3, [1, 2]), "t": (0, []), "u": (0, [])}


def test_web_view_and_pages(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"n{i}") for i in range(6)], "id int, name string")
    shop = Catalog([TableSpec("t", "id", visible=lambda d: d.where("name IS NOT NULL"))], lambda _: rows)
    assert sorted(r.id for r in Query(shop, "t").web().filter(id__gte=1).df.collect()) == [2, 4] and Query(shop, "t").df.count() == 6
    page = lambda n: tables.page_json(rows, ["id"], n, 4, "/t?kind=a&page=7").first()
    assert (page(1).count, page(1).next, page(1).previous, len(page(1).results)) != () and page(0).results == page(1).results
    assert page(99).previous == "/t?kind=a&page=1" and page(99).next is None and len(page(99).results) == 2 and page(1)["next"] == "/t?kind=a&page=2"
    odd = spark.createDataFrame([(1, "a;b"), (2, "x\ry"), (3, None), (4, 'q"')], "k int, v string")
    assert [r.line for r in tables.page_csv(odd, ["k", "v"], ";", header=True).collect()] == ["k;v", '1;"a;b"', '2;"x\ry"', "3;", '4;"q"""']
    assert [r.line for r in tables.markdown_rows(odd.limit(2), ["k", "v"]).collect()] == ["| 1 | a;b |", "| 2 | x<br>y |"]
    fixed = spark.createDataFrame([('["it\'s", None]',), ("['a\"b', NaN, 'c\\'d']",), ("[]",), (None,), ("no",)], "j string").select(values.repaired_array(F.col("j")).alias("r"))
    assert [r.r for r in fixed.collect()] == [["it's", None], ['a"b', None, "c'd"], [], None, None]


def test_archives_by_name(spark, tmp_path):
    spec = TableSpec("shop", "id", raw=("name", "--note"), archive_exclude=("made",))
    df = spark.createDataFrame([(1, 'a,"b"\n', ["x"], 1.5), (2, None, None, None)], "id int, name string, tags array<string>, made double")
    path = files.archive(df, spec, f"file://{tmp_path}", today=datetime.date(2022, 1, 5))
    assert path.endswith("/shop-minimal-2022-01-05.csv.zip")
    found = files.read_zipped_csv(spark, path, spark.createDataFrame([], "id int, name string").schema)
    assert {tuple(r) for r in found.collect()} == {(1, 'a,"b"\n'), (2, None)}
    full = files.archive(df.coalesce(1), spec, f"file://{tmp_path}", columns="full", today=datetime.date(2022, 1, 5))
    z = next((tmp_path / "shop-full-2022-01-05.csv.zip").glob("*.zip"))
    assert zipfile.ZipFile(z).read(zipfile.ZipFile(z).namelist()[0]).decode().splitlines()[0] == '"id","name","tags"' and full.endswith("full-2022-01-05.csv.zip")
    again = files.archive(df, spec, f"file://{tmp_path}", "parquet", ["id", "made"], "own.parquet")
    assert spark.read.parquet(again).columns == ["id", "made"]
    with pytest.raises(ValueError):
        files.archive(df, spec, str(tmp_path), "xml")


def test_lost_chunk_swaps_are_repaired(spark, tmp_path, monkeypatch):
    store = Datastore(spark, f"file://{tmp_path}/s", "id", 4)
    store.stage(spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("n")))
    store.promote()
    before = sorted(map(tuple, store.df.collect()))
    finish = Datastore._finish
    with pytest.raises(Exception, match="no_such"):
        store.rewrite(lambda d: d.selectExpr("*", "no_such AS x"), store.chunk_keys())
    assert sorted(map(tuple, store.df.collect())) == before and store.repair() == 0

    def lost(self, swap):
        fs, path = self._fs()
        fs.mkdirs(path(f"{swap}/old"))
        fs.rename(path(f"{self.root}/live/chunk_key=1"), path(f"{swap}/old/chunk_key=1"))
        raise KeyboardInterrupt

    monkeypatch.setattr(Datastore, "_finish", lost)
    with pytest.raises(KeyboardInterrupt):
        store.update_column("n", F.lit(5))
    monkeypatch.setattr(Datastore, "_finish", finish)
    assert 1 not in store.chunk_keys()
    assert store.repair() == 1 and store.chunk_keys() == [0, 1, 2, 3]
    assert store.df.count() == 60 and {r.n for r in store.df.collect()} == {5} and store.repair() == 0
    store.update_rows(spark.createDataFrame([(store.df.first().datastore_id, 9, None)], "datastore_id long, n int, id string"))
    assert store.df.where("n = 9").count() == 1 and store.df.where("id IS NULL").count() == 0
    store.update_column("n", F.lit(1), only_null=True)
    store.drop_column("id")
    assert {r.n for r in store.df.collect()} == {5, 9} and "id" not in store.df.columns and store.get_row(123).count() == 0
    assert store.schema().fieldNames() == store.df.columns


def test_comparisons_and_clusters(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(1, [3]), (2, [3]), (3, [12]), (4, [7])], "k int, w array<bigint>")
    cells = compare.matrix(df, df, "k", "w")
    assert cells.count() == 16 and compare.mean(cells).first().mean == pytest.approx(2 * (1 + 2 / 3 + 2 / 3 + 1 / 4) / 12)
    assert {(r.a, r.b): r.distance for r in compare.matrix(df, df, "k", "w", "identity", True).collect()}[1, 2] == 0.0
    pairs = {r.k: r.cluster for r in compare.cluster(df, "k", "w", cutoff=0.6).collect()}
    assert pairs[1] == pairs[2] == pairs[4] and pairs[3] == 3 and {r.k: r.cluster for r in compare.cluster_pairs(cells, df, "k", 0.6).collect()} == pairs
    assert len({r.cluster for r in compare.with_clusters(df, "k", "w", "identity").collect()}) == 3
    with pytest.raises(KeyError):
        compare.cluster(df, "k", "w", "unknown")
    flat = spark.createDataFrame([(i, [float(i), 0.0, float(i % 2)]) for i in range(8)], "k int, v array<double>")
    placed = compare.with_plane(flat, "k", "v").orderBy("k").collect()
    assert abs(abs(placed[7].x - placed[0].x) - 7) < 0.2 and compare.explained_plane(spark, flat, "v").first().share_x > 0.9


def test_window_change(spark):
    cpi = spark.createDataFrame([(2020, 100.0), (2023, 110.0)], "year int, index double")
    rows = spark.createDataFrame([("a", "2019-01-01", 1.0), ("a", "2020-06-01", 10.0), ("a", "2021-01-01", 5.0), ("a", "2023-05-01", 11.0), ("b", "1990-01-01", 0.0)], "i string, d string, p double")
    got = {r.i: r for r in prices.window_change(rows, "i", "d", "p", 3, cpi).collect()}
    assert (got["a"].start, got["a"].low, got["a"].high, got["a"].latest) == (10.0, 5.0, 11.0, 11.0)
    assert got["a"].change == pytest.approx(10.0) and got["a"].change_real == pytest.approx(0.0) and got["b"].change is None and got["b"].change_real is None


def test_principal_axes_are_those_of_numpy(spark):
    import numpy as np

    from tessera import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    got = np.array([r.place for r in queries.QUERIES["principal_axes"](spark, "/root/testdata/sf0.001").orderBy("vec_id").collect()])
    assert np.abs(np.abs(got) - np.abs(x @ axes.T)).max() < 1e-6
