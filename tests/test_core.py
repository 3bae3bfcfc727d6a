"""The query layer, sources and operators on small frames: nulls, ties, empty inputs, round trips."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import grouping, relations, reports, series, vectors
from tessera.plans import lookups
from tessera.plans.query import Query, form_filters, frame_filter, page_range, page_url, parse_url
from tessera.plans.schema import Bridge, Catalog, ForeignKey, TableSpec
from tessera.sources import files
from tessera.sources.datastore import Datastore
from tessera.streaming import traffic


@pytest.fixture(scope="module")
def shop(spark):
    frames = {
        "kind": spark.createDataFrame([(1, "x"), (2, None)], "k_id int, name string"),
        "thing": spark.createDataFrame([(1, 1, 5.0), (2, 2, None), (3, None, 5.0), (4, 9, 1.0)], "id int, kind_id int, price double"),
        "link": spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 7), (3, 9)], "thing_id int, tag_id int"),
    }
    specs = [TableSpec("kind", "k_id"), TableSpec("thing", "id", {"kind": ForeignKey("kind_id", "kind", "k_id")}, {"tags": Bridge("link", "thing_id", "tag_id")}), TableSpec("link", "thing_id")]
    return Catalog(specs, frames.__getitem__)


def ids(query):
    return [r.id for r in query.df.collect()]


def test_lookups_over_relations(shop):
    q = Query(shop, "thing")
    assert sorted(ids(q.filter(kind__name="x"))) == [1]
    assert sorted(ids(q.filter(kind__name__isnull=True))) == [2, 3, 4]
    assert sorted(ids(q.exclude(price__gte=5))) == [2, 4]
    assert ids(q.filter(price__in=[])) == []
    assert sorted(ids(q.filter(tags__ids=[7, 8]))) == [1] and sorted(ids(q.filter(tags__ids=[]))) == [4]
    assert ids(q.order_by("-price", "id")) == [1, 3, 4, 2]
    with pytest.raises(KeyError):
        q.filter(price__near=1)
    with pytest.raises(ValueError):
        q.from_config({"filters": {"kind__name__exact": "x"}}, depth=1)
    with pytest.raises(ValueError):
        lookups.build(["a"], {})


def test_pages(shop):
    q = Query(shop, "thing")
    assert ids(q.page(1, 3)) == [4, 3, 2] and ids(q.page(99, 3)) == [1] and ids(q.page("no", 3)) == [4, 3, 2]
    assert page_range(5, 9) == [1, None, 3, 4, 5, 6, 7, None, 9] and page_url("/a?z=1&page=2", 3) == "/a?page=3&z=1"
    assert parse_url("/t?a__gt=3&b=x&limit=5&a__gt=4&format=csv") == {"filters": {"a__gt": 4, "b": "x"}, "limit": 5}
    assert form_filters({"id__in": "1, 2\n3", "a": "", "b": "k", "csrf": "q"}, ("csrf",)) == {"id__in": ["1", "2", "3"], "b": "k"}


def test_only_pages_have_a_limit_of_their_own(spark):
    many = Query(Catalog([TableSpec("many", "id")], lambda _: spark.range(10_050)), "many")
    assert many.from_config({"filters": {"id__gte": 0}, "paginate": False}).df.count() == 10_050
    assert many.from_config({"filters": {"id__gte": 0}, "paginate": False, "limit": 7}).df.count() == 7
    # the last page is that of the first 10,000 rows
    assert ids(many.from_config({"filters": {"id__gte": 0}, "page": 999, "page_size": 5_000})) == list(range(5_049, 49, -1))


def test_frame_mode_and_fallback(shop):
    df = shop.read("kind")
    assert frame_filter(df, name__contains="^x$").count() == 1 and frame_filter(df, k_id__what=1).count() == 1


def test_chunk_key_and_subsystems(spark):
    df = spark.createDataFrame([("abc",), ("Z",), ("",)], "s string")
    got = {r.s: r.c for r in df.select("s", scalars.chunk_key(F.col("s"), 20_000).alias("c")).collect()}
    assert got == {s: int.from_bytes(hashlib.md5(s.encode()).digest(), "big") % 20_000 for s in got} and got["abc"] == 3570
    row = spark.createDataFrame([("N-Si-O",)], "s string").select(scalars.subsystems(F.col("s"))).first()[0]
    assert row == ["N", "O", "Si", "N-O", "N-Si", "O-Si", "N-O-Si"]


def test_small_parsers(spark):
    df = spark.createDataFrame([("1 2*0.5 x", ".TRUE.", "0xde0b6b3a7640000")], "v string, b string, h string")
    r = df.select(scalars.parse_vector(F.col("v")), scalars.is_true(F.col("b")), scalars.hex_amount(F.col("h"), 18).cast("double")).first()
    assert r[0] == [1.0, 0.5, 0.5, None] and r[1] and r[2] == 1.0


def test_merges(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in relations.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in relations.upsert(old, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, None), (3, "c")}
    first = relations.keep_first(new.unionByName(new), ["k"], ["v"])
    assert first.count() == 2


def test_datastore(spark, tmp_path):
    store = Datastore(spark, f"file://{tmp_path}/s", "id", 4)
    assert not store.promote()
    store.stage(spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("n")))
    assert store.promote() and store.df.count() == 40
    one = store.filter(id="7")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(chunk_key" in one._jdf.queryExecution().toString()
    rows = store.df.select("datastore_id", "chunk_key").collect()
    assert all(r.datastore_id // scalars.CHUNK_SIZE == r.chunk_key for r in rows) and len({r.datastore_id for r in rows}) == 40
    store.update([rows[0].datastore_id], n=5)
    assert store.df.where("n = 5").count() == 1 and store.df.count() == 40


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc"), (2, None)], "k int, v string")
    files.write_archive(df, f"{tmp_path}/x.csv")
    assert {tuple(r) for r in files.read_archive(spark, f"{tmp_path}/x.csv", df.schema).collect()} == {tuple(r) for r in df.collect()}
    files.write_archive(df, f"{tmp_path}/t.parquet")
    files.write_archive(df.unionByName(spark.createDataFrame([(3, "z")], df.schema)), f"{tmp_path}/a.parquet")
    assert files.load_archive(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/t.parquet", ["k"]) == 1
    (tmp_path / "r.sdf").write_text("m1\n> <ID>\n5\n\n> <W>\n1.5\n\n$$$$\nm2\n> <ID>\n6\n\n$$$$\n")
    assert sorted(r.tags["ID"] for r in files.read_records(spark, f"{tmp_path}/r.sdf").collect()) == ["5", "6"]


def test_pairs_match_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    bits = {r.vec_id: {i for i, x in enumerate(r.embedding) if x > 0} for r in df.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(bits), 2) if len(bits[a] & bits[b]) >= 0.5 * len(bits[a] | bits[b])}
    words = df.select("vec_id", vectors.to_words(F.col("embedding")).alias("w"))
    assert {(r.a, r.b) for r in vectors.tanimoto_pairs(words, "vec_id", "w", 0.5).collect()} == want


def test_pairs_across_bands_and_pieces(spark, monkeypatch):
    import random

    monkeypatch.setattr(vectors, "PAIR_ROWS", 7)
    rng = random.Random(8)
    bits = {f"k{i:02d}": {b for b in range(64) if rng.random() < rng.choice([0.05, 0.2, 0.5, 0.9])} for i in range(60)}
    bits |= {"none": set(), "one": {3}, "same": bits["k00"] | {1}, "top": {31, 32, 63}}
    rows = [(k, [sum(1 << (b % 32) for b in s if b // 32 == w) for w in (0, 1)]) for k, s in bits.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "k string, w array<bigint>").repartition(3)
    for cutoff in (0.2, 0.5, 1.0):
        want = {(a, b): len(bits[a] & bits[b]) / len(bits[a] | bits[b]) for a, b in itertools.combinations(sorted(bits), 2) if bits[a] | bits[b]}
        got = vectors.tanimoto_pairs(df, "k", "w", cutoff).collect()
        assert {(r.a, r.b): r.similarity for r in got} == {k: v for k, v in want.items() if v >= cutoff} and len(got) == len({(r.a, r.b) for r in got})
    assert vectors.tanimoto_pairs(df.limit(0), "k", "w", 0.5).collect() == []


def test_butina(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = [(1, 2), (2, 3), (2, 4), (5, 6), (7, 8), (8, 9), (4, 5)]
    near = {i: set() for i in range(1, 11)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    free, want = set(near), {}
    for i in sorted(near, key=lambda i: (len(near[i]), i), reverse=True):
        if i in free:
            for x in ({i} | near[i]) & free:
                want[x] = i
            free -= {i} | near[i]
    got = grouping.butina(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(i,) for i in near], "k int"), "k").collect()
    assert {r.k: r.cluster for r in got} == want


def test_hull(spark):
    rows = [("s", 1, 0.0, 0.0), ("s", 2, 1.0, 0.0), ("s", 3, 0.5, -1.0), ("s", 4, 0.25, -0.25), ("t", 5, 0.5, 1.0), ("s", 6, None, 1.0)]
    got = {r.k: r for r in grouping.binary_hull(spark.createDataFrame(rows, "s string, k int, x double, e double"), "s", "k", "x", "e").collect()}
    assert set(got) == {1, 2, 3, 4} and got[4].e_above_hull == pytest.approx(0.25) and got[3].is_stable and got[3].formation == -1.0


def test_series_and_reports(spark):
    cpi = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-03", 3.0)], "g string, d string, v double").withColumn("d", F.to_timestamp("d"))
    ask = spark.createDataFrame([("a", "2019-01-01"), ("a", "2020-01-02"), ("a", "2021-01-01"), ("b", "2020-01-02")], "g string, d string").withColumn("d", F.to_timestamp("d"))
    assert sorted((str(r.v) for r in series.interpolate(ask, cpi, ["g"], "d", "v").collect())) == ["1.0", "2.0", "3.0", "None"]
    assert series.buying_power(cpi, "d", "v").where("buying_power = 3").count() == 1
    one = spark.createDataFrame([("E", "2024-01-01")], "s string, u string").withColumn("u", F.to_timestamp("u"))
    assert reports.queue_stats(one, "s", "u", "2024-02-01").first().error_percent == 0.0
    assert reports.time_histogram(one, "u").first().n == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(source))
    got = traffic.run_once(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert 0 < got.agg(F.sum("n")).first()[0] <= 1000


def test_partitioned_search_is_whole(spark):
    from tessera import queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in queries.QUERIES["partitioned_search"](spark, sf).select("query_id", "vec_id", "rank").collect()}
    want = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.nearest_queries(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "l2", 10).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and got == want


def test_searches_by_blocks(spark, monkeypatch):
    import random

    from tessera import queries

    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 3)
    rng = random.Random(2)
    # a vector that stands 60 times, others by chance, far ones, and one that is null
    rows = [(i, [1.0, 2.0, 0.5] if i % 4 == 0 else [rng.gauss(0, 1) for _ in range(3)] if i % 9 else [1e6 + i, 0.0, -1e6]) for i in range(240)] + [(900, None)]
    base = spark.createDataFrame(rows, "id long, v array<float>")
    asked = base.where("id % 20 = 0 OR id % 7 = 1")
    sort = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    want = sort(vectors.nearest_queries(base.where("v IS NOT NULL"), asked.where("v IS NOT NULL"), "id", "v", "l2", 7))
    assert sort(vectors.search_exactly(base, asked, "id", "v", 7)) == want and len(want) > 300
    few = base.where("id < 4")
    assert sort(vectors.search_exactly(few, few, "id", "v", 7)) == sort(vectors.nearest_queries(few, few, "id", "v", "l2", 7)) != []
    assert vectors.search_exactly(base, asked.limit(0), "id", "v", 7).count() == 0
    # the pairs are compared inside tasks, not joined as rows
    plan = queries.QUERIES["partitioned_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_equal_groups_are_numbered_across_ranges(spark):
    from tessera.operators import vectors

    rows = [(5, "b"), (70_000, "a"), (70_001, "a"), (200_000, None), (3, "c"), (-1, "b"), (200_001, None)]
    got = {r.k: r.cluster for r in vectors.clusters_of_equal(spark.createDataFrame(rows, "k long, v string"), "k", "v").collect()}
    assert got == {-1: 1, 5: 1, 3: 2, 70_000: 3, 70_001: 3, 200_000: 4, 200_001: 4}


def test_salted_join_keeps_left_rows_and_refuses_right(spark):
    import pytest

    from tessera.operators import relations

    big = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    small = spark.createDataFrame([(1, "s"), (3, "t")], "k int, w string")
    assert sorted((r.k, r.v, r.w) for r in relations.salted_join(big, small, "k", 4, "left").collect()) == [(1, "x", "s"), (1, "y", "s"), (2, "z", None)]
    with pytest.raises(ValueError):
        relations.salted_join(big, small, "k", 4, "right")


def test_datastore_chunks_and_promotion(spark, tmp_path):
    import pytest

    from tessera.sources.datastore import Datastore

    store = Datastore(spark, f"file://{tmp_path}/store", "k", 3)
    for round_ in (1, 2, 3):
        store.stage(spark.createDataFrame([(f"k{i}", i * round_) for i in range(30)], "k string, v int"))
        assert store.promote()
    assert store.df.count() == 30 and sum(r.v for r in store.df.collect()) == 3 * sum(range(30))
    assert not store.promote() and len(store.chunk_files()) == store.df.select("chunk_key").distinct().count()
    some = store.df.first().chunk_key
    assert store.chunk(some).count() == store.df.where(f"chunk_key = {some}").count()
    with pytest.raises(FileNotFoundError):
        store.chunk(99)
    store.repartition(["v"], f"file://{tmp_path}/by_v", [0, 3])
    store.repartition(["v"], f"file://{tmp_path}/by_v", [6])
    assert sorted(r.v for r in spark.read.parquet(f"file://{tmp_path}/by_v").collect()) == [0, 3, 6]
