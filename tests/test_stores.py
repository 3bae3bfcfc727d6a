"""Stored vector indexes, tolerance joins and pools: builds that resume, brute force, nulls, ties and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nearby
from tessera.sources import vector_index
from tessera.sources.datastore import Datastore
from tessera.sources.vector_index import IndexSpec

SPEC = IndexSpec("pq", "v", cells=6, parts=4, codes=32, probes=6, rerank=8, chunks_per_shard=2, iterations=5)


@pytest.fixture
def store(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], i % 4) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(900, None, 0)]
    out = Datastore(spark, f"file://{tmp_path}/s", "id", 7, (SPEC,))
    out.stage(spark.createDataFrame(rows, "id long, v array<double>, kind int"))
    out.promote()
    return out


def test_index_build_resumes(spark, store, monkeypatch):
    index = store.index("pq")
    assert list(index.pending()) == ["0-1", "2-3", "4-5", "6-6"] and index.built() == []
    with pytest.raises(FileNotFoundError):
        index.load()
    commit, calls = vector_index.VectorIndex._commit, []

    def killed(self, df, name, *a, **b):
        calls.append(name)
        if name == "shards/shard=4-5":
            df.write.mode("overwrite").parquet(f"{self.root}/{name}.partial")  # what a lost driver leaves behind
            raise KeyboardInterrupt
        return commit(self, df, name, *a, **b)

    monkeypatch.setattr(vector_index.VectorIndex, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        index.build()
    monkeypatch.setattr(vector_index.VectorIndex, "_commit", commit)
    assert calls == ["template", "shards/shard=0-1", "shards/shard=2-3", "shards/shard=4-5"]
    again = store.index("pq")
    assert again.built() == ["0-1", "2-3"] and list(again.pending()) == ["4-5", "6-6"]
    assert again.load().count() < 300  # the partial shard doesn't count
    assert again.build(1) == 1 and again.build() == 1 and again.build() == 0
    assert again.load().count() == 300 and again.load("memory").select("datastore_id").distinct().count() == 300
    with pytest.raises(ValueError):
        again.load("disk")


def test_index_search(spark, store):
    index = store.index("pq")
    index.build(1)
    asked = store.df.where("id % 20 = 0")
    assert index.search(asked, 5).count() == 75  # one shard is searched by itself
    index.build()
    exact = {(r.query_id, r["rank"]): r.datastore_id for r in index.search_exactly(asked, 5).collect()}
    whole = index.search(asked, 5, rerank=1000).collect()
    assert {(r.query_id, r["rank"]): r.datastore_id for r in whole} == exact
    vector = {r.datastore_id: r.v for r in store.df.collect()}
    for r in index.search(asked, 5).collect():
        assert r.distance == pytest.approx(math.dist(vector[r.query_id], vector[r.datastore_id])) and r.query_id != r.datastore_id
    assert index.recall(asked, 5) >= 0.9
    assert index.search(asked.limit(0), 5).count() == 0


def test_search_is_widened_until_its_recall_is_reached(spark, store):
    store.indexes["rough"] = IndexSpec("rough", "v", cells=6, parts=2, codes=3, probes=1, rerank=1, chunks_per_shard=4, iterations=3)
    index = store.index("rough")
    index.build()
    asked = store.df.where("id % 20 = 0")
    assert index.recall(asked, 5) < 0.9
    found, recall = index.search_reaching(asked, 5, 0.9)
    assert found.count() == 75 and recall >= 0.9
    true = {(r.query_id, r.datastore_id) for r in index.search_exactly(asked, 5).collect()}
    assert len(true & {(r.query_id, r.datastore_id) for r in found.collect()}) == pytest.approx(recall * 75)
    assert index.search_reaching(asked, 5, 1.0)[1] == 1.0
    assert index.search_reaching(asked.limit(0), 5, 0.9)[1] == 1.0


def test_filter_similar_reads_few_chunks(spark, store):
    store.index("pq").build()
    like = store.df.where("id = 7").select("v")
    found = store.filter_similar("pq", like, 3, kind__in=[0, 1, 2, 3])
    assert [r.id for r in found.collect()][0] == 7 and found.count() == 3
    chunks = {r.datastore_id // 1_000_000_000 for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [chunk_key" in plan and len(chunks) <= 3
    assert store.filter_similar("pq", like, 3, kind=9).count() == 0


def brute_unique(rows, tolerance, metric):
    def far(a, b):
        if metric == "l2":
            return math.dist(a, b) >= tolerance
        return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b) >= tolerance

    kept = {}
    for k, b, v in sorted((r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and (metric == "l2" or any(r[2]))), key=lambda r: r[0]):
        if all(far(v, w) for _, w in kept.setdefault(b, [])):
            kept[b].append((k, v))
    return {(b, k) for b, ks in kept.items() for k, _ in ks}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_greedy_unique(spark, monkeypatch, metric):
    monkeypatch.setattr(nearby, "PIECE_ROWS", 20)
    rng = random.Random(4)
    rows = [(i, i % 3 or None, [rng.random() * 3, rng.random() * 3, rng.random()]) for i in range(200)]
    rows += [(300 + i, 1, [1.0, 1.0, 0.5 + i * 1e-6]) for i in range(60)] + [(400 + i, 2, [2.0, 2.0, 0.25]) for i in range(40)]
    rows += [(500, 1, None), (501, 1, [1.0, None, 1.0]), (502, 1, [1.0, math.nan, 1.0]), (503, 2, []), (504, 7, [9.0, 9.0, 9.0]), (505, 7, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "key long, block long, cell array<double>").repartition(4)
    tolerance = 0.7 if metric == "l2" else 0.02
    got = {tuple(r) for r in nearby.greedy_unique(df, "key", "block", "cell", tolerance, metric).collect()}
    assert got == brute_unique(rows, tolerance, metric)
    assert nearby.greedy_unique(df.limit(0), "key", "block", "cell", tolerance, metric).collect() == []


def test_a_chain_of_near_rows(spark):
    df = spark.createDataFrame([(i, [0.6 * i]) for i in range(12)], "k int, v array<double>")
    assert sorted(r.k for r in nearby.greedy_unique(df, "k", None, "v", 1.0).collect()) == [0, 2, 4, 6, 8, 10]


def test_pools(spark):
    pool = spark.createDataFrame([(1, [0.0, 0.0], 5)], "k int, v array<double>, made int")
    new = spark.createDataFrame([(2, [0.1, 0.0], 6), (3, [1.0, 0.0], 6), (4, [1.05, 0.0], 7), (5, [9.0, 9.0], 4), (6, None, 8)], pool.schema)
    flags = {r.k: r.is_unique for r in nearby.near_pool(new, pool, "k", "v", 0.3).collect()}
    assert flags == {2: False, 3: True, 4: True, 5: True, 6: None}
    assert sorted(r.k for r in nearby.added_to_pool(new, pool, "k", "v", 0.3).collect()) == [3, 5]
    assert sorted(r.k for r in nearby.refreshed_pool(pool, new, "k", "v", "made", 0.3).collect()) == [1, 3]
    assert sorted(r.k for r in nearby.refreshed_pool(pool.limit(0), new, "k", "v", "made", 0.3).collect()) == [2, 3, 5]
    asked = spark.createDataFrame([(2, 1), (1, 9), (3, 1)], "pos int, k int")
    assert [tuple(r) for r in nearby.stored_or_missing(asked, pool, "pos", "k", "made").collect()] == [(1, 9, None, False), (2, 1, 5, True), (3, 1, 5, True)]
    with pytest.raises(ValueError):
        nearby.greedy_unique(pool, "k", None, "v", 0.0)


def brute_hull(entries):
    """key -> (above, formation, mixture) by trying every simplex of entries."""
    import itertools

    rows = {k: ({p: a / sum(c.values()) for p, a in c.items() if a > 0}, e / sum(a for a in c.values() if a > 0)) for k, c, e in entries if c and e is not None and any(a > 0 for a in c.values())}
    out = {}
    for k, (x, e) in rows.items():
        parts = sorted(x)
        inside = [(q, y, f) for q, (y, f) in rows.items() if set(y) <= set(parts)]
        ends = [min((f for _, y, f in inside if set(y) == {p}), default=None) for p in parts]
        if None in ends:
            continue
        best = None
        for some in itertools.combinations(sorted(inside, key=lambda r: (r[2], r[0])), len(parts)):
            m = np.array([[y.get(p, 0.0) for p in parts] for _, y, _ in some]).T
            if abs(np.linalg.det(m)) < 1e-9:
                continue
            share = np.linalg.solve(m, [x[p] for p in parts])
            h = sum(s * f for s, (_, _, f) in zip(share, some, strict=True))
            if share.min() > -1e-9 and (best is None or h < best[0] - 1e-12):
                best = h, {q: s for s, (q, _, _) in zip(share, some, strict=True) if s > 1e-9}
        out[k] = e - best[0], e - sum(x[p] * f for p, f in zip(parts, ends, strict=True)), best[1]
    return out


@pytest.mark.parametrize("piece", [2000, 3])
def test_hull_of_many_parts(spark, monkeypatch, piece):
    from tessera.operators import hulls

    monkeypatch.setattr(hulls, "PIECE_ROWS", piece)
    rng = random.Random(6)
    entries = [(f"{p}{i}", {p: float(1 + i)}, (1 + i) * rng.uniform(-1, 0)) for p in "ABCD" for i in range(2)]
    for i in range(36):
        c = {p: float(rng.randrange(4)) for p in rng.sample("ABCD", rng.randrange(2, 5))}
        entries.append((f"m{i:02d}", c, sum(c.values()) * rng.uniform(-3, 0)))
    entries += [("same", {"A": 2.0, "B": 2.0}, -16.0), ("same2", {"A": 1.0, "B": 1.0}, -8.0), ("none", None, 1.0), ("zero", {"A": 0.0}, 1.0), ("noE", {"A": 1.0}, None), ("lost", {"A": 1.0, "Z": 1.0}, -9.0)]
    df = spark.createDataFrame(entries, "name string, made map<string,double>, total double").repartition(3)
    got = {r.name: r for r in hulls.hull(df, "name", "made", "total").collect()}
    want = brute_hull(entries)
    assert set(got) == set(want) and "lost" not in got and got["same2"].is_stable
    for k, (above, formation, mix) in want.items():
        r = got[k]
        assert r.e_above_hull == pytest.approx(above, abs=1e-8) and r.formation == pytest.approx(formation, abs=1e-8) and r.is_stable == (above < 1e-9)
        assert {m.key: pytest.approx(m.amount, abs=1e-7) for m in r.decomposes_to} == ({} if r.is_stable else mix)
    assert hulls.hull(df.limit(0), "name", "made", "total").collect() == []
