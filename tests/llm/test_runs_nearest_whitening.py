"""Runs, nearest vectors and whitening against brute force, with nulls, empty and long rows, ties, repeats and clashing columns."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest, queries, runs, whitening

SF = "/root/testdata/sf0.001"


def brute_runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(60))]
    if w and rng.random() < 0.5:
        p, at = rng.randrange(1, 7), rng.randrange(len(w))
        w = w[:at] + (w[at : at + p] * 12)[: len(w)]
    return w + [9] + w if rng.random() < 0.3 else w * rng.choice([1, 1, 4])


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (3, 3), (1, 5)])
def test_runs_of_random_sequences(min_length, exponent):
    rng = random.Random(min_length)
    for _ in range(300):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        bounds = np.append(0, np.cumsum([len(w) for w in docs])).astype(np.int64)
        got = runs.runs_of(np.array([x for w in docs for x in w], np.int64), bounds, min_length, exponent)
        assert [got.get(k, []) for k in range(len(docs))] == [brute_runs(w, min_length, exponent) for w in docs]


def test_find_runs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in random_words(rng))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "a"), (74, "é x " * 7), (75, "  b " * 6), (76, " ".join(f"u{i}" for i in range(40_000)) + " y z" * 9_000), (None, "k " * 8), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, RUNS int").repartition(3)
    got = runs.find_runs(frame)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "strongest_run", "collapsed"]
    for r in got.collect():
        w = (r.text or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        want = brute_runs(w) if len(w) < 9_000 else [(40_000, 18_000, 2)]
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(w), want)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.strongest_run and tuple(r.strongest_run)) == best
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert runs.find_runs(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(frame, min_exponent=2)


def products(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def brute_nearest(rows, asked, k):
    best = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            best[i] = max(v, best.get(i, v))
    out = []
    for q in filter(asked, best):
        scored = sorted((-products(best[q], v), i) for i, v in best.items() if i != q and len(v) == len(best[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "TILE_QUERIES", 7)
    monkeypatch.setattr(nearest, "TILE_ROWS", 50)
    monkeypatch.setattr(nearest, "PRODUCT_ROWS", 16)
    monkeypatch.setattr(nearest, "PRODUCT_QUERIES", 3)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 800)
    monkeypatch.setattr(nearest, "TILE_BYTES", 64 * 70 if kind == "float" else 64 << 20)
    monkeypatch.setattr(nearest, "PAIR_BYTES", 1)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 9)).astype("f4").astype(float).tolist()
    rows = list(enumerate(vectors))
    rows += [(200 + i, vectors[3]) for i in range(60)]  # one common vector
    rows += [(300 + i, [x * (1 + 1e-7) for x in vectors[4]] if kind == "double" else vectors[4]) for i in range(20)]
    rows += [(400, None), (401, []), (402, [0.0] * 9), (403, [1.0] * 8 + [None]), (404, [1.0] * 8 + [math.nan]), (405, [1.0] * 8 + [math.inf])]
    rows += [(410, [1.0, 2.0]), (420, [2.0, 1.0]), (430, [3.0])]  # other lengths
    rows += [(0, vectors[0]), (5, vectors[7]), (None, vectors[1]), (500, [1e-30] * 9), (510, [3e18] * 9), (520, [-x for x in vectors[0]])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, dims int, score string").repartition(5)
    got = sorted(tuple(r) for r in nearest.nearest(frame, F.col("vec_id") % 5 == 0, 6).collect())
    exact = [(i, v and [c if c is None else float(np.float32(c)) if kind == "float" else c for c in v]) for i, v in rows]
    assert got == brute_nearest(exact, lambda i: i % 5 == 0, 6)
    assert nearest.nearest(frame.limit(0), F.lit(True)).collect() == []
    assert nearest.nearest(frame, F.col("vec_id") < 0).collect() == []


def test_codes_bound_their_error():
    rows = np.random.default_rng(1).normal(size=(50, 33)) * np.logspace(-8, 8, 50)[:, None]
    codes, scale, norm, error = nearest.quantised(rows)
    assert (np.linalg.norm(rows - codes * scale[:, None], axis=1) <= error).all() and np.allclose(norm, np.linalg.norm(rows, axis=1))


def whitened(rows, components):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in rows], float)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    n, s = len(x), [sum(int(c) for c in col) for col in x.T]
    deviation = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    return (x - x.mean(axis=0)) @ v[:, :components] / np.sqrt(e[:components]), e / e.sum(), deviation


@pytest.mark.parametrize("columns", [64, 5])
def test_whiten(spark, monkeypatch, columns):
    monkeypatch.setattr(whitening, "COLUMNS", columns)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(80, 11)) * np.linspace(1, 2, 11)).tolist()
    vectors += [vectors[0]] * 10
    bad = [None, [], [1.0] * 10 + [None], [1.0] * 10 + [math.nan], [math.inf] + [1.0] * 10, [1.0] * 4]
    frame = spark.createDataFrame([(i, v, 2, 3.0) for i, v in enumerate(vectors + bad)] + [(None, vectors[5], 2, 3.0)], "vec_id long, embedding array<double>, component int, x double").repartition(4)
    got = whitening.whiten(frame).collect()
    want, share, deviation = whitened([*vectors, vectors[5]], 8)
    assert len(got) == 8 * 91 and {r.n for r in got} == {91} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    sign = {r.component: np.sign(r.whitened * want[7, r.component - 1]) for r in got if r.vec_id == 7}
    for r in got:
        i = 90 if r.vec_id is None else r.vec_id
        assert r.whitened == pytest.approx(sign[r.component] * want[i, r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and r.deviation == deviation[i]


def test_whiten_without_variance_or_rows(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], shape)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], shape)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], shape)).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and line[0].explained == pytest.approx(1.0)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 2 and {r.deviation for r in huge} == {None}


def test_op13_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    want, share, deviation = whitened([rows[i] for i in ids], 8)
    got = {(r.vec_id, r.component): r for r in queries.op13_whiten_embeddings(spark, SF).collect()}
    assert len(got) == 8 * len(ids)
    for k in range(8):
        sign = np.sign(got[ids[0], k + 1].whitened * want[0, k])
        for i, v in enumerate(ids):
            r = got[v, k + 1]
            assert r.whitened == pytest.approx(sign * want[i, k], abs=1e-9) and r.deviation == deviation[i] and r.n == len(ids)
            assert r.explained == pytest.approx(share[k], rel=1e-9) and r.identity_error < 1e-9
