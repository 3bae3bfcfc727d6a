"""Nested documents, site distances and graph patterns against brute force on small rows."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import nested, sites, subgraphs


def deep(a, b):
    if not isinstance(a, dict) or not isinstance(b, dict):
        return b
    return {k: deep(a[k], b[k]) if k in a and k in b else b[k] if k in b else a[k] for k in {*a, *b}}


def test_nested_documents(spark):
    pairs = [
        ({"a": {"x": 1, "y": {"z": 2}}, "l": [1, {"q": 1}]}, {"a": {"y": {"w": "t\"ext"}, "x": None}, "n": True}),
        ({"a": 1, "b": {"c": {"d": 1}}}, {"a": {"deep": 2}, "b": {"c": 7}}),
        ({"a": {"b": 1}}, {"a": {}}),
        ({"a": 5}, {"a": {}, "é": "ü"}),
        ({"only": 1}, {}),
    ]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(90, None, "{\"k\": 1}"), (91, "not json", "[1]")], "id int, lo string, hi string")
    got = {r.id: json.loads(r.document) for r in nested.merged(df, "id", "lo", "hi", 4).collect()}
    assert got == {i: deep(a, b) for i, (a, b) in enumerate(pairs)} | {90: {"k": 1}}
    cells = {(r.id, tuple(r.path)): r.value for r in nested.leaves(df, "id", "lo", 2).collect()}
    assert cells[0, ("a", "x")] == "1" and json.loads(cells[0, ("a", "y")]) == {"z": 2} and json.loads(cells[0, ("l",)]) == [1, {"q": 1}] and not any(k[0] > 80 for k in cells)
    wide = {r.id: r.asDict() for r in nested.wide(df, "id", "lo", lambda p: F.element_at(p, -1), ["x", "z", "only"], 4).collect()}
    assert wide[0] == {"id": 0, "x": 1.0, "z": 2.0, "only": 0.0} and wide[4]["only"] == 1.0 and wide[90] == {"id": 90, "x": 0.0, "z": 0.0, "only": 0.0}
    assert nested.merged(df.limit(0), "id", "lo", "hi", 2).collect() == []


def test_site_distances(spark):
    rng = random.Random(3)
    rows = [(i, [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(i % 5)], [[4.0, 0.5, 0.0], [0.0, 5.0, rng.random()], [0.3, 0.0, 6.0]]) for i in range(12)]
    rows += [(20, [[0.1, 0.1, 0.1], [1.1, 0.1, 0.1]], rows[0][2]), (21, None, rows[0][2])]

    def least(points, cell):
        found = []
        for a, b in itertools.combinations(points or [], 2):
            d = [x - y for x, y in zip(a, b, strict=True)]
            d = [x - round(x) for x in d]
            found.append(min(math.dist([0] * 3, [sum((d[k] + s[k]) * cell[k][c] for k in range(3)) for c in range(3)]) for s in itertools.product((-1, 0, 1), repeat=3)))
        return min(found, default=None)

    df = spark.createDataFrame(rows, "id int, s array<array<double>>, cell array<array<double>>").withColumn("kinds", F.transform("s", lambda x, i: F.when(i % 2 == 0, "A").otherwise("B")))
    s, cell = F.col("s"), F.col("cell")
    radii = sites.touching_radii({"A": 1.0, "B": 0.5})
    got = df.select("id", sites.min_site_distance(s, cell).alias("d"), sites.sites_apart(s, cell, 1.5).alias("apart"), sites.kinds_apart(s, F.col("kinds"), cell, radii).alias("kinds_apart"), sites.pair_distances(s, cell).alias("p")).collect()
    for r, (_, points, box) in zip(sorted(got), rows, strict=True):
        want = least(points, box)
        assert r.d == (want if want is None else pytest.approx(want, abs=1e-9)) and r.apart == (want is None or want >= 1.5)
        if points is not None:
            assert r.kinds_apart == all(p.distance >= radii[tuple(sorted("AB"[k % 2] for k in (p.i, p.j)))] for p in r.p)
    assert got[-2].d == pytest.approx(0.0, abs=1e-9)
    one = spark.range(1).select(sites.sphere_volume(F.create_map(F.lit("A"), F.lit(2)), {"A": 1.0}).alias("v")).first()
    assert one.v == pytest.approx(2 * 4 / 3 * math.pi / 0.5)


def test_subgraphs(spark):
    rng = random.Random(9)
    graphs = []
    for i in range(60):
        n = rng.randrange(0, 6)
        nodes = [rng.choice("CNO") for _ in range(n)]
        edges = [(a, b, rng.choice("12")) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        graphs.append((i, nodes, edges))
    df = spark.createDataFrame([*graphs, (99, None, None)], "id int, nodes array<string>, edges array<struct<a:int,b:int,kind:string>>").repartition(3)
    for labels, links in ((["C", "N", "O"], [(0, 1, "1"), (1, 2, "2")]), (["C", "C"], []), (["N", "C", "C"], [(0, 1, "1"), (1, 2, "1"), (2, 0, "1")]), (["O"], [])):
        def brute(nodes, edges, labels=labels, links=links):
            have = {(a, b, k) for a, b, k in edges} | {(b, a, k) for a, b, k in edges}
            return any(all(nodes[p] == x for p, x in zip(at, labels, strict=True)) and all((at[a], at[b], k) in have for a, b, k in links) for at in itertools.permutations(range(len(nodes)), len(labels)))

        got = {r.id for r in subgraphs.with_subgraph(df, "nodes", "edges", labels, links).collect()}
        assert got == {i for i, n, e in graphs if brute(n, e)}
    assert subgraphs.with_subgraph(df, "nodes", "edges", ["C"], [], 2).count() == 2
