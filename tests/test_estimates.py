"""Compositions, ledgers, slices of long groups, drawn centres and joins, by brute force on small tables."""

import math
import random
from decimal import Decimal
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import centres, compositions, ledgers, relations, series, slices


def test_amounts(spark):
    table = [(1, "NaCl"), (2, "Fe2O3"), (3, "C0.5HC1.5"), (4, ""), (5, None), (6, "??")]
    got = {r.k: r.a for r in spark.createDataFrame(table, "k long, f string").select("k", compositions.amounts(F.col("f")).alias("a")).collect()}
    plain = {k: None if v is None else [(p.symbol, p.amount) for p in v] for k, v in got.items()}
    assert plain == {1: [("Na", 1.0), ("Cl", 1.0)], 2: [("Fe", 2.0), ("O", 3.0)], 3: [("C", 2.0), ("H", 1.0)], 4: [], 5: None, 6: []}


STATES = [("A", -1, -0.2), ("A", 1, -0.1), ("A", 3, -0.1), ("B", -3, -0.5), ("B", -2, 0.0), ("B", 2, -0.3), ("C", -1, 0.0), ("C", 1, 0.0)]


def test_oxidation_guesses_are_the_best_of_all_choices(spark):
    rng = random.Random(3)
    formulas = ["".join(f"{s}{rng.randrange(1, 6)}" for s in rng.sample("ABC", rng.randrange(1, 4))) for _ in range(60)] + ["AZ", "", "A0.5B0.25"]
    df = spark.createDataFrame(list(enumerate(formulas)), "k long, f string")
    got = {r.k: r.states for r in compositions.oxidation_guesses(df, "k", "f", spark.createDataFrame(STATES, "symbol string, state int, weight double")).collect()}
    parts = {r.k: [(p.symbol, p.amount) for p in r.a] for r in df.select("k", compositions.amounts(F.col("f")).alias("a")).collect()}
    seen = 0
    for k, have in parts.items():
        if not have:
            assert k not in got
            continue
        choices = [c for c in product(*[[x for x in STATES if x[0] == s] for s, _ in have]) if sum(x[1] * n for x, (_, n) in zip(c, have, strict=True)) == 0]
        best = min(choices, key=lambda c: (-round(sum(x[2] for x in c), 9), [x[1] for x in c]), default=None)
        assert got[k] == (None if best is None else {x[0]: x[1] for x in best}), formulas[k]
        seen += best is not None
    assert seen > 10


def test_radii_volumes_and_distances(spark):
    df = spark.createDataFrame([(1, "A2C2"), (2, "AZ"), (3, "B")], "k long, f string")
    elements = spark.createDataFrame([("A", 1.0, None), ("B", 2.0, 1.0), ("C", 0.5, 1.0)], "symbol string, atomic_radius double, metallic_radius double")
    states, ionic = spark.createDataFrame(STATES, "symbol string, state int, weight double"), spark.createDataFrame([("A", 1, 0.75)], "symbol string, state int, radius double")
    parts = compositions.radii(df, "k", "f", elements, "ionic", states, ionic)
    assert sorted((r.k, r.symbol, r.radius) for r in parts.where("k <> 2").collect()) == [(1, "A", 0.75), (1, "C", 0.5), (3, "B", 2.0)]
    sizes = {r.k: r.volume for r in compositions.volumes(parts, "k", 0.5).collect()}
    assert sizes[2] is None and math.isclose(sizes[1], (2 * 0.75**3 + 2 * 0.5**3) * 4 / 3 * math.pi / 0.5)
    away = {(r.k, r.a, r.b): r.distance for r in compositions.least_distances(parts, "k").collect()}
    assert away[(1, "A", "C")] == away[(1, "C", "A")] == 0.625 and away[(1, "A", "A")] == 0.75 and away[(2, "A", "Z")] is None and len(away) == 9
    metal = compositions.radii(df, "k", "f", elements, "metallic")
    assert {r.k: r.volume is None for r in compositions.volumes(metal, "k").collect()} == {1: True, 2: True, 3: False}
    with pytest.raises(ValueError):
        compositions.radii(df, "k", "f", elements, "ionic")
    with pytest.raises(ValueError):
        compositions.radii(df, "k", "f", elements, "bohr")


MOVES = "seq long, a long, b long, usdc double, tokens double"


def plain_audit(moves, free, most):
    held, faults = {"usdc": {}, "tokens": {}}, {}
    for seq, a, b, *given in sorted(moves):
        money = dict(zip(("usdc", "tokens"), [Decimal(str(x or 0)) for x in given], strict=True))
        found = [n for n, x in (("same_account", a == b), ("no_amount", not any(money.values())), ("not_positive", any(v < 0 for v in money.values()))) if x]
        for c, v in money.items():
            if v > 0:
                h = held[c]
                h[a] = h.get(a, 0) - v
                if h[a] < 0 and a not in free[c]:
                    found.append(f"insufficient_{c}")
                h[b] = h.get(b, 0) + v
                if most[c] is not None and h[b] > most[c]:
                    found.append(f"unrealistic_{c}")
        if found:
            faults[seq] = found
    return faults


def test_audit_follows_the_moves(spark):
    rng = random.Random(8)
    # a hot account takes part in a third of all moves
    who = lambda: 0 if rng.random() < 0.2 else rng.randrange(6)
    moves = [(i * 3, who(), who(), rng.choice([None, 0.0, -1.0, 2.5, 7.1, 0.1]), rng.choice([None, 0.0, 1.0, 4.0])) for i in range(400)]
    frame = spark.createDataFrame(moves, MOVES)
    want = plain_audit(moves, {"usdc": [0, 1], "tokens": [0]}, {"usdc": None, "tokens": 30})
    for rows in (10**6, 37):
        got = ledgers.audit(frame, "seq", "a", "b", {"usdc": ([0, 1], None), "tokens": ([0], 30)}, rows=rows).collect()
        assert {r.seq: r.faults for r in got} == want
    assert {x for f in want.values() for x in f} == {"same_account", "no_amount", "not_positive", "insufficient_usdc", "insufficient_tokens", "unrealistic_tokens"}


def test_statement_runs_through_slices(spark):
    moves = [(i, i % 3, (i + 1) % 3 if i % 5 else None, 0.1 * (i % 7), None) for i in range(200)]
    frame = spark.createDataFrame(moves, MOVES)
    opening = spark.createDataFrame([(0, Decimal("5.5")), (None, Decimal(1))], "account long, balance decimal(20,2)")
    got = sorted(((r.account is None, r.account, r.seq, r.change, r.balance) for r in ledgers.statement(frame, "seq", "a", "b", "usdc", opening, rows=11).collect()), key=str)
    held, want = {0: Decimal("5.5"), None: Decimal(1)}, []
    for seq, a, b, v, _ in moves:
        for who, x in ((a, -Decimal(str(round(v, 6)))), (b, Decimal(str(round(v, 6))))):
            held[who] = held.get(who, Decimal(0)) + x
            want.append((who is None, who, seq, x, held[who]))
    assert [(*x[:3], float(x[3]), float(x[4])) for x in got] == [(*x[:3], float(x[3]), float(x[4])) for x in sorted(((w[0], w[1], w[2], w[3].quantize(Decimal("0.000001")), w[4].quantize(Decimal("0.000001"))) for w in want), key=str)]
    assert ledgers.checked(ledgers.balances(frame, "seq", "a", "b", "usdc"), "balance").first() == (Decimal(0), True)
    none = frame.where("false")
    assert ledgers.statement(none, "seq", "a", "b", "usdc").count() == ledgers.audit(none, "seq", "a", "b", {"usdc": ([], None)}).count() == 0
    assert ledgers.checked(ledgers.balances(none, "seq", "a", "b", "usdc"), "balance").first() == (Decimal(0), True)


def test_ledger_statement_has_no_entries_of_nothing(spark, tmp_path):
    rows = [(0, 3, 0.0), (1, 10, 2.5), (2, 17, None), (3, 24, -1.25), (4, 24, 0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["ledger_statement"](spark, str(tmp_path)).select("seq", "account", "change", "balance").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT seq, account, change, balance FROM ({queries.SQL['ledger_statement']})").fetchall())
    assert got == want and {r[0] for r in got} == {1, 3}


def test_slices_change_no_result(spark):
    rng = random.Random(5)
    day = lambda s: f"2024-01-0{1 + s % 3} {s % 24:02d}:{s % 60:02d}:00"
    points = [(rng.choice(["x", "x", "y", None]), day(i), float(rng.randrange(99)) if i % 6 else None) for i in range(0, 300, 4)]
    asked = [(i, rng.choice(["x", "x", "y", None, "z"]), day(rng.randrange(300)) if i % 9 else None) for i in range(120)]
    p = spark.createDataFrame(points, "g string, t string, v double").selectExpr("g", "t::timestamp AS t", "v").groupBy("g", "t").agg(F.max("v").alias("v"))
    a = spark.createDataFrame(asked, "id long, g string, t string").selectExpr("id", "g", "t::timestamp AS t")
    sort = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert sort(series.as_of(a, p, ["g"], "t", "v", rows=17)) == sort(series.as_of(a, p, ["g"], "t", "v"))
    whole = p.where("v IS NOT NULL")
    assert sort(series.interpolate(a, whole, ["g"], "t", "v", rows=17)) == sort(series.interpolate(a, whole, ["g"], "t", "v"))
    best = lambda **k: sort(series.best_so_far(p, "v", ["t"], ["g"], **k))
    assert best() == best(at=series.micros("t")) == best(at=series.micros("t"), rows=9) and len(best()) > 3
    assert slices.sliced(p, series.micros("t"), 9)[1] > 5


def test_seed_rows(spark):
    rng = random.Random(1)
    near = [(i, [rng.random(), rng.random()]) for i in range(200)]
    far = [(1000, [1e4, 0.0]), (1001, [0.0, 1e4])]
    odd = [(2000, None), (2001, []), (2002, [float("nan"), 0.0]), (2003, [None, 1.0]), (2004, [float("inf"), 0.0])]
    df = spark.createDataFrame(near + far + odd, "id long, v array<double>")
    got = [(r.pos, r.id) for r in centres.seed_rows(df, "id", "v", 3, seed=4).orderBy("pos").collect()]
    assert got == [(r.pos, r.id) for r in centres.seed_rows(df.repartition(5), "id", "v", 3, seed=4).orderBy("pos").collect()]
    # rows far away have all but all of the weight
    assert {1000, 1001} <= {i for _, i in got} and [p for p, _ in got] == [0, 1, 2]
    same = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id long, v array<double>")
    assert centres.seed_rows(same, "id", "v", 3).count() == 1 and centres.seed_rows(same.where("false"), "id", "v", 3).count() == 0


def test_kmeans_parts_far_groups(spark):
    rng = random.Random(2)
    rows = [(i, [100.0 * (i % 3) + rng.random(), rng.random()]) for i in range(90)] + [(900, None), (901, [float("nan"), 1.0])]
    found, middles = centres.kmeans(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3)
    of = {r.id: r.cluster for r in found.collect()}
    assert len(of) == 90 and len({(of[i], i % 3) for i in range(90)}) == 3 and middles.count() == 3


def test_outer_joins_beyond_hot_keys(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k int, x int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k int, y string")
    sort = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for how in ("right", "full"):
        assert sort(relations.salted_outer_join(big, small, "k", 4, how).select("k", "x", "y")) == sort(big.join(small, "k", how).select("k", "x", "y"))
    with pytest.raises(ValueError):
        relations.salted_outer_join(big, small, "k", 4, "cross")


def test_salted_joins_send_no_side_to_the_driver(spark):
    # both sides are small enough for Spark to broadcast them by its own estimate
    big, small = spark.range(1000).selectExpr("id % 7 AS k", "id AS x"), spark.range(10).selectExpr("id AS k", "-id AS y")
    for df, n in ((relations.salted_join(big, small, "k", 4), 1000), (relations.salted_join(big, small, "k", 4, "left"), 1000), (relations.salted_outer_join(big, small, "k", 4, "right"), 1003), (relations.salted_outer_join(big, small, "k", 4, "full"), 1003)):
        assert df.count() == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_in_values(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "x long")
    ids = lambda d: sorted(r.x for r in d.collect() if r.x is not None)
    many = [*range(5, 5000), None]
    for wanted in ([5, 6, None], many, spark.createDataFrame([(i,) for i in many], "v long")):
        inside = [5, 6] if wanted == [5, 6, None] else [5, 6, 7, 8, 9]
        assert ids(relations.in_values(df, "x", wanted)) == inside
        out = relations.in_values(df, "x", wanted, inverse=True)
        assert ids(out) == [i for i in range(10) if i not in inside] and out.count() == 10 - len(inside)
    for none in ([], [None], spark.createDataFrame([], "v long")):
        assert relations.in_values(df, "x", none).count() == 0 and relations.in_values(df, "x", none, inverse=True).count() == 11
