"""Labelled graphs that hold a given one: a bit screen in Spark, then backtracking over the few that pass it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import holds_bits

#: 32-bit words of a screen.
WORDS = 8


def _screen(features: Column) -> Column:
    """Bits of hashed features, in words of 32."""
    bits = F.array_distinct(F.transform(features, lambda f: F.pmod(F.xxhash64(f), F.lit(32 * WORDS)).cast("int")))
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 32) == w), F.lit(0).cast("long"), lambda s, b: s + F.pow(F.lit(2.0), F.pmod(b, F.lit(32))).cast("long"))
    return F.array(*[word(w) for w in range(WORDS)])


def screen(nodes: Column, edges: Column) -> Column:
    """A graph's bits: of its nodes' labels, and of its edges as (label, kind, label)."""
    ends = lambda e: F.array_sort(F.array(F.get(nodes, e["a"]), F.get(nodes, e["b"])))
    return _screen(F.concat(nodes, F.transform(edges, lambda e: F.concat_ws("\n", F.array_join(ends(e), "\n"), e["kind"]))))


def holds_graph(nodes: list[str], edges: list[tuple[int, int, str]], labels: list[str], links: list[tuple[int, int, str]]) -> bool:
    """Whether the graph (nodes, edges) has the pattern (labels, links): different nodes for different labels' places, equal
    labels, and each link an edge of its kind, in either direction."""
    around: list[dict[int, set[str]]] = [{} for _ in nodes]
    for a, b, kind in edges:
        around[a].setdefault(b, set()).add(kind)
        around[b].setdefault(a, set()).add(kind)
    needs: list[list[tuple[int, str]]] = [[] for _ in labels]
    for a, b, kind in links:
        needs[a].append((b, kind))
        needs[b].append((a, kind))
    # each place after the first is next to an earlier one, if the pattern hangs together
    order: list[int] = []
    while len(order) < len(labels):
        linked = [p for p in range(len(labels)) if p not in order and any(q in order for q, _ in needs[p])]
        order.append(min(linked or [p for p in range(len(labels)) if p not in order], key=lambda p: (-len(needs[p]), p)))
    taken: dict[int, int] = {}

    def place(k: int) -> bool:
        if k == len(order):
            return True
        p = order[k]
        met = [(taken[q], kind) for q, kind in needs[p] if q in taken]
        for n in around[met[0][0]] if met else range(len(nodes)):
            if nodes[n] == labels[p] and n not in taken.values() and all(kind in around[n].get(m, ()) for m, kind in met):
                taken[p] = n
                if place(k + 1):
                    return True
                del taken[p]
        return False

    return place(0)


def with_subgraph(df: DataFrame, nodes: str, edges: str, labels: list[str], links: list[tuple[int, int, str]], limit: int | None = None) -> DataFrame:
    """The rows whose graph holds the pattern; limit bounds how many.

    nodes is an array of labels, edges an array of (a, b, kind) with places in it; rows where either is null are left out. Rows
    without all bits of the pattern's screen go first, without leaving the JVM; the others are matched in Arrow batches.
    """
    text = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    pattern = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind")) for a, b, k in links]).cast("array<struct<a:int,b:int,kind:string>>")
    maybe = df.where(F.col(nodes).isNotNull() & F.col(edges).isNotNull()).where(holds_bits(screen(F.col(nodes), F.col(edges)), screen(text(labels), pattern)))
    i, j = df.columns.index(nodes), df.columns.index(edges)

    def match(batches):
        for b in batches:
            graphs = zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True)
            yield b.filter(pa.array([holds_graph(n, [(e["a"], e["b"], e["kind"]) for e in es], labels, links) for n, es in graphs], pa.bool_()))

    out = maybe.mapInArrow(match, df.schema)
    return out if limit is None else out.limit(limit)
