"""Mixing sources to target weights: exact quotas, a hypergeometric splitting tree, permuted blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, group_key, without

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks that a source is dealt in; a power of two.
BLOCKS = 1024
#: The permutation of a source's blocks: block b is at place (STRIDE * b + SHIFT) mod BLOCKS.
STRIDE, SHIFT = 389, 77
#: Single documents that a source adds after its blocks: the largest that fit, and at last the one that brings it nearest.
FITS = 2
#: Words of a shard on average, and the fewest shards.
SHARD_WORDS, SHARDS = 1 << 24, 16


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[int], cap: int) -> list[float]:
    """Targets that share sum(sizes) by weight; none is over cap times its size, the excess is shared again.

    Targets are level * weight, but for sources whose cap is below: those of the least cap for their weight.
    """
    order = sorted((i for i in range(len(sizes))), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, heavy, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for k, i in enumerate(order):
        if left * weights[i] / heavy <= cap * sizes[i]:
            for j in order[k:]:
                out[j] = left * weights[j] / heavy
            break
        out[i] = float(cap * sizes[i])
        left, heavy = left - cap * sizes[i], heavy - weights[i]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each kind (columns) in each shard (rows): the quotas halved again and again at random."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), np.zeros((shards, len(quotas)), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        part = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals")
        split(part, lo, mid)
        split(have - part, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def drawn_hash(key: Column, seed: int) -> Column:
    """60 bits of a hash of the key that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def block_place(h: Column) -> Column:
    """The place of a document's block among the permuted blocks of its source."""
    return F.pmod(F.pmod(h, F.lit(BLOCKS)) * STRIDE + SHIFT, F.lit(BLOCKS)).cast("int")


def plan_mix(sized: DataFrame, size: str = "size", key: str = "doc_id", source: str = "source", weights: tuple = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 17) -> DataFrame:
    """(_k, source_size, target, _whole, _bounds, _more): a row for each source, what mix() needs.

    A target is _whole times the source's size plus a rest. The source's documents lie in BLOCKS blocks by hash; the
    quota of an epoch is all blocks for the whole ones, and for the last one as many permuted blocks as do not exceed the
    rest in words. A splitting tree deals the quotas of all (source, epoch) to the shards; _bounds holds
    for each epoch how many permuted blocks the shards up to each have drawn, so what no shard draws isn't taken. What is
    left of the rest is filled by single documents, whose hashes are _more. A row for each source passes through the driver: the same
    size as a list of weights.
    """
    spark = sized.sparkSession
    narrow = sized.select(group_key(F.col(source)).alias("_k"), F.col(source).alias("_src"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), drawn_hash(F.col(key), seed).alias("_h"))
    narrow = narrow.withColumn("_at", block_place(F.col("_h")))
    stats = sorted(narrow.groupBy("_k").agg(F.max("_src").cast("string").alias("s"), F.sum("_size").alias("n")).collect(), key=lambda r: (r.s is None, [ord(c) for c in r.s or ""]))
    sizes = [r.n for r in stats]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(stats))], cap)
    whole = [int(t // n) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    rest = [int(t) - k * n for t, k, n in zip(targets, whole, sizes, strict=True)]
    names = {r._k: i for i, r in enumerate(stats)}
    quota, more = [0] * len(stats), [[] for _ in stats]

    def per_source(values: list[tuple], spec: str) -> DataFrame:
        """A row for each source; broadcast while they are few, so that a hot source stays spread."""
        frame = spark.createDataFrame(values, spec)
        return F.broadcast(frame) if len(values) * 1000 <= BROADCAST_BYTES else frame

    if any(rest):
        # words of each block, in permuted order: 1024 rows for a source
        words = narrow.groupBy("_k", "_at").agg(F.sum("_size").alias("w")).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_at", "w"))).alias("b"))
        words = words.join(per_source([(k, rest[i]) for k, i in names.items()], "_k string, _rest long"), "_k")
        so_far = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("over")), lambda a, x: F.struct(F.when(a["over"] | (a["sum"] + x["w"] > F.col("_rest")), a["sum"]).otherwise(a["sum"] + x["w"]).alias("sum"), F.when(a["over"] | (a["sum"] + x["w"] > F.col("_rest")), a["n"]).otherwise(x["_at"] + 1).alias("n"), (a["over"] | (a["sum"] + x["w"] > F.col("_rest"))).alias("over")))
        for r in words.select("_k", so_far.alias("a")).collect():
            quota[names[r._k]] = r.a.n
            rest[names[r._k]] -= r.a.sum
    for step in range(FITS + 1):
        if not any(rest):
            break
        left = narrow.join(per_source([(k, rest[i], quota[i], more[i]) for k, i in names.items()], "_k string, _rest long, _quota int, _more array<long>"), "_k")
        left = left.where((F.col("_size") > 0) & (F.col("_at") >= F.col("_quota")) & ~F.array_contains("_more", F.col("_h")))
        if step < FITS:
            best = left.where("_size <= _rest").groupBy("_k").agg(F.max(F.struct("_size", "_h")).alias("x"))
        else:
            best = left.where("_size < 2 * _rest").groupBy("_k").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_rest")).alias("d"), "_h", "_size")).alias("x"))
        for r in best.collect():
            more[names[r._k]].append(r.x._h)
            rest[names[r._k]] -= r.x._size
    shards = shards or max(SHARDS, -(-sum(sizes) // SHARD_WORDS))
    kinds = [(i, BLOCKS if e < whole[i] else quota[i]) for i in range(len(stats)) for e in range(whole[i] + (whole[i] < cap))]
    dealt = split_quotas([q for _, q in kinds], shards, seed).cumsum(axis=0) if kinds else np.zeros((shards, 0))
    bounds = [[[int(x) for x in dealt[:, c]] for c, (i, _) in enumerate(kinds) if i == s] for s in range(len(stats))]
    rows = [(r._k, sizes[i], targets[i], whole[i], bounds[i], more[i]) for i, r in enumerate(stats)]
    plan = spark.createDataFrame(rows, "_k string, source_size long, target double, _whole int, _bounds array<array<int>>, _more array<long>")
    return F.broadcast(plan) if len(rows) * (200 + 4 * shards * cap) <= BROADCAST_BYTES else plan


def mix(docs: DataFrame, size: str = "size", key: str = "doc_id", source: str = "source", weights: tuple = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 17, plan: DataFrame | None = None) -> DataFrame:
    """docs with source_size, target and copies, an array of (epoch, shard, place), one entry for each time a document is taken.

    Sources by code point, null last, have the weights in turn; see plan_mix, which is made here unless given. A document is
    taken in each epoch in which a shard draws its block, and once more if it fills a rest. place orders the rows of a
    shard. Reruns agree.

    Documents of size 0 (a null size is 0) are taken once at least; a null key or repeated rows fall or stay
    together; an empty table gives no rows. Input columns named like the new ones are replaced.
    """
    plan = plan if plan is not None else plan_mix(docs, size, key, source, weights, cap, shards, seed)
    # the input's columns travel inside a struct, so none can clash with those made here
    row = F.struct(*[F.col(f"`{c}`") for c in without(docs, ["source_size", "target", "copies"])]).alias("_row")
    out = docs.select(row, group_key(F.col(source)).alias("_k"), drawn_hash(F.col(key), seed).alias("_h"), F.coalesce(F.col(size), F.lit(0)).alias("_size")).join(plan, "_k")
    at = block_place(F.col("_h"))

    def copy(e: Column, shard: Column) -> Column:
        place = F.xxhash64(F.lit(seed), e, "_h")
        return F.struct(e.alias("epoch"), shard.cast("int").alias("shard"), place.alias("place"))

    # an epoch whose shards have drawn up to the block's place or less leaves it
    drawn = F.filter(F.transform("_bounds", lambda b, e: F.when(F.element_at(b, -1) > at, copy(e.cast("int"), F.size(F.filter(b, lambda x: x <= at))))), lambda c: c.isNotNull())
    alone = F.array(copy(F.col("_whole"), F.pmod("_h", F.size(F.get("_bounds", F.lit(0))))))
    copies = F.when(F.array_contains("_more", F.col("_h")) | ((F.col("_size") == 0) & (F.size(drawn) == 0)), F.concat(drawn, alone)).otherwise(drawn)
    return out.withColumn("copies", copies).select("_row.*", "source_size", "target", "copies")


def mixed_rows(plan: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy, with its shard and place, by shard and in the shuffled order of places."""
    rest = [c for c in plan.columns if c not in ("copies", "epoch", "shard", "place")]
    rows = plan.select(*rest, F.explode("copies").alias("copies")).select(*rest, "copies.epoch", "copies.shard", "copies.place")
    return rows.repartition("shard").sortWithinPartitions("shard", "place")
