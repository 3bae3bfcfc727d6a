"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, group_key, running, staged, unit, without


def interleave(docs: DataFrame, shards: int, key: str = "doc_id", source: str = "source", tie: tuple = (), seed: int = 11) -> DataFrame:
    """docs with shard and slot; shards differ by one row at most, and each matches the mixture of sources.

    Rows are ranked in the order of a seeded hash within their source, (rank + 1/2) / rows is their
    fractional rank, and the table in that order is cut into equal runs. Ranks come from totals of
    small buckets, so a hot source is spread over all tasks. Pass narrow rows: the operator stages
    them twice; join wide columns by key afterwards.

    Null keys and sources are ranked like values, repeated rows each get a slot, an empty table gives no
    rows; tie names columns that order rows of the same key. Input columns named shard or slot are replaced.
    """
    # the input's columns travel inside a struct, so none can clash with those made here
    row = F.struct(*[F.col(f"`{c}`") for c in without(docs, ["shard", "slot"])]).alias("_row")
    ties = [f"_t{i}" for i in range(len(tie))]
    docs = docs.select(row, group_key(F.col(source)).alias("_k"), F.col(key).alias("_id"), *[F.col(t).alias(n) for t, n in zip(tie, ties, strict=True)], F.xxhash64(F.lit(seed), F.col(key).cast("string"), *tie).alias("_h"))
    docs = staged(docs, "shard-rows")
    # a row for each source; while they are few, rows of a hot source need not meet in one task
    counts = staged(docs.groupBy("_k").agg(F.count("*").alias("_n")), "shard-counts")
    seen = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.octet_length("_k") + 24), F.lit(0)).alias("bytes")).first()
    total = seen.rows
    counts = F.broadcast(counts) if seen.bytes <= BROADCAST_BYTES else counts
    ranked = running(docs.join(counts, "_k"), "_k", unit(F.col("_h").bitwiseXOR(F.lit(-(1 << 63)))), F.col("_n"), ["_h", "_id", *ties], F.lit(1), "_rank")
    placed = staged(ranked.withColumns({"_f": (2 * F.col("_rank") + 1) / (2 * F.col("_n")), "_all": F.lit(0)}), "shard-ranks")
    placed = running(placed, "_all", F.col("_f"), F.lit(total), ["_f", "_k", "_rank"], F.lit(1), "_at")
    # exact in integers: shard s holds the places from ceil(s * total / shards) on
    shard = F.expr(f"CAST(_at * {shards} div {max(total, 1)} AS INT)")
    first = F.expr(f"CAST((CAST(shard AS BIGINT) * {total} + {shards - 1}) div {shards} AS BIGINT)")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_at") - first).select("_row.*", "shard", "slot")
