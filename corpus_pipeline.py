"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, minhash, mixing, quality, tokens
from tessera.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the rule ledger."""
    return quality.ledger(docs).where(quality.passes("v1")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; of repeated rows one."""
    out = minhash.near_duplicates(docs)
    gone = common.staged(out.where("NOT kept").select("doc_id").distinct(), "gone")
    again = common.staged(out.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    n, m = gone.count(), again.count()
    kept = docs.join(F.broadcast(gone) if n * 16 <= common.BROADCAST_BYTES else gone, "doc_id", "left_anti").select(*docs.columns)
    if not m:
        return kept
    again = F.broadcast(again) if m * 16 <= common.BROADCAST_BYTES else again
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken, by shard and shuffled in it."""
    sizes = common.staged(docs.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size")), "sizes")
    plan = mixing.plan_mix(sizes)
    empty = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD), 1).otherwise(0)
    mixed = mixing.mix(docs.withColumn("_words", empty), size="_words", plan=plan)
    return mixing.mixed_rows(mixed).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    out = common.new_path(spark, "tokens")
    tokens.write_tokens(docs, out, tokenizer_path())
    return tokens.read_tokens(spark, out)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_weights),
    ("token-ID / binary output", token_output),
]

#: SQL has no tokenizer and no sketches: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
