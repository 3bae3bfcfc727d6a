"""Quality rules: every rule is evaluated once into a ledger of failure bits; policies are masks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: (name, failure as SQL over the measures); the bit of a rule is its place and never changes.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 5 * word_chars"),
    ("dup_lines", "n_lines >= 5 AND 100 * n_dup_lines > 70 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "dup_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "dup_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and rule_bits, a bit for each failed rule; no shuffle, no Python.

    n_repeat_words counts words in 5-word windows that stand twice or more in the text: windows are
    compared by hash first, and texts with equal hashes by their words. A null text has no words.
    Repeated rows each get their entry. Input columns named like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in {*MEASURES, "rule_bits"}]
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(*keep, F.filter(F.split(t, SPACE), lambda w: w != "").alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"), F.length(F.translate(t, "\x20\t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    out = out.select(*keep, "_words", "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    base = [*keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))
    out = out.select(*base, "_words", F.when(F.col("n_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).alias("_hash"))
    # only texts with equal hashes go on; the others have no repeated window
    same = F.size("_hash") > F.size(F.array_distinct("_hash"))
    out = out.select(*base, F.when(same, F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("w"), i.alias("i"))))).alias("_s"))
    twin = lambda x, i: (F.get(F.col("_s"), i - 1)["w"] == x["w"]) | (F.get(F.col("_s"), i + 1)["w"] == x["w"])
    out = out.select(*base, F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"])).alias("_d"))
    covered = F.aggregate(F.transform("_d", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_d"), i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = out.select(*base, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    bits = F.lit(0)
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)))
    # The optimizer does not move filters below what is not deterministic: a filter on the ledger must not
    # be rewritten into a second evaluation of all rules.
    bits = bits.bitwiseOR(F.spark_partition_id().bitwiseAND(F.lit(0)))
    return out.select(*keep, *MEASURES, bits.cast("int").alias("rule_bits"))


def passes(policy: str, bits: Column | None = None) -> Column:
    return (F.col("rule_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it fails, rows that only it fails, and rows kept without it; counts by mask first.

    entries are rows of ledger(): repeated rows count each, further columns are ignored, and an empty table gives no rows."""
    rules = entries.sparkSession.createDataFrame([(r, BIT[r]) for r in POLICIES[policy]], "rule string, bit int")
    by_mask = entries.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    each = by_mask.select("bits", "n", F.explode(F.array(*[F.lit(BIT[r]) for r in POLICIES[policy]])).alias("bit"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("bit").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"), F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without")).join(rules, "bit").select("rule", "failed", "failed_alone", "kept_without")
