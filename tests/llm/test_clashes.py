"""Input columns named like those that the operators make change no result and crash nothing."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, lines, mixing, pii, queries, suffix, tokens

NAMES = ["_k", "_h", "_at", "_size", "_row", "_whole", "_bounds", "_more", "copies", "target", "source_size", "h", "x", "y", "n", "a", "b", "key", "line", "kind", "start", "end", "n_tokens", "ids", "pii", "n_bytes", "n_removed", "norm", "bucket", "i", "w", "_n", "text_key", "n_lines", "shard", "place", "epoch", "piece", "Spans", "KEPT"]


def clashing(df, names=NAMES):
    return df.select("*", *[F.lit("c").alias(n) for n in names if n.lower() not in {c.lower() for c in df.columns}])


def written(docs):
    out = common.new_path(docs.sparkSession, "clash")
    tokens.write_tokens(docs, out, queries.tokenizer_path())
    return tokens.read_tokens(docs.sparkSession, out)


OPERATORS = {
    "mix": (lambda d: mixing.mix(d.withColumn("words", mixing.count_words(F.col("text"))), size="words"), ["doc_id", "source_size", "target", "copies"]),
    "lines": (lambda d: lines.dedup_lines(d, min_chars=1), ["doc_id", "n_lines", "n_removed"]),
    "pii": (pii.find_pii, ["doc_id", "pii"]),
    "suffix": (suffix.remove_repeats, ["doc_id", "n_bytes", "n_removed", "n_spans"]),
    "tokens": (written, ["doc_id", "start", "n_tokens", "ids_crc32"]),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, "mail x@y.org here\nsecond line of text", "s"), (2, None, "s"), (3, "z " * 150, "t"), (4, "z " * 150, None), (5, "", None)], "doc_id long, text string, source string").repartition(3)
    f, columns = OPERATORS[name]
    plain, wide = (sorted(map(str, f(d).select(*columns).collect())) for d in (docs, clashing(docs)))
    assert plain == wide and len(plain) == 5


def test_mix_keeps_columns(spark):
    docs = clashing(spark.createDataFrame([(i, "s", 5) for i in range(9)], "doc_id long, source string, size long"))
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c not in ("source_size", "target", "copies")] + ["source_size", "target", "copies"]
    assert {r["_k"] for r in out.collect()} == {"c"} and out.count() == 9
    assert mixing.mix(docs.limit(0)).count() == 0


def test_clashing_columns_of_chats(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    read = lambda d: sorted(map(str, chat.read_chats(chat.format_chats(chat.turns_from_rows(d))).select("conv_id", "turns", "formatted", "loss").collect()))
    assert read(rows) == read(clashing(rows, ["turns", "formatted", "loss", "_p", "paths", "fingerprint", "_t", "i", "x"]))
