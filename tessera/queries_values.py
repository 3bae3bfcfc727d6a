"""Queries of value repairs, parsers, generated ids and samples over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars, values
from .operators import relations, tables, vectors
from .plans.query import frame_filter
from .queries import add, simple

simple("accents_folded", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents", lambda t: t("documents").select("doc_id", F.md5(values.folded(F.col("text"))).alias("folded")))
simple("encoding_repaired", "SELECT doc_id, md5(text) AS repaired FROM documents", lambda t: t("documents").select("doc_id", F.md5(values.repaired_encoding(F.when(~F.col("text").rlike(r"[^\x{00}-\x{FF}]"), F.decode(F.encode("text", "utf-8"), "iso-8859-1")).otherwise(F.col("text")))).alias("repaired")))
simple("json_column_repaired", "SELECT p_partkey, p_brand AS first, NULL::VARCHAR AS second, 2::BIGINT AS n FROM part", lambda t: t("part").withColumn("r", values.repaired_array(F.concat(F.lit("['"), F.col("p_brand"), F.lit("', None]")))).select("p_partkey", F.col("r")[0].alias("first"), F.col("r")[1].alias("second"), F.size("r").cast("long").alias("n")))
simple("hex_amounts", "SELECT o_orderkey, (o_orderkey::HUGEINT * 4722366482869645213696)::VARCHAR AS amount FROM orders", lambda t: t("orders").select("o_orderkey", values.wide_hex(F.concat(F.lit("0x"), F.hex("o_orderkey"), F.repeat(F.lit("0"), F.lit(18)))).cast("string").alias("amount")))
_WORD = "('0x' || substr(h, {}, {}))::BIGINT % {}"
_LETTER = "substr('BCDFGHJKLMNPQRSTVWXZ', (" + _WORD + ")::INT + 1, 1)"
_ID = " || ".join([*[_LETTER.format(1 + 4 * i, 4, 20) for i in range(3)], "'-'", "lpad((" + _WORD.format(13, 6, 1000) + ")::VARCHAR, 3, '0')", "'-'", "lpad((" + _WORD.format(19, 8, 10000) + ")::VARCHAR, 4, '0')"])
simple("public_ids", f"SELECT c_custkey, {_ID} AS id FROM (SELECT c_custkey, md5(c_custkey || ':0') AS h FROM customer)", lambda t: t("customer").select("c_custkey", values.public_id(F.col("c_custkey")).alias("id")))


@add("public_ids_unique", f"SELECT count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS n_ids FROM (SELECT {_ID} AS id FROM (SELECT md5(c_custkey || ':0') AS h FROM customer))")
def _unique(t) -> DataFrame:
    """How many ids would have to be drawn again."""
    return t("customer").select(values.public_id(F.col("c_custkey")).alias("id")).groupBy("id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_ids"))


simple("command_parser", "SELECT p_partkey, string_split(p_name, ' ')[1] AS command, len(string_split(p_name, ' ')) - 1 AS n_arguments FROM part UNION ALL SELECT p_partkey, 'set', 2 FROM part", lambda t: t("part").select("p_partkey", F.explode(values.commands(F.concat(F.col("p_name"), F.lit(";; set size "), F.col("p_size").cast("string"), F.lit(";")))).alias("c")).select("p_partkey", "c.command", F.size("c.arguments").cast("long").alias("n_arguments")))
simple("typed_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS whole, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice::DOUBLE END AS real, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus = 'F' END AS flag FROM orders", lambda t: t("orders").select("o_orderkey", values.typed(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice").cast("string")).otherwise(F.when(F.col("o_orderstatus") == "F", ".TRUE.").otherwise("f"))).alias("v")).select("o_orderkey", "v.whole", "v.real", "v.flag"))
simple("series_values", "SELECT o_orderkey, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice::DOUBLE END AS value FROM orders", lambda t: t("orders").select("o_orderkey", F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), values.series_value(F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))).alias("value")))
simple("first_status_row", "SELECT user_id, min(ts) AS at, arg_min(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id", lambda t: t("events").where("event_type = 'click'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", F.col("f.ts").alias("at"), "f.event_id"))
simple("parallel_arrays", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity::DOUBLE AS quantity FROM lineitem", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_linenumber")).alias("a"), F.to_json(F.collect_list(F.col("l_quantity").cast("double"))).alias("b")).select("l_orderkey", F.explode(F.arrays_zip(F.from_json("a", "array<bigint>").alias("line"), F.from_json("b", "array<double>").alias("quantity"))).alias("z")).select("l_orderkey", "z.line", "z.quantity"))
simple("json_membership", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red')", lambda t: frame_filter(t("part").select("p_partkey", F.to_json(F.split("p_name", " ")).alias("words")), words__contains='"red"').select("p_partkey"))
simple("seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey LIMIT 1000", lambda t: t("orders").select("o_orderkey", "o_totalprice").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":7"))), "o_orderkey").limit(1000))
simple("lookup_missing", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_size * 1.5::DOUBLE END AS energy FROM part", lambda t: relations.with_lookup(t("part").select("p_partkey", "p_size"), t.spark.range(1, 21).select(F.col("id").alias("p_size"), (F.col("id") * 1.5).alias("energy")), "p_size", "energy").select("p_partkey", "energy"))
simple("name_parts", "SELECT doc_id, 'relaxation' AS type, source AS app, coalesce(lang, '') AS preset FROM documents WHERE source IS NOT NULL AND NOT contains(source, '.')", lambda t: t("documents").where("source IS NOT NULL AND NOT contains(source, '.')").select("doc_id", F.concat(F.lit("relaxation."), "source", F.lit("."), F.coalesce("lang", F.lit(""))).alias("name")).select("doc_id", *[scalars.name_part(F.col("name"), i).alias(n) for i, n in ((1, "type"), (2, "app"), (3, "preset"))]))
simple("whole_days", "SELECT event_id, floor(event_id * 1000 / 86400)::BIGINT AS days FROM events", lambda t: t("events").select("event_id", scalars.whole_days(F.col("event_id") * 1000).alias("days")))
simple("matrix_norms", "SELECT vec_id, round(greatest(sqrt(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE * x))), sqrt(list_sum(list_transform(embedding[5:8], lambda x: x::DOUBLE * x)))), 4) AS row_norm, round(sqrt(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE * x))), 4) AS all_norm FROM embeddings", lambda t: t("embeddings").withColumn("m", F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4))).select("vec_id", F.round(scalars.matrix_norms(F.col("m"))[0], 4).alias("row_norm"), F.round(scalars.matrix_norms(F.col("m"))[1], 4).alias("all_norm")))


@add("trimmed_then_reranked", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, embedding, q FROM embeddings, q ORDER BY list_distance(embedding[1:8]::DOUBLE[], q[1:8]::DOUBLE[]), vec_id LIMIT 100) SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 4) AS distance FROM c ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def _rerank(t) -> DataFrame:
    """Candidates by a cheap distance over the first values, then the nearest of them by the whole vectors."""
    q = t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    l2 = vectors.METRICS["l2"]
    cheap = l2(F.slice("embedding", 1, 8), F.slice("q", 1, 8))
    trimmed = t("embeddings").select("vec_id", "embedding").crossJoin(F.broadcast(q)).orderBy(cheap, "vec_id").limit(100)  # one row of q
    return trimmed.select("vec_id", l2(F.col("embedding"), F.col("q")).alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 4).alias("distance"))


simple("frame_json_round_trip", "SELECT s_suppkey, s_name FROM supplier", lambda t: t("supplier").select("s_suppkey", tables.as_json(t("supplier")).alias("j")).select("s_suppkey", F.from_json("j", "s_name string")["s_name"].alias("s_name")))
