"""More queries over the driver tables, registered beside those of tessera.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import prices, tables, vectors
from .queries import add, simple

_FIVE = "vec_id % 50 = 0"

# pages, frames and stored rows
simple("frame_excluding", "SELECT c_custkey, c_name, c_mktsegment FROM customer", lambda t: tables.to_frame(t("customer"), exclude=("c_nationkey", "c_acctbal")))
simple("frame_columns", "SELECT s_name, s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7", lambda t: tables.to_frame(t("supplier").orderBy("s_suppkey"), ["s_name", "s_suppkey"], limit=7))
simple("page_json", "SELECT (SELECT count(*) FROM part) AS count, '/parts?page=3' AS next, '/parts?page=1' AS previous, list('{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' ORDER BY p_partkey) AS results FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 25 OFFSET 25)", lambda t: tables.page_json(t("part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"], 2, 25, "/parts"))
simple("row_json", "SELECT c_custkey, '{\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' AS row FROM customer", lambda t: t("customer").select("c_custkey", tables.as_json(t("customer"), ("c_custkey", "c_acctbal", "c_mktsegment")).alias("row")))
simple("page_csv", "SELECT doc_id || ',' || CASE WHEN regexp_matches(coalesce(text, ''), '[\",\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE coalesce(text, '') END AS line FROM documents", lambda t: tables.page_csv(t("documents"), ["doc_id", "text"]))
simple("markdown_rows", "SELECT '| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |' AS line FROM part", lambda t: tables.markdown_rows(t("part"), ["p_partkey", "p_name", "p_size"]))
simple("summary_lines", "SELECT s_suppkey, 's_name: ' || s_name || chr(10) || 's_nationkey: ' || s_nationkey || chr(10) || 's_suppkey: ' || s_suppkey AS summary FROM supplier", lambda t: tables.summary_lines(t("supplier"), "s_suppkey", ("s_acctbal",)))
simple("from_saved", "SELECT pos, v.t AS \"table\", id, row FROM (VALUES (0, 'supplier', 2), (1, 'nation', 5), (2, 'supplier', 1)) v(pos, t, id) JOIN (SELECT 'supplier' AS t, s_suppkey AS k, '{\"s_suppkey\":' || s_suppkey || ',\"s_nationkey\":' || s_nationkey || '}' AS row FROM supplier UNION ALL SELECT 'nation', n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' FROM nation) x ON x.t = v.t AND x.k = v.id", lambda t: tables.from_saved({"supplier": (t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey"), "nation": (t("nation").select("n_nationkey", "n_name"), "n_nationkey")}, t.spark.createDataFrame([(0, "supplier", 2), (1, "nation", 5), (2, "supplier", 1)], "pos int, table string, id long")))
simple("fetch_by_priority", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 5", lambda t: tables.fetch_by_priority(t("customer").select("c_custkey", "c_name"), [("c_name", None), ("c_custkey", 5)]))
simple("update_many", "SELECT p_partkey, CASE WHEN p_partkey IN (1, 4, 9) THEN 'Brand#0' ELSE p_brand END AS p_brand, p_size FROM part", lambda t: tables.update_many(t("part").select("p_partkey", "p_brand", "p_size"), "p_partkey", [1, 4, 9], {"p_brand": "Brand#0", "p_size": None}))
simple("work_to_fill", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 WHERE l_linenumber IS NULL AND o_orderstatus <> 'P'", lambda t: tables.to_fill(t("orders").join(t("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left"), ["l_linenumber"], F.col("o_orderstatus") != "P").select("o_orderkey", "l_linenumber"))
simple("update_column", "SELECT p_partkey, upper(p_brand) AS p_brand, p_size * 2 AS double_size FROM part", lambda t: tables.update_column(tables.update_column(t("part").select("p_partkey", "p_brand", "p_size"), "p_brand", F.upper("p_brand")), "double_size", F.col("p_size") * 2).drop("p_size"))
simple("exists_rows", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 1e12", lambda t: tables.exists(t("orders").where("o_totalprice > 1e12")))
simple("exists_some", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 0", lambda t: tables.exists(t("orders").where("o_totalprice > 0")))
simple("unique_partitions", "SELECT DISTINCT event_type FROM events", lambda t: t("events").select("event_type").distinct())
simple("null_bypass", "SELECT doc_id, length(text) AS n FROM documents", lambda t: t("documents").select("doc_id", tables.null_bypass(F.col("text"), F.length("text").cast("long")).alias("n")))
simple("pool_new", "SELECT p_partkey, p_type || p_size NOT IN (SELECT p_type || p_size FROM part WHERE p_partkey < 50) AS is_new FROM part", lambda t: tables.in_pool(t("part").select("p_partkey", "p_type", "p_size"), t("part").where("p_partkey < 50"), ["p_type", "p_size"]).select("p_partkey", "is_new"))
simple("beside_columns", "SELECT p_partkey, p_name, CAST(p_size AS DOUBLE) AS made FROM part", lambda t: tables.beside(t("part").select("p_partkey", "p_name"), t("part").select("p_partkey", F.col("p_size").cast("double").alias("made")), "p_partkey"))
simple("slice_page", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 40 OFFSET 100", lambda t: t("events").select("event_id", "value").orderBy("event_id").offset(100).limit(40))
simple("sorted_with_defaults", "SELECT doc_id, coalesce(lang, '') AS lang, row_number() OVER (ORDER BY coalesce(lang, ''), coalesce(source, ''), doc_id)::BIGINT AS place FROM documents QUALIFY place <= 100", lambda t: t("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).orderBy("lang", "source", "doc_id").limit(100).withColumn("place", F.row_number().over(Window.orderBy("lang", "source", "doc_id")).cast("long")).drop("source"))
simple("files_union", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation", lambda t: t("region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")).unionByName(t("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))))
simple("parent_children", "SELECT o_orderkey, count(l_linenumber) AS n_steps, list(l_linenumber ORDER BY l_linenumber) FILTER (l_linenumber IS NOT NULL) AS steps FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_linenumber) > 0", lambda t: t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_steps"), F.sort_array(F.collect_list("l_linenumber")).alias("steps")))
simple("known_users_only", "SELECT event_id, user_id FROM events WHERE user_id = 8 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = 8) AND event_type IN ('click', 'error')", lambda t: t("events").where("user_id = 8 AND event_type IN ('click', 'error')").join(t("customer").where("c_custkey = 8").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").select("event_id", "user_id"))
simple("flagged_with_any_tag", "SELECT p_partkey FROM part WHERE p_size >= 10 AND (p_name LIKE '%red%' OR p_name LIKE '%ring%')", lambda t: t("part").where((F.col("p_size") >= 10) & F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))).select("p_partkey"))
simple("pick_descriptor", "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id = 46 ORDER BY event_id LIMIT 1", lambda t: t("events").where("event_type = 'click' AND user_id = 46").select("event_id", "value").orderBy("event_id").limit(1))
simple("dashboard_filters", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 900 AND 1200 AND p_brand IN ('Brand#2', 'Brand#17') AND p_size BETWEEN 5 AND 40", lambda t: t("part").where(F.col("p_retailprice").between(900, 1200) & F.col("p_brand").isin("Brand#2", "Brand#17") & F.col("p_size").between(5, 40)).select("p_partkey"))
simple("subsystem_filter", "SELECT p_partkey FROM part WHERE list_has_all(['red', 'ring', 'small', 'widget'], string_split(p_name, ' '))", lambda t: t("part").where(F.size(F.array_except(F.split("p_name", " "), F.array(*[F.lit(x) for x in ("red", "ring", "small", "widget")]))) == 0).select("p_partkey"))
simple("count_so_far", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM events", lambda t: t("events").select("event_id", F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("n")))
simple("linear_ramp", "SELECT l_orderkey, l_linenumber, 300.0 + (900.0 - 300.0) * (l_linenumber - 1) / 6 AS temperature FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", (F.lit(300.0) + (900.0 - 300.0) * (F.col("l_linenumber") - 1) / 6).alias("temperature")))

# dates, maps and text
simple("same_day_years_ago", "SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 3 YEAR)::DATE AS day FROM orders", lambda t: t("orders").select("o_orderkey", prices.years_before(F.col("o_orderdate").cast("date"), 3).alias("day")))
simple("parse_day", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS day FROM orders", lambda t: t("orders").select("o_orderkey", F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd").alias("day")))
simple("epoch_time", "SELECT event_id, to_timestamp(1700000000 + event_id)::TIMESTAMP::VARCHAR AS at FROM events", lambda t: t("events").select("event_id", F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("event_id")), "yyyy-MM-dd HH:mm:ss").alias("at")))
simple("report_date", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders", lambda t: t("orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("shown")))
simple("merged_maps", "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, 1.5::DOUBLE AS view FROM events GROUP BY user_id", lambda t: t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("c")).withColumn("m", tables.merged_maps(F.create_map(F.lit("click"), F.col("c"), F.lit("view"), F.lit(9.0)), F.create_map(F.lit("view"), F.lit(1.5)))).select("user_id", F.col("m")["click"].alias("click"), F.col("m")["view"].alias("view")))
simple("chunked_lists", "SELECT l_orderkey, ceil(count(*) / 3.0)::BIGINT AS chunks, least(3, count(*)) AS first_size FROM lineitem GROUP BY 1", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("string"))).alias("v")).withColumn("c", tables.chunked(F.col("v"), 3)).select("l_orderkey", F.size("c").cast("long").alias("chunks"), F.size(F.get("c", F.lit(0))).cast("long").alias("first_size")))
simple("json_key_or_zero", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k FROM events", lambda t: t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long")).alias("k")))
simple("name_suggestion", "SELECT c_custkey, c_name || '-2' AS suggested FROM customer", lambda t: t("customer").select("c_custkey", F.concat("c_name", F.lit("-2")).alias("suggested")).join(t("customer").select(F.col("c_name").alias("suggested")), "suggested", "left_anti").select("c_custkey", "suggested"))
simple("pattern_cleanup", "SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '#', '-', 'g'), '[0-9]+$', 'n') AS cleaned FROM part", lambda t: t("part").select("p_partkey", F.regexp_replace(F.regexp_replace("p_brand", "#", "-"), "[0-9]+$", "n").alias("cleaned")))
simple("molar_volume", "SELECT p_partkey, round(p_retailprice / p_size * 0.602214076, 6) AS v FROM part WHERE p_size > 0", lambda t: t("part").where("p_size > 0").select("p_partkey", F.round(scalars.molar_volume(F.col("p_retailprice"), F.col("p_size")), 6).alias("v")))
simple("cluster_members", "SELECT p_brand AS cluster, list(p_partkey ORDER BY p_partkey) AS members FROM part GROUP BY 1", lambda t: tables.unflattened(t("part").select(F.col("p_brand").alias("cluster"), "p_partkey"), "cluster", "p_partkey"))
simple("cluster_rows", "SELECT p_brand AS cluster, p_partkey AS key FROM part", lambda t: tables.flattened(tables.unflattened(t("part").select(F.col("p_brand").alias("cluster"), "p_partkey"), "cluster", "p_partkey"), "members", "cluster"))

# prices
_CPI = [(y, 100.0 + 3 * (y - 1990)) for y in range(1990, 2030)]
_CPI_SQL = "(SELECT y AS year, 100.0 + 3 * (y - 1990) AS index FROM range(1990, 2030) r(y))"
simple("year_deltas", f"""WITH p AS (SELECT l_partkey, l_shipdate::DATE AS day, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_partkey, max(day) AS day, arg_max(price, day) AS now FROM p GROUP BY 1), a AS (SELECT *, (day - to_years(CAST(years AS INT)))::DATE AS since FROM l, (VALUES (1), (3)) v(years)),
f AS (SELECT a.l_partkey, years, now, a.day, min(p.day) AS then_day, arg_min(price, p.day) AS "then" FROM a JOIN p ON p.l_partkey = a.l_partkey AND p.day >= since GROUP BY 1, 2, 3, 4)
SELECT l_partkey, years, round(now - "then", 4) + 0.0 AS delta, round(100 * (now - "then") / "then", 4) + 0.0 AS percent, round(100 * (now - "then" * b.index / c.index) / ("then" * b.index / c.index), 4) + 0.0 AS percent_real FROM f JOIN {_CPI_SQL} b ON b.year = year(day) JOIN {_CPI_SQL} c ON c.year = year(then_day)""", lambda t: prices.year_deltas(t("lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(F.min("l_extendedprice").alias("price")), "l_partkey", "day", "price", [1, 3], t.spark.createDataFrame(_CPI, "year int, index double")).select("l_partkey", "years", *[(F.round(c, 4) + 0.0).alias(c) for c in ("delta", "percent", "percent_real")]))

# similarity as series, matrix and mean
_SIM = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda v: CASE WHEN v[1] > 0 AND v[2] > 0 THEN 1.0 ELSE 0.0 END)) / list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda v: CASE WHEN v[1] > 0 OR v[2] > 0 THEN 1.0 ELSE 0.0 END))"


def _matrix(t) -> DataFrame:
    """Similarities of a stated set of vectors with each other."""
    side = lambda n: t("embeddings").where(_FIVE).select(F.col("vec_id").alias(n), vectors.to_words(F.col("embedding")).alias(f"w{n}"))
    return side("a").crossJoin(F.broadcast(side("b"))).select("a", "b", vectors.tanimoto(F.col("wa"), F.col("wb")).alias("similarity"))


simple("similarity_matrix", f"SELECT x.vec_id AS a, y.vec_id AS b, round({_SIM}, 6) AS similarity FROM embeddings x, embeddings y WHERE x.{_FIVE} AND y.{_FIVE}", lambda t: _matrix(t).select("a", "b", F.round("similarity", 6).alias("similarity")))
simple("similarity_mean", f"SELECT round(avg({_SIM}), 6) AS mean FROM embeddings x, embeddings y WHERE x.{_FIVE} AND y.{_FIVE} AND x.vec_id <> y.vec_id", lambda t: _matrix(t).where("a <> b").agg(F.round(F.avg("similarity"), 6).alias("mean")))
simple("distance_matrix", f"SELECT x.vec_id AS a, y.vec_id AS b, round(1 - {_SIM}, 6) + 0.0 AS distance FROM embeddings x, embeddings y WHERE x.{_FIVE} AND y.{_FIVE}", lambda t: _matrix(t).select("a", "b", (F.round(1 - F.col("similarity"), 6) + 0.0).alias("distance")))
simple("identity_similarity", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' AND p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM part", lambda t: t("part").select("p_partkey", F.when((F.col("p_brand") == "Brand#2") & (F.col("p_type") == "ECONOMY"), 1.0).otherwise(0.0).alias("similarity")))
_DICE = "2 * list_sum(list_transform(list_zip(embedding, q), lambda v: CASE WHEN v[1] > 0 AND v[2] > 0 THEN 1.0 ELSE 0.0 END)) / (list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)) + list_sum(list_transform(q, lambda v: CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)))"


def _asked(t) -> DataFrame:
    q = t("embeddings").where("vec_id = 0").select(vectors.to_words(F.col("embedding")).alias("wq"), F.col("embedding").alias("q"))
    return t("embeddings").withColumn("w", vectors.to_words(F.col("embedding"))).crossJoin(F.broadcast(q))


simple("dice", f"SELECT vec_id, round({_DICE}, 6) AS similarity FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)", lambda t: _asked(t).select("vec_id", F.round(vectors.dice(F.col("w"), F.col("wq")), 6).alias("similarity")))
simple("holds_bits", "SELECT vec_id FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE len(list_filter(list_zip(embedding[1:4], q[1:4]), lambda v: v[2] > 0 AND v[1] <= 0)) = 0", lambda t: _asked(t).where(vectors.holds_bits(vectors.to_words(F.slice("embedding", 1, 4)), vectors.to_words(F.slice("q", 1, 4)))).select("vec_id"))
simple("similar_over_cutoff", f"SELECT y.vec_id, round({_SIM}, 6) AS similarity FROM embeddings x, embeddings y WHERE x.vec_id = 0 AND {_SIM} >= 0.5", lambda t: vectors.similar(_asked(t), vectors.tanimoto(F.col("w"), F.col("wq")), 0.5).select("vec_id", F.round("similarity", 6).alias("similarity")))


@add("nearest_then_filter", "SELECT vec_id, label, distance FROM (SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 4) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 50) WHERE label IN (1, 2, 3)")
def _compound(t) -> DataFrame:
    """The nearest rows first, then lookups on them, with their distance joined back."""
    near = vectors.top_k(_asked(t), "vec_id", vectors.METRICS["l2"](F.col("embedding"), F.col("q")), 50)
    found = t("embeddings").select("vec_id", "label").where(F.col("label").isin(1, 2, 3)).join(F.broadcast(near), "vec_id")  # 50 rows
    return found.orderBy("distance").select("vec_id", "label", F.round("distance", 4).alias("distance"))
