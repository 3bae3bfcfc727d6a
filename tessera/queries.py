"""Queries over the driver tables: one for each operator, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import grouping, nearby, relations, reports, series, vectors
from .plans import query as plans
from .plans.query import Query
from .plans.schema import Bridge, Catalog, ForeignKey, TableSpec
from .sources import files

SPECS = [
    TableSpec("region", "r_regionkey"),
    TableSpec("nation", "n_nationkey", {"region": ForeignKey("n_regionkey", "region", "r_regionkey")}),
    TableSpec("customer", "c_custkey", {"nation": ForeignKey("c_nationkey", "nation", "n_nationkey")}),
    TableSpec("supplier", "s_suppkey", {"nation": ForeignKey("s_nationkey", "nation", "n_nationkey")}),
    TableSpec("part", "p_partkey"),
    TableSpec("orders", "o_orderkey", {"customer": ForeignKey("o_custkey", "customer", "c_custkey")}, {"parts": Bridge("lineitem", "l_orderkey", "l_partkey"), "suppliers": Bridge("lineitem", "l_orderkey", "l_suppkey")}),
    TableSpec("lineitem", "l_orderkey", {"order": ForeignKey("l_orderkey", "orders", "o_orderkey"), "part": ForeignKey("l_partkey", "part", "p_partkey"), "supplier": ForeignKey("l_suppkey", "supplier", "s_suppkey")}),
    TableSpec("events", "event_id"),
    TableSpec("documents", "doc_id"),
    TableSpec("embeddings", "vec_id"),
    TableSpec("pages", "page_id"),
    TableSpec("benchmark", "item_id"),
    TableSpec("conversations", "conv_id"),
]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(SPECS, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Registers f(t), where t(table) reads a table and t.query(table) starts a query."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            c = catalog(spark, sf_dir)

            def t(table: str) -> DataFrame:
                return c.read(table)

            t.query = lambda table: Query(c, table)
            t.spark = spark
            return f(t)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return put


def simple(name: str, sql: str, f) -> None:
    add(name, sql)(f)


# lookups and the query layer

CONFIG = {"filters": {"o_totalprice__gte": 1000, "o_orderstatus__in": ["F", "O"], "customer__c_mktsegment": "BUILDING"}, "order_by": ["-o_totalprice", "o_orderkey"], "limit": 100, "page": 1}
simple("lookup_config", "SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O') AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", lambda t: t.query("orders").from_config(CONFIG).df)
simple("lookup_url", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1500 AND o_orderpriority LIKE '1%' ORDER BY o_orderkey LIMIT 10 OFFSET 10", lambda t: t.query("orders").from_url("/orders?o_totalprice__gt=1500&o_orderpriority__startswith=\"1\"&order_by=\"o_orderkey\"&page=2&page_size=10&format=json").df.select("o_orderkey", "o_totalprice"))
simple("lookup_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount < 0.05 AND l_tax <= 0.04", lambda t: t.query("lineitem").filter(l_quantity__range=(10, 20), l_discount__lt=0.05, l_tax__lte=0.04).df.select("l_orderkey", "l_linenumber", "l_quantity"))
simple("lookup_text", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND regexp_matches(p_brand, '[0-9]+$') AND NOT lower(p_type) LIKE 's%'", lambda t: t.query("part").filter(p_name__icontains="A", p_brand__regex="[0-9]+$").exclude(p_type__istartswith="S").df.select("p_partkey"))
simple("lookup_dates", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND quarter(o_orderdate) IN (1, 2) AND week(o_orderdate) > 5 AND dayofweek(o_orderdate) + 1 <> 1 AND month(o_orderdate) <= 5 AND day(o_orderdate) >= 3", lambda t: t.query("orders").filter(o_orderdate__year=1995, o_orderdate__quarter__in=[1, 2], o_orderdate__week__gt=5, o_orderdate__month__lte=5, o_orderdate__day__gte=3).exclude(o_orderdate__week_day=1).df.select("o_orderkey"))
simple("lookup_times", "SELECT event_id FROM events WHERE hour(ts) BETWEEN 6 AND 9 AND minute(ts) < 30 AND second(ts) >= 10 AND CAST(ts AS DATE) >= DATE '2024-01-05'", lambda t: t.query("events").filter(ts__hour__range=(6, 9), ts__minute__lt=30, ts__second__gte=10, ts__date__gte="2024-01-05").df.select("event_id"))
simple("lookup_null", "SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment = 'MACHINERY'", lambda t: t.query("customer").filter(c_acctbal__isnull=False, c_mktsegment__iexact="machinery").df.select("c_custkey"))
simple("lookup_hops", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND l_quantity > 45", lambda t: t.query("lineitem").filter(supplier__nation__region__r_name="ASIA", l_quantity__gt=45).df.select("l_orderkey", "l_linenumber"))
simple("lookup_values", "SELECT c_custkey, n_name AS nation__n_name, r_name AS nation__region__r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", lambda t: t.query("customer").values("c_custkey", "nation__n_name", "nation__region__r_name"))
simple("lookup_order_by_relation", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC NULLS LAST, c_custkey LIMIT 50", lambda t: t.query("customer").order_by("-nation__n_name", "c_custkey").limit(50).df.select("c_custkey"))
simple("lookup_linked_to_all", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2)", lambda t: t.query("orders").filter(suppliers__ids=[1, 2]).df.select("o_orderkey"))
simple("lookup_last_page", "SELECT c_custkey FROM (SELECT *, row_number() OVER (ORDER BY c_custkey DESC) AS r, count(*) OVER () AS n FROM customer) WHERE r > ((n - 1) // 40) * 40", lambda t: t.query("customer").page(10**6, 40).df.select("c_custkey"))
simple("lookup_frame", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'the .* and') AND lang = 'en'", lambda t: plans.frame_filter(t("documents"), text__contains="the .* and", lang="en").select("doc_id"))
simple("saved_filter", "SELECT s_suppkey, 'rich' AS scope_label FROM supplier WHERE s_acctbal >= 5000", lambda t: plans.scoped(t("supplier"), "rich", '{"s_acctbal__gte": 5000}').select("s_suppkey", "scope_label"))
simple("filter_tags", "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS tags FROM events GROUP BY 1) WHERE list_contains(tags, 'signup') AND list_contains(tags, 'error')", lambda t: Query(Catalog([TableSpec("users", "user_id")], None), "users", t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))).tagged(["signup", "error"]).df.select("user_id"))
simple("filter_age", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 168 HOUR", lambda t: t.query("events").younger("week", "ts", "2024-01-29 12:00:00").df.select("event_id"))
simple("named_filter", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 1000 AND c_mktsegment = 'BUILDING'", lambda t: t.query("customer").register("balance", lambda q, low, high: q.filter(c_acctbal__range=(low, high))).from_config({"filters": {"balance": {"low": 0, "high": 1000}, "low": 5, "c_mktsegment": "BUILDING"}, "paginate": False}).df.select("c_custkey"))
simple("distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1", lambda t: t.query("orders").distinct_on("o_custkey", order=["-o_totalprice", "o_orderkey"]).df.select("o_custkey", "o_orderkey"))
simple("conditional_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 2000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus FROM orders", lambda t: t.query("orders").update(F.col("o_totalprice") > 2000, o_orderstatus="BIG").df.select("o_orderkey", "o_orderstatus"))

# joins, differences, merges

simple("join_three_left", "SELECT l_orderkey, l_linenumber, p_name, s_name, o_orderstatus FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey > 100", lambda t: t.query("lineitem").filter(l_orderkey__gt=100).values("l_orderkey", "l_linenumber", "part__p_name", "supplier__s_name", "order__o_orderstatus").withColumnsRenamed({"part__p_name": "p_name", "supplier__s_name": "s_name", "order__o_orderstatus": "o_orderstatus"}))
simple("incremental_load", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)", lambda t: relations.missing(t("orders"), t("lineitem").where("l_quantity > 49").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]).select("o_orderkey"))
simple("semi_join_two", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", lambda t: relations.known(t("lineitem"), (t("part").where("p_size < 10").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey"), (t("supplier").where("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")).select("l_orderkey", "l_linenumber"))
simple("hash_key_anti_join", "SELECT md5(concat_ws(' ', user_id, event_type)) AS k, count(*) AS n FROM events WHERE md5(concat_ws(' ', user_id, event_type)) NOT IN (SELECT md5(concat_ws(' ', user_id, event_type)) FROM events WHERE ts < TIMESTAMP '2024-01-03') GROUP BY 1", lambda t: relations.missing(t("events").withColumn("k", scalars.table_counts_key(F.col("user_id"), F.col("event_type"))), t("events").where("ts < TIMESTAMP '2024-01-03'").withColumn("k", scalars.table_counts_key(F.col("user_id"), F.col("event_type"))), ["k"]).groupBy("k").agg(F.count("*").alias("n")))
simple("dedup_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1", lambda t: relations.keep_first(t("documents"), ["text"], ["doc_id"]).select("doc_id"))
simple("dedup_extras", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1", lambda t: relations.keep_first(t("documents"), ["text"], ["doc_id"], inverse=True).select("doc_id"))
simple("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, 1.5 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0", lambda t: relations.upsert(t("customer").select("c_custkey", "c_acctbal"), t("customer").where("c_custkey % 3 = 0").select(F.explode(F.array_distinct(F.array("c_custkey", -F.col("c_custkey")))).alias("c_custkey"), F.lit(1.5).alias("c_acctbal")), ["c_custkey"], ["c_acctbal"]))
simple("delist", "SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS is_active FROM supplier", lambda t: relations.delist(t("supplier"), t("lineitem").where("l_quantity > 49").withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey").select("s_suppkey", "is_active"))
simple("federated_search", "SELECT * FROM ((SELECT 'customer' AS source_table, c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY balance NULLS LAST, id LIMIT 50) UNION ALL (SELECT 'supplier', s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal NULLS LAST, s_suppkey LIMIT 50))", lambda t: relations.top_of_each({"customer": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))}, "source_table", plans.order_columns(["balance", "id"]), 50))
simple("recent_of_each", "SELECT * FROM ((SELECT 'F' AS source_table, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'O', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 15", lambda t: relations.top_of_each({s: t("orders").where(F.col("o_orderstatus") == s).select("o_orderkey", "o_orderdate") for s in "FO"}, "source_table", plans.order_columns(["-o_orderdate", "o_orderkey"]), 10, 15))
simple("quick_search", "SELECT source_table, id, total_count FROM (SELECT *, count(*) OVER (PARTITION BY source_table)::BIGINT AS total_count, row_number() OVER (PARTITION BY source_table ORDER BY id) AS n FROM (SELECT 'customer' AS source_table, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier) WHERE nation = 3) WHERE n <= 5", lambda t: relations.quick_search({"customer": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))}, F.col("nation") == 3, ["id"]).select("source_table", "id", "total_count"))
simple("given_order", "SELECT pos, c_custkey, c_name FROM (VALUES (3, 0), (1, 1), (3, 2), (7, 4)) v(k, pos) JOIN customer ON c_custkey = k", lambda t: relations.in_given_order(t("customer"), [3, 1, 3, -5, 7], "c_custkey").select("pos", "c_custkey", "c_name"))
simple("id_difference", "SELECT p_partkey FROM part EXCEPT (SELECT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48)", lambda t: t("part").select("p_partkey").subtract(t("lineitem").select("l_partkey").subtract(t("lineitem").where("l_quantity > 48").select("l_partkey"))))
simple("salted_join", "SELECT n_name, count(*) AS n FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1", lambda t: relations.salted_join(t("events").withColumn("k", (F.col("user_id") % 25).cast("int")), t("nation").withColumnRenamed("n_nationkey", "k"), "k").groupBy("n_name").agg(F.count("*").alias("n")))
simple("directory_parent", "SELECT page_id, regexp_extract(url, '^(.*)/[^/]+$', 1) AS parent FROM pages", lambda t: t("pages").select("page_id", scalars.parent_dir(F.col("url")).alias("parent")))

# aggregations and reports

simple("count_by_column", "SELECT o_orderstatus, count(o_orderstatus) AS n FROM orders GROUP BY 1", lambda t: reports.count_by(t("orders"), "o_orderstatus"))
simple("top_values", "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10", lambda t: reports.top_values(t("events"), "user_id"))
for unit in ("day", "week", "month"):
    simple(f"active_users_{unit}", f"SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS period, count(DISTINCT user_id) AS users FROM events GROUP BY 1", lambda t, unit=unit: reports.active_users(t("events"), "user_id", "ts", unit))
simple("traffic_histogram", "WITH e AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), b AS (SELECT lo, hi, greatest(1, CAST(floor((hi - lo) / 3.6e9) AS BIGINT) // 2) AS n FROM e) SELECT least(CAST(floor((epoch_us(ts) - lo) * n / (hi - lo)) AS BIGINT), n - 1) AS bin, count(*) AS n FROM events, b GROUP BY 1", lambda t: reports.time_histogram(t("events"), "ts"))
simple("histogram_sum", "SELECT least(CAST(floor(l_quantity / 5) AS BIGINT) + 1, 10) AS bin, round(sum(l_extendedprice), 2) AS y FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1", lambda t: reports.histogram(t("lineitem"), "l_quantity", 0.0, 50.0, 10, "sum", "l_extendedprice").withColumn("y", F.round("y", 2)))
simple("histogram_cumulative", "SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS y FROM (SELECT least(CAST(floor(l_quantity / 5) AS BIGINT) + 1, 10) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1)", lambda t: reports.histogram(t("lineitem"), "l_quantity", 0.0, 50.0, 10, cumulative=True))
STATUS = "CASE event_type WHEN 'signup' THEN 'P' WHEN 'view' THEN 'R' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'F' ELSE 'E' END"
COUNTS = ", ".join(f"count_if(s = '{s}')::BIGINT AS n_{s.lower()}" for s in "PRCFE")
simple("queue_stats", f"SELECT {COUNTS}, count_if(s = 'R' AND ts <= TIMESTAMP '2024-01-29 00:00:00')::BIGINT AS long_running, round(100.0 * count_if(s = 'E') / (count_if(s = 'E') + count_if(s = 'F')), 6) AS error_percent FROM (SELECT *, {STATUS} AS s FROM events)", lambda t: reports.queue_stats(t("events").withColumn("s", F.expr(STATUS)), "s", "ts", "2024-01-30 00:00:00"))
simple("tag_stats", f"SELECT 'u' || (user_id % 4) AS tag, {COUNTS} FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY 1 UNION ALL SELECT 'all', {COUNTS} FROM (SELECT {STATUS} AS s FROM events) UNION ALL SELECT 'total', {COUNTS} FROM (SELECT {STATUS} AS s FROM events)", lambda t: reports.tag_stats(t("events").select(F.array(F.concat(F.lit("u"), F.col("user_id") % 4), F.lit("all")).alias("tags"), F.expr(STATUS).alias("s")), "tags", "s"))
simple("ledger_sum", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(30,6))) AS DOUBLE) AS total, sum(CAST(c_acctbal AS DECIMAL(30,6))) = 0 AS balanced FROM customer GROUP BY 1", lambda t: reports.ledger_sums(t("customer"), "c_mktsegment", "c_acctbal").withColumn("total", F.col("total").cast("double")))
simple("pattern_counts", "SELECT doc_id, pattern, weight, n FROM (SELECT doc_id, p.pattern, p.weight, len(regexp_extract_all(text, p.pattern))::BIGINT AS n FROM documents, (VALUES ('the', 1.0::DOUBLE), ('qu.', 2.0), ('[0-9]+', 0.5)) p(pattern, weight)) WHERE n > 0", lambda t: reports.pattern_counts(t("documents"), "doc_id", "text", {"the": 1.0, "qu.": 2.0, "[0-9]+": 0.5}))
simple("high_water_mark", "SELECT max(event_id) AS last_id, count(*) AS n FROM events", lambda t: t("events").agg(F.max("event_id").alias("last_id"), F.count("*").alias("n")))
simple("best_of_group", "SELECT o_custkey, min(o_totalprice) AS low, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1", lambda t: t("orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best")))
simple("array_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS norm FROM embeddings", lambda t: t("embeddings").select("vec_id", F.round(scalars.norm(F.col("embedding")), 5).alias("norm")))
simple("grouped_lists", "SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1", lambda t: t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")))
simple("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda t: t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")))
simple("median", "SELECT event_type, round(median(value), 6) AS mid FROM events GROUP BY 1", lambda t: t("events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("mid")))
simple("price_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", lambda t: t("lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n")))

# series and windows

simple("best_so_far", "SELECT event_id FROM (SELECT event_id, value, min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value < m", lambda t: series.best_so_far(t("events"), "value", ["ts", "event_id"], ["event_type"], series.micros("ts")).select("event_id"))
simple("since_best", "WITH b AS (SELECT event_type, min((value, ts)) AS m FROM events GROUP BY 1) SELECT e.event_type, count_if(e.value > m[1] + 0.001 AND e.ts >= m[2])::BIGINT AS since FROM events e JOIN b USING (event_type) GROUP BY 1", lambda t: series.since_best(t("events"), "value", "ts", ["event_type"]))
simple("as_of_forward", "WITH f AS (SELECT user_id, min((ts, value)) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) SELECT user_id, round(m[2], 6) AS base_price FROM f WHERE m[1] < TIMESTAMP '2024-01-10' + INTERVAL 5 DAY", lambda t: series.as_of_forward(t("events"), "user_id", "ts", "value", F.lit("2024-01-10").cast("timestamp"), 5).select("user_id", F.round("base_price", 6).alias("base_price")))
simple("as_of_join", "SELECT c.event_id, p.value AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) p ON c.user_id = p.user_id AND c.ts >= p.ts", lambda t: series.as_of(t("events").where("event_type = 'click'"), t("events").where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), ["user_id"], "ts", "value").select("event_id", "as_of_value"))
add("interpolate", """WITH q AS (SELECT user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, value::DOUBLE AS v FROM events WHERE event_type = 'view'),
a AS (SELECT q.*, v.ts AS ta, v.v AS va FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts >= v.ts),
b AS (SELECT a.*, v.ts AS tb, v.v AS vb FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.ts <= v.ts)
SELECT user_id, round(coalesce(CASE WHEN ta = tb THEN va ELSE va + (epoch_us(ts) - epoch_us(ta)) / (epoch_us(tb) - epoch_us(ta)) * (vb - va) END, va, vb), 6) AS value FROM b""")(lambda t: series.interpolate(t("events").where("event_type = 'click'"), t("events").where("event_type = 'view'"), ["user_id"], "ts", "value").select("user_id", F.round("value", 6).alias("value")))
simple("deltas", "SELECT event_id, round(value - lag(value) OVER w, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", lambda t: series.deltas(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 6).alias("delta")))
simple("window_stats", "SELECT event_type, arg_min(value, (ts, event_id)) AS start, min(value) AS low, max(value) AS high, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1", lambda t: series.window_stats(t("events").withColumn("at", F.struct("ts", "event_id")), "event_type", "at", "value").drop("change"))
simple("buying_power", "SELECT event_id, round((SELECT arg_max(value, (ts, event_id)) FROM events) / value, 6) AS buying_power FROM events WHERE value > 0", lambda t: series.buying_power(t("events").where("value > 0").withColumn("at", F.struct("ts", "event_id")), "at", "value").select("event_id", F.round("buying_power", 6).alias("buying_power")))
simple("first_status", "SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'purchase' GROUP BY 1", lambda t: series.first_status(t("events"), "user_id", "event_type", "ts", "purchase"))
simple("days_to_complete", "SELECT user_id, trunc((epoch_us(e) - epoch_us(s)) / 86400000000)::BIGINT AS days FROM (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS s, min(ts) FILTER (event_type = 'purchase') AS e FROM events GROUP BY 1) WHERE s IS NOT NULL AND e IS NOT NULL", lambda t: series.days_between(t("events"), "user_id", "event_type", "ts", "signup", "purchase"))
simple("staged_pivot", "SELECT l_orderkey, arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity)) FILTER (l_returnflag = 'A') AS A, arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity)) FILTER (l_returnflag = 'N') AS N, arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity)) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1", lambda t: series.staged_pivot(t("lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_quantity")), "l_orderkey", "l_returnflag", ["A", "N", "R"], "l_quantity", "at"))
simple("ranking", "SELECT o_orderkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)", lambda t: t("orders").select("o_orderkey", F.rank().over(w := Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("r"), F.dense_rank().over(w).alias("d")))

# functions

simple("chunk_key", "SELECT o_orderkey, CAST(('0x' || md5(CAST(o_orderkey AS VARCHAR)))::UHUGEINT % 20000 AS INT) AS chunk_key FROM orders", lambda t: t("orders").select("o_orderkey", scalars.chunk_key(F.col("o_orderkey"), 20_000).alias("chunk_key")))
simple("chemical_system", "SELECT p_partkey, array_to_string(list_sort(string_split(replace(p_type, ' ', '-'), '-')), '-') AS system FROM part", lambda t: t("part").select("p_partkey", scalars.chemical_system(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("system")))
add("subsystems", """SELECT p_partkey, list_transform(list_sort(list_transform(range(1, (2 ** len(w))::BIGINT), lambda m: struct_pack(n := bit_count(m), s := array_to_string(list_filter(w, lambda x, i: (m >> (i - 1)) & 1 = 1), '-')))), lambda x: x.s) AS subsystems
FROM (SELECT p_partkey, list_sort(list_distinct(string_split(replace(p_type, ' ', '-'), '-'))) AS w FROM part)""")(lambda t: t("part").select("p_partkey", scalars.subsystems(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("subsystems")))
simple("accents", f"SELECT doc_id, md5(translate(text, '{scalars.ACCENTS}', '{scalars.PLAIN}')) AS plain FROM documents", lambda t: t("documents").select("doc_id", F.md5(scalars.without_accents(F.col("text"))).alias("plain")))
simple("page_title", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages", lambda t: files.page_text(t("pages"), "html").select("page_id", "title"))
simple("json_property", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
simple("price_per_unit", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice <> 0 AND l_quantity <> 0 THEN l_extendedprice / l_quantity END, 6) AS unit_price FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.per_unit(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("unit_price")))

# similarity and groups

QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _with_query(t) -> DataFrame:
    return t("embeddings").crossJoin(F.broadcast(t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))))  # one row


for metric, sql in {"l2": "list_distance(embedding::DOUBLE[], q::DOUBLE[])", "cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])", "inner": "list_inner_product(embedding::DOUBLE[], q::DOUBLE[])", "l1": "list_sum(list_transform(list_zip(embedding, q), lambda x: abs(x[1]::DOUBLE - x[2])))", "hamming": "list_sum(list_transform(list_zip(embedding, q), lambda x: CASE WHEN x[1] <> x[2] THEN 1.0 ELSE 0.0 END))"}.items():
    simple(f"distance_{metric}", f"SELECT vec_id, round(CAST({sql} AS DOUBLE), 4) + 0.0 AS d FROM embeddings, (SELECT {QUERY_VECTOR} AS q)", lambda t, metric=metric: _with_query(t).select("vec_id", (F.round(vectors.METRICS[metric](F.col("embedding"), F.col("q")), 4) + 0.0).alias("d")))
TANIMOTO = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CASE WHEN x[1] > 0 AND x[2] > 0 THEN 1.0 ELSE 0.0 END)) / list_sum(list_transform(list_zip({a}, {b}), lambda x: CASE WHEN x[1] > 0 OR x[2] > 0 THEN 1.0 ELSE 0.0 END))"
simple("tanimoto", f"SELECT vec_id, round({TANIMOTO.format(a='embedding', b='q')}, 6) AS similarity FROM embeddings, (SELECT {QUERY_VECTOR} AS q)", lambda t: _with_query(t).select("vec_id", F.round(vectors.tanimoto(vectors.to_words(F.col("embedding")), vectors.to_words(F.col("q"))), 6).alias("similarity")))
simple("top_k", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 4) AS distance FROM embeddings, (SELECT {QUERY_VECTOR} AS q) ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 20", lambda t: vectors.top_k(_with_query(t), "vec_id", vectors.METRICS["l2"](F.col("embedding"), F.col("q")), 20).withColumn("distance", F.round("distance", 4)))
simple("similarity_pairs", f"SELECT x.vec_id AS a, y.vec_id AS b, round({TANIMOTO.format(a='x.embedding', b='y.embedding')}, 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {TANIMOTO.format(a='x.embedding', b='y.embedding')} >= 0.6", lambda t: vectors.tanimoto_pairs(t("embeddings").select("vec_id", vectors.to_words(F.col("embedding")).alias("words")), "vec_id", "words", 0.6).withColumn("similarity", F.round("similarity", 6)))
simple("distance_jaccard", f"SELECT vec_id, round(1 - {TANIMOTO.format(a='embedding', b='q')}, 6) + 0.0 AS d FROM embeddings, (SELECT {QUERY_VECTOR} AS q)", lambda t: _with_query(t).select("vec_id", (F.round(vectors.METRICS["jaccard"](F.col("embedding"), F.col("q")), 6) + 0.0).alias("d")))
simple("nearest_queries", "SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), b.vec_id) AS INT) AS rank FROM embeddings b JOIN embeddings q ON b.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5", lambda t: vectors.nearest_queries(t("embeddings"), t("embeddings").where("vec_id % 50 = 0"), "vec_id", "embedding", "l2", 5).select("query_id", "vec_id", "rank"))
simple("equal_groups", "SELECT p_partkey, dense_rank() OVER (ORDER BY f)::BIGINT AS cluster FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part)", lambda t: vectors.clusters_of_equal(t("part"), "p_partkey", "p_brand"))
add("greedy_unique", """WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT label, vec_id, n, [v] AS kept, TRUE AS is_kept FROM e WHERE n = 1 UNION ALL
  SELECT label, vec_id, n, CASE WHEN far THEN list_append(kept, v) ELSE kept END, far FROM (SELECT e.label, e.vec_id, e.n, e.v, r.kept, len(list_filter(r.kept, lambda k: list_distance(k, e.v) < 1.0)) = 0 AS far FROM r JOIN e ON e.label = r.label AND e.n = r.n + 1))
SELECT label, vec_id FROM r WHERE is_kept""")(lambda t: nearby.greedy_unique(t("embeddings"), "vec_id", "label", "embedding", 1.0))


@add("butina", f"""WITH RECURSIVE p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE {TANIMOTO.format(a='x.embedding', b='y.embedding')} >= 0.6),
n AS (SELECT e.vec_id, coalesce(list(b) FILTER (b IS NOT NULL), []) AS near, count(b) AS d FROM embeddings e LEFT JOIN p ON p.a = e.vec_id GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY d DESC, vec_id DESC) AS k FROM n),
r AS (SELECT k, vec_id, [vec_id] AS kept, TRUE AS leads FROM o WHERE k = 1 UNION ALL SELECT o.k, o.vec_id, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, o.vec_id) END, NOT list_has_any(kept, near) FROM r JOIN o ON o.k = r.k + 1),
l AS (SELECT vec_id, k FROM r WHERE leads) SELECT o.vec_id, arg_min(l.vec_id, l.k) AS cluster FROM o JOIN l ON l.vec_id = o.vec_id OR list_contains(o.near, l.vec_id) GROUP BY 1""")
def _butina(t) -> DataFrame:
    words = t("embeddings").select("vec_id", vectors.to_words(F.col("embedding")).alias("words"))
    if not t.spark.sparkContext.getCheckpointDir():
        import tempfile

        if not t.spark.sparkContext.master.startswith("local[") and t.spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        t.spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return grouping.butina(vectors.tanimoto_pairs(words, "vec_id", "words", 0.6), words, "vec_id")


_HULL = """WITH e AS (SELECT l_partkey % 50 AS system, l_orderkey * 10 + l_linenumber AS entry, round(l_discount::DOUBLE * 10, 1) AS x, -l_quantity::DOUBLE AS y FROM lineitem),
b AS (SELECT system, x, min(y) AS y FROM e GROUP BY 1, 2), ends AS (SELECT p.system, p.y AS y0, q.y AS y1 FROM b p JOIN b q ON p.system = q.system AND p.x = 0 AND q.x = 1),
h AS (SELECT o.system, o.x, least(min(o.y), min(CASE WHEN q.x > p.x THEN p.y + (q.y - p.y) * (o.x - p.x) / (q.x - p.x) END)) AS hull FROM b o JOIN b p ON p.system = o.system AND p.x <= o.x JOIN b q ON q.system = o.system AND q.x >= o.x GROUP BY 1, 2)
SELECT system, entry, round(y - hull, 6) + 0.0 AS e_above_hull, y - hull < 1e-9 AS is_stable, round(y - y0 * (1 - x) - y1 * x, 6) + 0.0 AS formation FROM e JOIN h USING (system, x) JOIN ends USING (system)"""
add("binary_hull", _HULL)(lambda t: grouping.binary_hull(t("lineitem").select((F.col("l_partkey") % 50).alias("system"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry"), F.round(F.col("l_discount") * 10, 1).alias("share"), (-F.col("l_quantity")).alias("energy")), "system", "entry", "share", "energy").withColumns({"e_above_hull": F.round("e_above_hull", 6) + 0.0, "formation": F.round("formation", 6) + 0.0}))


@add("partitioned_search", "SELECT query_id, vec_id, round(d, 4) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, b.vec_id, list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings b JOIN embeddings q ON b.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 10")
def _cells(t) -> DataFrame:
    model = vectors.fit_partitions(t("embeddings"), "vec_id", "embedding", 8)
    return vectors.search_cells_exactly(vectors.assign_cells(t("embeddings"), model, "embedding"), t("embeddings").where("vec_id % 50 = 0"), model, "embedding", "vec_id", 10, 3).withColumn("distance", F.round("distance", 4))

# selections and derived columns

from .operators import selection  # noqa: E402

for mode, test in {"include": "len(list_filter(w, lambda x: NOT list_contains(['PROMO', 'SMALL', 'BRASS', 'STEEL', 'ECONOMY'], x))) = 0", "include_all": "list_sort(list_distinct(w)) = ['BRASS', 'ECONOMY', 'PROMO', 'SMALL', 'STEEL']", "exclude": "NOT list_has_any(w, ['PROMO', 'SMALL', 'BRASS', 'STEEL', 'ECONOMY'])"}.items():
    simple(f"allowed_{mode}", f"SELECT p_partkey FROM (SELECT *, string_split(p_type, ' ') AS w FROM part) WHERE {test}", lambda t, mode=mode: t("part").where(selection.allowed(F.split("p_type", " "), ["PROMO", "SMALL", "BRASS", "STEEL", "ECONOMY"], mode)).select("p_partkey"))
simple("allowed_exactly", "SELECT p_partkey FROM (SELECT *, list_sort(list_distinct(string_split(p_type, ' '))) AS w FROM part) WHERE w = (SELECT list_sort(list_distinct(string_split(min(p_type), ' '))) FROM part)", lambda t: t("part").where(selection.allowed(F.split("p_type", " "), t("part").agg(F.min("p_type")).first()[0].split(" "), "include_all")).select("p_partkey"))
simple("patterns_all", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'the') AND regexp_matches(text, '[0-9]')", lambda t: t("documents").where(selection.matches(F.col("text"), ["the", "[0-9]"], "all")).select("doc_id"))
simple("filter_count_inverse", "SELECT count_if(NOT (o_totalprice > 1500))::BIGINT AS n FROM orders", lambda t: selection.apply_filter(t("orders"), F.col("o_totalprice") > 1500, "count", inverse=True))
simple("invalid_dropped", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL", lambda t: t("events").where(F.get_json_object("props", "$.k").try_cast("long").isNotNull()).select("event_id"))
simple("datastore_id", "SELECT o_orderkey, c::BIGINT * 1000000000 + row_number() OVER (PARTITION BY c ORDER BY o_orderkey) - 1 AS datastore_id FROM (SELECT o_orderkey, ('0x' || md5(CAST(o_orderkey AS VARCHAR)))::UHUGEINT % 16 AS c FROM orders)", lambda t: t("orders").withColumn("c", scalars.chunk_key(F.col("o_orderkey"), 16)).select("o_orderkey", (F.col("c").cast("long") * scalars.CHUNK_SIZE + F.row_number().over(Window.partitionBy("c").orderBy("o_orderkey")) - 1).alias("datastore_id")))
simple("scaled_to_max", "SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 8) AS share FROM part", lambda t: t("part").crossJoin(F.broadcast(t("part").agg(F.max("p_retailprice").alias("m")))).select("p_partkey", F.round(F.col("p_retailprice") / F.col("m"), 8).alias("share")))
simple("kleene_rules", "SELECT p_partkey, p_size <= 25 AND p_retailprice <= 1500 AS passes FROM part", lambda t: t("part").select("p_partkey", ((F.col("p_size") <= 25) & (F.col("p_retailprice") <= 1500)).alias("passes")))
simple("split_by_sign", "SELECT c_custkey, greatest(c_acctbal, 0) AS up, least(c_acctbal, 0) AS down FROM customer", lambda t: t("customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("up"), F.least("c_acctbal", F.lit(0.0)).alias("down")))
simple("first_last_change", "SELECT user_id, round((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / arg_min(value, (ts, event_id)), 6) AS change FROM events GROUP BY 1 HAVING arg_min(value, (ts, event_id)) <> 0", lambda t: t("events").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("a"), F.max_by("value", F.struct("ts", "event_id")).alias("b")).where("a <> 0").select("user_id", F.round((F.col("b") - F.col("a")) / F.col("a"), 6).alias("change")))
simple("waiting_time", "SELECT user_id, greatest(0, date_diff('second', min(ts), max(ts)) - 3600)::BIGINT AS wait FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1", lambda t: t("events").groupBy("user_id").agg(F.greatest(F.lit(0).cast("long"), F.unix_timestamp(F.max(F.col("ts").cast("timestamp"))) - F.unix_timestamp(F.min(F.col("ts").cast("timestamp"))) - 3600).alias("wait")))
simple("table_counts", " UNION ALL ".join(f"SELECT '{s.name}' AS name, count(*) AS n FROM {s.name}" for s in SPECS), lambda t: relations.tagged_union({s.name: t(s.name).agg(F.count("*").alias("n")) for s in SPECS}, "name"))
simple("tags_by_depth", "SELECT DISTINCT p_type AS tag, length(p_type) - length(replace(p_type, ' ', '')) AS depth FROM part", lambda t: t("part").select(F.col("p_type").alias("tag"), (F.length("p_type") - F.length(F.replace("p_type", F.lit(" "), F.lit("")))).cast("long").alias("depth")).distinct().orderBy("depth", "tag"))
simple("group_index_sets", "SELECT p_size, p_brand, list(p_partkey ORDER BY p_partkey) AS members FROM part GROUP BY 1, 2", lambda t: t("part").groupBy("p_size", "p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("members")))
simple("next_work_item", "SELECT event_id FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 ORDER BY ts, event_id LIMIT 1", lambda t: selection.oldest_pending(t("events").withColumn("s", F.expr(STATUS)), "s", "ts", "event_id", F.col("user_id") % 2 == 0).select("event_id"))
simple("stop_condition", "WITH b AS (SELECT min((value, ts)) AS m FROM events) SELECT count(ts)::BIGINT AS completed, count_if(event_type = 'view')::BIGINT AS n_exact, count_if(value > m[1] + 0.001 AND ts >= m[2])::BIGINT AS since_best, count_if(event_type = 'view') >= 10 AND (count(ts) > 1000000 OR count_if(value > m[1] + 0.001 AND ts >= m[2]) > 100) AS stop FROM events, b", lambda t: selection.stop_condition(t("events"), "value", "ts", 1_000_000, 100, 10, F.col("event_type") == "view"))
simple("distance_from_known", f"SELECT label, arg_min(vec_id, (round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 4), vec_id)) AS nearest FROM embeddings, (SELECT {QUERY_VECTOR} AS q) GROUP BY 1", lambda t: _with_query(t).withColumn("d", F.round(vectors.METRICS["l2"](F.col("embedding"), F.col("q")), 4)).groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("nearest")))
simple("conversation_turns", "SELECT conv_id, list(role ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY 1", lambda t: t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.count("*").alias("n")))
simple("map_prefix_sums", "SELECT user_id, round(sum(value) FILTER (event_type LIKE 'c%' OR event_type LIKE 'p%'), 4) AS total FROM events WHERE event_type LIKE 'c%' OR event_type LIKE 'p%' GROUP BY 1", lambda t: t("events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m")).select("user_id", F.map_filter("m", lambda k, v: k.startswith("c") | k.startswith("p")).alias("m")).where(F.size("m") > 0).select("user_id", F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x), 4).alias("total")))
add("truncated_selection", "SELECT d.id AS draw, o_orderkey FROM (SELECT id, ('0x' || substr(md5('0:' || id), 1, 8))::BIGINT % 5 AS place FROM range(100) r(id)) d JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders) o USING (place)")(lambda t: selection.truncated(t("orders"), ["o_totalprice", "o_orderkey"], 100).select("draw", "o_orderkey"))
add("tournament_selection", """WITH r AS (SELECT s_suppkey, s_acctbal, d::INT AS draw, md5('0:' || d || ':' || s_suppkey) AS h FROM supplier, range(20) r(d)), n AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY h, s_suppkey) AS n FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY s_acctbal, s_suppkey) AS best FROM n WHERE n <= 3 OR ('0x' || substr(h, 1, 8))::BIGINT % 10000 < 2000) SELECT draw, s_suppkey, s_acctbal FROM b WHERE best = 1""")(lambda t: selection.tournament(t("supplier"), "s_acctbal", "s_suppkey", 20))
add("even_sample", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:' || p_partkey), p_partkey) AS n FROM part) WHERE n <= 5")(lambda t: selection.even_sample(t("part"), "p_brand", 5, "p_partkey").select("p_partkey", "p_brand"))


@add("principal_axes")
def _pca(t) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("place"))

from . import queries_edits, queries_estimates, queries_stores, queries_tables, queries_values  # noqa: E402, F401
