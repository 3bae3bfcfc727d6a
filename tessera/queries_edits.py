"""Queries of comparisons, clusters, edits, archives and datastore operations over the driver tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars, values
from .operators import compare, edits, prices, vectors
from .plans.query import Query
from .plans.schema import Catalog, TableSpec
from .queries import STATUS, add, simple
from .sources import files, readers
from .sources.datastore import Datastore
from .sources.scratch import new_path

# comparisons and clusters

_COMMON = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda v: CASE WHEN v[1] > 0 AND v[2] > 0 THEN 1.0 ELSE 0.0 END))"
_EVERY = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda v: CASE WHEN v[1] > 0 OR v[2] > 0 THEN 1.0 ELSE 0.0 END))"


def _bits(t) -> DataFrame:
    return t("embeddings").select("vec_id", "label", vectors.to_words(F.col("embedding")).alias("words"))


simple("compare_series", f"SELECT y.vec_id, round(1 - {_COMMON} / {_EVERY}, 6) + 0.0 AS distance FROM embeddings x, embeddings y WHERE x.vec_id = 0", lambda t: compare.series(_bits(t).crossJoin(F.broadcast(_bits(t).where("vec_id = 0").select(F.col("words").alias("q")))), "words", F.col("q"), distance=True).select("vec_id", (F.round("distance", 6) + 0.0).alias("distance")))
simple("compare_matrix", f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COMMON} / {_EVERY}, 6) AS similarity FROM embeddings x, embeddings y WHERE x.vec_id % 50 = 0", lambda t: compare.matrix(_bits(t).where("vec_id % 50 = 0"), _bits(t), "vec_id", "words").withColumn("similarity", F.round("similarity", 6)))
simple("compare_mean", f"SELECT round(avg({_COMMON} / {_EVERY}), 6) AS mean FROM embeddings x, embeddings y WHERE x.vec_id % 50 = 0 AND y.vec_id % 50 = 0 AND x.vec_id <> y.vec_id", lambda t: compare.mean(compare.matrix(_bits(t).where("vec_id % 50 = 0"), _bits(t).where("vec_id % 50 = 0"), "vec_id", "words")).select(F.round("mean", 6).alias("mean")))
simple("compare_identity", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM part", lambda t: compare.series(t("part"), "p_brand", F.lit("Brand#2"), "identity").select("p_partkey", "similarity"))
simple("cluster_identity", "SELECT p_partkey, dense_rank() OVER (ORDER BY f)::BIGINT AS cluster FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type) AS f FROM part)", lambda t: compare.with_clusters(t("part"), "p_partkey", "p_type", "identity").select("p_partkey", "cluster"))

# edits

simple("bulk_edit", "SELECT p_partkey, CASE WHEN p_partkey IN (1, 4, 9) THEN 'Brand#0' ELSE p_brand END AS p_brand, CASE WHEN p_partkey IN (1, 4, 9) THEN CASE WHEN p_partkey % 2 = 1 THEN p_name || chr(10) ELSE '' END || 'checked' WHEN p_partkey % 2 = 1 THEN p_name END AS comments FROM part", lambda t: edits.bulk_edit(t("part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 2 == 1, F.col("p_name")).alias("comments"), "p_size"), "p_partkey", [1, 4, 9], {"p_brand": "Brand#0", "comments": "checked", "p_size": None})[0].drop("p_size"))
simple("bulk_links", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (1, 2) UNION SELECT * FROM (VALUES (1, 7), (1, 9), (2, 7), (2, 9)) v(a, b)", lambda t: edits.bulk_edit(t("orders"), "o_orderkey", [1, 2], {"suppliers__ids": [7, 9, 7]}, {"suppliers": (t("lineitem").select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey")})[1]["suppliers"])
simple("free_ids", "SELECT count(*) AS n, count(*) AS n_ids, 0::BIGINT AS n_taken FROM customer", lambda t: _free_ids(t))


def _free_ids(t) -> DataFrame:
    """Ids for customers, with those of the first draw of every other one taken before: all are free and differ."""
    taken = t("customer").where("c_custkey % 2 = 0").select(values.public_id(F.col("c_custkey"), 0).alias("id"))
    ids = edits.free_ids(t("customer"), "c_custkey", values.public_id, taken)
    counted = ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))
    return counted.crossJoin(ids.join(taken, "id", "left_semi").agg(F.count("*").alias("n_taken")))  # one row each


_NAMES = "(SELECT p_brand AS n FROM part WHERE p_size > 5 UNION SELECT p_brand || '-2' FROM part WHERE p_size > 25 UNION SELECT p_brand || '-3' FROM part WHERE p_size > 45 AND p_partkey % 2 = 0)"
simple("free_names", f"SELECT p_partkey, (SELECT CASE WHEN p_brand NOT IN (FROM {_NAMES}) THEN p_brand ELSE p_brand || '-' || min(i) END FROM range(2, 9) r(i) WHERE p_brand || '-' || i NOT IN (FROM {_NAMES})) AS suggested FROM part", lambda t: edits.free_names(t("part"), "p_partkey", "p_brand", t("part").where("p_size > 5").select("p_brand").union(t("part").where("p_size > 25").select(F.concat("p_brand", F.lit("-2")))).union(t("part").where("p_size > 45 AND p_partkey % 2 = 0").select(F.concat("p_brand", F.lit("-3"))))))
simple("chemical_system_filter", "SELECT p_partkey FROM part WHERE list_has_all(['ECONOMY', 'PROMO', 'STEEL', 'BRASS'], string_split(p_type, ' '))", lambda t: t("part").where(edits.in_chemical_system(F.replace("p_type", F.lit(" "), F.lit("-")), "STEEL-PROMO-ECONOMY-BRASS")).select("p_partkey"))
simple("steady_state_running", f"SELECT user_id AS source, count(*) FILTER (s IN ('P', 'R')) AS running, coalesce(list(event_id ORDER BY event_id) FILTER (s IN ('P', 'R')), []) AS still_running FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY 1", lambda t: edits.running_of_sources(t("events").groupBy(F.col("user_id").alias("source")).agg(F.collect_list("event_id").alias("items")), "source", "items", t("events").withColumn("s", F.expr(STATUS)), "event_id", "s"))
simple("both_ends_known", "SELECT l_orderkey, l_linenumber, a.p_name AS from_name, b.p_name AS to_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) a ON a.p_partkey = l_partkey LEFT JOIN (SELECT * FROM part WHERE p_size > 25) b ON b.p_partkey = l_suppkey WHERE a.p_partkey IS NOT NULL OR b.p_partkey IS NOT NULL", lambda t: edits.with_both_ends(t("lineitem"), t("part").where("p_size > 25"), "p_partkey", {"from": "l_partkey", "to": "l_suppkey"}).select("l_orderkey", "l_linenumber", F.col("from__p_name").alias("from_name"), F.col("to__p_name").alias("to_name")))
simple("filter_kinds", "SELECT * FROM (VALUES ('o_orderkey', 'range'), ('o_orderstatus', 'choice'), ('o_totalprice', 'range'), ('o_orderpriority', 'choice')) v(\"column\", kind)", lambda t: edits.filter_kinds(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")).drop("distinct"))
simple("dashboard_filter", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 900 AND 1200 AND p_size >= 5 AND p_brand IN ('Brand#2', 'Brand#17')", lambda t: edits.dashboard_filter(t("part"), p_retailprice=(900, 1200), p_size=(5, None), p_brand=["Brand#2", "Brand#17"], p_type=[], p_name=None).select("p_partkey"))
simple("tagged_workflows", "SELECT p_partkey FROM part WHERE p_size >= 10 AND list_has_any(string_split(p_name, ' '), ['red', 'ring'])", lambda t: edits.flagged_with_any_tag(t("part"), F.col("p_size") >= 10, F.split("p_name", " "), ["red", "ring"]).select("p_partkey"))
simple("parents_with_children", "SELECT o_orderkey, count(l_linenumber) AS n_children, list(l_linenumber ORDER BY l_linenumber) AS children FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", lambda t: edits.parents_with_children(t("orders").select("o_orderkey"), t("lineitem"), "o_orderkey", "l_orderkey", "l_linenumber"))
simple("first_matching", "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id = 46 ORDER BY event_id LIMIT 1", lambda t: edits.first_matching(t("events"), "event_id", event_type="click", user_id=46).select("event_id", "value"))
simple("ramp_held", "SELECT l_orderkey, l_linenumber, 300.0 + 600.0 * least(l_linenumber - 1, 4) / 4 AS temperature FROM lineitem", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", edits.linear_ramp(F.col("l_linenumber") - 1, 300, 900, 5).alias("temperature")))
simple("patterns_cleaned", "SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '#', '-', 'g'), '[0-9]+$', 'n') AS cleaned FROM part", lambda t: t("part").select("p_partkey", edits.cleaned(F.col("p_brand"), [("#", "-"), ("[0-9]+$", "n")]).alias("cleaned")))
simple("atomic_density", "SELECT p_partkey, round(p_size / p_retailprice, 8) AS density FROM part WHERE p_size > 0", lambda t: t("part").where("p_size > 0").select("p_partkey", F.round(scalars.atomic_density(F.col("p_retailprice"), F.col("p_size")), 8).alias("density")))
simple("price_window", """WITH p AS (SELECT l_partkey, l_shipdate::DATE AS day, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), l AS (SELECT l_partkey, max(day) AS last FROM p GROUP BY 1),
w AS (SELECT p.*, last FROM p JOIN l USING (l_partkey) WHERE day >= (last - INTERVAL 3 YEAR)::DATE), s AS (SELECT l_partkey, arg_min(price, day) AS start, min(day) AS first, min(price) AS low, max(price) AS high, arg_max(price, day) AS latest, max(day) AS last FROM w GROUP BY 1)
SELECT l_partkey, start, low, high, latest, round(100 * (latest - start) / start, 4) + 0.0 AS change, round(100 * (latest - start * a / b) / (start * a / b), 4) + 0.0 AS change_real FROM (SELECT *, 100.0 + 3 * (year(last) - 1990) AS a, 100.0 + 3 * (year(first) - 1990) AS b FROM s)""", lambda t: prices.window_change(t("lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(F.min("l_extendedprice").alias("price")), "l_partkey", "day", "price", 3, t.spark.createDataFrame([(y, 100.0 + 3 * (y - 1990)) for y in range(1990, 2030)], "year int, index double")).withColumns({c: F.round(c, 4) + 0.0 for c in ("change", "change_real")}))
simple("web_visible", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey = 3", lambda t: Query(Catalog([TableSpec("supplier", "s_suppkey", visible=lambda df: df.where("s_acctbal > 0"))], t), "supplier").web().filter(s_nationkey=3).df.select("s_suppkey"))

# archives and datastores


def _archived(t, kind: str, columns) -> DataFrame:
    """A table written as a dated archive, loaded into a table that has a third of its rows."""
    spec, root = TableSpec("part", "p_partkey", raw=("p_name", "p_size"), archive_exclude=("p_type",)), new_path(t.spark, "archived")
    path = files.archive(t("part"), spec, root, kind, columns, today=date(2024, 5, 6))
    have = t("part").select("p_partkey", "p_name", "p_size")
    have.where("p_partkey % 3 = 0").write.parquet(f"{root}/table")
    added = files.load_archive(t.spark, path, f"{root}/table", ["p_partkey"], have.schema)
    return t.spark.read.parquet(f"{root}/table").select("p_partkey", "p_name", "p_size", F.lit(path.rsplit("/", 1)[1]).alias("archive"), F.lit(added).cast("long").alias("added"))


_ADDED = "(SELECT count(*) FROM part WHERE p_partkey % 3 <> 0)"
simple("archive_minimal_csv", f"SELECT p_partkey, p_name, p_size, 'part-minimal-2024-05-06.csv.zip' AS archive, {_ADDED} AS added FROM part", lambda t: _archived(t, "csv", "minimal"))
simple("archive_custom_parquet", f"SELECT p_partkey, p_name, p_size, 'part-custom-2024-05-06.parquet' AS archive, {_ADDED} AS added FROM part", lambda t: _archived(t, "parquet", ["p_partkey", "p_name", "p_size"]))


def _store(t) -> Datastore:
    """Orders as a datastore of 6 chunks."""
    store = Datastore(t.spark, new_path(t.spark, "orders"), "o_orderkey", 6)
    store.stage(t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    store.promote()
    return store


_CHUNK = "(('0x' || md5(CAST(o_orderkey AS VARCHAR)))::UHUGEINT % 6)"
_STORED = f"(SELECT *, {_CHUNK}::INT AS chunk_key, ({_CHUNK})::BIGINT * 1000000000 + row_number() OVER (PARTITION BY {_CHUNK} ORDER BY o_orderkey) - 1 AS datastore_id FROM orders)"
simple("datastore_chunks", f"SELECT {_CHUNK}::INT AS chunk_key, count(*) AS n FROM orders GROUP BY 1", lambda t: (lambda s: s.df.where(F.col("chunk_key").isin(s.chunk_keys())).groupBy("chunk_key").agg(F.count("*").alias("n")))(_store(t)))
simple("datastore_one_chunk", f"SELECT o_orderkey, datastore_id FROM {_STORED} WHERE chunk_key = 4", lambda t: _store(t).chunk(4).select("o_orderkey", "datastore_id"))
simple("datastore_filter_ids", f"SELECT o_orderkey, datastore_id FROM {_STORED} WHERE o_orderkey IN (1, 2, 5) AND o_totalprice > 100", lambda t: _store(t).filter(o_orderkey__in=[1, 2, 5], o_totalprice__gt=100).select("o_orderkey", "datastore_id"))
simple("datastore_get_row", f"SELECT o_orderkey, o_totalprice FROM {_STORED} WHERE datastore_id = 2000000003", lambda t: _store(t).get_row(2_000_000_003).select("o_orderkey", "o_totalprice"))


@add("datastore_updates", f"SELECT o_orderkey, CASE WHEN datastore_id IN (1000000000, 1000000002) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_custkey * 2 AS doubled FROM {_STORED}")
def _updates(t) -> DataFrame:
    """Two rows set by id, the prices of one status by a table of changes, and a column made in all chunks."""
    store = _store(t)
    changes = store.df.where("o_orderstatus = 'F'").select("datastore_id", F.lit(-1.0).alias("o_totalprice"))
    store.update_rows(changes)
    store.update([1_000_000_000, 1_000_000_002], o_orderstatus="X")
    store.update_column("doubled", F.col("o_custkey") * 2, batch=4)
    store.drop_column("o_custkey")
    return store.df.select("o_orderkey", "o_orderstatus", "o_totalprice", "doubled")


@add("datastore_processed", f"SELECT chunk_key, o_orderstatus, count(*) AS n FROM {_STORED} GROUP BY ALL")
def _processed(t) -> DataFrame:
    """Counts of each chunk, made two chunks at a time."""
    store, out = _store(t), new_path(t.spark, "processed")
    store.process(lambda df: df.groupBy("chunk_key", "o_orderstatus").agg(F.count("*").alias("n")), out, batch=2)
    return store.processed(out).select("chunk_key", "o_orderstatus", "n")


@add("datastore_repartitioned", "SELECT o_orderstatus, count(*) AS n, TRUE AS by_folder FROM orders GROUP BY 1")
def _repartitioned(t) -> DataFrame:
    """The rows of all chunks by another column, one value at a time."""
    store, out = _store(t), new_path(t.spark, "by-status")
    for status in ("F", "O", "P"):
        store.repartition(["o_orderstatus"], out, [status])
    found = t.spark.read.parquet(out).withColumn("f", F.input_file_name())
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min(F.col("f").contains(F.concat(F.lit("o_orderstatus="), "o_orderstatus"))).alias("by_folder"))


simple("several_files", "SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || md5(CAST(o_orderkey AS VARCHAR)))::UHUGEINT % 6 IN (1, 3)", lambda t: (lambda s: t.spark.read.option("basePath", f"{s.root}/live").parquet(*[f"{s.root}/live/chunk_key={k}" for k in (1, 3)]).select("o_orderkey", "o_totalprice"))(_store(t)))


@add("synced_folder", "SELECT o_orderkey, o_orderstatus, TRUE AS whole FROM orders")
def _synced(t) -> DataFrame:
    """A partitioned table copied file by file to another folder; a second run copies nothing."""
    root = new_path(t.spark, "synced")
    t("orders").select("o_orderkey", "o_orderstatus").repartition(3).write.partitionBy("o_orderstatus").parquet(f"{root}/a")
    first, again = readers.sync_folder(t.spark, f"{root}/a", f"{root}/b"), readers.sync_folder(t.spark, f"{root}/a", f"{root}/b")
    return t.spark.read.parquet(f"{root}/b").select("o_orderkey", "o_orderstatus", F.lit(first > 0 and again == 0).alias("whole"))
