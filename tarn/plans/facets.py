"""Facet, list and map aggregates over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions.scalar import int_ratio
from tarn.operators import grouping as g
from tarn.operators import joins as j
from tarn.plans.registry import query, table

_N = F.count
_HITS = "part JOIN lineitem ON p_partkey = l_partkey"


def _hits(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return part.join(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice"), F.col("p_partkey") == F.col("l_partkey"))


@query("facet_count", "SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1")
def facet_count(spark, sf_dir):
    return g.facet(table(spark, sf_dir, "part"), F.col("p_brand"), [F.count("*").alias("n")])


@query(
    "facet_order_expr",
    f"SELECT p_brand AS brand, count(*) AS n, round(avg(l_quantity / 50), 6) AS avg_relevance FROM {_HITS} GROUP BY 1 ORDER BY count(*) * avg(l_quantity / 50) DESC, brand LIMIT 50",
)
def facet_order_expr(spark, sf_dir):
    groups = g.facet(_hits(spark, sf_dir), F.col("p_brand"), [F.count("*").alias("n"), F.avg(F.col("l_quantity") / 50).alias("r")], [(F.col("n") * F.col("r")).desc()], 50, "brand")
    return groups.select("brand", "n", F.round("r", 6).alias("avg_relevance"))


@query("facet_max_groups", f"SELECT p_type AS key, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS n FROM {_HITS} GROUP BY 1 ORDER BY min(p_retailprice), key LIMIT 3")
def facet_max_groups(spark, sf_dir):
    aggregates = [F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.count("*").alias("n")]
    return g.facet(_hits(spark, sf_dir), F.col("p_type"), aggregates, [F.col("low").asc()], 3)


@query(
    "facet_bucket_price",
    "SELECT CASE WHEN p_retailprice < 950 THEN '[900,950)' WHEN p_retailprice < 1000 THEN '[950,1000)' ELSE '[1000,inf)' END AS bucket, count(*) AS n, round(avg(p_size), 6) AS avg_size FROM part WHERE p_retailprice >= 900 GROUP BY 1",
)
def facet_bucket_price(spark, sf_dir):
    return g.facet_buckets(table(spark, sf_dir, "part"), F.col("p_retailprice"), [900, 950, 1000, None], [F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("avg_size")])


@query("facet_int_division", "SELECT CAST(p_size // 10 AS BIGINT) AS key, count(*) AS n FROM part GROUP BY 1")
def facet_int_division(spark, sf_dir):
    return g.facet(table(spark, sf_dir, "part"), int_ratio(F.col("p_size"), F.lit(10)), [F.count("*").alias("n")])


@query("facet_multivalue", "SELECT w AS key, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1")
def facet_multivalue(spark, sf_dir):
    return g.facet_elements(table(spark, sf_dir, "part"), F.split("p_name", " "), [F.count("*").alias("n")])


@query(
    "nested_grouping",
    """
    WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, NULL::VARCHAR AS n_name, NULL::VARCHAR AS c_mktsegment, count(*) AS n, 1 AS depth FROM c GROUP BY 1
    UNION ALL SELECT r_name, n_name, NULL, count(*), 2 FROM c GROUP BY 1, 2
    UNION ALL SELECT r_name, n_name, c_mktsegment, count(*), 3 FROM c GROUP BY 1, 2, 3
    """,
)
def nested_grouping(spark, sf_dir):
    rows = j.import_parent(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"})
    rows = j.import_parent(rows, table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", {"r_name": "r_name"})
    return g.nested_groups(rows, ["r_name", "n_name", "c_mktsegment"], [F.count("*").alias("n")])


@query("top_hits_per_group", "SELECT lang, doc_id, n_chars, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents) WHERE place <= 3")
def top_hits_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return g.top_hits(docs, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3)


@query("best_group_by_max", "SELECT source, n_chars, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 5")
def best_group_by_max(spark, sf_dir):
    return g.best_groups(table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id"), "source", "n_chars", "doc_id", 5)


@query("collapse_field", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def collapse_field(spark, sf_dir):
    return g.collapsed(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")])


@query(
    "weighted_set_profile",
    "SELECT o_custkey, l_partkey AS part, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
)
def weighted_set_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return g.count_map(lines, "o_custkey", "l_partkey").select("o_custkey", F.explode("counts").alias("part", "n"))


@query("ordered_basket", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS basket FROM lineitem GROUP BY 1")
def ordered_basket(spark, sf_dir):
    lists = g.ordered_list(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], "l_partkey")
    return lists.select("l_orderkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("basket"))


@query(
    "struct_list_flat",
    "SELECT o_custkey, count(*) AS n_orders, round(max(o_totalprice), 2) AS top_price FROM orders GROUP BY 1",
)
def struct_list_flat(spark, sf_dir):
    lists = g.struct_list(table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"])
    return lists.select("o_custkey", F.size("items").cast("long").alias("n_orders"), F.round(F.array_max("items")["o_totalprice"], 2).alias("top_price"))


@query("ctr_by_category", "SELECT user_id, count(*) AS impressions, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS ctr FROM events GROUP BY 1")
def ctr_by_category(spark, sf_dir):
    return g.click_rates(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "click").withColumn("ctr", F.round("ctr", 6))


@query("value_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def value_percentiles(spark, sf_dir):
    return g.percentiles(table(spark, sf_dir, "events"), "value", [0.5, 0.9, 0.95]).select(*[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95")])


@query("group_sizes", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def group_sizes(spark, sf_dir):
    return g.group_sizes(table(spark, sf_dir, "orders"), "o_custkey")


@query("flatten_distinct", "SELECT DISTINCT w AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> 'ring'")
def flatten_distinct(spark, sf_dir):
    return g.flattened_distinct(table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " ")), "words", ["ring"])


@query("category_tensor", "SELECT event_type AS category, round(avg(value), 6) AS v FROM events GROUP BY 1")
def category_tensor(spark, sf_dir):
    rates = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return g.as_mapped_tensor(rates, "event_type", "v").select(F.explode("cells").alias("category", "v")).withColumn("v", F.round("v", 6))


@query(
    "multi_facet_top",
    """
    WITH t AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50)
    SELECT 'brand' AS facet, p_brand AS key, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM t GROUP BY 2
    """,
)
def multi_facet_top(spark, sf_dir):
    return g.facets_of_best(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], 50, {"brand": F.col("p_brand"), "type": F.col("p_type")})


@query("json_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return g.facet(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long"), [F.count("*").alias("n")], name="k")
