"""Interval, reference and matching joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions.scalar import epoch_seconds
from tarn.operators import joins as j
from tarn.plans.registry import query, scratch, table

_A = "a AS (SELECT user_id AS id, event_id AS a_key, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 AS e FROM events WHERE event_type = 'view')"
_B = "b AS (SELECT user_id AS id, event_id AS b_key, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS e FROM events WHERE event_type = 'click')"


def _side(spark, sf_dir, kind, seconds):
    t = epoch_seconds(F.col("ts"))
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), F.col("event_id").alias("key"), t.alias("start"), (t + seconds).alias("end"))


@query("interval_join_pairs", f'WITH {_A}, {_B} SELECT a.id, a_key, b_key, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM a JOIN b ON a.id = b.id AND a.s <= b.e AND b.s <= a.e')
def interval_join_pairs(spark, sf_dir):
    pairs = j.interval_join(_side(spark, sf_dir, "view", 3600), _side(spark, sf_dir, "click", 1800), ["id"], unit=1800)
    return pairs.select("id", "a_key", "b_key", "start", "end")


@query("interval_join_plain", f'WITH {_A}, {_B} SELECT a.id, a_key, b_key, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM a JOIN b ON a.id = b.id AND a.s <= b.e AND b.s <= a.e')
def interval_join_plain(spark, sf_dir):
    pairs = j.interval_join(_side(spark, sf_dir, "view", 3600), _side(spark, sf_dir, "click", 1800), ["id"])
    return pairs.select("id", "a_key", "b_key", "start", "end")


@query("interval_join_semi", f"WITH {_A}, {_B} SELECT b.id, b_key AS key FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND a.s <= b.e AND b.s <= a.e)")
def interval_join_semi(spark, sf_dir):
    return j.interval_semi_join(_side(spark, sf_dir, "click", 1800), _side(spark, sf_dir, "view", 3600), ["id"]).select("id", "key")


@query(
    "interval_intersection",
    """
    WITH t AS (SELECT o_custkey AS id, o_orderstatus AS st, floor(epoch(o_orderdate))::BIGINT AS s, lead(floor(epoch(o_orderdate))::BIGINT) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS e FROM orders),
         a AS (SELECT id, s, e FROM t WHERE st = 'F' AND e IS NOT NULL), b AS (SELECT id, s, e FROM t WHERE st = 'O' AND e IS NOT NULL)
    SELECT a.id, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM a JOIN b ON a.id = b.id AND a.s <= b.e AND b.s <= a.e
    """,
)
def interval_intersection(spark, sf_dir):
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus", epoch_seconds(F.col("o_orderdate")).alias("start"), F.lead(epoch_seconds(F.col("o_orderdate"))).over(w).alias("end"))
    side = lambda s: spans.where(F.col("o_orderstatus") == s).select("id", "start", "end")
    return j.interval_join(side("F"), side("O"), ["id"]).select("id", "start", "end")


@query("dimension_enrich", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_enrich(spark, sf_dir):
    rows = j.import_parent(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey", {"n_name": "n_name", "n_regionkey": "__r"})
    return j.import_parent(rows, table(spark, sf_dir, "region"), "__r", "r_regionkey", {"r_name": "r_name"}).select("s_suppkey", "s_name", "n_name", "r_name")


@query("fact_enrich", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def fact_enrich(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return j.import_parent(lines, table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", {"o_custkey": "o_custkey", "o_orderpriority": "o_orderpriority"})


@query("lookup_enrich", "SELECT d.doc_id, l.quality::DOUBLE AS quality, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_enrich(spark, sf_dir):
    return j.enriched(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", "quality").withColumn("quality", F.col("quality").cast("double"))


_SPAN = "CASE WHEN {k} % 64 = 0 THEN {year} WHEN {k} % 4 = 1 THEN 86400 WHEN {k} % 4 = 2 THEN 3600 ELSE 5 END"


@query(
    "interval_join_lengths",
    f"""
    WITH a AS (SELECT o_orderkey AS a_key, floor(epoch(o_orderdate))::BIGINT AS s, floor(epoch(o_orderdate))::BIGINT + {_SPAN.format(k="o_orderkey", year=94608000)} AS e FROM orders),
         b AS (SELECT s_suppkey AS b_key, 700000000 + 1234567 * (s_suppkey % 151) AS s, 700000000 + 1234567 * (s_suppkey % 151) + {_SPAN.format(k="s_suppkey", year=63072000)} AS e FROM supplier)
    SELECT b_key, count(*) AS n, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS seconds, max(a_key) AS last_key FROM a JOIN b ON a.s <= b.e AND b.s <= a.e GROUP BY 1
    """,
)
def interval_join_lengths(spark, sf_dir):
    """J1 without keys: orders and suppliers with windows of seconds, hours, days and years."""
    begin = epoch_seconds(F.col("o_orderdate"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), begin.alias("start"), (begin + F.expr(_SPAN.format(k="o_orderkey", year=94_608_000))).alias("end"))
    begin = F.expr("700000000 + 1234567 * (s_suppkey % 151)")
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), begin.alias("start"), (begin + F.expr(_SPAN.format(k="s_suppkey", year=63_072_000))).alias("end"))
    # equal intervals meet the same ones, so that each different interval is joined once, with its number of rows
    path = scratch(spark, "intervals")
    a.groupBy("start", "end").agg(F.count("*").alias("n"), F.max("key").alias("last")).write.parquet(f"{path}/a")
    b.select("start", "end").distinct().write.parquet(f"{path}/b")
    kinds, asked = spark.read.parquet(f"{path}/a"), spark.read.parquet(f"{path}/b")
    pairs = j.interval_join(kinds, asked, [])
    seconds = F.sum(F.col("a_n") * (F.col("end") - F.col("start"))).cast("long")
    met = pairs.groupBy("b_start", "b_end").agg(F.sum("a_n").alias("n"), seconds.alias("seconds"), F.max("a_last").alias("last_key"))
    return b.join(met, (F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_end"))).groupBy(F.col("key").alias("b_key")).agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.max("last_key").alias("last_key"))


@query(
    "band_match",
    """
    SELECT s_suppkey, c_custkey, round(score, 6) AS score, place FROM (
      SELECT s_suppkey, c_custkey, 1 / (1 + abs(c_acctbal - s_acctbal)) AS score,
             CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY 1 / (1 + abs(c_acctbal - s_acctbal)) DESC, c_custkey) AS INTEGER) AS place
      FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - 100 AND s_acctbal + 100) WHERE place <= 3
    """,
)
def band_match(spark, sf_dir):
    """J18 without any equal column."""
    left = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") - 100).alias("low"), (F.col("s_acctbal") + 100).alias("high"))
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    score = 1 / (1 + F.abs(F.col("c_acctbal") - F.col("s_acctbal")))
    best = j.nearest_match(left, right, "s_acctbal", "low", "high", "c_acctbal", score, "s_suppkey", "c_custkey", 3, scratch(spark, "band"), unit=25)
    return best.select("s_suppkey", "c_custkey", F.round("score", 6).alias("score"), "place")


@query(
    "two_sided_match",
    """
    SELECT s_suppkey, c_custkey, round(score, 6) AS score, place FROM (
      SELECT s_suppkey, c_custkey, 1 / (1 + abs(c_acctbal - s_acctbal)) AS score,
             CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY 1 / (1 + abs(c_acctbal - s_acctbal)) DESC, c_custkey) AS INTEGER) AS place
      FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal - 1000 AND s_acctbal + 1000) WHERE place <= 3
    """,
)
def two_sided_match(spark, sf_dir):
    bounds = [(F.col("s_acctbal") - 1000).alias("low"), (F.col("s_acctbal") + 1000).alias("high")]
    left = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("l_nation"), *bounds)
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("r_nation"))
    score = 1 / (1 + F.abs(F.col("c_acctbal") - F.col("s_acctbal")))
    best = j.nearest_match(left, right, "s_acctbal", "low", "high", "c_acctbal", score, "s_suppkey", "c_custkey", 3, scratch(spark, "sides"), [("l_nation", "r_nation")], unit=25)
    return best.select("s_suppkey", "c_custkey", F.round("score", 6).alias("score"), "place")


@query(
    "parent_child_ctr_score",
    """
    WITH c AS (SELECT event_id % 10 AS label, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS ctr FROM events GROUP BY 1)
    SELECT vec_id, round(embedding[1]::DOUBLE * ctr, 6) AS score FROM embeddings LEFT JOIN c ON embeddings.label = c.label
    """,
)
def parent_child_ctr_score(spark, sf_dir):
    from tarn.operators.grouping import click_rates

    events = table(spark, sf_dir, "events").withColumn("category", F.col("event_id") % 10)
    rates = click_rates(events, "category", F.col("event_type") == "click")
    rows = j.import_parent(table(spark, sf_dir, "embeddings"), rates, "label", "category", {"ctr": "ctr"})
    return rows.select("vec_id", F.round(F.col("embedding")[0].cast("double") * F.col("ctr"), 6).alias("score"))


@query(
    "pairwise_wins",
    """
    WITH t AS (SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1000), p AS (SELECT a.s_suppkey, a.s_acctbal - b.s_acctbal * 0.5 AS o FROM t a JOIN t b ON a.s_suppkey <> b.s_suppkey)
    SELECT s_suppkey, CAST(sum(CASE WHEN o > (SELECT avg(o) FROM p) THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM p GROUP BY 1
    """,
)
def pairwise_wins(spark, sf_dir):
    pairs = j.pairwise(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    return j.pairwise_wins(pairs, "s_suppkey", F.col("i_s_acctbal") - F.col("j_s_acctbal") * 0.5)


@query("anti_join_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabelled(spark, sf_dir):
    return j.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("impression_lookup", "SELECT user_id, p_brand, count(*) AS shown, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM events JOIN part ON p_partkey = event_id % 300 GROUP BY 1, 2")
def impression_lookup(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select("user_id", F.concat((F.col("event_id") % 300).cast("string"), F.when(F.col("event_type") == "click", "-1").otherwise("-0")).alias("log"))
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), "p_brand")
    return j.impressions(logs, "log", catalogue, "item").groupBy("user_id", "p_brand").agg(F.count("*").alias("shown"), F.sum("clicked").alias("clicks"))


@query("common_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_keys(spark, sf_dir):
    return j.common_keys(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])
