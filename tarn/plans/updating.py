"""Updates, set operations, metrics, mining and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import metrics as m
from tarn.operators import updates as u
from tarn.plans.registry import query, scratch, table
from tarn.streaming import counters, keyed


@query("rating_rollup_batch", "SELECT c_custkey, CAST(coalesce(sum(floor(o_totalprice)), 0) AS BIGINT) AS rating_stars, count(o_orderkey) AS rating_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def rating_rollup_batch(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).cast("long").alias("rating_stars"), F.lit(0).cast("long").alias("rating_count"))
    reviews = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").cast("long").alias("stars"))
    return u.rated(items, reviews, "c_custkey", "stars")


@query(
    "weighted_set_update",
    """
    WITH a AS (SELECT user_id, event_type AS k, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS d FROM events)
    SELECT user_id, k, CAST(sum(d) AS BIGINT) AS w FROM a GROUP BY 1, 2 HAVING sum(d) <> 0
    """,
)
def weighted_set_update(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("d"))
    side = lambda keep: ops.where(keep).groupBy("user_id", "event_type").agg(F.sum("d").alias("w")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "w"))).alias("m"))
    up, down = side(F.col("d") > 0), side(F.col("d") < 0).withColumnRenamed("m", "n")
    both = up.join(down, "user_id", "full").select("user_id", u.weighted_set_sum(F.col("m"), F.col("n")).alias("set"))
    return both.select("user_id", F.explode("set").alias("k", "w"))


@query(
    "partial_update_assign",
    "SELECT s_suppkey, s_name, coalesce((SELECT arg_max(value, event_id) FROM events WHERE user_id = s_suppkey AND event_type = 'purchase'), s_acctbal) AS s_acctbal FROM supplier",
)
def partial_update_assign(spark, sf_dir):
    ops = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("s_suppkey"), F.lit("s_acctbal").alias("field"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return u.assigned(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), ops, "s_suppkey", "field", "value", "seq")


@query(
    "upsert_latest",
    "SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'signup') WHERE r = 1 UNION ALL SELECT user_id, NULL, NULL FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')",
)
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    known = events.select("user_id").distinct().withColumns({"value": F.lit(None).cast("double"), "event_id": F.lit(None).cast("long")})
    return u.upsert(known, events.where("event_type = 'signup'").select("user_id", "value", "event_id"), "user_id", ["event_id"])


@query("remove_by_selection", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def remove_by_selection(spark, sf_dir):
    return u.removed_where(table(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("index_refresh_diff", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def index_refresh_diff(spark, sf_dir):
    feed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return u.stale_ids(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), feed.select(F.col("o_custkey").alias("id")), "id")


@query("union_first_wins", "SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1")
def union_first_wins(spark, sf_dir):
    side = lambda t, k, i: table(spark, sf_dir, t).groupBy(F.col(k).alias("k")).agg(F.min(i).alias("id"))
    return u.first_wins(side("customer", "c_nationkey", "c_custkey"), side("supplier", "s_nationkey", "s_suppkey"), key="k")


@query("dense_codes", "SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1 AS INTEGER) AS code FROM part GROUP BY 1")
def dense_codes(spark, sf_dir):
    return u.dense_codes(table(spark, sf_dir, "part"), "p_brand", "p_partkey", scratch(spark, "codes"))


@query("word_codes", "SELECT word, CAST(row_number() OVER (ORDER BY first, word) - 1 AS INTEGER) AS code FROM (SELECT w AS word, min(doc_id) AS first FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1)")
def word_codes(spark, sf_dir):
    """U6 for the words of all documents."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    return u.dense_codes(words, "word", "doc_id", scratch(spark, "codes"))


_RUN = "r AS (SELECT label AS query_id, vec_id, embedding[1]::DOUBLE AS score, CASE WHEN vec_id % 4 = 0 THEN 3 WHEN vec_id % 4 = 1 THEN 1 ELSE 0 END AS y FROM embeddings)"


def _run(spark, sf_dir):
    y = F.when(F.col("vec_id") % 4 == 0, 3).when(F.col("vec_id") % 4 == 1, 1).otherwise(0)
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), "vec_id", F.col("embedding")[0].cast("double").alias("score"), y.alias("y"))


@query(
    "ndcg_at_k",
    f"""
    WITH {_RUN}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY y DESC, vec_id) AS b FROM r)
    SELECT query_id, round(sum(CASE WHEN a <= 10 THEN (2 ** y - 1) / log2(a + 1) ELSE 0 END) / sum(CASE WHEN b <= 10 THEN (2 ** y - 1) / log2(b + 1) ELSE 0 END), 6) AS ndcg FROM p GROUP BY 1
    """,
)
def ndcg_at_k(spark, sf_dir):
    return m.ndcg(_run(spark, sf_dir), "query_id", "score", F.col("y"), "vec_id", 10).withColumn("ndcg", F.round("ndcg", 6))


@query("mrr", f"WITH {_RUN}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS a FROM r) SELECT query_id, round(sum(CASE WHEN y > 0 THEN 1.0 / a ELSE 0 END) / sum(CASE WHEN y > 0 THEN 1 ELSE 0 END), 6) AS mrr FROM p GROUP BY 1")
def mrr(spark, sf_dir):
    return m.mean_reciprocal_rank(_run(spark, sf_dir), "query_id", "score", F.col("y") > 0, "vec_id").withColumn("mrr", F.round("mrr", 6))


@query(
    "group_auc",
    f"WITH {_RUN} SELECT a.query_id, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM r a JOIN r b ON a.query_id = b.query_id AND a.y > 0 AND b.y = 0 GROUP BY 1",
)
def group_auc(spark, sf_dir):
    return m.group_auc(_run(spark, sf_dir), "query_id", "score", F.col("y") > 0).withColumn("auc", F.round("auc", 6))


@query(
    "precision_recall_at_k",
    f"""
    WITH {_RUN}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS a FROM r), c AS (SELECT *, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY a) AS seen FROM p)
    SELECT query_id, round(count(*) FILTER (y > 0 AND a <= 10) / 10.0, 6) AS "precision", round(count(*) FILTER (y > 0 AND a <= 10) / (count(*) FILTER (y > 0))::DOUBLE, 6) AS recall,
           round(coalesce(sum(seen / a::DOUBLE) FILTER (y > 0 AND a <= 10), 0) / least(10, count(*) FILTER (y > 0)), 6) AS map FROM c GROUP BY 1
    """,
)
def precision_recall_at_k(spark, sf_dir):
    found = m.at_k(_run(spark, sf_dir), "query_id", "score", F.col("y") > 0, "vec_id", 10)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "map")])


@query("hard_negatives", "SELECT label AS query_id, vec_id AS doc FROM embeddings WHERE vec_id % 4 <> 0 AND label IN (SELECT label FROM embeddings WHERE vec_id % 4 = 0)")
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc"))
    return m.hard_negatives(rows, rows.where("doc % 4 = 0"), "query_id", "doc")


@query("mixed_label_groups", "SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type <> 'click') > 0)")
def mixed_label_groups(spark, sf_dir):
    return m.mixed_labels_only(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_type") == "click").select("user_id", "event_id")


@query("nested_subsets", "SELECT o_orderkey, CASE WHEN r <= 10 THEN 10 WHEN r <= 50 THEN 50 ELSE 100 END AS subset FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 100")
def nested_subsets(spark, sf_dir):
    return m.nested_subsets(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [10, 50, 100]).withColumn("subset", F.col("subset").cast("int"))


def _streamed(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)




@query("stream_rating_counts", "SELECT user_id, round(sum(value), 4) AS rating_stars, count(*) AS rating_count FROM events GROUP BY 1")
def stream_rating_counts(spark, sf_dir):
    state = counters.running_ratings(_streamed(spark, sf_dir), "user_id", "value")
    path = scratch(spark, "ratings")
    return counters.into_table(state, f"{path}/state", f"{path}/checkpoint").withColumn("rating_stars", F.round("rating_stars", 4))


@query("stream_batch_merge", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def stream_batch_merge(spark, sf_dir):
    ops = counters.filtered_operations(_streamed(spark, sf_dir), F.col("event_type") != "error").select("event_type", F.lit(1).cast("long").alias("n"))
    path = scratch(spark, "totals")
    counters.merged_each_batch(ops, f"{path}/totals", f"{path}/checkpoint", "event_type", ["n"])
    return counters.batch_totals(spark, f"{path}/totals", "event_type", ["n"])


@query(
    "stream_partial_updates",
    """
    SELECT user_id AS key, event_type AS field, round(sum(value), 4) AS value FROM events GROUP BY 1, 2
    UNION ALL SELECT user_id, 'last', round(arg_max(value, event_id), 4) FROM events GROUP BY 1
    """,
)
def stream_partial_updates(spark, sf_dir):
    """An assignment and an increment for each event, out of order in four micro-batches, a fifth of them twice."""
    events, path = table(spark, sf_dir, "events"), scratch(spark, "operations")
    kinds = F.array(F.struct(F.lit("assign").alias("kind"), F.lit("last").alias("field")), F.struct(F.lit("increment").alias("kind"), F.col("event_type").alias("field")))
    ops = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", F.col("ts").cast("timestamp").alias("at"), F.posexplode(kinds).alias("k", "o"))
    ops = ops.select("key", (F.col("seq") * 2 + F.col("k")).alias("op_id"), "seq", "o.kind", "o.field", "value", "at")
    twice = ops.withColumn("copy", F.explode(F.when(F.col("seq") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    twice.repartition(4, F.xxhash64("op_id", "copy")).drop("copy").write.parquet(f"{path}/ops")
    stream = spark.readStream.schema(keyed.OPERATIONS).option("maxFilesPerTrigger", 1).parquet(f"{path}/ops")
    found = keyed.run_documents(keyed.keyed_documents(stream, 400 * 86_400_000), f"{path}/documents", f"{path}/checkpoint")
    each = found.select("key", F.explode(F.arrays_zip("field", "value")).alias("x"))
    return each.select("key", F.col("x.field").alias("field"), F.round("x.value", 4).alias("value"))
