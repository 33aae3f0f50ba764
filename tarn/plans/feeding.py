"""Sources and sinks: feeds, delimited and TREC files, vectors, grouped tables, document types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import scalar as sc
from tarn.functions import tensor as tn
from tarn.functions import text as tx
from tarn.operators import joins as j
from tarn.operators import schema as sm
from tarn.operators import updates as u
from tarn.operators import vector as v
from tarn.operators.ranking import places
from tarn.plans.registry import query, scratch, table
from tarn.sources import feeds, vectors

_ITEM = "p_name string, p_size int, p_retailprice double"


@query("feed_round_trip", "SELECT 'put' AS op, 'id:shop:item::' || p_partkey AS _id, false AS \"create\", p_name, p_size, p_retailprice FROM part")
def feed_round_trip(spark, sf_dir):
    path = scratch(spark, "feed")
    feeds.write_operations(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, "shop", "item", "p_partkey")
    return feeds.read_operations(spark, path, _ITEM)


def _operations(spark, sf_dir):
    """Puts, updates that may create, and removes, a JSON object a line."""
    path, part = scratch(spark, "ops"), table(spark, sf_dir, "part")
    document = F.concat(F.lit("id:shop:item::"), F.col("p_partkey").cast("string"))
    fields = F.struct("p_name", "p_size")
    kind = F.col("p_partkey") % 3
    line = F.when(kind == 0, F.to_json(F.struct(document.alias("remove")))).when(kind == 1, F.to_json(F.struct(document.alias("update"), F.lit(True).alias("create"), fields.alias("fields"))))
    part.select(F.coalesce(line, F.to_json(F.struct(document.alias("put"), fields.alias("fields")))).alias("value")).write.text(path)
    return feeds.read_operations(spark, path, "p_name string, p_size int")


@query(
    "feed_operations",
    """
    SELECT CASE p_partkey % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'update' ELSE 'put' END AS op, p_partkey % 3 = 1 AS "create", 'item' AS type, CAST(p_partkey AS VARCHAR) AS local,
           CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name FROM part
    """,
)
def feed_operations(spark, sf_dir):
    rows = feeds.with_id_parts(_operations(spark, sf_dir))
    return rows.select("op", "create", F.col("_type").alias("type"), F.col("_local").alias("local"), "p_name")


@query("remove_by_id", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def remove_by_id(spark, sf_dir):
    gone = feeds.with_id_parts(_operations(spark, sf_dir)).where("op = 'remove'").select(F.col("_local").cast("long").alias("p_partkey"))
    return u.removed(table(spark, sf_dir, "part").select("p_partkey"), gone, "p_partkey")


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    return feeds.read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("tsv_positional", "SELECT n_nationkey AS a, n_name AS b FROM nation")
def tsv_positional(spark, sf_dir):
    path = scratch(spark, "tsv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("sep", "\t").csv(path)
    return feeds.read_csv(spark, path, "a int, b string", "\t", header=False)


@query("qrels_read", "SELECT CAST(label AS VARCHAR) AS qid, CAST(vec_id AS VARCHAR) AS docid, CAST(vec_id % 3 AS INTEGER) AS rel FROM embeddings")
def qrels_read(spark, sf_dir):
    path = scratch(spark, "qrels")
    line = F.concat_ws(" ", F.col("label").cast("string"), F.lit("Q0 "), F.col("vec_id").cast("string"), (F.col("vec_id") % 3).cast("string"))
    table(spark, sf_dir, "embeddings").select(line.alias("value")).write.text(path)
    return feeds.read_qrels(spark, path)


@query(
    "trec_run",
    """
    SELECT label || ' Q0 ' || vec_id || ' ' || r || ' ' || (1000 - r) || ' dot' AS line
    FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) AS r FROM embeddings) WHERE r <= 5
    """,
)
def trec_run(spark, sf_dir):
    path = scratch(spark, "run")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    feeds.write_run(places(rows, "score", "vec_id", "place", "label").where("place <= 5"), path, "label", "vec_id", "place", "dot")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("parquet_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def parquet_pushdown(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey", "o_totalprice")


@query(
    "binary_vectors",
    "SELECT id, count(*) AS n, CAST(sum(list_sum(list_transform(embedding, lambda x: CAST(trunc(x * 127) AS BIGINT)))) AS BIGINT) AS total FROM (SELECT embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS id FROM embeddings) GROUP BY 1",
)
def binary_vectors(spark, sf_dir):
    """Files of signed bytes, one for each label: a header of two 32-bit numbers, then the vectors."""
    # multiplied in single precision, as the vectors are: 64 / 127 is then 64, in double precision 63.99..
    byte = lambda x: F.lpad(F.hex(F.pmod((x * F.lit(127).cast("float")).cast("int"), F.lit(256))), 2, "0")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.size("embedding").alias("dim"), F.array_join(F.transform("embedding", byte), "").alias("h"))
    number = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda x: x["h"]), "")
    files = rows.groupBy("label").agg(F.unhex(F.concat(number(F.count("*").cast("int")), number(F.max("dim")), body)).alias("content"))
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return feeds.vectors_of(files).groupBy("id").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query("binary_vectors_split", "SELECT CAST(i - 1 AS INTEGER) AS dim, count(*) AS n, CAST(sum(CAST(trunc(embedding[i]::DOUBLE * 127) AS BIGINT)) AS BIGINT) AS total FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY 1")
def binary_vectors_split(spark, sf_dir):
    """Vectors written as two files of signed bytes and read again by ranges of 4,096 bytes."""
    vectors.register(spark)
    path = scratch(spark, "vectors")
    small = F.transform("embedding", lambda x: (x.cast("double") * 127).cast("int").cast("tinyint"))
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("file"), F.col("vec_id").alias("id"), small.alias("vector"))
    rows.repartition(2, "id").write.format("vectors").mode("append").save(path)
    cells = spark.read.format("vectors").option("split", 4096).load(path).select(F.posexplode("vector").alias("dim", "x"))
    return cells.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("total"))


def _lenient(spark, sf_dir):
    path = scratch(spark, "lenient")
    key = F.col("s_suppkey").cast("string")
    good = F.concat(F.lit("{'id': "), key, F.lit(", 'name': \""), F.col("s_name"), F.lit('"}'))
    line = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("{'id': "), key, F.lit(", 'name'"))).when(F.col("s_suppkey") % 10 == 1, F.lit('{"name": "no id"}')).otherwise(good)
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    return feeds.read_lenient_json(spark, path, "id long, name string", ["id"])


@query("lenient_json", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 10 > 1")
def lenient_json(spark, sf_dir):
    return _lenient(spark, sf_dir)[0]


@query("lenient_json_skipped", "SELECT count(*) AS skipped FROM supplier WHERE s_suppkey % 10 <= 1")
def lenient_json_skipped(spark, sf_dir):
    return _lenient(spark, sf_dir)[1]


@query("routed_scan", "SELECT 'supplier' AS _type, s_suppkey AS id, s_name AS name, NULL::VARCHAR AS size FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, CAST(p_size AS VARCHAR) FROM part")
def routed_scan(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))
    return sm.routed_scan({"supplier": supplier, "part": part, "nation": table(spark, sf_dir, "nation")}, ["supplier", "part"]).select("_type", "id", "name", "size")


@query("grouped_scan", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def grouped_scan(spark, sf_dir):
    path = scratch(spark, "grouped")
    feeds.write_grouped(table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("group")), path)
    return feeds.read_group(spark, path, "click").select("event_id", "user_id")


@query("point_lookup", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def point_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    documents = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return feeds.lookup(ids, documents, "o_custkey")


@query("visit_continuation", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS INTEGER) AS part FROM orders ORDER BY o_orderkey LIMIT 300")
def visit_continuation(spark, sf_dir):
    rows, after, out = table(spark, sf_dir, "orders").select("o_orderkey"), None, None
    for k in range(3):
        part = feeds.visit(rows, "o_orderkey", 100, after)
        after = part.agg(F.max("o_orderkey")).first()[0]
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "vector_literals",
    "SELECT vec_id, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE, 6) AS dense, CAST(label - 128 AS INTEGER) AS hex, round(embedding[3]::DOUBLE, 6) AS cell FROM embeddings",
)
def vector_literals(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", tn.doubles(F.col("embedding")))
    dense = sc.dense_from_json(F.to_json(F.struct(F.slice("v", 1, 2).alias("values"))))
    raw = sc.bytes_from_hex(F.lpad(F.hex(F.col("label") + 128), 2, "0"))
    cells = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("a").alias("x")).alias("address"), F.col("v")[2].alias("value"))).alias("cells")))
    return rows.select("vec_id", F.round(dense[0] + dense[1], 6).alias("dense"), raw[0].alias("hex"), F.round(F.element_at(sc.mapped_from_json(cells, "x"), "a"), 6).alias("cell"))


_PICK = "('0x' || md5('{}:' || s_suppkey)[1:15])::BIGINT % {}"


@query(
    "random_albums",
    f"""
    SELECT 'album-' || s_suppkey AS id, ['red', 'blue', 'silent', 'loud'][{_PICK.format(4, 4)} + 1] AS artist, CAST(1960 + {_PICK.format(5, 60)} AS INTEGER) AS year,
           CAST({_PICK.format(1, 101)} AS INTEGER) AS pop, CAST({_PICK.format(2, 101)} AS INTEGER) AS rock, CAST({_PICK.format(3, 101)} AS INTEGER) AS jazz FROM supplier
    """,
)
def random_albums(spark, sf_dir):
    """An album for each supplier."""
    albums = feeds.random_albums(table(spark, sf_dir, "supplier"), "s_suppkey")
    return albums.select(F.col("_id").alias("id"), "artist", "year", *[F.col("category_scores")[c].cast("int").alias(c) for c in ("pop", "rock", "jazz")])


# ---- document types and summaries ---------------------------------------------------------------------------------

_PRODUCT = sm.DocumentType(
    "product", "p_partkey bigint, p_name string, p_retailprice double", derived={"price_class": lambda: F.when(F.col("p_retailprice") > 1000, "high").otherwise("low")},
    fieldsets={"default": ("p_name",)}, summaries={"short": ("p_partkey", "p_name as title", "price_class")},
)
_SIZED = sm.DocumentType("sized", "p_size int, weight double", parents=(_PRODUCT,))


@query("summary_class", "SELECT p_partkey, p_name AS title, CASE WHEN p_retailprice > 1000 THEN 'high' ELSE 'low' END AS price_class FROM part")
def summary_class(spark, sf_dir):
    return _SIZED.summary(_SIZED.ingested(table(spark, sf_dir, "part")), "short")


@query("typed_ingestion", "SELECT p_partkey, p_name, p_retailprice, p_size, NULL::DOUBLE AS weight, CASE WHEN p_retailprice > 1000 THEN 'high' ELSE 'low' END AS price_class FROM part")
def typed_ingestion(spark, sf_dir):
    return _SIZED.ingested(table(spark, sf_dir, "part"))


@query(
    "dynamic_snippet",
    "SELECT p_partkey, CASE string_split(p_name, ' ')[1] WHEN 'ring' THEN '<hi>ring</hi><sep />' ELSE '<sep /><hi>ring</hi>' END AS snippet FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')",
)
def dynamic_snippet(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.snippet(F.col("p_name"), ["ring"], 0).alias("snippet")).where("snippet IS NOT NULL")


@query("matched_elements", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w IN ('ring', 'red')), ',') AS words FROM part")
def matched_elements(spark, sf_dir):
    found = sm.matched_elements(F.split("p_name", " "), lambda w: w.isin("ring", "red"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("words"))


@query(
    "selected_elements",
    "SELECT vec_id, string_agg('e' || i, ',' ORDER BY x DESC, i) AS best FROM (SELECT vec_id, i, embedding[i + 1] AS x, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) AS r FROM embeddings, unnest(range(0, 8)) AS t(i)) WHERE r <= 3 GROUP BY 1",
)
def selected_elements(spark, sf_dir):
    cells = F.map_from_arrays(F.sequence(F.lit(0), F.lit(7)), F.slice("embedding", 1, 8))
    names = F.array(*[F.lit(f"e{k}") for k in range(8)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(sm.elements_by_labels(names, tn.top_labels(cells, 3)), ",").alias("best"))


@query("late_fetch", "SELECT p_partkey, p_name, p_brand, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def late_fetch(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    winners = part.select("p_partkey", F.col("p_retailprice").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)
    return v.fetched(winners, part, "p_partkey", ["p_name", "p_brand"])


@query("joined_bits", "SELECT o_orderkey, (o_custkey << 32) | o_orderkey AS id FROM orders")
def joined_bits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.joined_bits(F.col("o_custkey"), F.col("o_orderkey")).alias("id"))


@query("existing_only", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def existing_only(spark, sf_dir):
    lists = table(spark, sf_dir, "events").select("event_id", "user_id")
    return j.existing_only(lists, table(spark, sf_dir, "supplier").where("s_nationkey < 10"), "user_id", "s_suppkey")
