"""Vector search, fusion and phased ranking over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import tensor as tn
from tarn.operators import ann
from tarn.operators import ranking as r
from tarn.operators import vector as v
from tarn.plans.registry import query, scratch, table

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", tn.doubles(F.col("embedding")).alias("v"))


def _query(spark, sf_dir, vec_id=7):
    return tn.literal(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query("knn_exact_cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS cosine FROM embeddings ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) DESC, vec_id LIMIT 10")
def knn_exact_cosine(spark, sf_dir):
    score = F.round(tn.cosine(F.col("v"), _query(spark, sf_dir)), 6)
    return _vectors(spark, sf_dir).select("vec_id", score.alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


@query("knn_l2", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}), 6) AS distance FROM embeddings WHERE label < 5 ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    best = v.nearest(_vectors(spark, sf_dir), "v", _query(spark, sf_dir), "vec_id", 10, condition=F.col("label") < 5)
    return best.select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "knn_hamming_rerank",
    f"""
    WITH q AS (SELECT {_Q} AS q), h AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END)) AS bits FROM embeddings, q),
         f AS (SELECT * FROM h ORDER BY bits, vec_id LIMIT 50)
    SELECT vec_id, CAST(bits AS INTEGER) AS bits, round(list_inner_product(v, q), 6) AS score FROM f, q ORDER BY list_inner_product(v, q) DESC, vec_id LIMIT 10
    """,
)
def knn_hamming_rerank(spark, sf_dir):
    best = v.binary_then_float(_vectors(spark, sf_dir), "v", _query(spark, sf_dir), "vec_id", 50, 10)
    return best.select("vec_id", "bits", F.round("score", 6).alias("score"))


_ASSIGN = """
    c AS (SELECT vec_id AS centroid, embedding::DOUBLE[] AS cv FROM embeddings WHERE vec_id % 6 = 0),
    a AS (SELECT vec_id, centroid, 1 / (1 + list_distance(embedding::DOUBLE[], cv)) AS closeness, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], cv), centroid) AS place FROM embeddings, c)
"""


def _assigned(spark, sf_dir, k):
    vectors = _vectors(spark, sf_dir)
    centroids = vectors.where("vec_id % 6 = 0").select(F.col("vec_id").alias("centroid"), F.col("v").alias("centroid_vector"))
    return vectors, centroids, v.closest_centroids(vectors, centroids, "vec_id", "v", "centroid", "centroid_vector", k)


@query("centroid_prune", f"WITH {_ASSIGN}, b AS (SELECT *, max(closeness) OVER (PARTITION BY vec_id) AS best FROM a WHERE place <= 12) SELECT vec_id, centroid, round(closeness, 6) AS closeness FROM b WHERE place = 1 OR closeness > 0.8 * best")
def centroid_prune(spark, sf_dir):
    _, _, assigned = _assigned(spark, sf_dir, 12)
    return v.pruned(assigned, "vec_id", 0.8).select("vec_id", "centroid", F.round("closeness", 6).alias("closeness"))


@query(
    "spann_search",
    f"""
    WITH {_ASSIGN}, lists AS (SELECT vec_id, centroid FROM a WHERE place <= 4),
    n AS (SELECT * FROM (SELECT vec_id AS query_id, centroid, closeness, place, max(closeness) OVER (PARTITION BY vec_id) AS best FROM a WHERE place <= 8 AND vec_id % 50 = 0) WHERE place = 1 OR closeness > 0.5 * best),
    d AS (SELECT DISTINCT query_id, lists.vec_id FROM n JOIN lists USING (centroid)),
    s AS (SELECT query_id, d.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM d JOIN embeddings e ON e.vec_id = d.vec_id JOIN embeddings q ON q.vec_id = query_id)
    SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM s) WHERE place <= 10
    """,
)
def spann_search(spark, sf_dir):
    vectors, centroids, lists = _assigned(spark, sf_dir, 4)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    found = v.centroid_search(vectors, lists, centroids, queries, "vec_id", "v", 10, 8, 0.5)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def _trained(spark, sf_dir):
    """An index of all vectors with about a list for each root of their number, and the stated queries."""
    vectors = _vectors(spark, sf_dir)
    path = scratch(spark, "ann")
    lists = max(1, min(65_536, round(vectors.count() ** 0.5)))
    ann.write_index(vectors, "vec_id", "v", ann.train(vectors, "vec_id", "v", lists, rounds=6), path, copies=2, factor=0.8)
    return ann.open_index(spark, path), vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))


@query(
    "ivf_exact_knn",
    """
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
         d AS (SELECT query_id, vec_id, list_distance(embedding::DOUBLE[], qv) AS distance FROM embeddings, q),
         p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM d)
    SELECT query_id, vec_id, round(distance, 6) AS distance, place FROM p WHERE place <= 10
    """,
)
def ivf_exact_knn(spark, sf_dir):
    index, queries = _trained(spark, sf_dir)
    found = ann.exact_search(index, queries, "query_id", "query_vector", 10, 8, 100)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "place")


@query("ivf_recall")
def ivf_recall(spark, sf_dir):
    """For each stated query the recall of ten neighbours by lists and codes, against the true ones; probes are tuned on other vectors."""
    index, queries = _trained(spark, sf_dir)
    others = ann.sampled(_vectors(spark, sf_dir).where("vec_id % 50 = 25"), "vec_id", "v", 200).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    probes = ann.tuned_probes(index, others, "query_id", "query_vector", 10, 0.97)
    true = ann.exact_search(index, queries, "query_id", "query_vector", 10, probes, 200)
    near = ann.search(index, queries, "query_id", "query_vector", 10, probes, 200).select("query_id", F.col("distance").alias("near"), "place")
    both = true.join(near, ["query_id", "place"], "left").groupBy("query_id").agg(F.count("*").alias("n_true"), F.max("distance").alias("far"), F.collect_list("near").alias("near"))
    hits = F.size(F.filter("near", lambda x: x <= F.col("far") + 1e-6))  # ties count
    return both.select("query_id", "n_true", hits.alias("n_found"), (hits / F.col("n_true")).alias("recall"), F.lit(probes).alias("probes"), F.lit(len(index.sizes)).alias("lists"))


@query(
    "hybrid_rrf",
    f"""
    WITH s AS (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS a, CASE WHEN label % 2 = 0 THEN n_chars END AS b FROM embeddings JOIN documents ON vec_id = doc_id),
         x AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY a DESC, vec_id)) AS r FROM s UNION ALL SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY b DESC, vec_id)) FROM s WHERE b IS NOT NULL)
    SELECT vec_id, round(sum(r), 6) AS relevance FROM x GROUP BY 1
    """,
)
def hybrid_rrf(spark, sf_dir):
    rows = _vectors(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    rows = rows.select("vec_id", F.round(tn.dot(F.col("v"), _query(spark, sf_dir)), 6).alias("a"), F.when(F.col("label") % 2 == 0, F.col("n_chars")).cast("double").alias("b"))
    return r.reciprocal_rank_fusion(rows, ["a", "b"], "vec_id", most=None).select("vec_id", F.round("relevance", 6).alias("relevance"))


@query("hybrid_linear", f"SELECT vec_id, round(0.7 * list_inner_product(embedding::DOUBLE[], {_Q}) + 0.3 * coalesce(quality, 0), 6) AS relevance FROM embeddings LEFT JOIN labels ON vec_id = doc_id")
def hybrid_linear(spark, sf_dir):
    rows = _vectors(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    return rows.select("vec_id", F.round(r.linear_fusion(tn.dot(F.col("v"), _query(spark, sf_dir)), F.col("quality").cast("double"), 0.7), 6).alias("relevance"))


@query(
    "near_dup_collapse",
    """
    WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1000)
    SELECT vec_id FROM t i WHERE coalesce((SELECT max(greatest(0, list_inner_product(i.v, j.v))) FROM t j WHERE j.vec_id < i.vec_id), 0) < 0.9
    """,
)
def near_dup_collapse(spark, sf_dir):
    """V13 works on a result list, here the first 1,000 hits: a top-k is the feature."""
    return v.near_duplicates_collapsed(_vectors(spark, sf_dir), "v", "vec_id", 0.9, most=1000).select("vec_id")


_PIECES = "[e[1:16], e[17:32], e[33:48], e[49:64]]"


@query(
    "maxsim",
    f"""
    WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT vec_id, {_PIECES} AS ps FROM t), q AS (SELECT ps AS qs FROM d WHERE vec_id = 7),
         p AS (SELECT vec_id, qi, max(list_inner_product(qs[qi], ps[pi])) AS m FROM d, q, unnest([1, 2, 3, 4]) AS a(qi), unnest([1, 2, 3, 4]) AS b(pi) GROUP BY 1, 2)
    SELECT vec_id, round(sum(m), 6) AS score FROM p GROUP BY 1
    """,
)
def maxsim(spark, sf_dir):
    cut = lambda a: F.array(*[tn.sliced(a, k, k + 16) for k in range(0, 64, 16)])
    rows = _vectors(spark, sf_dir).select("vec_id", cut(F.col("v")).alias("ps"))
    return rows.select("vec_id", F.round(tn.max_sim(cut(_query(spark, sf_dir)), F.col("ps")), 6).alias("score"))


@query(
    "multi_vector_min",
    f"""
    WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e[1:16] AS q FROM t WHERE vec_id = 7),
         p AS (SELECT vec_id, pi, list_distance({_PIECES}[pi], q) AS d FROM t, q, unnest([1, 2, 3, 4]) AS b(pi))
    SELECT vec_id, round(min(d), 6) AS distance, CAST(arg_min(pi, d) AS INTEGER) AS label FROM p GROUP BY 1
    """,
)
def multi_vector_min(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(k + 1).alias("label"), tn.sliced(F.col("v"), 16 * k, 16 * k + 16).alias("v")) for k in range(4)])
    rows = _vectors(spark, sf_dir).select("vec_id", cells.alias("cells"))
    return v.sub_vector_minimum(rows, "vec_id", "cells", tn.sliced(_query(spark, sf_dir), 0, 16)).select("vec_id", F.round("distance", 6).alias("distance"), "label")


@query(
    "second_phase_rerank",
    f"""
    WITH f AS (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], {_Q}) AS s FROM embeddings), b AS (SELECT vec_id FROM f ORDER BY s DESC, vec_id LIMIT 20)
    SELECT f.vec_id, CASE WHEN b.vec_id IS NULL THEN 1 ELSE 2 END AS phase, round(CASE WHEN b.vec_id IS NULL THEN s ELSE label + s END, 6) AS relevance FROM f LEFT JOIN b ON f.vec_id = b.vec_id
    """,
)
def second_phase_rerank(spark, sf_dir):
    base = r.Profile("base", first=lambda s: tn.dot(F.col("v"), s.q("q")))
    child = r.Profile("child", parents=(base,), second=lambda s: F.col("label") + F.col("first_phase"), rerank=20)
    return r.ranked(_vectors(spark, sf_dir), child, "vec_id", {"q": _query(spark, sf_dir)}).select("vec_id", "phase", F.round("relevance", 6).alias("relevance"))


@query("tensor_features", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(list_max(embedding::DOUBLE[]), 6) AS high, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def tensor_features(spark, sf_dir):
    x = F.col("v")
    return _vectors(spark, sf_dir).select("vec_id", F.round(tn.reduce_dense(x, "sum"), 5).alias("total"), F.round(tn.reduce_dense(x, "max"), 6).alias("high"), F.round(tn.norm(x), 6).alias("norm"))


@query("gbdt_score", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN CASE WHEN p_retailprice <= 950 THEN 0.1 ELSE 0.3 END ELSE -0.2 END + CASE WHEN p_retailprice <= 1000 THEN 0.05 ELSE 0.5 END AS score FROM part")
def gbdt_score(spark, sf_dir):
    leaf = lambda x: {"value": x}
    trees = [
        {"feature": "p_size", "threshold": 20, "left": {"feature": "p_retailprice", "threshold": 950, "left": leaf(0.1), "right": leaf(0.3)}, "right": leaf(-0.2)},
        {"feature": "p_retailprice", "threshold": 1000, "left": leaf(0.05), "right": leaf(0.5)},
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(r.tree_ensemble(trees), 6).alias("score"))
