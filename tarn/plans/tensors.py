"""Tensor expressions over the ``embeddings`` table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarn.functions import tensor as tn
from tarn.operators import vector as v
from tarn.plans.registry import query, table
from tarn.plans.vectors import _query, _vectors

_E = "t AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM t WHERE vec_id = 7)"


def _r(column, name, digits=6):
    return F.round(column, digits).alias(name)


@query(
    "context_max_sim",
    f"""
    WITH {_E}, c AS (SELECT vec_id, [[e[1:16], e[17:32]], [e[33:48], e[49:64]]] AS cs, [qe[1:16], qe[17:32]] AS qs FROM t, q),
    p AS (SELECT vec_id, qi, ci, max(list_inner_product(qs[qi], cs[ci][pi])) AS s FROM c, unnest([1, 2]) AS a(qi), unnest([1, 2]) AS b(ci), unnest([1, 2]) AS d(pi) GROUP BY 1, 2, 3)
    SELECT vec_id, round((SELECT max(x) FROM (SELECT sum(s) AS x FROM p y WHERE y.vec_id = c.vec_id GROUP BY ci)), 6) AS best, round((SELECT sum(x) FROM (SELECT max(s) AS x FROM p y WHERE y.vec_id = c.vec_id GROUP BY qi)), 6) AS across FROM c
    """,
)
def context_max_sim(spark, sf_dir):
    cut = lambda a, k: tn.sliced(a, 16 * k, 16 * k + 16)
    asked = _query(spark, sf_dir)
    tokens = F.array(cut(asked, 0), cut(asked, 1))
    contexts = F.array(F.array(cut(F.col("v"), 0), cut(F.col("v"), 1)), F.array(cut(F.col("v"), 2), cut(F.col("v"), 3)))
    rows = _vectors(spark, sf_dir)
    return rows.select("vec_id", _r(tn.max_sim_by_context(tokens, contexts, False), "best"), _r(tn.max_sim_by_context(tokens, contexts, True), "across"))


@query(
    "tensor_distances",
    f"WITH {_E} SELECT vec_id, round(acos(least(1.0, greatest(-1.0, list_cosine_similarity(e, qe)))), 4) AS angle, round(1 - list_inner_product(e, qe), 6) AS prenormalised, round(1 / (1 + list_distance(e, qe)), 6) AS closeness FROM t, q WHERE vec_id <> 7",
)
def tensor_distances(spark, sf_dir):
    x, q = F.col("v"), _query(spark, sf_dir)
    rows = _vectors(spark, sf_dir).where("vec_id <> 7")
    return rows.select("vec_id", _r(tn.angular(x, q), "angle", 4), _r(tn.prenormalised_angular(x, q), "prenormalised"), _r(tn.closeness(tn.euclidean(x, q)), "closeness"))


@query(
    "tensor_cells",
    f"""
    WITH {_E} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS squares, CAST(list_sum(list_transform(e, lambda x: trunc(x * 127.999))) AS BIGINT) AS bytes,
    round((e[1] - list_min(e)) / (list_max(e) - list_min(e)), 6) AS scaled, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS unit, len(e[1:4] || e[1:2]) AS joined FROM t
    """,
)
def tensor_cells(spark, sf_dir):
    x = F.col("v")
    whole = F.aggregate(tn.byte_cells(x), F.lit(0).cast("long"), lambda s, b: s + b.cast("long"))
    return _vectors(spark, sf_dir).select(
        "vec_id", _r(tn.total(tn.mapped(x, lambda y: y * y)), "squares"), whole.alias("bytes"), _r(tn.min_max_scaled(x)[0], "scaled"), _r(tn.l2_normalised(x)[0], "unit"),
        F.size(tn.concatenated(tn.sliced(x, 0, 4), tn.sliced(x, 0, 2))).cast("long").alias("joined"),
    )


_MATRIX = [[1.0, 0.5], [-0.25, 2.0], [0.75, -1.0]]


@query(
    "projected_vectors",
    f"""
    WITH {_E}, p AS (SELECT vec_id, e[1] - 0.25 * e[2] + 0.75 * e[3] AS a, 0.5 * e[1] + 2 * e[2] - e[3] AS b FROM t)
    SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(a / sqrt(a * a + b * b), 6) AS unit FROM p
    """,
)
def projected_vectors(spark, sf_dir):
    """A product with a constant matrix, then unit length."""
    rows = _vectors(spark, sf_dir).select("vec_id", tn.matrix_product(np.array(_MATRIX))(F.slice("v", 1, 3)).alias("p"))
    return rows.select("vec_id", _r(F.col("p")[0], "a"), _r(F.col("p")[1], "b"), _r(tn.l2_normalised(F.col("p"))[0], "unit"))


@query(
    "query_network",
    f"""
    WITH {_E}, h AS (SELECT vec_id, e[1] AS a, e[2] AS b, greatest(0, 2 * e[1] - e[2] + 0.5) AS x, greatest(0, e[1] + 3 * e[2]) AS y FROM t),
    m AS (SELECT *, (x + y) / 2 AS mean, sqrt(((x - (x + y) / 2) ** 2 + (y - (x + y) / 2) ** 2) / 2 + 1e-5) AS sd FROM h)
    SELECT vec_id, round(0.5 * (a + (x - mean) / sd) - (b + (y - mean) / sd), 5) AS score FROM m
    """,
)
def query_network(spark, sf_dir):
    network = tn.query_network([(np.array([[2.0, -1.0], [1.0, 3.0]]), np.array([0.5, 0.0]))], np.array([0.5, -1.0]))
    return _vectors(spark, sf_dir).select("vec_id", _r(network(F.slice("v", 1, 2)), "score", 5))


@query("patch_grid", "SELECT vec_id, CAST(vec_id // 32 AS INTEGER) AS \"row\", CAST(vec_id % 32 AS INTEGER) AS \"column\", round(embedding[1]::DOUBLE, 6) AS similarity FROM embeddings")
def patch_grid(spark, sf_dir):
    row, column = tn.similarity_grid(F.col("vec_id"), 32)
    return _vectors(spark, sf_dir).select("vec_id", row.alias("row"), column.alias("column"), _r(F.col("v")[0], "similarity"))


@query("top_cells", "SELECT vec_id, round((SELECT avg(x) FROM (SELECT unnest(embedding[1:8]::DOUBLE[]) AS x ORDER BY x DESC LIMIT 3)), 6) AS top_mean FROM embeddings")
def top_cells(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _r(tn.top_mean(F.slice("v", 1, 8), 3), "top_mean"))


@query(
    "nearest_label",
    f"""
    WITH {_E}, p AS (SELECT vec_id, pi, list_distance([e[1:16], e[17:32], e[33:48], e[49:64]][pi], qe[1:16]) AS d FROM t, q, unnest([1, 2, 3, 4]) AS b(pi))
    SELECT vec_id, CAST(arg_min(pi, d) AS INTEGER) AS label FROM p GROUP BY 1
    """,
)
def nearest_label(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(k + 1).alias("label"), tn.sliced(F.col("v"), 16 * k, 16 * k + 16).alias("v")) for k in range(4)])
    return _vectors(spark, sf_dir).select("vec_id", tn.nearest_label(cells, tn.sliced(_query(spark, sf_dir), 0, 16)).alias("label"))


@query("unpacked_bits", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS DOUBLE) AS ones FROM embeddings")
def unpacked_bits(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", tn.total(tn.unpacked_bits(tn.packed_bits(F.col("v")))).alias("ones"))


@query(
    "mapped_tensor_join",
    "SELECT o_custkey, CAST(sum(2 * n) AS DOUBLE) AS dot FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) WHERE p IN ('1-URGENT', '5-LOW') GROUP BY 1",
)
def mapped_tensor_join(spark, sf_dir):
    from tarn.operators.grouping import count_map

    profile = tn.mapped_literal({"1-URGENT": 2.0, "5-LOW": 2.0})
    rows = count_map(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return rows.select("o_custkey", tn.sparse_dot(F.col("counts"), profile).alias("dot")).where("dot > 0")


@query("doubled_hits", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 9)), 6) AS distance FROM embeddings WHERE label % 2 = 1 ORDER BY 2, 1 LIMIT 5")
def doubled_hits(spark, sf_dir):
    best = v.nearest(_vectors(spark, sf_dir), "v", _query(spark, sf_dir, 9), "vec_id", 5, condition=F.col("label") % 2 == 1)
    return best.select("vec_id", _r(F.col("distance"), "distance"))
