"""Tensor functions: dense tensors are arrays, mapped ones maps, mixed ones arrays of ``struct<label, v>``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def literal(values) -> Column:
    """A dense tensor from Python numbers."""
    return F.array(*[F.lit(float(v)) for v in values])


def mapped_literal(cells: dict) -> Column:
    """X17."""
    return F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), F.lit(float(v)))])


def join_dense(a: Column, b: Column, f) -> Column:
    """X1."""
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def join_mapped(a: Column, b: Column, f) -> Column:
    """Over the labels that both hold."""
    both = F.map_filter(a, lambda k, _: F.map_contains_key(b, k))
    return F.transform_values(both, lambda k, v: f(v.cast("double"), F.element_at(b, k).cast("double")))


def total(a: Column) -> Column:
    """The sum of a dense tensor."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def reduce_dense(a: Column, how: str) -> Column:
    """``sum``, ``max``, ``min``, ``avg`` or ``count``."""
    return {"sum": total(a), "max": F.array_max(doubles(a)), "min": F.array_min(doubles(a)), "avg": total(a) / F.size(a), "count": F.size(a)}[how]


def sparse_dot(a: Column, b: Column) -> Column:
    """The sum of products over common labels."""
    return F.aggregate(F.map_values(join_mapped(a, b, lambda x, y: x * y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """X4."""
    return F.aggregate(join_dense(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalised(a: Column) -> Column:
    """Unchanged where the length is 0."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    """X6, V15."""
    return F.sqrt(F.aggregate(join_dense(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def angular(a: Column, b: Column) -> Column:
    """The angle."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b))))


def prenormalised_angular(a: Column, b: Column) -> Column:
    """``1 - dot`` for vectors of length 1."""
    return 1 - dot(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of arrays of bytes."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")).bitwiseAND(F.lit(255)))), F.lit(0), lambda s, x: s + x
    )


DISTANCES = {"angular": angular, "prenormalized-angular": prenormalised_angular, "euclidean": euclidean, "hamming": hamming}


def closeness(distance: Column) -> Column:
    """X5."""
    return 1.0 / (1.0 + distance)


def packed_bits(a: Column) -> Column:
    """Signs of 8 values to a signed byte each, first value in the highest bit."""
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 8).cast("int") - 1), lambda i: F.slice(a, i * 8 + 1, F.lit(8)))
    weight = F.array(*[F.lit(1 << (7 - k)) for k in range(8)])
    byte = lambda g: F.aggregate(F.transform(g, lambda x, i: F.when(x > 0, F.element_at(weight, i + 1)).otherwise(F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.transform(F.transform(groups, byte), lambda v: F.when(v > 127, v - 256).otherwise(v).cast("tinyint"))


def unpacked_bits(a: Column) -> Column:
    """A byte to eight 0/1 values, highest bit first."""
    bits = F.array(*[F.lit(1 << (7 - k)) for k in range(8)])
    return F.flatten(F.transform(a, lambda b: F.transform(bits, lambda m: F.when(b.cast("int").bitwiseAND(m) != 0, F.lit(1.0)).otherwise(F.lit(0.0)))))


def mapped(a: Column, f) -> Column:
    """X15."""
    return F.transform(a, f)


def sliced(a: Column, start: int, stop: int) -> Column:
    """A part of a dense tensor, from 0, stop exclusive."""
    return F.slice(a, start + 1, stop - start)


def concatenated(*parts: Column) -> Column:
    """X16."""
    return F.concat(*parts)


def min_max_scaled(a: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """All ``low`` where the values are equal."""
    least, most = F.array_min(doubles(a)), F.array_max(doubles(a))
    return F.transform(a, lambda x: F.when(most > least, low + (high - low) * (x.cast("double") - least) / (most - least)).otherwise(F.lit(low)))


def byte_cells(a: Column, scale: float = 127.999) -> Column:
    """Cut to integers in the range of a signed byte."""
    return F.transform(a, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), (x.cast("double") * scale).cast("int"))).cast("tinyint"))


def top_mean(cells: Column, n: int) -> Column:
    """Mean of the ``n`` largest values of a map or array."""
    best = F.slice(F.reverse(F.array_sort(cells)), 1, n)
    return F.when(F.size(best) > 0, total(best) / F.size(best))


def top_labels(cells: Column, n: int) -> Column:
    """Labels of the ``n`` largest values; ties go to the smaller label."""
    entries = F.transform(F.map_entries(cells), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["k"])


def max_sim(query: Column, doc: Column, similarity=dot) -> Column:
    """For arrays of vectors, the sum over the query's of the best similarity with the document's."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: similarity(q, d)))), F.lit(0.0), lambda s, x: s + x)


def max_sim_by_context(query: Column, contexts: Column, across: bool) -> Column:
    """X11: contexts is an array of arrays of vectors; the best context's score, or scores over all contexts at once."""
    return max_sim(query, F.flatten(contexts)) if across else F.array_max(F.transform(contexts, lambda c: max_sim(query, c)))


def nearest_label(cells: Column, query: Column, distance=euclidean) -> Column:
    """Of ``array<struct<label, v>>``, the label of the nearest vector; ties go to the smaller label."""
    return F.array_min(F.transform(cells, lambda c: F.struct(distance(c["v"], query).alias("d"), c["label"].alias("label"))))["label"]


def matrix_product(matrix: np.ndarray):
    """A UDF for ``v @ matrix``; the matrix is part of the function."""
    matrix = np.asarray(matrix, dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else (np.asarray(x, np.float64) @ matrix).tolist())

    return run


def query_network(weights: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray, epsilon: float = 1e-5):
    """A UDF for ``relu(W x + b)``, layer normalisation without parameters, residual, for each layer; then a dot product."""
    layers = [(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in weights]
    last = np.asarray(out, np.float64)

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, np.float64) for a in v]) if len(v) else np.zeros((0, len(last)))
        for w, b in layers:
            h = np.maximum(x @ w.T + b, 0)
            h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + epsilon)
            x = x + h
        return pd.Series(x @ last)

    return run


def similarity_grid(patch: Column, columns: int) -> tuple[Column, Column]:
    """Row and column of a patch number in a grid."""
    return F.floor(patch / columns).cast("int"), (patch % columns).cast("int")
