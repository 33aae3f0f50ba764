"""Phased ranking: profiles with inputs, functions and inheritance; re-ranking of the best; score fusion; ensembles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.scalar import spread_number

Scorer = Callable[["Scope"], Column]


class Scope:
    """What a scoring function sees: ``q`` inputs by name, other functions by call, and columns through ``F.col``."""

    def __init__(self, inputs: dict[str, object], functions: dict[str, Scorer]):
        self.inputs, self.functions = inputs, functions

    def q(self, name: str) -> Column:
        value = self.inputs[name]
        return value if isinstance(value, Column) else F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)

    def f(self, name: str) -> Column:
        return self.functions[name](self)


@dataclass(frozen=True)
class Profile:
    """A scoring program; children override what they name, functions are bound late."""

    name: str
    first: Scorer | None = None
    second: Scorer | None = None
    rerank: int | None = None
    last: Scorer | None = None
    last_rerank: int | None = None
    inputs: dict[str, object] = field(default_factory=dict)
    functions: dict[str, Scorer] = field(default_factory=dict)
    features: tuple[str, ...] = ()
    drop_below: float | None = None
    parents: tuple[Profile, ...] = ()

    def resolved(self) -> Profile:
        """With what it inherits, later parents over earlier ones. Counts of re-ranked hits that nobody sets are 100."""
        chain = [p.resolved() for p in self.parents] + [self]
        pick = lambda a: next((getattr(p, a) for p in reversed(chain) if getattr(p, a) is not None), None)
        merged = lambda a: reduce(lambda x, y: {**x, **y}, [getattr(p, a) for p in chain], {})
        return Profile(
            self.name, pick("first"), pick("second"), pick("rerank"), pick("last"), pick("last_rerank"), merged("inputs"), merged("functions"),
            tuple(dict.fromkeys(f for p in chain for f in p.features)), pick("drop_below"),
        )


def ranked(hits: DataFrame, profile: Profile, id_col: str, inputs: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """``relevance``, ``phase`` and the profile's features for every hit, best first.

    The first phase scores every hit; a later one scores the best ``rerank`` of the one
    before and may use ``first_phase``. Rows that a phase did not reach keep their score and
    come after those it did. Hits at or below ``drop_below`` go before re-ranking. Ties go by id.
    """
    p = profile.resolved()
    scope = Scope({**p.inputs, **(inputs or {})}, p.functions)
    rows = hits.withColumn("relevance", (p.first(scope) if p.first else F.lit(0.0)).cast("double")).withColumn("phase", F.lit(1))
    if p.drop_below is not None:
        rows = rows.where(F.col("relevance") > p.drop_below)
    for f in p.features:
        rows = rows.withColumn(f, scope.f(f))
    rows = rows.withColumn("first_phase", F.col("relevance"))
    for phase, scorer, n in ((2, p.second, p.rerank), (3, p.last, p.last_rerank)):
        if scorer is not None:
            rows = reranked(rows, scorer(scope), id_col, 100 if n is None else n, phase)
    ordered = rows.orderBy(F.desc("phase"), F.desc("relevance"), id_col)
    return ordered if limit is None else ordered.limit(limit)


def reranked(rows: DataFrame, score: Column, id_col: str, n: int, phase: int) -> DataFrame:
    """The best ``n`` get a new score. Only their ids pass through one task (a top-n, cut in every task first)."""
    best = rows.orderBy(F.desc("phase"), F.desc("relevance"), id_col).limit(n).select(F.col(id_col).alias("__id"), F.lit(True).alias("__best"))
    tagged = rows.join(F.broadcast(best), F.col(id_col) == F.col("__id"), "left")
    return tagged.withColumn("relevance", F.when(F.col("__best"), score.cast("double")).otherwise(F.col("relevance"))).withColumn("phase", F.when(F.col("__best"), F.lit(phase)).otherwise(F.col("phase"))).drop("__id", "__best")


def places(rows: DataFrame, score: str, id_col: str, name: str, query: str | None = None) -> DataFrame:
    """Places from 1 by falling score, per query if there is one."""
    w = Window.partitionBy(query) if query else Window.partitionBy(F.lit(0))
    return rows.withColumn(name, F.row_number().over(w.orderBy(F.desc(score), F.col(id_col))))


def all_places(rows: DataFrame, score: str, id_col: str, name: str, rows_in_range: int = 50_000) -> DataFrame:
    """O7 for any number of rows: as ``places``, numbered within ranges of score and id, after the rows of the ranges before.

    The limits of the ranges come from a sample by hash of the id, of about 20 rows a range; there are 1,000 ranges at most.
    """
    n = rows.count()
    ranges = min(1000, -(-n // rows_in_range))
    if ranges <= 1:
        return places(rows, score, id_col, name)
    share = min(1.0, 20 * ranges / n)
    picked = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select(F.col(score).alias("s"), F.col(id_col).alias("i"))
    limits = picked.withColumn("n", F.ntile(ranges).over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), "i"))).withColumn("first", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("s"), "i")))
    limits = limits.where("first = 1").agg(F.collect_list(F.struct("s", "i")).alias("__limits"))
    ahead = lambda x: (x["s"] > F.col(score)) | ((x["s"] == F.col(score)) & (x["i"] <= F.col(id_col)))
    ranged = rows.crossJoin(F.broadcast(limits)).withColumn("__range", F.size(F.filter("__limits", ahead))).drop("__limits")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(score), F.col(id_col)))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def reciprocal_rank_fusion(rows: DataFrame, scores: list[str], id_col: str, k: int = 60, most: int | None = 1000, query: str | None = None) -> DataFrame:
    """The sum of ``1 / (k + place)`` over scores; a null score has no place. Per score the best ``most`` take part, or all without it."""
    keys = [query] if query else []
    parts = []
    for s in scores:
        some = rows.where(F.col(s).isNotNull()).select(*keys, id_col, F.col(s).alias("__s"))
        if query is None and most is None:
            placed = all_places(some, "__s", id_col, "__at")
        else:
            if query is None:
                some = some.orderBy(F.desc("__s"), id_col).limit(most)
            placed = places(some, "__s", id_col, "__at", query)
        if most is not None:
            placed = placed.where(F.col("__at") <= most)
        parts.append(placed.select(*keys, id_col, (1.0 / (k + F.col("__at"))).alias("__r")))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, id_col).agg(F.sum("__r").alias("relevance"))


def linear_fusion(a: Column, b: Column, alpha: float) -> Column:
    """A missing score counts 0."""
    return alpha * F.coalesce(a, F.lit(0.0)) + (1 - alpha) * F.coalesce(b, F.lit(0.0))


def linear_model(coefficients: dict[str, float], intercept: float) -> Column:
    """R12."""
    return reduce(lambda s, kv: s + F.lit(kv[1]) * F.col(kv[0]), coefficients.items(), F.lit(intercept))


def tree_ensemble(trees: list[dict], missing_left: bool = True) -> Column:
    """The sum of decision trees as one expression.

    A node is ``{"feature", "threshold", "left", "right"}`` (left where the value is at most
    the threshold) or ``{"value"}``. Null and NaN go left, or right if told so.
    """

    def walk(node: dict) -> Column:
        if "value" in node:
            return F.lit(float(node["value"]))
        x = F.col(node["feature"]).cast("double")
        left = F.coalesce(F.when(F.isnan(x), F.lit(missing_left)).otherwise(x <= node["threshold"]), F.lit(missing_left))
        return F.when(left, walk(node["left"])).otherwise(walk(node["right"]))

    return reduce(lambda a, b: a + b, [walk(t) for t in trees], F.lit(0.0))


def lightgbm_trees(model: dict) -> list[dict]:
    """Trees of a dumped LightGBM model as nodes of :func:`tree_ensemble`."""
    names = model["feature_names"]

    def node(t):
        if "leaf_value" in t:
            return {"value": t["leaf_value"]}
        return {"feature": names[t["split_feature"]], "threshold": t["threshold"], "left": node(t["left_child"]), "right": node(t["right_child"])}

    return [node(t["tree_structure"]) for t in model["tree_info"]]


def xgboost_trees(model: list[dict]) -> list[dict]:
    """Trees of a dumped XGBoost model; its test is "less than", so thresholds move down by the least step."""
    import math

    def node(t):
        if "leaf" in t:
            return {"value": t["leaf"]}
        children = {c["nodeid"]: c for c in t["children"]}
        return {"feature": t["split"], "threshold": math.nextafter(t["split_condition"], -math.inf), "left": node(children[t["yes"]]), "right": node(children[t["no"]])}

    return [node(t) for t in model]


def network_onnx(layers: list[tuple[list[list[float]], list[float], str | None]]) -> bytes:
    """A feed-forward network as an ONNX file from ``x`` to ``y``, written field by field.

    A layer is its weights (a row for each input), its biases and the ONNX operator that follows (``Relu``, ``Sigmoid``, ``Tanh``, ``Softmax``), or none.
    """
    import struct

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(field_no: int, value: int | bytes | str) -> bytes:
        if isinstance(value, int):
            return number(field_no << 3) + number(value)
        raw = value.encode() if isinstance(value, str) else value
        return number(field_no << 3 | 2) + number(len(raw)) + raw

    def tensor(name: str, dims: list[int], values: list[float]) -> bytes:
        return b"".join(part(1, d) for d in dims) + part(2, 1) + part(8, name) + part(9, struct.pack(f"<{len(values)}f", *values))

    def matrix(name: str, width: int) -> bytes:
        shape = part(1, part(2, "n")) + part(1, part(1, width))
        return part(1, name) + part(2, part(1, part(1, 1) + part(2, shape)))

    graph, constants, at = b"", b"", "x"
    for k, (weights, biases, after) in enumerate(layers):
        steps = [("Gemm", [at, f"w{k}", f"b{k}"])] + ([(after, [f"g{k}"])] if after else [])
        for j, (operator, inputs) in enumerate(steps):
            at = "y" if k == len(layers) - 1 and j == len(steps) - 1 else f"g{k}" if j == 0 else f"a{k}"
            graph += part(1, b"".join(part(1, i) for i in inputs) + part(2, at) + part(4, operator))
        constants += part(5, tensor(f"w{k}", [len(weights), len(biases)], [w for row in weights for w in row]))
        constants += part(5, tensor(f"b{k}", [len(biases)], biases))
    graph += part(2, "network") + constants + part(11, matrix("x", len(layers[0][0]))) + part(12, matrix("y", len(layers[-1][1])))
    return part(1, 8) + part(7, graph) + part(8, part(2, 13))


def linear_onnx(weights: list[float], bias: float) -> bytes:
    """A linear model as an ONNX file."""
    return network_onnx([([[w] for w in weights], [bias], None)])


def perceptron_onnx(model) -> bytes:
    """A ``MultilayerPerceptronClassificationModel`` of Spark as an ONNX file: sigmoid layers, then softmax; its output is the model's probability vector."""
    sizes, flat, at, layers = list(model.getLayers()), model.weights.toArray(), 0, []
    for k, (n_in, n_out) in enumerate(zip(sizes, sizes[1:], strict=False)):
        weights = flat[at : at + n_in * n_out].reshape(n_in, n_out)
        biases = flat[at + n_in * n_out : at + (n_in + 1) * n_out]
        at += (n_in + 1) * n_out
        layers.append((weights.tolist(), biases.tolist(), "Softmax" if k == len(sizes) - 2 else "Sigmoid"))
    return network_onnx(layers)


def onnx_scorer(model_bytes: bytes, inputs: list[str], output: str | None = None, column: int = 0):
    """A UDF over float columns for an ONNX model of one input matrix, of whose output it takes a ``column``; one session for each Python worker and model."""

    key = hashlib.sha256(model_bytes).hexdigest()

    @F.pandas_udf(T.DoubleType())
    def run(rows: pd.DataFrame) -> pd.Series:
        import onnxruntime

        session = _sessions.get(key) or _sessions.setdefault(key, onnxruntime.InferenceSession(model_bytes))
        x = rows.to_numpy(np.float32)
        out = session.run([output] if output else None, {session.get_inputs()[0].name: x})[0]
        return pd.Series(np.asarray(out, np.float64).reshape(len(x), -1)[:, column])

    return run(F.struct(*[F.col(c) for c in inputs]))


_sessions: dict = {}


def prompt(hits: DataFrame, fields: list[str], question: str, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` hits as one text, each field as ``name: value``, with the question at the end."""
    part = F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    top = hits.orderBy(*order).limit(n).withColumn("__at", F.row_number().over(Window.orderBy(*order))).withColumn("__t", part)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__t"))), lambda x: x["__t"]), "\n\n")
    return top.agg(F.concat(joined, F.lit(f"\n\nQuestion: {question}")).alias("prompt"))


def random_score(id_col: str, seed: int = 0) -> Column:
    """The same pseudo-random score in [0, 1) on every run."""
    return F.pmod(spread_number(seed, F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)


def popularity_blend(score: Column, clicks: Column, impressions: Column, weight: float = 100.0) -> Column:
    """A text score plus the weighted click rate."""
    return score + weight * F.when(impressions > 0, clicks / impressions).otherwise(F.lit(0.0))


def in_rating_window(score: Column, rating: Column, low: float, high: float, enabled: bool = True, sentinel: float = -200.0) -> Column:
    """The score of rows strictly inside the window, else a sentinel for ``drop_below`` to cut."""
    return F.when((rating > low) & (rating < high), score).otherwise(F.lit(sentinel)) if enabled else score


def sorting_score(attribute: Column, ascending: bool) -> Column:
    """A sort as a score."""
    return (-1.0 if ascending else 1.0) * attribute.cast("double")


def merged_and_trimmed(parts: list[DataFrame], id_col: str, n: int) -> DataFrame:
    """Result lists as one, best score of an id first, cut to ``n``."""
    rows = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.max("relevance").alias("relevance"))
    return rows.orderBy(F.desc("relevance"), id_col).limit(n)
