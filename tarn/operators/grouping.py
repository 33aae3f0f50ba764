"""Grouping and aggregation of hits, and the list, map and statistics aggregates of data preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.order import exact_percentiles


def facet(hits: DataFrame, key: Column, aggregates: Sequence[Column], order: Sequence[Column] = (), limit: int | None = None, name: str = "key") -> DataFrame:
    """A1-A5: one group per value, aggregates, groups in an order of aggregates (then by key), the first ``limit``."""
    groups = hits.groupBy(key.alias(name)).agg(*aggregates)
    if order or limit is not None:
        groups = groups.orderBy(*order, F.col(name))
    return groups if limit is None else groups.limit(limit)


def facet_elements(hits: DataFrame, values: Column, aggregates: Sequence[Column], name: str = "key") -> DataFrame:
    """A document counts once for each different element."""
    return hits.withColumn(name, F.explode(F.array_distinct(values))).groupBy(name).agg(*aggregates)


def bucket_label(value: Column, edges: Sequence[float | None]) -> Column:
    """``[low,high)`` labels between neighbouring edges; None is infinity; outside all buckets null."""
    label = F.lit(None).cast("string")
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = (value >= low if low is not None else F.lit(True)) & (value < high if high is not None else F.lit(True))
        text = f"[{'-inf' if low is None else f'{low:g}'},{'inf' if high is None else f'{high:g}'})"
        label = F.when(inside, F.lit(text)).otherwise(label)
    return label


def facet_buckets(hits: DataFrame, value: Column, edges: Sequence[float | None], aggregates: Sequence[Column], name: str = "bucket") -> DataFrame:
    """Rows outside all buckets fall out."""
    return hits.withColumn(name, bucket_label(value, edges)).where(F.col(name).isNotNull()).groupBy(name).agg(*aggregates)


def nested_groups(hits: DataFrame, levels: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Counts at every level: one row per group of each depth (``depth`` 1 is the outermost), deeper keys null."""
    rolled = hits.rollup(*levels).agg(F.grouping_id().alias("__gid"), *aggregates)
    depth = F.lit(len(levels)) - F.bit_count(F.col("__gid"))
    return rolled.withColumn("depth", depth.cast("int")).where("depth > 0").drop("__gid")


def top_hits(hits: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` of each group. Spark cuts each task's rows to ``n`` per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return hits.withColumn(name, place).where(F.col(name) <= n)


def best_groups(hits: DataFrame, key: str, score: str, tie: str, n: int) -> DataFrame:
    """Groups by their best hit, with that hit."""
    best = hits.groupBy(key).agg(F.max_by(F.struct(F.col(score), F.col(tie)), F.struct(F.col(score), -F.col(tie))).alias("b"))
    return best.select(key, F.col(f"b.{score}").alias(score), F.col(f"b.{tie}").alias(tie)).orderBy(F.desc(score), tie).limit(n)


def collapsed(hits: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The best hit of each value."""
    return top_hits(hits, [key], order, 1).drop("place")


def count_map(rows: DataFrame, key: str, value: str, name: str = "counts") -> DataFrame:
    """Value counts as a map per key. Counted before they are gathered."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias(name))


def ordered_list(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str = "items") -> DataFrame:
    """Values of a key in the order of other columns. For keys of bounded length (a basket, a session)."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]).alias(name))


def struct_list(rows: DataFrame, key: str, columns: Sequence[str], name: str = "items") -> DataFrame:
    """Records of a key as an array of structs, sorted."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def click_rates(rows: DataFrame, key: str, clicked: Column) -> DataFrame:
    """Impressions, clicks and their ratio (0 without impressions)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("impressions"), F.sum(F.when(clicked, 1).otherwise(0)).alias("clicks"))
    return counts.withColumn("ctr", F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(F.lit(0.0)))


def as_mapped_tensor(rows: DataFrame, label: str, value: str, name: str = "cells") -> DataFrame:
    """A whole table of bounded size as one map."""
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), F.col(value).cast("double"))))).alias(name))


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """How often each term occurs, and in how many documents (rows).

    A row's terms are sorted within the row, where the first of equal neighbours stands for the document, so
    one aggregate by term, combined in each task first, gives both numbers; no row per term and document is shuffled.
    """
    held = docs.select(F.sort_array(terms).alias("term"))
    pairs = F.arrays_zip("term", F.concat(F.array(F.lit(None).cast("string")), F.col("term")).alias("before"))
    rows = held.select(F.inline(pairs)).where("term IS NOT NULL")  # the zip is one longer than the terms
    return rows.groupBy("term").agg(F.count("*").alias("corpus_count"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("document_count"))


def constant_columns(rows: DataFrame) -> list[str]:
    """Columns of one value at most, null being a value; one pass."""
    stats = rows.agg(*[(F.min(F.col(f"`{c}`").cast("string")).eqNullSafe(F.max(F.col(f"`{c}`").cast("string"))) & ((F.count(F.col(f"`{c}`")) == 0) | (F.count(F.col(f"`{c}`")) == F.count("*")))).alias(c) for c in rows.columns]).first()
    return [c for c in rows.columns if stats[c]]


def flattened_distinct(rows: DataFrame, values: str, drop: Sequence[str] = ()) -> DataFrame:
    """All array elements of all hits, once each, without some."""
    return rows.select(F.explode(values).alias("value")).where(~F.col("value").isin(*drop) if drop else F.lit(True)).distinct()


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key, in key order."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def percentiles(rows: DataFrame, value: str, at: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """One row of exact percentiles, interpolated, found by passes that narrow to their ranks; with ``accuracy`` approximate ones."""
    if accuracy is not None:
        return rows.agg(*[F.percentile_approx(value, p, accuracy).alias(f"p{round(100 * p)}") for p in at])
    found = exact_percentiles(rows, value, at)
    return rows.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(f"p{round(100 * p)}") for p, x in zip(at, found, strict=True)])


def standardised_logistic(rows: DataFrame, features: Sequence[str], label: str, penalty: float = 1e-4):
    """Coefficients and intercept of a logistic regression on standardised features, in the features' own units."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(features), outputCol="__x").transform(rows)
    model = LogisticRegression(featuresCol="__x", labelCol=label, standardization=True, regParam=penalty, tol=1e-8, maxIter=200).fit(assembled)
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept)


def facets_of_best(hits: DataFrame, order: Sequence[Column], most: int | None, facets: dict[str, Column]) -> DataFrame:
    """Several groupings of one request, over the first ``most`` hits or over all: ``facet, key, n``.

    One pass: each hit becomes a row for each facet, and all facets are one aggregate.
    """
    top = hits if most is None else hits.orderBy(*order).limit(most)
    parts = F.array(*[F.struct(F.lit(name).alias("facet"), key.cast("string").alias("key")) for name, key in facets.items()])
    return top.select(F.inline(parts)).groupBy("facet", "key").agg(F.count("*").alias("n"))


def mean_importance(rows: DataFrame, feature: str, gain: str) -> DataFrame:
    """Mean over folds, largest first."""
    return rows.groupBy(feature).agg(F.avg(gain).alias("importance")).orderBy(F.desc("importance"), feature)
