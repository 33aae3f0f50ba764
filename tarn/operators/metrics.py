"""Relevance metrics and data sets for learning to rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalar import spread_number


def _placed(rows: DataFrame, query: str, order: Sequence[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def ndcg(rows: DataFrame, query: str, score: str, gain: Column, tie: str, k: int, exponential: bool = True) -> DataFrame:
    """NDCG at ``k`` per query; gains ``2**y - 1`` or ``y``, discount ``log2(place + 1)``; 0 without relevant rows."""
    g = F.pow(F.lit(2.0), gain) - 1 if exponential else gain.cast("double")
    rows = rows.withColumn("__g", g)
    rows = _placed(rows, query, [F.desc(score), F.col(tie)], "__at")
    rows = _placed(rows, query, [F.desc("__g"), F.col(tie)], "__best")
    share = lambda at: F.sum(F.when(F.col(at) <= k, F.col("__g") / F.log2(F.col(at) + 1)).otherwise(0.0))
    sums = rows.groupBy(query).agg(share("__at").alias("dcg"), share("__best").alias("ideal"))
    return sums.select(query, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def mean_reciprocal_rank(rows: DataFrame, query: str, score: str, relevant: Column, tie: str) -> DataFrame:
    """The mean of reciprocal places over all relevant rows of a query."""
    rows = _placed(rows.withColumn("__y", relevant.cast("double")), query, [F.desc(score), F.col(tie)], "__at")
    sums = rows.groupBy(query).agg(F.sum(F.col("__y") / F.col("__at")).alias("a"), F.sum("__y").alias("b"))
    return sums.select(query, F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("mrr"))


def group_auc(rows: DataFrame, query: str, score: str, relevant: Column) -> DataFrame:
    """Area under the curve per query from ranks with ties averaged; null where one class is missing."""
    w = Window.partitionBy(query)
    rows = rows.withColumn("__y", relevant.cast("double"))
    ties = F.count("*").over(w.partitionBy(query, score))
    rank = F.rank().over(w.orderBy(score)) + (ties - 1) / 2.0
    sums = rows.withColumn("__r", rank).groupBy(query).agg(F.sum(F.col("__r") * F.col("__y")).alias("r"), F.sum("__y").alias("p"), F.count("*").alias("n"))
    negatives = F.col("n") - F.col("p")
    return sums.select(query, F.when((F.col("p") > 0) & (negatives > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * negatives)).alias("auc"))


def at_k(rows: DataFrame, query: str, score: str, relevant: Column, tie: str, k: int) -> DataFrame:
    """E5: accuracy, precision, recall, first reciprocal rank and average precision at ``k``."""
    rows = _placed(rows.withColumn("__y", relevant.cast("int")), query, [F.desc(score), F.col(tie)], "__at")
    seen = F.sum("__y").over(Window.partitionBy(query).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__seen", seen).withColumn("__in", (F.col("__at") <= k) & (F.col("__y") == 1))
    sums = rows.groupBy(query).agg(
        F.sum(F.when(F.col("__in"), 1).otherwise(0)).alias("hits"),
        F.sum("__y").alias("relevant"),
        F.min(F.when(F.col("__in"), F.col("__at"))).alias("first"),
        F.sum(F.when(F.col("__in"), F.col("__seen") / F.col("__at")).otherwise(0.0)).alias("gain"),
    )
    some = F.col("relevant") > 0
    return sums.select(
        query,
        (F.col("hits") > 0).cast("int").alias("accuracy"),
        (F.col("hits") / k).alias("precision"),
        F.when(some, F.col("hits") / F.col("relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(some, F.col("gain") / F.least(F.col("relevant"), F.lit(k))).otherwise(0.0).alias("map"),
    )


def match_recall(matched: DataFrame, judged: DataFrame, query: str, doc: str) -> DataFrame:
    """Per query the judged documents, those matched, and all matched."""
    hit = judged.join(matched.select(query, doc).distinct().withColumn("__hit", F.lit(1)), [query, doc], "left")
    per = hit.groupBy(query).agg(F.count("*").alias("judged"), F.count("__hit").alias("found"))
    every = matched.groupBy(query).agg(F.count("*").alias("matched"))
    return per.join(every, query, "left").select(query, "judged", "found", F.coalesce("matched", F.lit(0)).alias("matched"), (F.col("found") / F.col("judged")).alias("recall"))


def recall_with_ties(found: DataFrame, exact: DataFrame, query: str, doc: str, distance: str, k: int, tolerance: float = 1e-6) -> DataFrame:
    """Share of the ``k`` found whose distance is at most the exact k-th plus ``tolerance``."""
    limit = _placed(exact, query, [F.col(distance), F.col(doc)], "__at").where(F.col("__at") <= k).groupBy(query).agg(F.max(distance).alias("__limit"))
    mine = _placed(found, query, [F.col(distance), F.col(doc)], "__at").where(F.col("__at") <= k)
    good = mine.join(limit, query).where(F.col(distance) <= F.col("__limit") + tolerance).groupBy(query).agg(F.count("*").alias("n"))
    return limit.join(good, query, "left").select(query, (F.coalesce("n", F.lit(0)) / k).alias("recall"))


def hard_negatives(retrieved: DataFrame, positives: DataFrame, query: str, doc: str) -> DataFrame:
    """Retrieved documents that are no positives, of queries that have both."""
    left = retrieved.join(positives.select(query, doc), [query, doc], "left_anti")
    return left.join(positives.select(query).distinct(), query, "left_semi").select(query, doc)


def sampled_negatives(rows: DataFrame, group: str, id_col: str, label: Column, per_positive: int, seed: int = 0) -> DataFrame:
    """Positives, and of each group up to ``per_positive`` negatives for each of them, in hashed order."""
    rows = rows.withColumn("__y", label.cast("int"))
    n = F.sum("__y").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group, "__y").orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col))
    return rows.withColumn("__n", n).withColumn("__place", place).where((F.col("__y") == 1) | (F.col("__place") <= F.col("__n") * per_positive)).drop("__n", "__place", "__y")


def mixed_labels_only(rows: DataFrame, group: str, label: Column) -> DataFrame:
    """groups with both a positive and a negative."""
    counts = rows.groupBy(group).agg(F.sum(label.cast("int")).alias("p"), F.count("*").alias("n")).where("p > 0 AND p < n")
    return rows.join(counts.select(group), group, "left_semi")


def folds(rows: DataFrame, key: str, k: int, name: str = "fold") -> DataFrame:
    """A fold per key, never per row."""
    return rows.withColumn(name, F.pmod(spread_number(0, F.col(key)), F.lit(k)).cast("int"))


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows in hashed order; the same on every run."""
    return rows.orderBy(spread_number(seed, F.col(key)), key).limit(n)


def nested_subsets(rows: DataFrame, order: str, sizes: Sequence[int]) -> DataFrame:
    """Each row with the smallest of the nested prefixes that holds it, null beyond all."""
    cut = rows.orderBy(order).limit(max(sizes))
    place = cut.withColumn("__at", F.row_number().over(Window.orderBy(order)))
    smallest = F.lit(None).cast("long")
    for s in sorted(sizes, reverse=True):
        smallest = F.when(F.col("__at") <= s, F.lit(s)).otherwise(smallest)
    return place.withColumn("subset", smallest).drop("__at")


def judged_and_sampled(docs: DataFrame, judged: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Every judged document, and ``n`` others."""
    own = docs.join(judged.select(key).distinct(), key, "left_semi")
    return own.unionByName(hashed_sample(docs.join(judged.select(key).distinct(), key, "left_anti"), key, n, seed))


def training_rows(relevant: DataFrame, retrieved: DataFrame, query: str, doc: str, per_query: int) -> DataFrame:
    """Relevant pairs with label 1, and of each query's other retrieved documents the first ``per_query`` with label 0."""
    others = retrieved.join(relevant.select(query, doc), [query, doc], "left_anti")
    others = _placed(others, query, [F.desc("score"), F.col(doc)], "__at").where(F.col("__at") <= per_query)
    return relevant.select(query, doc, F.lit(1).alias("label")).unionByName(others.select(query, doc, F.lit(0).alias("label")))


def factorised(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 50, seed: int = 1, penalty: float = 0.1, alpha: float = 1.0):
    """User and item vectors by implicit alternating least squares; users are solved last, so their vectors satisfy the normal equations of the items'."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=rank, implicitPrefs=True, userCol=user, itemCol=item, ratingCol=rating, seed=seed, maxIter=5, regParam=penalty, alpha=alpha).fit(ratings)
    return model.userFactors, model.itemFactors
