"""Joins: closed intervals on a key, reference lookups, matching two sides, pairwise comparison of a bounded list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.dyadic import meeting_intervals, points_in_intervals
from tarn.operators.order import counted_before


def interval_join(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", unit: float | None = None) -> DataFrame:
    """Pairs with equal keys and ``max(start) <= min(end)``; bounds are closed, duplicates stay.

    Other columns of the sides get the prefixes ``a_`` and ``b_``; ``start`` and ``end`` are the
    intersection. With a ``unit`` (and always without keys) intervals meet by dyadic cells of that many units and its doublings,
    so that a key with many intervals, of seconds and of years, is spread over tasks, and an interval is at most twice as many rows as the logarithm
    of its length in units. Null bounds and empty intervals (start after end) join nothing.
    """
    a, b = (df.where(F.col(start) <= F.col(end)) for df in (a, b))
    name = lambda df, p: df.select(*[F.col(k).alias(f"__{p}{k}") for k in keys], *[F.col(c).alias(p + c) for c in df.columns if c not in keys])
    left, right = name(a, "a_"), name(b, "b_")
    on = [(f"__a_{k}", f"__b_{k}") for k in keys]
    if unit or not keys:
        pairs = meeting_intervals(left, right, on, (f"a_{start}", f"a_{end}"), (f"b_{start}", f"b_{end}"), unit or 1)
    else:
        pairs = left.join(right, [F.col(x) == F.col(y) for x, y in on])
        pairs = pairs.where((F.col(f"a_{start}") <= F.col(f"b_{end}")) & (F.col(f"b_{start}") <= F.col(f"a_{end}")))
    own = [F.col(f"__a_{k}").alias(k) for k in keys]
    pairs = pairs.select(*own, *[F.col(c) for c in left.columns + right.columns if not c.startswith("__")])
    return pairs.withColumn("start", F.greatest(f"a_{start}", f"b_{start}")).withColumn("end", F.least(f"a_{end}", f"b_{end}"))


def interval_semi_join(b: DataFrame, a: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``b`` that meet an interval of ``a`` of the same key, each once; null and empty intervals meet nothing."""
    a, b = (df.where(F.col(start) <= F.col(end)) for df in (a, b))
    other = a.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(start).alias("__s"), F.col(end).alias("__e"))
    cond = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)] + [F.col("__s") <= F.col(end), F.col(start) <= F.col("__e")]
    return b.join(other, cond, "left_semi")


def import_parent(child: DataFrame, parent: DataFrame, reference: str, parent_id: str, fields: dict[str, str]) -> DataFrame:
    """Parent fields by reference, null where there is no parent. Spark broadcasts a parent under its threshold."""
    own = parent.select(F.col(parent_id).alias("__ref"), *[F.col(f).alias(to) for f, to in fields.items()])
    return child.join(own, F.col(reference) == F.col("__ref"), "left").drop("__ref")


def enriched(docs: DataFrame, lookup: DataFrame, key: str, field: str) -> DataFrame:
    """``field`` from the lookup where there is one, else as it was."""
    found = lookup.select(F.col(key).alias("__k"), F.col(field).alias("__new"))
    own = F.col(field) if field in docs.columns else F.lit(None)
    return docs.join(found, F.col(key) == F.col("__k"), "left").withColumn(field, F.coalesce("__new", own)).drop("__k", "__new")


def required_row(df: DataFrame, condition: Column, what: str):
    """The one row of a lookup on the read path; an error where there is none."""
    row = df.where(condition).first()
    if row is None:
        raise LookupError(f"{what} not found")
    return row


def two_sided_match(left: DataFrame, right: DataFrame, condition: Column, score: Column, left_id: str, right_id: str, n: int, on: Sequence[str] = ()) -> DataFrame:
    """For each left row the ``n`` best right rows that satisfy the condition; ``on`` names equal keys, if any."""
    pairs = left.join(right, [*[F.col(f"l_{k}") == F.col(f"r_{k}") for k in on], condition]) if on else left.join(right, condition)
    place = F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc("score"), F.col(right_id)))
    return pairs.withColumn("score", score).withColumn("place", place).where(F.col("place") <= n)


def band_match(left: DataFrame, right: DataFrame, low: str, high: str, value: str, score: Column, left_id: str, right_id: str, n: int, on: Sequence[tuple[str, str]] = (), unit: float = 1) -> DataFrame:
    """For each left row the ``n`` best right rows whose ``value`` lies in its ``low`` to ``high``, with or without equal columns; columns must differ between the sides.

    Values meet bands by dyadic cells, an equal join; each task keeps ``n`` rows of a left row before they are shuffled by it.
    """
    pairs = points_in_intervals(right, left, value, low, high, [(r, k) for k, r in on], unit)
    place = F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc("score"), F.col(right_id)))
    return pairs.withColumn("score", score).withColumn("place", place).where(F.col("place") <= n)


def nearest_match(left: DataFrame, right: DataFrame, centre: str, low: str, high: str, value: str, score: Column, left_id: str, right_id: str, n: int, path: str, on: Sequence[tuple[str, str]] = (), unit: float = 1) -> DataFrame:
    """J18 as :func:`band_match`, for a ``score`` that never rises as ``value`` goes away from ``centre``: what is joined does not grow with the rows within a band.

    The different values of the right side, each with its ``n`` least ids, and the centres are put in one order by ranges (tables under ``path``), where a centre learns
    its place among the values. Only the ``n + 1`` values on either side of it are joined, by their places. Where the last of those scores no less than the ``n``-th
    best, or a band does not hold its centre, places do not decide, and those rows go through :func:`band_match`.
    """
    spark = left.sparkSession
    keys = [f"__k{i}" for i in range(len(on))]
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    asked = left.where(known(centre)).select("*", *[F.col(a).alias(k) for (a, _), k in zip(on, keys, strict=True)], F.col(centre).alias("__c"))
    least = right.where(known(value)).select("*", *[F.col(b).alias(k) for (_, b), k in zip(on, keys, strict=True)], F.col(value).alias("__v"))
    least = least.withColumn("__first", F.row_number().over(Window.partitionBy(*keys, "__v").orderBy(right_id))).where(F.col("__first") <= n).drop("__first")
    marked = lambda rows, x, is_value: rows.select(*keys, F.col(x).alias("__x")).distinct().withColumn("__after", F.lit(not is_value))
    merged = counted_before(marked(least, "__v", True).unionByName(marked(asked, "__c", False)), [*keys, "__x", "__after"], ~F.col("__after"), "__place", f"{path}/ordered")
    around = F.sequence(F.col("__place") - n - 1, F.col("__place") + n)
    slots = merged.where("__after").select(*keys, F.col("__x").alias("__c"), F.posexplode(around).alias("__slot", "__place"))
    near = slots.join(merged.where("NOT __after").select(*keys, F.col("__x").alias("__v"), "__place"), [*keys, "__place"]).drop("__place")
    pairs = asked.join(near, [*keys, "__c"]).where((F.col("__v") >= F.col(low)) & (F.col("__v") <= F.col(high))).join(least, [*keys, "__v"])
    mine = Window.partitionBy(left_id)
    place = F.row_number().over(mine.orderBy(F.desc("score"), F.col(right_id)))
    scored = pairs.withColumn("score", score).withColumn("place", place)
    last = F.min(F.when(F.col("place") <= n, F.col("score"))).over(mine)
    open_ = F.max(F.col("__slot").isin(0, 2 * n + 1) & (F.col("score") >= last)).over(mine)
    scored.withColumn("__open", open_).where((F.col("place") <= n) | F.col("__open")).drop(*keys, "__c", "__v", "__slot").write.parquet(f"{path}/matched")
    found = spark.read.parquet(f"{path}/matched")
    outside = left.where(~((F.col(centre) >= F.col(low)) & (F.col(centre) <= F.col(high))) & (F.col(low) <= F.col(high)))
    others = found.where("__open").select(left_id).union(outside.select(left_id)).distinct()
    settled = found.where(F.col("place") <= n).drop("__open")
    if others.isEmpty():
        return settled
    plain = band_match(left.join(others, left_id, "left_semi"), right, low, high, value, score, left_id, right_id, n, on, unit)
    return settled.join(others, left_id, "left_anti").unionByName(plain.select(*settled.columns))


def bucket_join(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_buckets: str, query_buckets: str) -> DataFrame:
    """Pairs of a query and a document that share a bucket, once each."""
    d = docs.withColumn("__bucket", F.explode(F.array_distinct(doc_buckets)))
    q = queries.withColumn("__bucket", F.explode(F.array_distinct(query_buckets)))
    return d.join(q, "__bucket").dropDuplicates([doc_id, query_id]).drop("__bucket")


def bucket_partners(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_buckets: str, query_buckets: str) -> DataFrame:
    """J19 counted: for each document that shares a bucket with a query, ``partners``, the number of such queries, and ``last``, the largest of their ids.

    Rows with the same set of buckets have the same partners, so classes of them are joined, and a document takes the result of its class: what is joined grows with
    the different sets, not with the pairs. Rows of one id are taken together.
    """

    def members(rows: DataFrame, id_col: str, buckets: str) -> DataFrame:
        each = rows.select(F.col(id_col).alias("__id"), F.explode(buckets).alias("__b")).where("__b IS NOT NULL")
        return each.groupBy("__id").agg(F.sort_array(F.collect_set("__b")).alias("__set"))

    d, q = members(docs, doc_id, doc_buckets), members(queries, query_id, query_buckets)
    asked = q.groupBy(F.col("__set").alias("__asked")).agg(F.count("*").alias("__n"), F.max("__id").alias("__last"))
    kinds = d.select(F.col("__set").alias("__kind")).distinct()
    # a pair of classes is taken at the least bucket that they share, hence once
    pairs = kinds.withColumn("__b", F.explode("__kind")).join(asked.withColumn("__b", F.explode("__asked")), "__b").where(F.col("__b") == F.array_min(F.array_intersect("__kind", "__asked")))
    of_kind = pairs.groupBy("__kind").agg(F.sum("__n").alias("partners"), F.max("__last").alias("last"))
    return d.join(of_kind, F.col("__set") == F.col("__kind")).select(F.col("__id").alias(doc_id), "partners", "last")


def pairwise(top: DataFrame, id_col: str, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """Ordered pairs of different rows of a result list, which is cut to its first ``most`` rows by ``id_col``."""
    cut = top.orderBy(id_col).limit(most)
    side = lambda p: cut.select(F.col(id_col).alias(p + id_col), *[F.col(c).alias(p + c) for c in columns])
    return side("i_").join(side("j_"), F.col(f"i_{id_col}") != F.col(f"j_{id_col}"))


def pairwise_wins(pairs: DataFrame, id_col: str, model: Column) -> DataFrame:
    """For each row how many of its comparisons are above the mean of all."""
    scored = pairs.withColumn("__out", model)
    mean = scored.agg(F.avg("__out").alias("__mean"))
    return scored.join(F.broadcast(mean)).groupBy(F.col(f"i_{id_col}").alias(id_col)).agg(F.sum(F.when(F.col("__out") > F.col("__mean"), 1).otherwise(0)).alias("wins"))


def existing_only(lists: DataFrame, docs: DataFrame, key: str, doc_key: str) -> DataFrame:
    """Rows whose document exists."""
    return lists.join(docs.select(F.col(doc_key).alias(key)).distinct(), key, "left_semi")


def without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the other table."""
    return rows.join(other.select(*keys).distinct(), list(keys), "left_anti")


def in_window(rows: DataFrame, low, high, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that meet a window, filtered before the join; without both limits nothing is joined."""
    if low is None or high is None:
        return rows.limit(0)
    return rows.where((F.col(start) <= high) & (F.col(end) >= low))


def impressions(logs: DataFrame, column: str, catalogue: DataFrame, item: str) -> DataFrame:
    """``"N1-0 N2-1"`` as a row for each shown item with ``clicked``; items that are not in the catalogue go."""
    shown = logs.withColumn("__part", F.explode(F.filter(F.split(column, r"\s+"), lambda x: x != "")))
    cut = F.length("__part") - F.length(F.substring_index("__part", "-", -1)) - 1
    rows = shown.withColumn(item, F.substring(F.col("__part"), F.lit(1), cut)).withColumn("clicked", (F.substring_index("__part", "-", -1) == "1").cast("int"))
    return rows.drop("__part").join(catalogue, item)


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: keys that both tables have, once each."""
    return a.select(*keys).intersect(b.select(*keys))
