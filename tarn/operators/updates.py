"""Updates of document tables: put, remove, partial updates, counters, weighted sets; set operations on ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.order import numbered


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of several puts of an id the last one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert(table: DataFrame, puts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Puts replace documents or create them; the last put of an id counts."""
    new = latest(puts, key, order)
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(*table.columns), allowMissingColumns=True)


def removed(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """S14."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def removed_where(table: DataFrame, selection: Column) -> DataFrame:
    """Rows for which the selection is not true stay, null included."""
    return table.where(~F.coalesce(selection, F.lit(False)))


def stale_ids(index: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Ids that the index has and the feed has not."""
    return index.select(key).distinct().join(feed.select(key).distinct(), key, "left_anti")


def assigned(table: DataFrame, ops: DataFrame, key: str, field: str, value: str, seq: str, create: bool = False) -> DataFrame:
    """Ops of ``key, field, value, seq`` overwrite fields; the last write of a field counts. Values are cast."""
    fields = [c for c in table.columns if c != key]
    last = ops.groupBy(key).agg(*[F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(seq))).alias(f"__{f}") for f in fields], *[F.max(F.when(F.col(field) == f, F.col(seq))).alias(f"__s_{f}") for f in fields])
    joined = table.join(last, key, "full" if create else "left")
    types = dict(table.dtypes)
    return joined.select(key, *[F.when(F.col(f"__s_{f}").isNotNull(), F.col(f"__{f}").cast(types[f])).otherwise(F.col(f)).alias(f) for f in fields])


def incremented(table: DataFrame, deltas: DataFrame, key: str, counters: Sequence[str], create: bool = False) -> DataFrame:
    """Sums of deltas added to counters; an unknown id is created or ignored."""
    sums = deltas.groupBy(key).agg(*[F.sum(c).alias(f"__{c}") for c in counters])
    joined = table.join(sums, key, "full" if create else "left")
    others = [c for c in table.columns if c != key and c not in counters]
    return joined.select(key, *others, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in counters])


def rated(items: DataFrame, reviews: DataFrame, item_key: str, stars: str) -> DataFrame:
    """Each review adds its stars and one to its item; reviews without item or stars change nothing."""
    deltas = reviews.where(F.col(stars).isNotNull()).select(item_key, F.col(stars).alias("rating_stars"), F.lit(1).alias("rating_count"))
    return incremented(items, deltas, item_key, ["rating_stars", "rating_count"])


def weighted_set_sum(a: Column, b: Column) -> Column:
    """Weights added by key, a missing key counts 0; keys of weight 0 go."""
    both = F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,bigint>")), F.coalesce(b, F.create_map().cast("map<string,bigint>")), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.map_filter(both, lambda _, v: v != 0)


def first_wins(*sources: DataFrame, key: str) -> DataFrame:
    """Union of tables, of equal ids the one of the first source."""
    tagged = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy("__source"))
    return out.withColumn("__place", place).where("__place = 1").drop("__place", "__source")


def padded_distinct(values: Column, n: int, fill: str = "") -> Column:
    """The first ``n`` different elements in order of first occurrence, filled up."""
    return F.slice(F.concat(F.array_distinct(values), F.array_repeat(F.lit(fill), n)), 1, n)


def dense_codes(rows: DataFrame, value: str, order: str, path: str, name: str = "code") -> DataFrame:
    """``value, code``: codes from 0 by first occurrence; the vocabulary is numbered in ranges, which are written under ``path``."""
    first = rows.groupBy(value).agg(F.min(order).alias("__first"))
    return numbered(first, ["__first", value], name, path).select(value, name)
