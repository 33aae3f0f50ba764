"""F21 the other way round: an index of stored boolean expressions, met by many requests through equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.dyadic import interval_cells, point_cells

#: What an open end of a range stands for in cells; a number beyond it shares the last cell and is compared by itself.
_FAR = float(1 << 50)
#: Expressions that need no clause to hold, and requests, meet in so many parts.
_PARTS = 32
#: Pairs of a key that one part holds against their clauses, and members of a class that are carried together.
_PAIRS = 1_000_000
_TOGETHER = 500


def _clauses(stored: DataFrame, id_col: str, column: str) -> DataFrame:
    """``id, choice, clause`` and the clause's fields, for each clause of each alternative."""
    each = stored.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(column).alias("choice", "all"))
    return each.select("id", "choice", F.posexplode("all").alias("clause", "c")).select("id", "choice", "clause", "c.*")


def index_expressions(stored: DataFrame, id_col: str, column: str, unit: float = 1) -> tuple[DataFrame, DataFrame]:
    """Entries and sizes of stored expressions in the form of :func:`predicates.with_expressions` (alternatives of clauses that must all hold).

    An entry is ``key`` and what it is part of: a clause on values has a key for each value; one on a range has a key for each dyadic cell of the
    range, twice the logarithm of its length in ``unit`` at most, with its bounds. A size is ``id, choice, n_needed``: how many clauses must be hit, those
    that are negated must not. Choices without such a clause get an entry of their own that every request meets. Null expressions and empty lists of
    choices are in no entry.
    """
    clauses = _clauses(stored, id_col, column)
    unbounded = F.col("values").isNull()
    cells = interval_cells(F.coalesce("low", F.lit(-_FAR)), F.coalesce("high", F.lit(_FAR)), unit)
    by_cell = F.transform(cells, lambda c: F.concat_ws("\x01", F.col("attribute"), F.lit("n"), c["level"].cast("string"), c["cell"].cast("string")))
    by_value = F.transform("values", lambda v: F.concat_ws("\x01", F.col("attribute"), F.lit("v"), v))
    keys = F.when(unbounded, by_cell).otherwise(F.array_distinct(F.filter(by_value, lambda k: k.isNotNull())))
    entries = clauses.select(F.explode(keys).alias("key"), "id", "choice", "clause", "low", "high", "negated")
    choices = stored.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(column).alias("choice", "all"))
    sizes = choices.select("id", "choice", F.size(F.filter("all", lambda c: ~c["negated"])).alias("n_needed"))
    part = F.pmod(F.xxhash64("id", "choice"), F.lit(_PARTS)).cast("string")
    always = sizes.where("n_needed = 0").select(F.concat(F.lit("\x01*"), part).alias("key"), "id", "choice", F.lit(-1).alias("clause"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("negated"))
    return entries.unionByName(always), sizes.withColumn("n_needed", F.greatest("n_needed", F.lit(1)))


def request_keys(requests: DataFrame, id_col: str, texts: Column, numbers: Column, levels: list[int], unit: float = 1) -> DataFrame:
    """``request_id, key, number`` of requests with ``texts``, a map of attributes to arrays of strings, and ``numbers``, one to arrays of doubles."""
    text_keys = F.flatten(F.transform(F.map_entries(texts), lambda e: F.transform(e["value"], lambda v: F.struct(F.concat_ws("\x01", e["key"], F.lit("v"), v).alias("key"), F.lit(None).cast("double").alias("number")))))
    cell_key = lambda name, c: F.concat_ws("\x01", name, F.lit("n"), c["level"].cast("string"), c["cell"].cast("string"))
    number_keys = F.flatten(
        F.transform(
            F.map_entries(numbers),
            lambda e: F.flatten(F.transform(e["value"], lambda x: F.transform(point_cells(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), x)), levels, unit), lambda c: F.struct(cell_key(e["key"], c).alias("key"), x.alias("number"))))),
        )
    )
    always = F.array(*[F.struct(F.lit(f"\x01*{k}").alias("key"), F.lit(None).cast("double").alias("number")) for k in range(_PARTS)])
    empty = F.array().cast("array<struct<key: string, number: double>>")
    return requests.select(F.col(id_col).alias("request_id"), F.inline(F.concat(F.coalesce(text_keys, empty), F.coalesce(number_keys, empty), always)))


def matches(stored: DataFrame, stored_id: str, column: str, requests: DataFrame, request_id: str, texts: Column, numbers: Column, unit: float = 1, path: str | None = None) -> DataFrame:
    """``request_id, id`` of all requests and all stored expressions that hold for them, once for each pair of rows; equal joins, whatever their numbers.

    Equal expressions are a class, and so are equal requests: classes are matched, and their pairs then stand for those of all members. Each choice is met by keys of one
    of its clauses, that which fewest requests can meet; the pairs found are then held against all clauses. A choice holds if all
    its positive clauses are hit and none of its negated ones: an attribute that a request lacks makes a clause false, hence its negation true. What is
    joined grows with what the most telling clause lets through; a choice of negated lists of values alone holds for nearly all requests, and meets them all.
    With a ``path``, classes are written there and not made again for each step.
    """
    kept = stored.where(F.col(column).isNotNull()).select(F.col(stored_id).alias("own"), F.col(column).alias("parsed")).withColumn("id", _class("parsed"))
    asked = requests.select(F.col(request_id).alias("own"), texts.alias("texts"), numbers.alias("numbers")).withColumn("request_id", _class("texts", "numbers"))
    expressions = _written(kept.groupBy("id").agg(F.any_value("parsed").alias("parsed")), path, "expressions")
    kinds = _written(asked.groupBy("request_id").agg(F.any_value("texts").alias("texts"), F.any_value("numbers").alias("numbers")), path, "requests")
    kept, asked = _written(_members(kept, "id", "ids"), path, "ids"), _written(_members(asked, "request_id", "request_ids"), path, "request_ids")
    # few pairs of classes may stand for many rows, so parts are not merged by their size
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _met(expressions, kinds, unit, parts).join(kept, "id").repartition(parts, "request_id").join(asked, "request_id")
    return met.select("ids", F.explode("request_ids").alias("r")).select(F.col("r.own").alias("request_id"), F.explode("ids").alias("e")).select("request_id", F.col("e.own").alias("id"))


def _class(*columns: str) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def _written(rows: DataFrame, path: str | None, name: str) -> DataFrame:
    if path is None:
        return rows
    rows.write.parquet(f"{path}/{name}")
    return rows.sparkSession.read.parquet(f"{path}/{name}")


def _members(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``own`` of each class as arrays ``name`` of about :data:`_TOGETHER`; a large class has many."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / _TOGETHER).alias("__blocks"))
    blocks = rows.join(sizes, key).groupBy(key, F.pmod(F.xxhash64("own"), F.col("__blocks")).alias("__block"))
    return blocks.agg(F.collect_list(F.struct("own")).alias(name)).drop("__block")


def _met(expressions: DataFrame, requests: DataFrame, unit: float, parts: int) -> DataFrame:
    """``request_id, id`` of different requests ``request_id, texts, numbers`` and different expressions ``id, parsed``, each pair once."""
    choices = expressions.select("id", "parsed", F.posexplode("parsed").alias("choice", "all"))
    ways = _ways(choices, unit)
    levels = sorted(r[0] for r in ways.select(F.explode("cells.level").alias("k")).distinct().collect())
    absent = sorted(r[0] for r in ways.where("negated").select("attribute").distinct().collect())
    keys = request_keys(requests, "request_id", F.col("texts"), F.col("numbers"), levels, unit).select("request_id", "key")
    lacking = F.array(*[F.when(~F.coalesce(F.exists(F.col("numbers")[a], lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)), F.lit(_absent(a))) for a in absent]).cast("array<string>")
    lacked = requests.select("request_id", F.explode(F.filter(lacking, lambda k: k.isNotNull())).alias("key"))
    keys = keys.where(~F.col("key").startswith("\x01*")).unionByName(lacked)
    # the clause of a choice that fewest requests can meet is its way in
    met = keys.groupBy("key").agg(F.count("*").alias("n"))
    weighed = ways.select("id", "choice", "clause", F.explode_outer("keys").alias("key")).join(met, "key", "left").groupBy("id", "choice", "clause").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    chosen = weighed.groupBy("id", "choice").agg(F.min_by("clause", F.struct("n", "clause")).alias("clause"))
    entries = ways.join(chosen, ["id", "choice", "clause"]).select("id", "choice", F.explode("keys").alias("key"))
    # a key of many pairs is dealt to as many parts
    loads = entries.groupBy("key").agg(F.count("*").alias("m")).join(met, "key").select("key", F.ceil(F.col("m") * F.col("n") / _PAIRS).alias("parts"))
    anchored = entries.join(choices, ["id", "choice"]).join(loads, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    open_ = choices.join(ways.select("id", "choice").distinct(), ["id", "choice"], "left_anti").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    used = keys.join(loads, "key").withColumn("part", F.pmod(F.xxhash64("request_id"), F.col("parts"))).drop("parts").join(requests, "request_id").repartition(parts, "key", "part")
    near = used.join(anchored, ["key", "part"])
    rest = requests.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(_PARTS))).join(open_, "part")
    # a pair is found by the first of its choices that holds
    holds = lambda clauses: F.forall(clauses, lambda c: _hit(c) != c["negated"])
    first = holds(F.col("all")) & ~F.exists(F.slice("parsed", F.lit(1), F.col("choice")), holds)
    found = near.where(first).select("request_id", "id").unionByName(rest.where(first).select("request_id", "id"))
    # a request with one value an attribute has one key of a clause at most
    several = F.exists(F.map_values("texts"), lambda v: F.size(v) > 1) | F.exists(F.map_values("numbers"), lambda v: (F.size(v) > 1) | F.exists(v, F.isnan))
    return found.distinct() if requests.where(several).head(1) else found


def _absent(attribute: str | Column) -> Column | str:
    return f"{attribute}\x01-" if isinstance(attribute, str) else F.concat(attribute, F.lit("\x01-"))


def _hit(c: Column) -> Column:
    """Whether a request's ``texts`` and ``numbers`` meet a clause."""
    inside = F.exists(F.col("numbers")[c["attribute"]], lambda x: (c["low"].isNull() | (c["low"] <= x)) & (c["high"].isNull() | (c["high"] >= x)))
    return F.coalesce(F.when(c["values"].isNull(), inside).otherwise(F.arrays_overlap(F.col("texts")[c["attribute"]], c["values"])), F.lit(False))


def _ways(choices: DataFrame, unit: float) -> DataFrame:
    """``id, choice, clause, attribute, negated, cells, keys``: the clauses that can lead to a choice. Each request for which the choice holds has one of the clause's keys.

    A clause on values or a range that must be met has its own keys; a range that must not be met has those of what lies below and above it, and of requests without a number.
    """
    each = choices.select("id", "choice", F.posexplode("all").alias("clause", "c")).select("id", "choice", "clause", "c.*").where("NOT negated OR values IS NULL")
    low, high, far = F.coalesce("low", F.lit(-_FAR)), F.coalesce("high", F.lit(_FAR)), F.lit(_FAR)
    none = F.array().cast("array<struct<level: int, cell: bigint>>")
    beside = F.concat(F.when(F.col("low").isNotNull(), interval_cells(-far, low, unit)).otherwise(none), F.when(F.col("high").isNotNull(), interval_cells(high, far, unit)).otherwise(none))
    # an empty range is met by nothing, hence everything lies beside it; where both ends are in one cell, what lies beside has that cell twice
    beside = F.when(F.floor(low / unit) >= F.floor(high / unit), interval_cells(-far, far, unit)).otherwise(beside)
    own = F.when(F.col("values").isNotNull(), none).when(F.col("negated"), beside).otherwise(F.coalesce(interval_cells(low, high, unit), none))
    each = each.withColumn("cells", own)
    by_cell = F.transform("cells", lambda c: F.concat_ws("\x01", F.col("attribute"), F.lit("n"), c["level"].cast("string"), c["cell"].cast("string")))
    by_value = F.filter(F.transform("values", lambda v: F.when(v.isNotNull(), F.concat_ws("\x01", F.col("attribute"), F.lit("v"), v))), lambda k: k.isNotNull())
    keys = F.when(F.col("values").isNotNull(), by_value).when(F.col("negated"), F.concat(by_cell, F.array(_absent(F.col("attribute"))))).otherwise(by_cell)
    return each.select("id", "choice", "clause", "attribute", "negated", "cells", F.array_distinct(keys).alias("keys"))
