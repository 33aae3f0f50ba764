"""Scalar functions of ranking expressions, and codecs of vector literals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """M5: null or NaN."""
    return x.isNull() | F.isnan(x.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """Division guarded by zero: 0 where ``b`` is not positive."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def int_ratio(a: Column, b: Column) -> Column:
    """A5: integer division, null on 0."""
    return F.when(b != 0, F.floor(a / b).cast("long"))


def sigmoid(x: Column) -> Column:
    """M4."""
    return 1.0 / (1.0 + F.exp(-x))


def saturated(score: Column, half: float = 11.0) -> Column:
    """``s / (s + half)``."""
    return score / (score + half)


def arctan_normalised(score: Column, scale: float = 8.0) -> Column:
    """``2 atan(s / scale) / pi``."""
    return 2 * F.atan(score / scale) / math.pi


def safe_log(score: Column) -> Column:
    """Log of positive scores, else 0."""
    return F.when(score > 0, F.log(score)).otherwise(F.lit(0.0))


def freshness(seconds: Column, now: int | Column, max_age: float) -> Column:
    """M6: 1 at ``now``, falling to 0 at ``max_age`` seconds."""
    age = (F.lit(now) if isinstance(now, int) else now) - seconds
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age / F.lit(float(max_age))))


def log_freshness(seconds: Column, now: int, max_age: float, half: float) -> Column:
    """M6: logarithmic fall that is 0.5 at age ``half``; our own curve, for long tails."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - seconds).cast("double"))
    # 1 - log(1 + r a) / log(1 + r A) is a half where (1 + r h)**2 = 1 + r A
    rate = max_age / half**2 - 2 / half
    if rate <= 0:
        raise ValueError("half must be less than half of max_age")
    return F.greatest(F.lit(0.0), 1 - F.log1p(age * rate) / math.log1p(max_age * rate))


def after_last(text: Column, separator: str) -> Column:
    """M9."""
    return F.substring_index(text, separator, -1)


def string_id(*parts: Column) -> Column:
    """A 64-bit id of concatenated strings."""
    return F.xxhash64(F.concat_ws("\u0001", *parts))


def spread_number(seed: int, key: Column) -> Column:
    """A number of 60 bits from a key, the same wherever it is computed, for samples, folds and random order: the start of the MD5 of ``seed:key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def scaled_byte(x: Column) -> Column:
    """``100 x`` cut to an integer of at most 127; NaN and null are 0."""
    return F.least(F.lit(127), (F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) * 100).cast("int"))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number, from 0, 1, 1, 2."""
    steps = F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1)))
    pair = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")))
    return F.when(n >= 1, pair["a"]).otherwise(F.lit(0).cast("long"))


def joined_bits(high: Column, low: Column) -> Column:
    """``high << 32 | low``."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def epoch_seconds(moment: Column) -> Column:
    """M7: whole seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment)


def date_to_epoch(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """M7."""
    return F.unix_timestamp(text, pattern)


def epoch_to_day(seconds: Column) -> Column:
    """M7: ``yyyyMMdd`` as an integer."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd").cast("int")


# ---- S17: vector literals -----------------------------------------------------------------------------------------


def dense_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(text, "$.values"), "array<double>"), F.from_json(text, "array<double>"))


def bytes_from_hex(text: Column) -> Column:
    """Signed bytes of a hexadecimal string."""
    raw = F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.transform(raw, lambda b: F.when(b > 127, b - 256).otherwise(b))


def mapped_from_json(text: Column, label: str) -> Column:
    """``{"cells": [{"address": {label: k}, "value": v}]}`` or ``{k: v}`` to a map."""
    cells = F.from_json(F.get_json_object(text, "$.cells"), "array<struct<address: map<string,string>, value: double>>")
    listed = F.map_from_entries(F.transform(cells, lambda c: F.struct(F.element_at(c["address"], label).alias("k"), c["value"].alias("v"))))
    return F.when(cells.isNotNull(), listed).otherwise(F.from_json(text, "map<string,double>"))
