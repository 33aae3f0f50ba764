"""Joins by dyadic cells, against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import dyadic, joins

DDL = "k string, start long, end long"


def spans(seed, n, keys="ab"):
    """Spans of one second to thirty years, of both signs, with ties and repeats."""
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        start = pick.choice([0, 1, -1, pick.randint(-(10**9), 10**9), pick.randint(-50, 50)])
        out.append((pick.choice(keys), start, start + pick.choice([0, 1, 5, 63, 64, 3600, 10**6, 10**9])))
    return out + out[:5]


def meeting(a, b, keyed=True):
    return sorted((x, y) for x in a for y in b if (x[0] == y[0] or not keyed) and x[1] <= y[2] and y[1] <= x[2])


def test_cells_cover_an_interval_once(spark):
    rows = spark.createDataFrame([(0, 0), (-7, 13), (5, 4), (1, 1 << 30), (-(1 << 40), 3), (None, 4)], "s long, e long")
    for r in rows.select("s", "e", dyadic.interval_cells(F.col("s"), F.col("e")).alias("cells")).collect():
        if r.s is None or r.s > r.e:
            assert r.cells is None
            continue
        parts = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.cells)
        assert parts[0][0] == r.s and parts[-1][1] == r.e + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= max(1, 2 * math.ceil(math.log2(r.e - r.s + 2)))


@pytest.mark.parametrize("unit", [1, 10, 1000])
def test_intervals_of_any_length(spark, unit):
    a, b = spans(1, 120), spans(2, 120)
    for keys in (["k"], []):
        left, right = spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL)
        if not keys:
            left, right = left.withColumnRenamed("k", "name"), right.withColumnRenamed("k", "name")
        got = joins.interval_join(left, right, keys, unit=unit)
        key = lambda r, p: r["k"] if keys else r[f"{p}name"]
        found = sorted(((key(r, "a_"), r.a_start, r.a_end), (key(r, "b_"), r.b_start, r.b_end)) for r in got.collect())
        assert found == meeting(a, b, bool(keys))


def test_no_nested_loop_and_few_rows(spark):
    a = spark.createDataFrame([("x", k, k + 10**9) for k in range(50)] + [("x", k, k) for k in range(50)], DDL)
    plan = joins.interval_join(a.withColumnRenamed("k", "n"), a.withColumnRenamed("k", "n"), [])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    cells = a.select(F.size(dyadic.interval_cells(F.col("start"), F.col("end"))).alias("n")).agg(F.max("n")).first()[0]
    assert cells <= 2 * 30


def test_times_dates_and_fractions(spark):
    day = dt.date(2024, 1, 1)
    points = spark.createDataFrame([(1, day, dt.datetime(2024, 1, 1, 5), 0.25), (2, day + dt.timedelta(9), dt.datetime(2024, 1, 9), 1.75), (3, None, None, None)], "id int, d date, t timestamp, x double")
    spans_ = spark.createDataFrame([(10, day, day + dt.timedelta(3), dt.datetime(2024, 1, 1, 4), dt.datetime(2024, 1, 1, 6), 0.3, 1.75), (11, day + dt.timedelta(9), day + dt.timedelta(9), dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1), -1e30, 0.25)], "s int, d1 date, d2 date, t1 timestamp, t2 timestamp, x1 double, x2 double")
    find = lambda p, s, e, unit: sorted((r.id, r.s) for r in dyadic.points_in_intervals(points, spans_, p, s, e, unit=unit).collect())
    assert find("d", "d1", "d2", 1) == [(1, 10), (2, 11)] and find("t", "t1", "t2", 1_000_000) == [(1, 10), (1, 11), (2, 11)]
    assert find("x", "x1", "x2", 1) == find("x", "x1", "x2", 0.01) == [(1, 11), (2, 10)]


def test_band_match(spark):
    pick = random.Random(3)
    left = [(k, float(pick.randint(-100, 100)), pick.choice("uv")) for k in range(30)]
    right = [(k, pick.uniform(-120, 120), pick.choice("uv")) for k in range(200)]
    a = spark.createDataFrame(left, "l int, x double, lk string").selectExpr("*", "x - 15 AS low", "x + 15 AS high")
    b = spark.createDataFrame([*right, (999, None, "u")], "r int, y double, rk string")
    for on in ((), (("lk", "rk"),)):
        best = joins.band_match(a, b, "low", "high", "y", -F.abs(F.col("x") - F.col("y")), "l", "r", 4, on, unit=5)
        wanted = set()
        for k, x, g in left:
            near = sorted((abs(x - y), r) for r, y, h in right if abs(x - y) <= 15 and (not on or g == h))[:4]
            wanted |= {(k, r, place) for place, (_, r) in enumerate(near, 1)}
        assert {(r.l, r.r, r.place) for r in best.collect()} == wanted
        plan = best._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_nothing_meets_nothing(spark):
    none = spark.createDataFrame([], DDL)
    some = spark.createDataFrame([("a", 1, 2), ("a", None, 2), ("a", 3, 2)], DDL)
    assert joins.interval_join(none, some, ["k"], unit=1).count() == 0 and joins.interval_join(some, none, ["k"], unit=1).count() == 0
    assert joins.interval_join(some, some, ["k"], unit=1).count() == 1
