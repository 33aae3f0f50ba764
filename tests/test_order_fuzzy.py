"""Order statistics, numbering and fuzzy words, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import fuzzy, grouping, order, updates


@pytest.mark.parametrize("values", ["ties", "wide", "small"])
def test_ranks_and_percentiles(spark, monkeypatch, values):
    monkeypatch.setattr(order, "FEW", 20)
    monkeypatch.setattr(order, "BOUNDARIES", 12)
    pick = random.Random(values)
    rows = {
        "ties": [7.0] * 1000 + [float(pick.randint(0, 9)) for _ in range(500)] + [pick.random() for _ in range(500)],
        "wide": [pick.choice([-1, 1]) * 10.0 ** pick.randint(-300, 300) for _ in range(1500)] + [float("inf"), float("-inf")],
        "small": [3.0, 1.0, 2.0],
    }[values]
    df = spark.createDataFrame([(x,) for x in rows] + [(None,), (float("nan"),)], "x double").repartition(5)
    ranks = sorted({0, len(rows) - 1, *(pick.randrange(len(rows)) for _ in range(9))})
    assert order.at_ranks(df, "x", ranks) == [sorted(rows)[r] for r in ranks]
    if values != "wide":
        at = [0.0, 0.25, 0.5, 0.9, 1.0]
        got = grouping.percentiles(df, "x", at).first()
        assert list(got) == pytest.approx(np.quantile(rows, at).tolist())
    with pytest.raises(ValueError, match="fewer rows"):
        order.at_ranks(df, "x", [len(rows)])


def test_percentiles_of_nothing(spark):
    assert tuple(grouping.percentiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5, 0.9]).first()) == (None, None)


def test_numbers_without_one_task(spark, tmp_path):
    pick = random.Random(1)
    keys = pick.sample(range(10**6), 500)
    rows = spark.createDataFrame([(k, f"v{k % 7}") for k in keys], "k long, v string").repartition(6)
    got = order.numbered(rows, ["v", "k"], "n", str(tmp_path / "n")).collect()
    assert [(r.v, r.k) for r in sorted(got, key=lambda r: r.n)] == sorted((f"v{k % 7}", k) for k in keys) and {r.n for r in got} == set(range(500))
    codes = updates.dense_codes(rows, "v", "k", str(tmp_path / "c")).collect()
    first = {}
    for k in sorted(keys):
        first.setdefault(f"v{k % 7}", len(first))
    assert {r.v: r.code for r in codes} == first
    assert order.numbered(rows.limit(0), ["k"], "n", str(tmp_path / "e")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_words_against_all_pairs(spark):
    pick = random.Random(6)
    stems = ["".join(pick.choice("abc") for _ in range(pick.choice([2, 3, 4, 6, 7, 9, 15, 30]))) for _ in range(25)]

    def edited(w):
        for _ in range(pick.randint(0, 3)):
            at = pick.randint(min(2, len(w)), len(w))
            w = pick.choice([w[:at] + w[at + 1 :], w[:at] + pick.choice("abcé") + w[at:], w[:at] + "c" + w[at + 1 :], w[:at] + "xy" + w[at:]])
        return w

    terms, words = [edited(pick.choice(stems)) for _ in range(220)] + ["", "a"], [edited(pick.choice(stems)) for _ in range(60)] + ["", "A", None]
    index = fuzzy.deletion_index(spark.createDataFrame([(t,) for t in terms] + [(None,)], "t string"), "t")
    got = fuzzy.fuzzy_terms(index, spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    most = lambda w: 0 if len(w) <= 3 else 1 if len(w) <= 6 else 2
    wanted = {(w, t, distance(w, t)) for w in {w.lower() for w in words if w is not None} for t in set(terms) if w[:2] == t[:2] and distance(w, t) <= most(w)}
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    assert index.groupBy("term").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 56
