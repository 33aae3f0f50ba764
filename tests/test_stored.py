"""The index of stored expressions, against each expression on each request."""

import random

from pyspark.sql import functions as F

from tarn.operators import predicates, stored

REQUESTS = "r int, texts map<string, array<string>>, numbers map<string, array<double>>"


def holds(choices, texts, numbers):
    def clause(c):
        if c["values"] is not None:
            hit = any(v in c["values"] for v in texts.get(c["attribute"], []))
        else:
            hit = any((c["low"] is None or c["low"] <= x) and (c["high"] is None or x <= c["high"]) for x in numbers.get(c["attribute"], []))
        return hit != c["negated"]

    return choices is not None and any(all(clause(c) for c in choice) for choice in choices)


def expressions(pick, n):
    def clause():
        if pick.random() < 0.5:
            values = pick.sample(["x", "y", "z"], pick.randint(1, 2))
            return f"{pick.choice(['a', 'b'])} {pick.choice(['', '', 'not '])}in [{', '.join(repr(v) for v in values)}]"
        low, width = pick.randint(-50, 50), pick.choice([0, 1, 7, 100])
        text = pick.choice([f"{low}..{low + width}", f"..{low}", f"{low}..", f"{low}.5..{low + 3}.25", f"{low}..{low - 1}"])
        return f"{pick.choice(['m', 'n'])} {pick.choice(['', '', 'not '])}in [{text}]"

    out = []
    for _ in range(n):
        parts = [clause() for _ in range(pick.randint(1, 4))]
        text = f" {pick.choice(['and', 'or'])} ".join(parts)
        out.append(pick.choice([text, f"not ({text})", f"({text}) and {clause()}", f"{clause()} or ({text})"]))
    return [*out, "", None]


def requests(pick, n):
    out = []
    for k in range(n):
        texts = {a: pick.sample(["x", "y", "z"], pick.randint(1, 3)) for a in "ab" if pick.random() < 0.7}
        numbers = {a: [pick.choice([pick.randint(-55, 55) / 1.0, pick.randint(-200, 200) / 4, 1e18, -1e18]) for _ in range(pick.randint(1, 2))] for a in "mn" if pick.random() < 0.7}
        out.append((k, texts, numbers))
    return [*out, (n, None, None), (n + 1, {}, {})]


def test_all_requests_against_all_expressions(spark):
    pick = random.Random(11)
    asked, kept = requests(pick, 60), list(enumerate(expressions(pick, 80)))
    parsed = predicates.with_expressions(spark.createDataFrame(kept, "i int, e string"), "e", "p")
    wanted = {(r, i) for i, e in kept for r, texts, numbers in asked if holds(predicates.parse_expression(e), texts or {}, numbers or {})}
    for unit in (1, 10):
        got = stored.matches(parsed, "i", "p", spark.createDataFrame(asked, REQUESTS), "r", F.col("texts"), F.col("numbers"), unit)
        found = [(r.request_id, r.id) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    assert 0 < len(wanted) < len(asked) * len(kept)


def test_equal_keys_only(spark):
    parsed = predicates.with_expressions(spark.createDataFrame([(1, "m in [0..1000000] and a in ['x']")], "i int, e string"), "e", "p")
    asked = spark.createDataFrame([(1, {"a": ["x"]}, {"m": [77.0]}), (2, {"a": ["x"]}, {"m": [-1.0]})], REQUESTS)
    got = stored.matches(parsed, "i", "p", asked, "r", F.col("texts"), F.col("numbers"))
    plan = got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 1)] and "Cartesian" not in plan and "NestedLoop" not in plan
    entries, _ = stored.index_expressions(parsed, "i", "p")
    assert entries.count() <= 2 * 20 + 1


def test_nothing_stored_and_nothing_asked(spark):
    parsed = predicates.with_expressions(spark.createDataFrame([(1, None)], "i int, e string"), "e", "p")
    asked = spark.createDataFrame([(1, None, None)], REQUESTS)
    find = lambda s, a: stored.matches(s, "i", "p", a, "r", F.col("texts"), F.col("numbers")).count()
    assert find(parsed, asked) == find(parsed.limit(0), asked) == find(parsed, asked.limit(0)) == 0
