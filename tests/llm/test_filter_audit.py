import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.llm.filter_audit import MOST_FILTERS, contract_failures, edges, filter_audit, op11_filter_audit, paths
from tests.llm.conftest import ODD

LABELS = "doc_id long, quality int, toxic int"
GOOD = " ".join(f"word{k}" for k in range(60))
ROWS = [
    *ODD,
    (20, GOOD, "en", "a"),
    (21, GOOD, "en", "a"),
    (21, GOOD, "en", "a"),
    (19, GOOD, "en", "b"),
    (None, GOOD, "en", "b"),
    (22, GOOD + " #", "en", ""),
    (23, "A" * 10 + GOOD, "en", None),
    (24, ("x y " * 40) + "%", "en", "d"),
    (25, "\x0b".join(GOOD.split()), "en", "d"),
    (26, " ".join(GOOD.split()), "en", "d"),
]
MARKED = [(20, 1, 0), (20, 0, 1), (21, 1, None), (22, 1, 0), (23, 0, 1), (24, None, 1), (None, 1, 1), (999, 1, 1), (4, 0, 1)]


def brute(rows, labels):
    """Every document through every order, one after another."""
    texts = [(i, t or "", s or "") for i, t, _, s in rows]
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, x in labels if i is not None and x == 1}
    out = Counter()
    for i, t, part in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        }
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                out[key, "kept"] += not gone and not fails[f]
                out[key, "removed"] += not gone and fails[f]
                out[key, "redundant"] += gone and fails[f]
                out[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[key, "good_lost"] += not gone and fails[f] and i in good
                out[key, "toxic_lost"] += not gone and fails[f] and i in toxic
                gone = gone or fails[f]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    total = Counter()
    for (key, name), n in out.items():
        if name == "removed":
            total[key[0], key[1][key[2] - 1]] += n
    return {key: tuple(out[key, n] for n in names) + (total[key[0], key[1][key[2] - 1]],) for key, _ in out}


def test_lattice():
    assert len(edges(5)) == 80
    steps = paths("ABCDE")
    assert len(steps) == 600 and len({s[0] for s in steps}) == 120
    assert {(d, f) for _, _, d, f in steps} == set(edges(5))


def test_against_every_order(spark, as_docs, saved):
    docs, labels = as_docs(ROWS, "part", "mask", "h", "n", "good"), spark.createDataFrame(MARKED, LABELS).withColumn("text", F.lit("x"))
    got = op11_filter_audit(spark, saved(documents=docs, labels=labels)).collect()
    wanted = brute(ROWS, MARKED)
    assert len(got) == len(wanted) == 600 * len({s or "" for *_, s in ROWS})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == wanted


def test_a_copied_third_of_all_rows(spark, as_docs):
    rows = [(k, GOOD, "en", "a" if k % 2 else "b") for k in range(300)] + [(1000 + k, f"{GOOD} {k}", "en", "a") for k in range(600)]
    docs = as_docs(rows).repartition(7)
    got = filter_audit(docs, spark.createDataFrame([], LABELS), contract_failures(F.col("text")), "E")
    last = {r.part: r for r in got.where("filter_order = 'ABCDE' AND step = 5").collect()}
    assert (last["a"].kept, last["a"].removed) == (600, 150) and (last["b"].kept, last["b"].removed) == (1, 149)
    assert last["a"].unique_fails == 150 and last["b"].shapley == 149 * 120


def test_empty_and_own_filters(spark, as_docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(as_docs([]), labels, contract_failures(F.col("text")), "E").count() == 0
    own = filter_audit(as_docs(ODD), labels, {"x": F.length("text") < 3, "y": F.col("doc_id") > 5}, part_col="lang")
    assert own.count() == len({lang for _, _, lang, _ in ODD}) * 4
    assert {r.filter_order for r in own.collect()} == {"xy", "yx"}
    with pytest.raises(ValueError, match="filters"):
        filter_audit(as_docs([]), labels, {chr(97 + k): F.lit(True) for k in range(MOST_FILTERS + 1)})
