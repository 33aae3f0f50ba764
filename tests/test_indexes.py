"""Indexes in written tables, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.operators import ann
from tarn.operators import inverted as iv
from tarn.operators import postings as ps


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, copies of one vector, and a null."""
    pick = np.random.default_rng(4)
    centres = pick.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * pick.normal(size=16)).tolist()) for k in range(600)] + [(k, [0.5] * 16) for k in range(600, 700)] + [(999, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ann") / "index")
    ann.write_index(vectors, "id", "v", ann.train(vectors, "id", "v", 20, parts=4, codes=64, rounds=5), path, copies=2, factor=0.7)
    return ann.open_index(spark, path)


def true_neighbours(rows, queries, k):
    out = set()
    for q, v in queries:
        near = sorted((math.dist(v, w), i) for i, w in rows if w is not None)[:k]
        out |= {(q, i, place) for place, (_, i) in enumerate(near, 1)}
    return out


def test_k_means_finds_groups(spark):
    rows = [(k, [float(10 * (k % 3)) + (k % 7) / 100, 1.0]) for k in range(300)]
    centres = ann.k_means(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), "id", "v", 3, rounds=8)[0]
    # each centre is the mean of the rows that are nearest to it
    points = np.array([v for _, v in rows])
    cell = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
    assert all(np.allclose(points[cell == c].mean(0), centres[c]) for c in set(cell.tolist()))
    assert ann.k_means(spark.createDataFrame(rows[:2], "id long, v array<double>"), "id", "v", 5, rounds=2).shape == (1, 2, 2)
    with pytest.raises(ValueError, match="no vectors"):
        ann.k_means(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 2)


def test_every_row_is_indexed(index, vectors):
    stored = index.lists().groupBy("id").agg(F.count("*").alias("n")).collect()
    assert {r.id for r in stored} == {r.id for r in vectors.where("v IS NOT NULL").collect()} and max(r.n for r in stored) <= 2
    assert index.sizes.sum() == sum(r.n for r in stored)


def test_exact_search_equals_brute_force(index, vectors):
    rows = [(r.id, r.v) for r in vectors.collect()]
    queries = vectors.where("id % 37 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    for at_once in (1000, 7):
        found = ann.exact_search(index, queries, "q", "qv", 8, 2, 20, at_once)
        assert {(r.query_id, r.id, r.place) for r in found.collect()} == true_neighbours(rows, [(i, v) for i, v in rows if i % 37 == 0 and v], 8)
    # more neighbours than the probed lists hold
    all_of = ann.exact_search(index, queries.where("q = 37"), "q", "qv", 650, 1, 5)
    assert all_of.count() == 650


def test_recall_and_pruning(index, vectors):
    queries = vectors.where("id % 9 = 4").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    probes = ann.tuned_probes(index, vectors.where("id % 50 = 3").select(F.col("id").alias("q"), F.col("v").alias("qv")), "q", "qv", 10, 0.97)
    assert 1 <= probes < len(index.sizes)
    near = ann.search(index, queries, "q", "qv", 10, probes, 60)
    true = ann.exact_search(index, queries, "q", "qv", 10, probes, 60)
    worst = {r.query_id: r.d for r in true.groupBy("query_id").agg(F.max("distance").alias("d")).collect()}
    hits = Counter(r.query_id for r in near.collect() if r.distance <= worst[r.query_id] + 1e-6)
    assert sum(hits.values()) / (10 * len(worst)) >= 0.9
    plan = ann.search(index, queries.limit(1), "q", "qv", 10, 2, 60)._jdf.queryExecution().explainString(spark_mode(plan_of=index))
    assert "PartitionFilters: [list" in plan and "CartesianProduct" not in plan


def spark_mode(plan_of):
    return plan_of.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


def test_no_queries_and_unknown_shape(spark, index, vectors):
    none = spark.createDataFrame([(1, None)], "q long, qv array<double>")
    assert ann.search(index, none, "q", "qv", 5, 2, 10).count() == 0 and ann.exact_search(index, none, "q", "qv", 5, 2, 10).count() == 0
    with pytest.raises(ValueError, match="do not divide"):
        ann.train(vectors, "id", "v", 4, parts=5, rounds=1)


# ---- inverted index -------------------------------------------------------------------------------------------------

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(8)
    rare = lambda: WORDS[min(int(pick.expovariate(0.12)), 59)]
    return [(k, " ".join(rare() for _ in range(pick.choice([3, 10, 40, 200])))) for k in range(400)] + [(900, None), (901, ""), (902, "w1 w1 w1"), (903, "w1 w2 w1 w2")]


@pytest.fixture(scope="module")
def inverted(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("inv") / "index")
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    iv.write_inverted(docs, "doc_id", {"text": tx.word_tokens(F.col("text"))}, path, block_docs=8)
    return iv.Inverted(spark, path)


def words_of(spark, *queries):
    return spark.createDataFrame([(q, place, w) for q, text in enumerate(queries) for place, w in enumerate(text.split())], "query_id int, place int, term string")


def test_blocks_hold_every_posting(inverted, texts):
    wanted = {(i, w): ([k for k, x in enumerate(t.split()) if x == w], len(t.split())) for i, t in texts if t for w in set(t.split())}
    got = iv.opened(inverted.blocks(), "id", "tf", "length", "positions").collect()
    assert len(got) == len(wanted) and all((list(r.positions), r.length) == wanted[r.id, r.term] and r.tf == len(r.positions) for r in got)
    stats = inverted.statistics.first()
    assert stats.n_docs == len(texts) and stats.average_length == pytest.approx(sum(n for n in (len((t or "").split()) for _, t in texts)) / len(texts))


def test_pruned_weak_and_equals_exhaustive(spark, inverted, texts, tmp_path):
    queries = words_of(spark, "w55 w0 w1", "w0 w1", "w58 w57 w30 w2", "w3", "unknown w4 w4", "unknown").drop("place")
    rows = spark.read.parquet(f"{inverted.path}/rows")
    for k, lead in ((5, 4096), (5, 1), (1, 50), (1000, 4096)):
        found = iv.weak_and_blocks(inverted, queries, "text", k, str(tmp_path / f"{k}-{lead}"), lead)
        plain = ps.weak_and_top(rows.where("term IS NOT NULL"), iv.statistics(rows), queries, k)
        as_set = lambda df: {(r.query_id, r.id, r.score, r.place) for r in df.collect()}
        assert as_set(found.hits) == as_set(plain)


def test_share_of_postings_skipped(spark, inverted, tmp_path):
    queries = words_of(spark, "w55 w0 w1", "w58 w0", "w50 w1 w2 w3").drop("place")
    found = iv.weak_and_blocks(inverted, queries, "text", 3, str(tmp_path / "w"), 50)
    total, read = found.blocks.agg(F.sum("n"), F.sum(F.when(F.col("used"), F.col("n")).otherwise(0))).first()
    print(f"postings read: {read} of {total}")
    assert 0 < read < 0.5 * total


def test_phrases_from_positions(spark, inverted, texts):
    phrases = ["w0 w1", "w1 w1", "w1 w2 w1", "w0", "w0 nowhere", "w2 w0 w0 w3"]
    wanted = set()
    for q, phrase in enumerate(phrases):
        own = phrase.split()
        for i, t in texts:
            tokens = (t or "").split()
            starts = tuple(k for k in range(len(tokens) - len(own) + 1) if tokens[k : k + len(own)] == own)
            wanted |= {(q, i, starts)} if starts else set()
    assert {(r.query_id, r.id, tuple(r.starts)) for r in iv.phrases(inverted, words_of(spark, *phrases), "text").collect()} == wanted


def test_elements_and_their_gap(spark, tmp_path):
    docs = spark.createDataFrame([(1, [["a", "b"], ["c"], []]), (2, [["a"], ["b"]]), (3, None), (4, [None, ["a", None, "b"], ["a", "b"]])], "id long, t array<array<string>>")
    iv.write_inverted(docs, "id", {"far": F.col("t"), "near": F.col("t")}, str(tmp_path / "i"), {"far": iv.APART, "near": 1})
    index = iv.Inverted(spark, str(tmp_path / "i"))
    find = lambda field, text: {r.id: list(r.starts) for r in iv.phrases(index, words_of(spark, text), field).collect()}
    assert find("far", "a b") == {1: [0], 4: [0 + iv.APART - 1, 2 + 2 * (iv.APART - 1)]}
    assert find("near", "a b") == {1: [0], 2: [0], 4: [0, 2]} and find("near", "b c") == {1: [1]} and find("far", "b c") == {}
    assert {(r.field, r.n_docs) for r in index.statistics.collect()} == {("far", 4), ("near", 4)}


def test_proximity_against_brute_force(spark, inverted, texts):
    query = ["w9", "w2", "w14"]
    got = {r.id: r for r in iv.proximity(inverted, words_of(spark, " ".join(query)), "text").collect()}
    for i, t in texts:
        tokens = (t or "").split()
        here = [w for w in query if w in tokens]
        if not here:
            assert i not in got
            continue
        at = [k for k, w in enumerate(tokens) if w in here]
        smallest = min(b - a + 1 for a in at for b in at if a <= b and set(here) <= set(tokens[a : b + 1]))
        pairs = sum(any(tokens[k : k + 2] == [x, y] for k in range(len(tokens))) for x, y in zip(query, query[1:], strict=False))
        r = got[i]
        assert (r.matched, r.smallest_window, r.orderness) == (len(here), smallest, pairs / 2)
        assert r.proximity == pytest.approx(len(here) / smallest) and r.earliness == pytest.approx(1 - at[0] / len(tokens))


def test_index_of_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    iv.write_inverted(docs, "doc_id", {"text": tx.word_tokens(F.col("text"))}, str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i" / "rows"))
    assert rows.count() == 0


def test_impacts_hold_every_posting_and_bound_it(spark, texts, tmp_path):
    """the index without positions, made where texts are read."""
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    iv.write_impacts(docs, "doc_id", "text", tx.word_tokens(F.col("text")), str(tmp_path / "i"), block_docs=8)
    index = iv.Impacts(spark, str(tmp_path / "i"))
    wanted = {(i, w): (t.split().count(w), len(t.split())) for i, t in texts if t for w in set(t.split())}
    got = iv.opened(index.blocks(), "id", "tf", "length").join(index.blocks().select("term", "range", "most"), ["term", "range"]).collect()
    assert len(got) == len(wanted) and all((r.tf, r.length) == wanted[r.id, r.term] for r in got)
    stats = index.statistics.first()
    assert stats.n_docs == len(texts) and stats.average_length == pytest.approx(sum(len((t or "").split()) for _, t in texts) / len(texts))
    assert all(r.most >= r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * r.length / stats.average_length)) - 1e-9 for r in got)
    queries = words_of(spark, "w55 w0 w1", "w0 w1", "w58 w57 w30 w2", "w3", "unknown w4 w4", "unknown").drop("place")
    rows = iv.term_rows(docs, "doc_id", {"text": tx.word_tokens(F.col("text"))})
    as_set = lambda df: {(r.query_id, r.id, r.score, r.place) for r in df.collect()}
    for k, lead in ((5, 4096), (5, 1), (1, 50), (1000, 4096)):
        found = iv.weak_and_blocks(index, queries, "text", k, str(tmp_path / f"{k}-{lead}"), lead)
        assert as_set(found.hits) == as_set(ps.weak_and_top(rows.where("term IS NOT NULL"), iv.statistics(rows), queries, k))
    total, read = iv.weak_and_blocks(index, words_of(spark, "w55 w0 w1", "w58 w0").drop("place"), "text", 3, str(tmp_path / "w"), 50).blocks.agg(F.sum("n"), F.sum(F.when(F.col("used"), F.col("n")).otherwise(0))).first()
    assert 0 < read < total


def test_impacts_of_no_documents(spark, tmp_path):
    iv.write_impacts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", tx.word_tokens(F.col("text")), str(tmp_path / "i"))
    assert iv.weak_and_blocks(iv.Impacts(spark, str(tmp_path / "i")), words_of(spark, "w1").drop("place"), "text", 3, str(tmp_path / "w")).hits.collect() == []
