"""Queries on tables that were found to break them: rounding, repeated groups, skewed keys."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def answered(spark, folder, name, **tables):
    """Rows of a registered query over small tables given as ``(rows, schema)``."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return entry.queries()[name](spark, str(folder))


def by_sql(folder, name):
    """The rows of its SQL over the same tables, sorted."""
    import duckdb

    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_bytes_of_vectors_are_rounded_as_singles(spark, tmp_path):
    rows = [(k, [k / 127.0] * 64, k % 3) for k in range(127)]
    found = answered(spark, tmp_path, "binary_vectors", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "binary_vectors")


def test_bytes_of_whole_vectors(spark, tmp_path):
    """vectors that differ beyond their eighth value alone."""
    rows = [(k, [0.5] * 8 + [((k + i) % 5 - 2) / 4.0 for i in range(56)], k % 3) for k in range(40)]
    found = answered(spark, tmp_path, "binary_vectors", embeddings=(rows, "vec_id long, embedding array<float>, label int")).collect()
    of = lambda place: sum(int(x * 127) for k in range(3 * place, min(3 * place + 3, 40)) for x in rows[k][1])
    assert {r.id: r.total for r in found} == {place: of(place) for place in range(14)}
    assert sorted(map(tuple, found)) == by_sql(tmp_path, "binary_vectors")


def test_bucket_join_takes_rows_of_equal_buckets_as_one(spark, tmp_path):
    """4,000 parts and 4,000 suppliers of one bucket are 16 million pairs, but one pair of classes for each number modulo 997 or 991."""
    parts = ([(k, 7 * (k % 2) + k % 3) for k in range(4000)], "p_partkey long, p_size int")
    suppliers = ([(k, k % 4, 9500.0 if k % 5 else 100.0) for k in range(4000)], "s_suppkey long, s_nationkey int, s_acctbal double")
    found = answered(spark, tmp_path, "bucket_join", part=parts, supplier=suppliers)
    assert "__kind" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "bucket_join")


@pytest.mark.parametrize("name", ["band_match", "two_sided_match"])
def test_matches_join_no_band(spark, tmp_path, name):
    """Three nearest of 2,000 customers, many of one balance: by places, not by all that lie in a band."""
    customers = ([(k, k % 3, [-50.0, 7.25, 10.0 + k % 40][k % 3] if k % 9 else None, "X") for k in range(2000)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    suppliers = ([(k, k % 3, [7.25, -3.0, 30.5, 5000.0, -50.0][k % 5] if k else None) for k in range(40)], "s_suppkey long, s_nationkey int, s_acctbal double")
    found = answered(spark, tmp_path, name, customer=customers, supplier=suppliers)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, name)


def test_nearest_match_with_coarse_scores_and_odd_bands(spark, tmp_path):
    """Scores that do not tell values apart, and bands beside their centre, are settled by the plain join."""
    from tarn.operators import joins as j

    left = spark.createDataFrame([(k, float(k), float(k - 4), float(k + 4)) for k in range(20)] + [(99, 3.0, 8.0, 15.0), (98, None, 1.0, 2.0)], "l long, c double, low double, high double")
    right = spark.createDataFrame([(100 - k, k / 4.0) for k in range(100)], "r long, v double")
    score = -F.floor(F.abs(F.col("v") - F.col("c")) / 2)
    got = j.nearest_match(left, right, "c", "low", "high", "v", score, "l", "r", 3, str(tmp_path / "near")).select("l", "r", "place")
    want = j.band_match(left, right, "low", "high", "v", score, "l", "r", 3).where("c IS NOT NULL").select("l", "r", "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("l = 99").count() == 3


def test_equal_intervals_are_joined_once(spark, tmp_path):
    """20,000 orders of 40 days against 600 suppliers, where repeated keys count as often as they stand."""
    day = lambda k: datetime.datetime(1992, 3, 7) + datetime.timedelta(days=20 * (k % 40))
    orders = ([(k, day(k)) for k in range(20_000)], "o_orderkey long, o_orderdate timestamp_ntz")
    suppliers = ([(k % 500,) for k in range(600)], "s_suppkey long")
    found = answered(spark, tmp_path, "interval_join_lengths", orders=orders, supplier=suppliers)
    assert "orders.parquet" not in "".join(found.inputFiles())  # what is joined are the intervals, counted before
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "interval_join_lengths")


def test_nearest_of_many_queries_by_matrix_products(spark, tmp_path):
    """Copies and near copies tie as in SQL; no pair of a query and a row is a row of the plan."""
    rows = [(k, [((k // 3 * 37 + i * i) % 11) / 8.0 + (1e-4 if k % 3 == 2 else 0.0) for i in range(64)], k % 3) for k in range(600)]
    found = answered(spark, tmp_path, "exact_neighbours", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "exact_neighbours")


def test_stored_expressions_are_met_by_their_most_telling_clause(spark, tmp_path):
    """A negated range is met from beside it, not by all requests."""
    customers = ([(k, k % 5, [-970.5, -920.0, 0.0, 9500.0, 40.25][k % 5] + k % 7, ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"][k % 4]) for k in range(400)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    suppliers = ([(k, k % 5, [-980.5, 9400.0, -5.0][k % 3]) for k in range(60)], "s_suppkey long, s_nationkey int, s_acctbal double")
    found = answered(spark, tmp_path, "predicate_index", customer=customers, supplier=suppliers)
    assert "n_needed" not in found._jdf.queryExecution().toString()  # hits of single clauses are not counted
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "predicate_index")


def test_equal_requests_and_expressions_are_matched_once(spark, tmp_path):
    """4,000 customers of 20 kinds and 400 suppliers of 15 are matched as classes; repeated keys count as often as they stand."""
    from tarn.operators import stored as st

    kinds = [(k % 5, [-970.5, -920.0, 0.0, 9500.0, 40.25][k % 5], ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"][k % 4]) for k in range(20)]
    customers = ([(k % 3999, *kinds[k % 20]) for k in range(4000)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    suppliers = ([(k % 399, k % 5, [-980.5, 9400.0, -5.0][k % 3]) for k in range(400)], "s_suppkey long, s_nationkey int, s_acctbal double")
    found = answered(spark, tmp_path, "predicate_index", customer=customers, supplier=suppliers)
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "predicate_index")
    rows = st._members(spark.range(4000).select(F.col("id").alias("own"), (F.col("id") % 2).alias("c")), "c", "ids")
    assert rows.count() == 8 and rows.agg(F.sum(F.size("ids"))).first()[0] == 4000


def test_recall_is_reached_without_structure(spark, tmp_path):
    """Vectors without structure, a sixth of them centroids: 24 lists do not hold enough of the neighbours."""
    import numpy as np

    made = np.random.default_rng(3).normal(size=(2000, 64))
    rows = [(k, (x / np.linalg.norm(x)).tolist(), k % 3) for k, x in enumerate(made)]
    found = answered(spark, tmp_path, "recall_with_ties", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "recall_with_ties")


def test_probed_lists_are_met_in_matrix_products(spark, tmp_path):
    """what the centroid search finds, without a row for each pair of a query and a list."""
    import numpy as np

    from tarn.operators import vector as v

    made = np.random.default_rng(9).normal(size=(700, 16)).round(2)
    rows = [(k, made[k // 2].tolist() if k != 5 else None) for k in range(1400)]
    docs = spark.createDataFrame(rows, "id long, v array<double>")
    centroids = docs.where("id % 6 = 0").select(F.col("id").alias("centroid"), F.col("v").alias("centroid_vector"))
    queries = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    lists = v.closest_centroids(docs, centroids, "id", "v", "centroid", "centroid_vector", 4)
    listed = v.listed(docs, lists, centroids, "id")
    for probes in (1, 24, 500):
        found = v.probed_each(listed, centroids, queries, "id", "v", 10, probes, at_once=9)
        assert "centroid_vector" not in found._jdf.queryExecution().toString()
        want = v.centroid_search(docs, lists, centroids, queries, "id", "v", 10, probes, 0.0)
        key = lambda r: (r.query_id, r.place, r.id, round(r.distance, 9))
        assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))


def test_exact_search_makes_no_row_for_pairs_that_cannot_win(spark, tmp_path):
    """3,000 vectors, half of them copies of one: queries meet rows in matrix products, and of copies only those of least ids are measured."""
    import numpy as np

    from tarn.operators import ann

    made = np.random.default_rng(5).normal(size=(3000, 64))
    rows = [(k, (made[0] if k % 2 else made[k]).tolist(), k % 3) for k in range(3000)]
    found = answered(spark, tmp_path, "ivf_exact_knn", embeddings=(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "ivf_exact_knn")
    vectors = spark.createDataFrame(rows, "id long, v array<double>, label int")
    ann.write_index(vectors, "id", "v", ann.train(vectors, "id", "v", 20, rounds=2), str(tmp_path / "i"), copies=2, factor=0.8)
    index, asked = ann.open_index(spark, str(tmp_path / "i")), np.array([made[0]] * 40)
    near = ann._reachable(index, list(range(40)), asked, "bigint", np.ones((40, 20), bool), np.full(40, np.inf), 10)
    assert 400 <= near.count() < 40 * 1500  # one row for each copy would be 60,000 at least


def test_lists_of_an_index_are_few_files(spark, tmp_path):
    """F8: lists are written as few files each, however many tasks have rows of them."""
    import glob

    from tarn.operators import ann

    vectors = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id"))).alias("v")).repartition(12)
    ann.write_index(vectors, "id", "v", ann.train(vectors, "id", "v", 25, rounds=2), str(tmp_path / "i"))
    assert len(glob.glob(str(tmp_path / "i/lists/*/*.parquet"))) <= 25 + 12


WORDY = [(k, " ".join(f"w{(k * k + i * 7) % (3 + k % 17)}" for i in range(k % 40))) for k in range(300)] + [(k, "w1 w2 w2 w3") for k in range(300, 340)] + [(900, None), (901, ""), (902, "W1, w1! nothing")]
ITEMS = [(1, "w1 w2 w3"), (2, "w9 w0 W0 unknown"), (3, "unknown"), (4, None), (5, "w16 w3 w4 w5 w6")]


@pytest.mark.parametrize("name", ["bm25_topk", "weak_and_top", "bounded_rank", "bayesian_bm25", "bayesian_logodds"])
def test_documents_are_scored_where_they_are_read(spark, tmp_path, name):
    """no posting is joined or shuffled for a query, and Arrow batches of texts are small."""
    found = answered(spark, tmp_path, name, documents=(WORDY, "doc_id long, text string"), benchmark=(ITEMS, "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "HashAggregate" not in plan
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, name)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_scores_in_parts_of_queries(spark, tmp_path):
    """queries that go in several parts, and documents in several pieces, score as the plain operator."""
    from tarn.functions import text as tx
    from tarn.operators import inverted as iv
    from tarn.operators import postings as ps

    docs = spark.createDataFrame(WORDY, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(str(q), t.lower()) for q, text in ITEMS if text for t in text.split()], "query_id string, term string")
    held = ps.held_terms(docs, "doc_id", tx.word_tokens(F.col("text")), queries, str(tmp_path / "h"))
    rows = iv.term_rows(docs, "doc_id", {"text": tx.word_tokens(F.col("text"))})
    plain = {(r.query_id, r.id): r.score for r in ps.bm25(rows.where("term IS NOT NULL"), iv.statistics(rows), queries).collect()}
    average = held.average_length
    got = {(r.query_id, r.id): r.score for r in ps.scored_in_documents(held, lambda tf, n: ps.bm25_weight(tf, n, average, 1.2, 0.75), at_once=2).collect()}
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k]) for k in plain)


def test_texts_meet_the_index_in_small_batches(spark, tmp_path, monkeypatch):
    """While postings are counted, a task holds few documents at once."""
    from tarn.functions import text as tx
    from tarn.operators import inverted as iv

    seen, plain = [], iv.term_rows
    monkeypatch.setattr(iv, "term_rows", lambda *a: (seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))), plain(*a))[1])
    docs = spark.createDataFrame([(k, f"a b{k}") for k in range(1200)], "id long, text string").coalesce(1)
    iv.write_inverted(docs, "id", {"text": tx.word_tokens(F.col("text"))}, str(tmp_path / "i"))
    assert seen == [500] and spark.read.parquet(str(tmp_path / "i/rows")).count() == 3600


def test_terms_are_collected_from_bounded_portions(spark, tmp_path, monkeypatch):
    """the texts of a task do not grow with the input."""
    from tarn.plans import texts
    from tarn.sources import scan

    seen = []
    monkeypatch.setattr(texts, "portioned", lambda rows, key: (seen.append(scan.portioned(rows, key, 500)), seen[-1])[1])
    found = answered(spark, tmp_path, "term_ngram_counts", documents=(WORDY, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path, "term_ngram_counts")
    assert seen[0].rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
