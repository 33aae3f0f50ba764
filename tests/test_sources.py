import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.sources import feeds
from tarn.streaming import counters


def test_operations(spark, tmp_path):
    path = tmp_path / "ops.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"put": "id:ns:music:g=u1:a", "fields": {"year": 1}}, {"update": "id:ns:music::b", "create": True, "fields": {"year": 2}}, {"remove": "id:ns:music::c"}]))
    got = feeds.with_id_parts(feeds.read_operations(spark, str(path), "year int")).orderBy("_id").collect()
    assert [(r.op, r.create, r.year, r._type, r._local) for r in sorted(got, key=lambda r: r._local)] == [("put", False, 1, "music", "a"), ("update", True, 2, "music", "b"), ("remove", False, None, "music", "c")]
    feeds.write_operations(spark.createDataFrame([("k", 5)], "id string, year int"), str(tmp_path / "out"), "ns", "music", "id")
    assert feeds.read_operations(spark, str(tmp_path / "out"), "year int").first()._id == "id:ns:music::k"


def test_delimited_and_qrels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("item,price\nx,3\n")
    assert feeds.read_csv(spark, str(tmp_path / "a.csv"), "item string, price int").first().price == 3
    (tmp_path / "q.txt").write_text("1 0 d1 2\n1\tQ0\td2\t0\n\n")
    assert sorted(tuple(r) for r in feeds.read_qrels(spark, str(tmp_path / "q.txt")).collect()) == [("1", "d1", 2), ("1", "d2", 0)]
    ranked = spark.createDataFrame([("1", "d1", 1)], "q string, d string, place int")
    feeds.write_run(ranked, str(tmp_path / "run"), "q", "d", "place")
    assert spark.read.text(str(tmp_path / "run")).first().value == "1 Q0 d1 1 999 run"


def test_lenient_json_counts_what_it_skips(spark, tmp_path):
    (tmp_path / "r.json").write_text("{'asin': 'x', 'stars': 3}\nnot json\n{\"stars\": 1}\n")
    good, skipped = feeds.read_lenient_json(spark, str(tmp_path / "r.json"), "asin string, stars int", ["asin"])
    assert [tuple(r) for r in good.collect()] == [("x", 3)] and skipped.first().skipped == 2


def test_binary_vectors(spark, tmp_path):
    data = np.array([[1, -2], [3, 4], [5, 6]], np.int8)
    (tmp_path / "v.i8bin").write_bytes(np.array([3, 2], "<i4").tobytes() + data.tobytes())
    assert sorted((r.id, list(r.vector)) for r in feeds.read_vectors(spark, str(tmp_path / "v.i8bin")).collect()) == [(0, [1, -2]), (1, [3, 4]), (2, [5, 6])]


def test_groups_are_pruned(spark, tmp_path):
    mails = spark.createDataFrame([("1234", 1), ("1234", 2), ("5678", 3)], "group string, ts int")
    feeds.write_grouped(mails, str(tmp_path / "mail"))
    one = feeds.read_group(spark, str(tmp_path / "mail"), "1234")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(group" in one._jdf.queryExecution().toString()


def test_random_albums_are_repeatable(spark):
    ids = spark.range(5)
    assert feeds.random_albums(ids, "id", 1).collect() == feeds.random_albums(ids, "id", 1).collect() != feeds.random_albums(ids, "id", 2).collect()


def test_batch_merge_is_exact_when_a_stream_goes_on(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k string, n long"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(source))
        counters.merged_each_batch(stream, str(tmp_path / "t"), str(tmp_path / "c"), "k", ["n"])
        spark.createDataFrame([("a", 10)], schema).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    counters.merged_each_batch(stream, str(tmp_path / "t"), str(tmp_path / "c"), "k", ["n"])
    assert sorted(tuple(r) for r in counters.batch_totals(spark, str(tmp_path / "t"), "k", ["n"]).collect()) == [("a", 21), ("b", 2)]


def test_windowed_counts(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:00:00", "x")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in counters.windowed_counts(events, "t", "k").collect()) == [1, 2]


def test_states_of_a_stream_are_a_table(spark, tmp_path):
    schema = "k string, n long"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", None)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = counters.into_table(counters.running_ratings(stream, "k", "n"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 4, 2), ("b", 2, 1)]


def test_visit_goes_on_after_the_last_key(spark):
    from tarn.sources.feeds import visit

    rows, seen, after = spark.range(25), [], None
    while part := [r.id for r in visit(rows, "id", 10, after).collect()]:
        seen.append(part)
        after = part[-1]
    assert [len(p) for p in seen] == [10, 10, 5] and sum(seen, []) == list(range(25))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tarn.plans.registry import scratch

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch(remote, "x")
    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "hdfs://shared/"))
    assert scratch(shared, "x").startswith("hdfs://shared/x-")


def test_only_small_scans_are_dealt_out(spark, tmp_path, monkeypatch):
    from tarn.sources import scan

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert scan.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(scan, "SMALL_BYTES", 1)
    assert scan.spread(rows) is rows
