"""Keyed state of streams and the vector data source."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.sources import feeds, vectors
from tarn.streaming import keyed

START = dt.datetime(2024, 1, 1)


def op(key, op_id, seq, kind, field, value, minutes):
    return (key, op_id, seq, kind, field, value, START + dt.timedelta(minutes=minutes))


def streamed(spark, path, batches, horizon_ms, idle_ms=None):
    """Files of operations, one a micro-batch and in order of time written."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, keyed.OPERATIONS).coalesce(1).write.mode("append").parquet(f"{path}/ops")
    stream = spark.readStream.schema(keyed.OPERATIONS).option("maxFilesPerTrigger", 1).parquet(f"{path}/ops")
    return keyed.run_documents(keyed.keyed_documents(stream, horizon_ms, idle_ms), f"{path}/docs", f"{path}/checkpoint")


def cells(found):
    return {(r.key, f): v for r in found.collect() for f, v in zip(r.field, r.value, strict=True)}


def test_late_and_repeated_operations_end_as_in_the_batch(spark, tmp_path):
    pick = random.Random(2)
    ops = [op(pick.randint(1, 6), k, pick.randint(0, 40), pick.choice(["assign", "increment"]), pick.choice("abc"), float(pick.randint(-9, 9)), pick.randint(0, 600)) for k in range(150)]
    ops = [o if o[3] == "assign" else (*o[:4], o[4].upper(), *o[5:]) for o in ops]
    sent = ops + pick.sample(ops, 60) + [(None, 1, 1, "assign", "a", 1.0, START), (1, None, 1, "assign", "a", 1.0, START), (1, 999, 1, "assign", None, 1.0, START), (1, 998, 1, "other", "a", 1.0, START)]
    pick.shuffle(sent)
    found = streamed(spark, str(tmp_path), [sent[k::4] for k in range(4)], 86_400_000)
    batch = keyed.batch_documents(spark.createDataFrame(sent, keyed.OPERATIONS))
    assert cells(found) == {(r.key, r.field): r.value for r in batch.collect()}


def test_timers_forget_what_is_idle(spark, tmp_path):
    hour = 3_600_000
    batches = [
        [op(1, 1, 1, "increment", "n", 1.0, 0), op(2, 2, 1, "increment", "n", 1.0, 0)],
        [op(2, 3, 2, "increment", "n", 1.0, 300), op(2, 2, 1, "increment", "n", 1.0, 300)],
        [op(2, 4, 3, "assign", "m", 5.0, 500)],
        [op(3, 5, 3, "assign", "m", 7.0, 700)],
    ]
    found = streamed(spark, str(tmp_path), batches, hour, idle_ms=6 * hour)
    # key 1 has had nothing for six hours of event time, keys 2 and 3 have; the repeat came when its id was still known or its time too old
    assert {k for k, _ in cells(found)} == {2, 3} and cells(found)[3, "m"] == 7.0


def test_a_key_that_waits_asks_for_no_other_timer():
    """timers are set when a key comes and when its timer rings, not for each batch."""
    import pandas as pd

    class Store:
        held, asked = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.held

        def exists(self):
            return self.held is not None

        def update(self, state):
            self.held = state

        def registerTimer(self, at):
            self.asked = [*self.asked, at]

        def listTimers(self):
            return iter(self.asked)

        def deleteTimer(self, at):
            self.asked.remove(at)

        def getCurrentWatermarkInMs(self):
            return 1_704_070_800_000  # an hour after START

    store, updates = Store(), keyed.PartialUpdates(1000, None)
    updates.init(store)
    part = lambda k: pd.DataFrame([op(1, k, k, "increment", "n", 1.0, k)], columns=[c.split()[0] for c in keyed.OPERATIONS.split(", ")])
    for k in range(3):
        (row,) = updates.handleInputRows((1,), iter([part(k)]), store)
        assert row["value"][0] == [k + 1.0]
    first = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert store.asked == [first + 1001]
    list(updates.handleExpiredTimer((1,), store, None))
    assert keyed.Document(store.held).seen == {} and store.asked == [first + 1001]  # nothing to forget, no timer
    list(updates.handleInputRows((1,), iter([part(9)]), store))
    assert len(store.asked) == 2


def test_document_rules():
    d = keyed.Document(None)
    assert d.apply(1, 5, "assign", "f", 1.0, 10) and not d.apply(1, 9, "assign", "f", 2.0, 10)
    d.apply(2, 4, "assign", "f", 9.0, 20)
    d.apply(3, 5, "assign", "f", 3.0, 30)
    assert d.fields == {"f": (5, 3.0)} and d.last == 30
    d.forget(20)
    assert set(d.seen) == {2, 3} and keyed.Document(d.state()).state() == d.state()


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    vectors.register(spark)
    rows = spark.range(1000).select(F.lit(0).alias("file"), "id", F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: ((F.col("id") * 7 + k) % 256 - 128).cast("tinyint")).alias("vector"))
    path = f"file://{tmp_path}/v"
    rows.coalesce(1).write.format("vectors").mode("append").save(path)
    got = spark.read.format("vectors").option("split", 1300).load(path)
    assert got.rdd.getNumPartitions() == 10
    assert [(r.id, list(r.vector)) for r in got.orderBy("id").collect()] == [(r.id, list(r.vector)) for r in rows.collect()]
    whole = feeds.read_vectors(spark, path)
    assert whole.join(got.withColumnRenamed("vector", "w"), "id").where("vector = w").count() == 1000


def test_files_and_errors(spark, tmp_path):
    vectors.register(spark)
    for k, n in enumerate((3, 0)):
        (tmp_path / f"f{k}.vec").write_bytes(np.array([n, 2], "<i4").tobytes() + bytes(range(2 * n)))
    got = spark.read.format("vectors").load(str(tmp_path))
    assert sorted((r.file, r.id, tuple(r.vector)) for r in got.collect()) == [(0, 0, (0, 1)), (0, 1, (2, 3)), (0, 2, (4, 5))]
    assert spark.read.format("vectors").load(str(tmp_path / "f1.vec")).count() == 0
    (tmp_path / "bad.vec").write_bytes(np.array([9, 9], "<i4").tobytes())
    with pytest.raises(Exception, match="shorter than its header"):
        spark.read.format("vectors").load(str(tmp_path)).count()
