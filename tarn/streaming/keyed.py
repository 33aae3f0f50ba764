"""Documents kept as keyed state of a stream: partial updates out of order and repeated, with timers that forget."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What the operations of a stream look like; ``at`` is event time, ``seq`` the order in which assignments count.
OPERATIONS = "key long, op_id long, seq long, kind string, field string, value double, at timestamp"
ASSIGN, INCREMENT = "assign", "increment"
_STATE = "field array<string>, seq array<bigint>, value array<double>, counter array<string>, total array<double>, seen array<bigint>, seen_at array<bigint>, last bigint"
DOCUMENTS = "key long, field array<string>, value array<double>, removed boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Document:
    """The state of one key: assigned fields with their ``seq``, counters, and the operations seen of late."""

    def __init__(self, state: tuple | None):
        field, seq, value, counter, total, seen, seen_at, self.last = state or ([], [], [], [], [], [], [], 0)
        self.fields = dict(zip(field, zip(seq, value, strict=True), strict=True))
        self.counters = dict(zip(counter, total, strict=True))
        self.seen = dict(zip(seen, seen_at, strict=True))

    def apply(self, op_id: int, seq: int, kind: str, field: str, value: float, at: int) -> bool:
        """An assignment counts if none of a later ``seq`` did (of equal ones the larger value), an increment always; a repeated operation never."""
        if op_id in self.seen:
            return False
        self.seen[op_id] = at
        self.last = max(self.last, at)
        if kind == INCREMENT:
            self.counters[field] = self.counters.get(field, 0.0) + value
        elif kind == ASSIGN:
            self.fields[field] = max(self.fields.get(field, (seq, value)), (seq, value))
        return True

    def forget(self, before: int) -> None:
        self.seen = {k: at for k, at in self.seen.items() if at >= before}

    def state(self) -> tuple:
        return (
            list(self.fields), [s for s, _ in self.fields.values()], [v for _, v in self.fields.values()], list(self.counters), list(self.counters.values()),
            list(self.seen), list(self.seen.values()), self.last,
        )

    def row(self, key: int, removed: bool = False) -> pd.DataFrame:
        fields = {**self.counters, **{f: v for f, (_, v) in self.fields.items()}}
        return pd.DataFrame({"key": [key], "field": [list(fields)], "value": [list(fields.values())], "removed": [removed]})


class PartialUpdates(StatefulProcessor):
    """W1-W4 with state: operations of a key meet its document; ids of operations are kept for ``horizon_ms`` of event time, documents without operations for ``idle_ms``."""

    def __init__(self, horizon_ms: int, idle_ms: int | None):
        self.horizon, self.idle = horizon_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", _STATE)

    def _wake(self, document: Document, now: int = 0) -> None:
        """The one timer of a key, which looks again when it rings: a call to Spark for each key and batch would cost more than the operations."""
        self.handle.registerTimer(max(now, document.last) + min(self.horizon, self.idle or self.horizon) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.document.get()
        document = Document(held)
        asleep, changed = held is None or (not document.seen and self.idle is None), False
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64")
            for op in zip(part["op_id"], part["seq"], part["kind"], part["field"], part["value"], at, strict=True):
                op_id, seq, kind, field, value, ms = op
                changed |= document.apply(int(op_id), int(seq), kind, field, float(value), int(ms))
        self.document.update(document.state())
        if asleep:
            self._wake(document)
        if changed:
            yield document.row(int(key[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        document = Document(self.document.get() if self.document.exists() else None)
        if self.idle is not None and document.last + self.idle < now:
            self.document.clear()
            yield document.row(int(key[0]), removed=True)
            return
        document.forget(now - self.horizon)
        self.document.update(document.state())
        if document.seen or self.idle is not None:
            self._wake(document, now)


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """State with timers needs the store on disk, which also bounds the memory that keys take."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keyed_documents(ops: DataFrame, horizon_ms: int, idle_ms: int | None = None) -> DataFrame:
    """``key, field, value, removed``: a stream of documents as they change, from a stream of :data:`OPERATIONS`.

    Operations whose event time is more than ``horizon_ms`` behind the latest are dropped by the watermark, so a repeat is either seen or dropped. Operations
    without a key, an id or a field are left out.
    """
    known = ops.where("key IS NOT NULL AND op_id IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL AND seq IS NOT NULL")
    timed = known.withWatermark("at", f"{horizon_ms} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(PartialUpdates(horizon_ms, idle_ms), DOCUMENTS, "Update", "EventTime")


def run_documents(documents: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what its source holds now; the table of each key's last document, ``key, field, value``.

    A micro-batch writes the documents that it changed, and those alone, to a folder of its own, in overwrite mode: run again, it replaces itself. The table
    takes each key's row of the latest batch.
    """
    spark = documents.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with _rocks(spark):
        documents.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{DOCUMENTS}, batch int").parquet(path)
    # a batch that also runs timers may write a key twice: removed first, then again
    latest = rows.groupBy("key").agg(F.max_by(F.struct("field", "value", "removed"), F.struct("batch", (~F.col("removed")).alias("kept"))).alias("d"))
    return latest.where("NOT d.removed").select("key", "d.field", "d.value")


def batch_documents(ops: DataFrame) -> DataFrame:
    """The same table ``key, field, value`` (a row a field) from all operations at once: repeats once, assignments by the largest ``seq``, increments summed."""
    once = ops.where("key IS NOT NULL AND op_id IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL AND seq IS NOT NULL").dropDuplicates(["key", "op_id"])
    assigned = once.where(F.col("kind") == ASSIGN).groupBy("key", "field").agg(F.max(F.struct("seq", "value")).alias("m")).select("key", "field", F.col("m.value").alias("value"))
    counted = once.where(F.col("kind") == INCREMENT).groupBy("key", "field").agg(F.sum("value").alias("value"))
    return assigned.unionByName(counted.join(assigned.select("key", "field"), ["key", "field"], "left_anti"))
