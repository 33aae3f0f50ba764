"""What the operators of this subpackage share: tables, the shared folder, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.scan import spread

#: Of long texts, in Arrow batches of the stages that are written.
ROWS_IN_BATCH = 2000
#: Of text that a task turns into Python objects at once.
SLICE_BYTES = 4 << 20

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input, dealt to all cores where it is small."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder; a
    cluster session has no safe default, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tarn-")
        context.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tarn/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with arrow_rows(spark, ROWS_IN_BATCH):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver-made rows, as one JSON literal; for control tables of bounded size."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(': '.join(p.split()) for p in schema.split(','))}>>")))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a table is written, Arrow batches of at most ``rows`` rows: texts are long, and both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``most`` bytes of text and ``rows`` rows, and one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(size[at - 1]) if at else 0
        stop = min(batch.num_rows, at + rows, max(at + 1, int(np.searchsorted(size, before + most, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def frugal(run: Callable) -> Callable:
    """A task's generator that gives memory back when it ends: workers outlive tasks, and the next may do something else."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
