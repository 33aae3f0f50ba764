"""How a scan is dealt to the cores."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Below so many bytes a core, an exchange costs less than cores that wait for one row group.
SMALL_BYTES = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input is small for them, as a small file may be one row group, hence one task.

    By the size that the optimiser knows from the files, nothing is read; larger inputs, with row groups for all cores, stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL_BYTES else rows


def portioned(rows: DataFrame, key: str, most: int = 2 * SMALL_BYTES) -> DataFrame:
    """Rows dealt by a key to so many tasks that each has about ``most`` bytes of files: what a task collects from its rows stays as it is when the input grows."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // most)
    return rows.repartition(parts, key) if parts > rows.sparkSession.sparkContext.defaultParallelism else spread(rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While a table is written, Arrow batches of at most ``rows`` rows: token arrays of long texts are held in whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
