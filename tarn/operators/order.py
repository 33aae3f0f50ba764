"""Order statistics and numbering without one task for all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boundaries of a pass; a range of the values with so few rows or less is sorted at once.
BOUNDARIES = 256
FEW = 10_000


def _counted(values: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Rows below the first edge, equal to it, between it and the second, and so on: one count for each edge and gap, added in each task."""
    shipped = values.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shipped.value
        n = np.zeros(2 * len(edges) + 1, np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            n += np.bincount(np.searchsorted(edges, x, "left") + np.searchsorted(edges, x, "right"), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["cell", "n"])

    out = np.zeros(2 * len(edges) + 1, np.int64)
    for r in values.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def at_ranks(rows: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """The values at some ranks from 0 of the sorted column, nulls and NaN left out: exact, however many rows and ties.

    Each pass takes boundaries from approximate quantiles of the rows still in question (a small mergeable state), counts exactly how many rows lie at and
    between them, and goes on with the gaps that hold a rank, a few hundredths of the rows. A rank that falls on a boundary is settled, so equal values
    need no narrowing. Gaps of ``FEW`` rows or less are sorted on the driver.
    """
    numbers = rows.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    found: dict[int, float] = {}
    open_gaps: list[tuple[float, float, list[tuple[int, int]]]] = [(-math.inf, math.inf, [(r, r) for r in sorted(set(ranks))])]  # bounds, and (rank, rank within)
    while open_gaps:
        low, high, wanted = open_gaps.pop()
        inside = numbers if (low, high) == (-math.inf, math.inf) else numbers.where((F.col("x") > low) & (F.col("x") < high))
        if math.isinf(low) and math.isinf(high):  # infinities are values too
            inside = numbers
        steps = [k / (BOUNDARIES - 1) for k in range(BOUNDARIES)]
        edges = inside.agg(F.percentile_approx("x", F.array(*map(F.lit, steps)), 10 * BOUNDARIES)).first()[0]
        if edges is None:
            raise ValueError("fewer rows than the ranks asked for")
        edges = np.unique(np.array(edges, np.float64))
        n = _counted(inside, edges)
        until = np.cumsum(n)
        if wanted[-1][1] >= until[-1] or wanted[0][1] < 0:
            raise ValueError("fewer rows than the ranks asked for")
        gaps: dict[int, list[tuple[int, int]]] = {}
        for rank, within in wanted:
            cell = int(np.searchsorted(until, within, "right"))
            if cell % 2:
                found[rank] = float(edges[cell // 2])
            else:
                gaps.setdefault(cell // 2, []).append((rank, within - int(until[cell] - n[cell])))
        for gap, still in gaps.items():
            a, b = (float(edges[gap - 1]) if gap else low), (float(edges[gap]) if gap < len(edges) else high)
            if n[2 * gap] <= FEW:
                here = sorted(r[0] for r in inside.where((F.col("x") > a) & (F.col("x") < b)).collect())
                found |= {rank: here[within] for rank, within in still}
            else:
                open_gaps.append((a, b, still))
    return [found[r] for r in ranks]


def exact_percentiles(rows: DataFrame, value: str, at: Sequence[float]) -> list[float | None]:
    """Percentiles interpolated between the two nearest ranks, as the ``percentile`` function has them, without its map of all values; null where there is no row."""
    n = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    values = dict(zip(ranks, at_ranks(rows, value, ranks), strict=True))
    return [values[math.floor(x)] + (x - math.floor(x)) * (values[math.ceil(x)] - values[math.floor(x)]) if values[math.floor(x)] != values[math.ceil(x)] else values[math.floor(x)] for x in places]


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, path: str) -> DataFrame:
    """Rows with their place from 0 in an order, which must tell all rows apart, as a column ``name``; no task sees all of them.

    Rows are dealt by ranges of the order and written under ``path`` with the number of their part; parts are numbered by themselves and moved on by what
    comes before them, a table of one row a part.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__place", place).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def counted_before(rows: DataFrame, order: Sequence[str | Column], counted: Column, name: str, path: str) -> DataFrame:
    """Rows with a column ``name``: how many of those with ``counted`` come before them in an order, which must tell all rows apart; as :func:`numbered`, by ranges."""
    spark = rows.sparkSession
    rows.withColumn("__one", counted.cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("__part").agg(F.sum("__one").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("__one").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__one")
    return dealt.withColumn("__within", within).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(name, F.col("__within") + F.col("__before")).drop("__part", "__one", "__within", "__before")
