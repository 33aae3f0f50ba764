"""Dyadic cells: intervals as few cells of many sizes, so that points meet intervals, and intervals meet, by equal cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds are clamped to this many units on either side; what is beyond shares the last cells and is told apart by its own value.
_LIMIT = 1 << 52


def _units(value: Column, unit: float) -> Column:
    return F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.floor(value / unit).cast("long")))


def _shifted(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def interval_cells(start: Column, end: Column, unit: float = 1) -> Column:
    """Cells ``array<struct<level, cell>>`` that cover a closed interval without overlap: two of a level at most, so at most twice the logarithm of its length in units.

    A cell of level k is ``2 ** k`` units wide, and ``cell`` its number. At each level the left edge, rounded up, and the right one, rounded down, are cells of their own
    where they are odd, that is where the next level's cell would reach beyond the interval.
    """
    low, high = _units(start, unit), _units(end, unit) + 1
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2((high - low).cast("double"))).cast("int")) + 1)

    def at(level: Column) -> Column:
        left, right = -_shifted(-low, level), _shifted(high, level)
        own = lambda cell, ok: F.struct(level.alias("level"), cell.alias("cell"), ((left < right) & ok).alias("ok"))
        return F.array(own(left, left % 2 != 0), own(right - 1, right % 2 != 0))

    cells = F.filter(F.flatten(F.transform(levels, at)), lambda c: c["ok"])
    return F.when(start <= end, F.transform(cells, lambda c: F.struct(c["level"].alias("level"), c["cell"].alias("cell"))))


def point_cells(point: Column, levels: Sequence[int], unit: float = 1) -> Column:
    """The cells of the given levels that hold a point."""
    at = _units(point, unit)
    if not levels:
        return F.array().cast("array<struct<level: int, cell: bigint>>")
    return F.when(point.isNotNull(), F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("cell")) for k in levels]))


def used_levels(cells: DataFrame, column: str) -> list[int]:
    """Levels that some interval uses (under 64 of them), so that points are looked for at no others."""
    return sorted(r[0] for r in cells.select(F.explode(f"{column}.level").alias("k")).distinct().collect())


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[tuple[str, str]] = (), unit: float = 1) -> DataFrame:
    """Pairs of a point and a closed interval that holds it, each once; ``on`` names equal columns of the two sides. Columns must differ between the sides.

    An equal join of cells finds them, with or without ``on``; every joined pair with integral bounds in whole units is a result, others share a unit at least and
    are compared. So a hot cell costs what its results cost. Nulls and empty intervals meet nothing.
    """
    covered = intervals.where(F.col(start) <= F.col(end)).withColumn("__cells", interval_cells(_number(intervals, start), _number(intervals, end), unit))
    levels = used_levels(covered, "__cells")
    sides = [F.col(a) == F.col(b) for a, b in on]
    left = points.where(F.col(point).isNotNull()).withColumn("__p", F.explode(point_cells(_number(points, point), levels, unit)))
    right = covered.withColumn("__i", F.explode("__cells")).drop("__cells")
    pairs = left.join(right, [*sides, F.col("__p.level") == F.col("__i.level"), F.col("__p.cell") == F.col("__i.cell")]).drop("__p", "__i")
    return pairs.where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)))


def _number(df: DataFrame, column: str) -> Column:
    """Times as microseconds, dates as days, numbers as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(F.col(column)) if isinstance(kind, T.DateType) else F.col(column)


def meeting_intervals(a: DataFrame, b: DataFrame, on: Sequence[tuple[str, str]], a_bounds: tuple[str, str], b_bounds: tuple[str, str], unit: float = 1) -> DataFrame:
    """Pairs of closed intervals that meet, each once, whatever their lengths. Columns must differ between the sides.

    Two intervals meet where the later start lies in the other: starts of ``b`` in ``a``, and starts of ``a`` in ``b`` but for equal ones.
    """
    (a_start, a_end), (b_start, b_end) = a_bounds, b_bounds
    a, b = a.where(F.col(a_start) <= F.col(a_end)), b.where(F.col(b_start) <= F.col(b_end))
    first = points_in_intervals(b, a, b_start, a_start, a_end, [(y, x) for x, y in on], unit)
    then = points_in_intervals(a, b, a_start, b_start, b_end, on, unit).where(F.col(a_start) > F.col(b_start))
    return first.unionByName(then)
