"""Document types: typed fields with roles, inheritance, fieldsets, summary classes, derived fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DocumentType:
    """A named record: DDL of its own fields, parents, derived columns, fieldsets (F8) and summary classes."""

    name: str
    ddl: str
    parents: tuple[DocumentType, ...] = ()
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)
    fieldsets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    summaries: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        own = T.StructType.fromDDL(self.ddl)
        inherited = [f for p in self.parents for f in p.schema().fields]
        names = {f.name for f in own.fields}
        return T.StructType([f for f in inherited if f.name not in names] + own.fields)

    def ingested(self, rows: DataFrame) -> DataFrame:
        """Fields of the type cast to it, missing ones null, then the derived ones in order; others are dropped."""
        out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema().fields])
        for name, make in {k: v for p in (*self.parents, self) for k, v in p.derived.items()}.items():
            out = out.withColumn(name, make())
        return out

    def summary(self, rows: DataFrame, name: str) -> DataFrame:
        """A projection by class name; entries ``a as b`` rename."""
        for t in (self, *self.parents):
            if name in t.summaries:
                return rows.selectExpr(*t.summaries[name])
        raise KeyError(name)


def routed_scan(types: dict[str, DataFrame], wanted: list[str] | None = None) -> DataFrame:
    """One, several or all types as one table with ``_type``; fields that a type lacks are null."""
    parts = [df.withColumn("_type", F.lit(n)) for n, df in types.items() if wanted is None or n in wanted]
    if not parts:
        raise ValueError("no such type")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def matched_elements(values: Column, condition: Callable[[Column], Column]) -> Column:
    """P5."""
    return F.filter(values, condition)


def elements_by_labels(values: Column, labels: Column) -> Column:
    """Elements at 0-based places, in the order of the labels; places outside are left out."""
    return F.filter(F.transform(labels, lambda i: F.get(values, i.cast("int"))), lambda x: x.isNotNull())


def with_default(column: Column, default: str = "-") -> Column:
    """P13."""
    return F.coalesce(column, F.lit(default))
