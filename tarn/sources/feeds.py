"""Sources and sinks: document operations, delimited files, TREC files, vectors in binary, and generated data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.scalar import spread_number

_ID = r"^id:([^:]*):([^:]*):(?:g=([^:]*))?(?:n=([^:]*))?:(.*)$"


def with_id_parts(rows: DataFrame, column: str = "_id") -> DataFrame:
    """A document id's namespace, type, group and local part as ``_namespace``, ``_type``, ``_group``, ``_local``."""
    part = lambda k: F.regexp_extract(column, _ID, k)
    group = F.when(part(3) != "", part(3)).when(part(4) != "", part(4))
    return rows.withColumns({"_namespace": part(1), "_type": part(2), "_group": group, "_local": part(5)})


def read_operations(spark: SparkSession, path: str, fields: str, one_array: bool = False) -> DataFrame:
    """``op, _id, create, fields...`` of put, update and remove operations, a JSON object a line or one array."""
    schema = f"put string, update string, remove string, id string, create boolean, fields struct<{fields}>"
    rows = spark.read.schema(schema).option("multiLine", one_array).json(path)
    op = F.when(F.col("remove").isNotNull(), "remove").when(F.col("update").isNotNull(), "update").otherwise("put")
    return rows.select(op.alias("op"), F.coalesce("put", "update", "remove", "id").alias("_id"), F.coalesce("create", F.lit(False)).alias("create"), "fields.*")


def write_operations(rows: DataFrame, path: str, namespace: str, type_name: str, id_col: str) -> None:
    """Put operations, an object a line."""
    own = [c for c in rows.columns if c != id_col]
    put = F.concat(F.lit(f"id:{namespace}:{type_name}::"), F.col(id_col).cast("string"))
    rows.select(put.alias("put"), F.struct(*own).alias("fields")).write.json(path)


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    """Typed columns, no inference."""
    return spark.read.schema(schema).option("header", header).option("sep", separator).csv(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid, docid, rel`` of a file whose columns are parted by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("qid"), parts[2].alias("docid"), parts[3].cast("int").alias("rel"))


def write_run(ranked: DataFrame, path: str, query: str, doc: str, place: str, tag: str = "run") -> None:
    """A TREC run file; the score is 1000 less the place."""
    line = F.concat_ws(" ", F.col(query), F.lit("Q0"), F.col(doc), F.col(place), F.lit(1000) - F.col(place), F.lit(tag))
    ranked.select(line.alias("value")).write.text(path)


def read_lenient_json(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that parse and have the required fields, and a one-row table of how many did not; single quotes are allowed."""
    names = T.StructType.fromDDL(schema).fieldNames()
    rows = spark.read.schema(f"{schema}, __bad string").option("columnNameOfCorruptRecord", "__bad").option("allowSingleQuotes", True).json(path)
    good = F.col("__bad").isNull()
    for r in required:
        good = good & F.col(r).isNotNull()
    return rows.where(good).select(*names), rows.agg(F.sum(F.when(good, 0).otherwise(1)).alias("skipped"))


_VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.ByteType()))])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``count, dimension`` (32-bit little endian) and that many signed bytes a vector; ids count from 0 in a file."""

    return vectors_of(spark.read.format("binaryFile").load(path).select("content"))


def vectors_of(files: DataFrame) -> DataFrame:
    """The vectors of files in a column ``content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                count, size = np.frombuffer(content, "<i4", 2)
                data = np.frombuffer(content, np.int8, int(count) * int(size), 8).reshape(count, size)
                for at in range(0, int(count), 10_000):
                    part = data[at : at + 10_000]
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "vector": list(part)})

    return files.select("content").mapInPandas(run, _VECTORS)


def read_group(spark: SparkSession, path: str, group: str) -> DataFrame:
    """One group of a table that is partitioned by ``group``: other folders are not read."""
    return spark.read.parquet(path).where(F.col("group") == group)


def write_grouped(rows: DataFrame, path: str) -> None:
    """Partitioned by ``group``; rows of a group are gathered first, so that it has few files."""
    rows.repartition("group").write.partitionBy("group").parquet(path)


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Documents by id."""
    return rows.join(table, key, "left")


def visit(rows: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """The next ``limit`` rows in key order after a continuation, the last key of the part before: a range of the key, no offset."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of an order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def random_albums(ids: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """An album for each id, with random scores for three categories, the same on every run."""
    number = lambda k, n: F.pmod(spread_number(seed + k, F.col(id_col)), F.lit(n)).cast("int")
    score = lambda k: number(k, 101).cast("float")
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), number(k, len(words)) + 1)
    scores = F.create_map(F.lit("pop"), score(1), F.lit("rock"), score(2), F.lit("jazz"), score(3))
    return ids.select(F.concat(F.lit("album-"), F.col(id_col)).alias("_id"), pick(["red", "blue", "silent", "loud"], 4).alias("artist"), (1960 + number(5, 60)).alias("year"), scores.alias("category_scores"))
