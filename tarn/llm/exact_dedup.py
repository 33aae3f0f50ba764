"""Exact deduplication by 128-bit content hash with a byte comparison inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    hash128: Callable[[Column], Column] = F.md5,
    rank: Callable[[Column], Column] = lambda i: i,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the 128-bit hash of the normalised text and by its bytes,
    so two texts with the same hash stay apart. Copies are counted where they are
    read, hence a group with a third of all rows costs one row for each task. Of a
    group the id with the smallest ``rank(id)`` stays. Only groups of two or more
    go back to their rows, by hash and SHA-256 (no text moves a second time); the
    engine splits a skewed key of that join.

    A null text is the empty text. Null ids are never kept unless a group has no
    other (then keep_id is null and its rows count as kept). Rows that repeat an id
    within a group share one decision, and each counts in ``group_size``. Other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    keyed = rows.withColumn("h", hash128(F.col("t")))
    groups = (
        keyed.groupBy("h", "t")
        .agg(F.min_by("doc_id", rank(F.col("doc_id"))).alias("g_keep"), F.count("*").alias("g_size"))
        .where("g_size > 1")
        .select("h", F.sha2("t", 256).alias("s"), "g_keep", "g_size")
    )
    light = keyed.select("doc_id", "h", F.sha2("t", 256).alias("s"))
    joined = light.join(groups, ["h", "s"], "left")
    grouped = F.col("g_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("g_keep")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("g_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("doc_id").eqNullSafe(F.col("g_keep"))).otherwise(F.lit(True)).alias("kept"),
        F.col("s").alias("text_sha256"),
    )


def op9_exact_dedup(spark, sf_dir):
    """Contract query: of equal texts the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, rank=lambda i: -i)


OP9_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
