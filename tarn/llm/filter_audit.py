"""Filter interaction audit: documents are counted on the edges of the filter lattice, orders are paths through it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import base

#: Orders grow as a factorial: 5,040 of them for seven filters.
MOST_FILTERS = 7

#: Contract conditions, each true where a document fails: white space that parts words, and what filters B, C and D look for.
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
MARKS = "[#$%&*|]"


def contract_failures(text: Column) -> dict[str, Column]:
    """Filters A to D of the contract by their letter; words are of one array, which Catalyst evaluates once."""
    parted = F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " ")
    words = F.array_remove(parted, "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def edges(n: int) -> list[tuple[int, int]]:
    """All ``(already applied, next filter)`` of ``n`` filters as ``(bits, place)``: ``n * 2 ** (n - 1)`` of them."""
    return [(done, f) for f in range(n) for done in range(1 << n) if not done >> f & 1]


def paths(letters: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """``filter_order, step, done, place`` of each step of each order: an order is a path of edges from no filter to all."""
    rows = []
    for order in itertools.permutations(range(len(letters))):
        name, done = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append((name, step, done, f))
            done |= 1 << f
    return rows


def classes(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], duplicate: str | None, part_col: str, text_col: str, id_col: str) -> DataFrame:
    """``part, mask, good, toxic, n``: how many documents of a part fail just the filters of the mask (bit k: the k-th letter).

    A text is read once and leaves as a mask and its SHA-256, in a table of the shared folder. Rows of equal id and
    text become one with a count, rows of equal text one for each part and label, both before they are shuffled; hence
    a text of a third of all rows is a few rows for each task when the least id of each text is sought.
    """
    letters = [*failures, *([duplicate] if duplicate else [])]
    mask = sum((F.when(F.coalesce(failed, F.lit(False)), 1 << k).otherwise(0) for k, failed in enumerate(failures.values())), F.lit(0))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    light = base.written(plain.select("doc_id", "part", mask.alias("mask"), F.sha2(text_col, 256).alias("h")), "audit-masks")
    known = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = light.groupBy("doc_id", "part", "mask", "h").agg(F.count("*").alias("n")).join(known.where("__id IS NOT NULL"), F.col("doc_id") == F.col("__id"), "left")
    rows = rows.select("doc_id", "part", "mask", "h", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    if duplicate:
        has_id = F.col("doc_id").isNotNull()
        alike = rows.groupBy("h", "part", "mask", "good", "toxic", has_id.alias("has_id")).agg(F.sum("n").alias("n"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"))
        first = F.min("least.doc_id").over(Window.partitionBy("h"))
        alike = alike.withColumn("stay", F.when(~F.col("has_id"), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
        bit = 1 << (len(letters) - 1)
        split = F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
        rows = alike.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edge_counts(found: DataFrame, n: int) -> DataFrame:
    """``part, done, place`` and what happens there, of all ``n * 2 ** (n - 1)`` edges of each part, zeros included.

    ``kept`` and ``removed`` are of documents that none of the filters already applied removed; ``redundant`` fail the next
    filter but were removed before; ``unique_fails`` fail it and no other; ``good_lost`` and ``toxic_lost`` are of ``removed``.
    """
    each = F.array(*[F.struct(F.lit(done).alias("done"), F.lit(f).alias("place"), F.lit(1 << f).alias("bit")) for done, f in edges(n)])
    on = found.select("*", F.inline(each))
    fails, alive = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("done")) == 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return on.groupBy("part", "done", "place").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(alive & fails & F.col("good")).alias("good_lost"),
        total(alive & fails & F.col("toxic")).alias("toxic_lost"),
    )


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    failures: dict[str, Column],
    duplicate: str | None = None,
    part_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """What each filter removes at each step of each order, by part: ``part, filter_order, step``, the counts of :func:`edge_counts`, ``shapley``.

    ``failures`` maps one-letter names to conditions over the columns id, part and text of ``docs``, true where a
    document fails; a null condition passes. ``duplicate`` names one more filter, which a document fails whose text some
    row of a smaller id has, removed or not. Documents are counted once on the edges ``(filters applied, next filter)``;
    the steps of all orders are joined to those counts. ``shapley`` is what the step's filter removes, summed
    over all orders: an edge counts once for each order that passes it.

    A null text is empty, a null part the empty string. A null id has no smaller one, is nobody's smaller one, and has
    no label; rows of equal id and text fail the duplicate filter together or not at all. Labels that repeat
    an id count where one says so; null labels say nothing. Other columns are ignored; an empty table gives an empty one.
    """
    letters = [*failures, *([duplicate] if duplicate else [])]
    if len(letters) > MOST_FILTERS or any(len(x) != 1 for x in letters) or len(set(letters)) < len(letters):
        raise ValueError(f"up to {MOST_FILTERS} filters with distinct names of one letter")
    n = len(letters)
    counted = edge_counts(classes(docs, labels, failures, duplicate, part_col, text_col, id_col), n)
    # orders through an edge: any order of what was applied, and of what is left
    size = F.bit_count("done")
    through = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), (size + 1).cast("int"))
    counted = counted.withColumn("shapley", F.sum(F.col("removed") * through).over(Window.partitionBy("part", "place")))
    steps = base.small_table(docs.sparkSession, paths(letters), "filter_order string, step int, done int, place int")
    return counted.join(F.broadcast(steps), ["done", "place"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley")
    )


def op11_filter_audit(spark, sf_dir):
    """Contract query: filters A to E over whole documents, in all 120 orders, by source."""
    return filter_audit(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"), contract_failures(F.col("text")), "E")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                            regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fail FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
c AS (SELECT part, fail, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2, 3, 4),
one AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ord FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ord, step, ord[step] AS nxt, ord[1:step - 1] AS done FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT c.*, s.*, fail[nxt] AS fails, len(list_filter(done, lambda i: fail[i])) = 0 AS alive, len(list_filter(fail, lambda b: b)) AS n_fail FROM c, s),
r AS (SELECT part, ord, step, nxt,
             sum(CASE WHEN alive AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN alive AND fails THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN NOT alive AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND n_fail = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN alive AND fails AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN alive AND fails AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM x GROUP BY 1, 2, 3, 4)
SELECT part, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, nxt))::BIGINT AS shapley
FROM r
"""
