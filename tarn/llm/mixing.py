"""Mixing sources to target weights by Pfair scheduling with earliest deadline first.

Weights are taken as exact fractions ``q / Q`` of integers. Block ``k`` (from 0) of a
source is released at slot ``floor(k * Q / q)`` and due at ``ceil((k + 1) * Q / q)``;
in each slot the released block with the earliest deadline goes out. At every slot of
a phase a source is then less than one block away from its target. With a ``quantum``,
weights are rounded to shares of it: the schedule repeats after ``quantum`` slots, and
one period is computed.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base


_OWN = ("block_no", "release", "deadline", "slot", "mix_pos")


def quantised(weights: dict[str, float], quantum: int) -> dict[str, int]:
    """Integers that sum to ``quantum``, at least 1 each, by largest remainder; ties go by name."""
    names = sorted(n for n, w in weights.items() if w > 0)
    if len(names) > quantum:
        raise ValueError(f"{len(names)} sources need a quantum of at least as much")
    total = sum(weights[n] for n in names)
    exact = {n: weights[n] / total * quantum for n in names}
    out = {n: max(1, math.floor(exact[n])) for n in names}
    while (rest := quantum - sum(out.values())) > 0:
        for n in sorted(names, key=lambda n: (out[n] - exact[n], n))[:rest]:
            out[n] += 1
    while sum(out.values()) > quantum:  # sources too small for a whole share took one
        n = max((n for n in names if out[n] > 1), key=lambda n: (out[n] - exact[n], n))
        out[n] -= 1
    return out


def one_period(shares: dict[str, int]) -> list[str]:
    """The source of each slot of a period, earliest deadline first among released blocks; ties go by name."""
    quantum = sum(shares.values())
    done = dict.fromkeys(shares, 0)
    slots = []
    for t in range(quantum):
        ready = [(-(-(done[s] + 1) * quantum // q), s) for s, q in shares.items() if done[s] < q and done[s] * quantum // q <= t]
        due, source = min(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")  # cannot happen: the shares sum to one
        done[source] += 1
        slots.append(source)
    return slots


def plan(blocks: dict[str, int], weights: dict[str, float], quantum: int) -> list[tuple]:
    """Rows ``source, phase_no, from_block, to_block, first_slot, share, place, at``: where each block of a source goes.

    A phase lasts until the first source runs out; the others go on in the
    proportions of their weights. Within a phase, block ``from_block + j`` goes to
    slot ``first_slot + (j div share) * period + at``, where ``at`` is the slot of
    place ``j mod share`` in the period. There are at most as many phases as sources.
    """
    done, first, rows, phase = dict.fromkeys(blocks, 0), 0, [], 0
    while live := {s: weights[s] for s in sorted(blocks) if done[s] < blocks[s]}:
        shares = quantised(live, quantum)
        period = one_period(shares)
        at: dict[str, list[int]] = {s: [] for s in shares}
        for t, s in enumerate(period):
            at[s].append(t)
        # the slot in which a source first lacks a block ends the phase
        left = {s: blocks[s] - done[s] for s in live}
        length = min((left[s] // q) * quantum + at[s][left[s] % q] for s, q in shares.items())
        for s, q in shares.items():
            took = (length // quantum) * q + sum(t < length % quantum for t in at[s])
            rows += [(s, phase, done[s], done[s] + took, first, q, place, t) for place, t in enumerate(at[s])]
            done[s] += took
        first, phase = first + length, phase + 1
    return rows


def schedule(blocks: list[int], weights: list[float], rows_at_once: int = 250_000) -> Iterator[list[array]]:
    """Columns ``source, block, release, deadline, slot`` of every block, in slot order, some rows at a time.

    Sources are numbered by their places in ``blocks``. Weights are exact, and ties go to the greater weight, then to the
    first source: of sources without a block in this phase the next is then the first of a list that is sorted once, so
    a phase costs as much as its slots. A phase ends as in ``plan``.
    """
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*{w.denominator for w in exact})
    order = sorted((i for i, n in enumerate(blocks) if n), key=lambda i: (-exact[i], i))
    q, left = [int(exact[i] * scale) for i in order], [blocks[i] for i in order]
    after = [*range(1, len(order) + 1)]  # the next source that is not dropped from the list
    head, total, first, taken = 0, sum(q), 0, [0] * len(order)
    out = [array("q") for _ in range(5)]
    while total:
        ended: list[int] = []
        ready: list[tuple[int, int]] = []
        later: list[tuple[int, int]] = []
        done: dict[int, int] = {}
        before, fresh, t = -1, head, 0
        while True:
            while later and later[0][0] <= t:
                i = heapq.heappop(later)[1]
                heapq.heappush(ready, (-(-(done[i] + 1) * total // q[i]), i))
            while fresh < len(order) and not left[fresh]:
                fresh = after[fresh]
                if before < 0:
                    head = fresh
                else:
                    after[before] = fresh
            new = (-(-total // q[fresh]), fresh) if fresh < len(order) else None
            due, i = min(ready[0], new) if ready and new else ready[0] if ready else new
            if due <= t:
                raise AssertionError("a deadline was missed")  # cannot happen: the shares sum to one
            if not left[i]:
                break
            if i == fresh and i not in done:
                before, fresh = fresh, after[fresh]
            else:
                heapq.heappop(ready)
            k = done.get(i, 0)
            for column, value in zip(out, (order[i], taken[i], first + k * total // q[i], first + due, first + t), strict=True):
                column.append(value)
            done[i] = k + 1
            taken[i] += 1
            left[i] -= 1
            if not left[i]:
                ended.append(i)
            heapq.heappush(later, ((k + 1) * total // q[i], i))
            t += 1
            if len(out[0]) == rows_at_once:
                yield out
                out = [array("q") for _ in range(5)]
        total -= sum(q[i] for i in ended)
        first += t
    yield out


def numbered(docs: DataFrame, counts: dict[str, int], id_col: str, rows_in_chunk: int) -> DataFrame:
    """``docs``, which have ``__source``, with ``__src``, its place in ``counts``, and ``__row``: from 0 within the source, in hashed order of the id.

    A source is cut into chunks of about ``rows_in_chunk`` rows by a hash of the id; chunk
    counts are summed up first, then each chunk numbers its rows: none is ordered in one task.
    """
    spark = docs.sparkSession
    columns = [pa.array(counts.keys(), pa.string()), pa.array(range(len(counts)), pa.int64()), pa.array([-(-n // rows_in_chunk) for n in counts.values()], pa.int64())]
    chunks = spark.createDataFrame(pa.table(columns, names=["__source", "__src", "__chunks"]))
    keyed = docs.join(F.broadcast(chunks), "__source").withColumn("__chunk", F.pmod(F.xxhash64(F.col(id_col)), F.col("__chunks"))).drop("__chunks")
    sizes = keyed.groupBy("__source", "__chunk").agg(F.count("*").alias("__n"))
    before = sizes.selectExpr("__source", "__chunk", "sum(__n) OVER (PARTITION BY __source ORDER BY __chunk) - __n AS __before")
    placed = keyed.selectExpr("*", f"row_number() OVER (PARTITION BY __source, __chunk ORDER BY xxhash64(`{id_col}`), `{id_col}`) - 1 AS __at")
    return placed.join(before, ["__source", "__chunk"]).withColumn("__row", F.col("__before") + F.col("__at")).drop("__chunk", "__before", "__at")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block: int = 16,
    quantum: int | None = None,
    temperature: float = 0.5,
    source_col: str = "source",
    id_col: str = "doc_id",
    rows_in_chunk: int = 5000,
    other_weight: float = 1.0,
) -> DataFrame:
    """``docs`` with ``block_no, release, deadline, slot, mix_pos``: rows ordered by ``mix_pos`` hold the sources in their target weights.

    ``weights`` maps sources to targets; a source that it lacks gets ``other_weight``.
    Without it, targets are the sources' row counts to the power ``temperature``. Each
    source is cut into blocks of ``block`` rows in hashed order of the id; a block's slot is
    at or after ``release`` and before ``deadline``. No row is
    dropped or repeated: when a source runs out the others keep their proportions, from
    that slot on.

    Without ``quantum``, weights are exact and any number of sources is possible. The
    slots are planned one by one on the driver and written in parts, so its memory holds
    a few numbers a source. With ``quantum``, weights are rounded to multiples of
    ``1 / quantum`` (one at least), from which the deviation grows with the slots; up to
    ``quantum`` sources are possible, which bounds the plan that is broadcast.

    A null source is the source ''. Null ids and repeated rows are scheduled as rows of
    their own (equal ids in no set order); texts are not read. Columns with the names
    of the result's own are replaced, others kept. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in _OWN]
    docs = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(source_col), F.lit("")).alias("__source"))
    sizes = docs.groupBy("__source").count()
    sizes = (sizes if quantum is None else sizes.limit(quantum + 1)).toArrow()
    counts = dict(sorted(zip(sizes.column("__source").to_pylist(), sizes.column("count").to_pylist(), strict=True)))
    if quantum is not None and len(counts) > quantum:
        raise ValueError(f"more than {quantum} sources")
    if weights is None:
        weights = {s: n**temperature for s, n in counts.items()}
    targets = {s: weights.get(s, other_weight) for s in counts}
    if any(w <= 0 for w in targets.values()):
        raise ValueError("weights must be positive")
    blocks = {s: -(-n // block) for s, n in counts.items()}
    rows = numbered(docs, counts, id_col, rows_in_chunk).withColumn("block_no", F.floor(F.col("__row") / block))
    rows = _planned(rows, blocks, targets) if quantum is None else _periodic(rows, blocks, targets, quantum)
    return rows.select(
        *[F.col(f"`{c}`") for c in own],
        *[F.col(c).cast("long").alias(c) for c in ("block_no", "release", "deadline", "slot")],
        (F.col("slot") * block + F.col("__row") % block).cast("long").alias("mix_pos"),
    )


def _planned(rows: DataFrame, blocks: dict[str, int], targets: dict[str, float]) -> DataFrame:
    """``rows`` with ``release, deadline, slot`` from the exact schedule, a table in the shared folder."""
    spark, names = rows.sparkSession, ("__src", "block_no", "release", "deadline", "slot")
    path = base.fresh_path(spark, "mixing-plan")
    for part in schedule([*blocks.values()], [targets[s] for s in blocks]):
        spark.createDataFrame(pa.table([pa.array(np.asarray(c, np.int64)) for c in part], names=names)).write.mode("append").parquet(path)
    table = spark.read.schema(", ".join(f"{c} long" for c in names)).parquet(path)
    own = [F.col(f"`{c}`") for c in rows.columns if c not in names[2:]]
    return rows.select(*own).join(table, ["__src", "block_no"])


def _periodic(rows: DataFrame, blocks: dict[str, int], targets: dict[str, float], quantum: int) -> DataFrame:
    """``rows`` with ``release, deadline, slot`` from one period a phase."""
    spark = rows.sparkSession
    slots = plan(blocks, targets, quantum)
    # a phase is a range of a source's blocks, found from the block's number through the list of ranges
    ends: dict[str, list[int]] = {}
    for s, _, _, to, _, _, place, _ in slots:
        if place == 0:
            ends.setdefault(s, []).append(to)
    ranges = base.small_table(spark, [(s, e) for s, e in ends.items()], "__source string, ends array<bigint>")
    table = base.small_table(spark, slots, "__source string, phase_no int, from_block long, to_block long, first_slot long, share long, place long, at long")
    rows = rows.join(F.broadcast(ranges), "__source")
    rows = rows.withColumn("phase_no", F.size(F.filter("ends", lambda e: e <= F.col("block_no"))))
    phases = table.where("place = 0").drop("place", "at", "to_block")
    rows = rows.join(F.broadcast(phases), ["__source", "phase_no"])
    rows = rows.withColumn("place", (F.col("block_no") - F.col("from_block")) % F.col("share"))
    rows = rows.join(F.broadcast(table.select("__source", "phase_no", "place", "at")), ["__source", "phase_no", "place"])
    slot = F.col("first_slot") + F.floor((F.col("block_no") - F.col("from_block")) / F.col("share")) * quantum + F.col("at")
    window = lambda k, up: F.col("first_slot") + (F.ceil if up else F.floor)(k * quantum / F.col("share"))
    k = F.col("block_no") - F.col("from_block")
    return rows.withColumn("release", window(k, False)).withColumn("deadline", window(k + 1, True)).withColumn("slot", slot)


def op2_mixing(spark, sf_dir):
    """All of ``documents`` in mixed order; targets are the square roots of the sources' sizes."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block_no", "release", "deadline", "slot", "mix_pos")
