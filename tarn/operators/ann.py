"""A trained index for nearest neighbours: k-means lists, product-quantised residuals, partitions read only where probed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import tensor as tn

#: Rows that one k-means is fitted on, whatever the table's size; all rows are indexed.
SAMPLE = 200_000
#: Pairs of a query and a row whose distances a task holds at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the lists ``(lists, dim)``, and for each part of a residual a book of codes ``(parts, codes, dim / parts)``."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.books)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _closest(rows: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Places of the ``k`` nearest centres of each row, nearest first; ties go to the smaller place."""
    out = np.empty((len(rows), min(k, len(centres))), np.int64)
    norm = (centres**2).sum(1)
    for start in range(0, len(rows), 4096):
        part = rows[start : start + 4096]
        d = norm - 2 * part @ centres.T
        if k > 4:
            out[start : start + len(part)] = np.argsort(d, axis=1, kind="stable")[:, :k]
            continue
        for place in range(out.shape[1]):
            out[start : start + len(part), place] = best = d.argmin(1)
            d[np.arange(len(part)), best] = np.inf
    return out


def sampled(vectors: DataFrame, id_col: str, vector: str, most: int) -> DataFrame:
    """About ``most`` rows by a hash of the id (all where there are fewer), so that the fit is bounded and repeatable."""
    known = vectors.where(F.col(vector).isNotNull())
    share = min(1.0, most / max(1, known.count()))
    buckets = 1 << 30
    return known.where(F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(buckets)) < math.ceil(share * buckets))


def k_means(rows: DataFrame, id_col: str, vector: str, k: int, parts: int = 1, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds for each of ``parts`` equal pieces of the vectors at once: centres ``(parts, k, dim / parts)``.

    Each task sends sums of its rows per centre, which are added where centres are dealt to; the driver holds the centres only. First centres are the
    rows with the least hashes; a centre that loses all rows stays where it was. With fewer rows than ``k`` there are as many centres as rows.
    """
    first = rows.select(vector).orderBy(F.xxhash64(F.lit(5), F.col(id_col)), id_col).limit(k).collect()
    if not first:
        raise ValueError("no vectors to fit")
    start = np.array([r[0] for r in first], np.float64)
    centres = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    spark = rows.sparkSession
    made = len(first)

    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(centres)

        def partial(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            now = shipped.value
            sums, n = np.zeros_like(now), np.zeros(now.shape[:2])
            for batch in batches:
                x = _matrix(batch.column(0))
                for p in range(parts if len(x) else 0):
                    piece = x[:, p * now.shape[2] : (p + 1) * now.shape[2]]
                    cell = _closest(piece, now[p])[:, 0]
                    np.add.at(sums[p], cell, piece)
                    n[p] += np.bincount(cell, minlength=made)
            used = np.flatnonzero(n)
            values = pa.array(list(sums.reshape(parts * made, -1)[used]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n.reshape(-1)[used]), values], names=["cell", "n", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for cell, n, sums in zip(batch.column("cell").to_pylist(), batch.column("n").to_pylist(), _matrix(batch.column("sums")), strict=True):
                    old = total.setdefault(cell, [0.0, 0.0])
                    old[0], old[1] = old[0] + n, old[1] + sums
            values = pa.array([t[1] / t[0] for t in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), values], names=["cell", "centre"])

        sums = rows.select(vector).mapInArrow(partial, "cell long, n double, sums array<double>")
        moved = sums.repartition("cell").mapInArrow(added, "cell long, centre array<double>").collect()
        centres = centres.copy()
        for r in moved:
            centres[r.cell // made, r.cell % made] = r.centre
        shipped.destroy()
    return centres


def train(vectors: DataFrame, id_col: str, vector: str, lists: int, parts: int = 8, codes: int = 256, rounds: int = 10, sample: int = SAMPLE) -> Quantiser:
    """V3, V6: centroids by distributed k-means on about ``sample`` rows, then books of codes on what is left of the rows after their centroid.

    ``parts`` must divide the dimension. Null vectors are left out.
    """
    rows = sampled(vectors, id_col, vector, sample).select(id_col, tn.doubles(F.col(vector)).alias("__v"))
    centroids = k_means(rows, id_col, "__v", lists, rounds=rounds)[0]
    if centroids.shape[1] % parts:
        raise ValueError(f"{parts} parts do not divide {centroids.shape[1]} dimensions")
    left = rows.mapInArrow(_residuals(rows.sparkSession.sparkContext.broadcast(centroids)), f"{id_col} {dict(rows.dtypes)[id_col]}, __v array<double>")
    return Quantiser(centroids, k_means(left, id_col, "__v", codes, parts, rounds))


def _residuals(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            x = x - shipped.value[_closest(x, shipped.value)[:, 0]] if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=batch.schema.names)

    return run


def encoded(vectors: DataFrame, id_col: str, vector: str, quantiser: Quantiser, copies: int = 1, factor: float = 0.9) -> DataFrame:
    """V3, V4: ``list, id, code, gap, v``: each vector in its nearest list, and in up to ``copies`` lists whose closeness is above ``factor`` times the best's.

    ``code`` has one byte for each part of the residual, ``gap`` is the distance to the centroid. No shuffle.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shipped.value
        width = q.books.shape[2]
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            near = _closest(x, q.centroids, copies)
            gap = np.sqrt(((x[:, None, :] - q.centroids[near]) ** 2).sum(2))
            close = 1 / (1 + gap)
            keep = close > factor * close[:, :1]
            keep[:, 0] = True
            row, place = np.nonzero(keep)
            left = x[row] - q.centroids[near[row, place]]
            code = np.stack([_closest(left[:, p * width : (p + 1) * width], q.books[p])[:, 0] for p in range(q.parts)], 1).astype(np.uint8)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near[row, place].astype(np.int32)), batch.column("id").take(taken), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(gap[row, place]), batch.column("v").take(taken)],
                names=["list", "id", "code", "gap", "v"],
            )

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), tn.doubles(F.col(vector)).alias("v"))
    return rows.mapInArrow(run, f"list int, id {dict(rows.dtypes)['id']}, code binary, gap double, v array<double>")


def write_index(vectors: DataFrame, id_col: str, vector: str, quantiser: Quantiser, path: str, copies: int = 1, factor: float = 0.9) -> None:
    """The index as tables under ``path``: ``lists``, a partition for each list; ``centroids`` with rows and radius of each list; ``books``.

    Rows are encoded once, then dealt by ranges of list and id, so that a list is few files, a list with many rows is several tasks' work, and a task has one file open at a time.
    """
    if quantiser.books.shape[1] > 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    encoded(vectors, id_col, vector, quantiser, copies, factor).write.parquet(f"{path}/encoded")
    rows = spark.read.parquet(f"{path}/encoded").repartitionByRange("list", "id")
    rows.sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/lists")
    measured = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    centroids = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(quantiser.centroids)], "list int, centroid array<double>")
    centroids.join(measured, "list", "left").na.fill({"n": 0, "radius": 0.0}).coalesce(1).write.parquet(f"{path}/centroids")
    flat = [(p, k, c.tolist()) for p, book in enumerate(quantiser.books) for k, c in enumerate(book)]
    spark.createDataFrame(flat, "part int, code int, centre array<double>").coalesce(1).write.parquet(f"{path}/books")


@dataclass
class Index:
    """An index that was written: its quantiser, and the rows and radius of each list."""

    spark: SparkSession
    path: str
    quantiser: Quantiser
    sizes: np.ndarray
    radii: np.ndarray

    def lists(self, wanted=None) -> DataFrame:
        """The indexed rows; of the ``wanted`` lists alone, whose partitions are the only ones that are listed and read."""
        rows = self.spark.read.parquet(f"{self.path}/lists")
        return rows if wanted is None else rows.where(F.col("list").isin([int(x) for x in wanted]))


def open_index(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    books = spark.read.parquet(f"{path}/books").orderBy("part", "code").collect()
    parts = 1 + max(r.part for r in books)
    quantiser = Quantiser(np.array([r.centroid for r in rows]), np.array([r.centre for r in books]).reshape(parts, len(books) // parts, -1))
    return Index(spark, path, quantiser, np.array([r.n for r in rows]), np.array([r.radius for r in rows]))


def _query_blocks(queries: DataFrame, query_id: str, query_vector: str, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """A stated set of queries in parts of about ``most``: ids and vectors, on the driver."""
    parts = max(1, -(-queries.count() // most))
    for k in range(parts):
        part = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(F.col(query_id)), F.lit(parts)) == k)
        rows = sorted(part.where(F.col(query_vector).isNotNull()).select(query_id, query_vector).collect())
        if rows:
            yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def _asked(near: np.ndarray) -> dict[int, np.ndarray]:
    """For each list the places of the queries that want it, from a matrix ``(queries, lists)`` of truths."""
    return {int(c): np.flatnonzero(near[:, c]) for c in np.flatnonzero(near.any(0))}


def _probed(index: Index, vectors: np.ndarray, probes: int) -> np.ndarray:
    near = np.zeros((len(vectors), len(index.sizes)), bool)
    np.put_along_axis(near, _closest(vectors, index.quantiser.centroids, probes), True, 1)
    return near


def _pieces(batch: pa.RecordBatch, of_list: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``list, queries, rows`` of a batch: places of the queries that want a list and of some of its rows, :data:`PAIRS` pairs at most."""
    lists = batch.column("list").to_numpy()
    order = np.argsort(lists, kind="stable")
    for at in np.split(order, 1 + np.flatnonzero(np.diff(lists[order]))):
        asked = of_list.get(int(lists[at[0]])) if len(at) else None
        if asked is None:
            continue
        step = max(1, PAIRS // len(asked))
        for start in range(0, len(at), step):
            yield int(lists[at[0]]), asked, at[start : start + step]


def _shortlisted(index: Index, ids: list, vectors: np.ndarray, id_type: str, probes: int, shortlist: int) -> DataFrame:
    """``query_id, list, id, approximate``: of the probed lists the ``shortlist`` rows of least distance by codes, for each query.

    The rows that codes stand for meet all queries of their list in one matrix product. Each task keeps its best rows
    only, so a list with a third of all rows is as many tasks as it has files, and none sends more than the others.
    """
    of_list = _asked(_probed(index, vectors, probes))
    shipped = index.spark.sparkContext.broadcast((index.quantiser, vectors, of_list, ids))

    def cut(held: list[tuple], bound: np.ndarray) -> tuple:
        """The best of what a task holds for each query; full shortlists bound what may still enter."""
        q, d, names, lists = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, q))
        q, d = q[order], d[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        full, keep = place == shortlist - 1, place < shortlist
        bound[q[full]] = d[full]
        return q[keep], d[keep], names[order[keep]], lists[order[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, vectors, of_list, ids = shipped.value
        bound, norm = np.full(len(ids), np.inf), (vectors**2).sum(1)
        held, size, room = [], 0, PAIRS
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, quantiser.parts)
            names = batch.column("id").to_numpy(zero_copy_only=False)
            for c, asked, at in _pieces(batch, of_list):
                x = quantiser.centroids[c] + quantiser.books[np.arange(quantiser.parts), codes[at]].reshape(len(at), -1)
                d = norm[asked, None] + (x**2).sum(1) - 2 * vectors[asked] @ x.T
                most = np.partition(d, shortlist - 1, axis=1)[:, shortlist - 1] if len(at) > shortlist else np.full(len(asked), np.inf)
                query, row = np.nonzero((d <= most[:, None]) & (d < bound[asked, None]))
                held.append((asked[query], d[query, row], names[at[row]], np.full(len(row), c, np.int32)))
                size += len(row)
                if size > room:
                    held = [cut(held, bound)]
                    size = len(held[0][0])
                    room = max(PAIRS, 2 * size)
        if size:
            q, d, names, lists = cut(held, bound)
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type).take(pa.array(q)), pa.array(lists), pa.array(names, schema.field(2).type), pa.array(np.sqrt(np.maximum(d, 0)))], schema=schema)

    rows = index.lists(of_list).select("list", "id", "code")
    as_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("query_id", as_arrow[id_type]), ("list", pa.int32()), ("id", as_arrow[dict(rows.dtypes)["id"]]), ("approximate", pa.float64())])
    found = rows.mapInArrow(run, f"query_id {id_type}, list int, id {dict(rows.dtypes)['id']}, approximate double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("approximate", "id", "list"))
    return found.withColumn("__place", place).where(F.col("__place") <= shortlist).drop("__place")


def _least_copies(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Without rows that have ``k`` copies of smaller ids in the batch and list: none of those is one of ``k`` neighbours."""
    if not batch.num_rows:
        return batch
    x = np.ascontiguousarray(_matrix(batch.column("v")))
    vector = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    of_id = np.unique(batch.column("id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    lists = batch.column("list").to_numpy()
    order = np.lexsort((of_id, vector, lists))
    new = np.append(True, (np.diff(lists[order]) != 0) | (np.diff(vector[order]) != 0))
    first = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return batch if place.max() < k else batch.take(pa.array(np.sort(order[place < k])))


def _reachable(index: Index, ids: list, vectors: np.ndarray, id_type: str, may: np.ndarray, most: np.ndarray, k: int) -> DataFrame:
    """``query_id, id, v``: rows of the lists that a query ``may`` find something in, no further than ``most`` and than ``k`` other rows of their piece.

    Matrix products tell which rows those are, with room for their rounding; nothing is made for other pairs.
    """
    shipped = index.spark.sparkContext.broadcast((vectors, _asked(may), ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, of_list, ids = shipped.value
        bound, norm = most**2, (vectors**2).sum(1)
        queries = pa.array(ids, as_arrow[id_type])
        for batch in batches:
            batch = _least_copies(batch, k)
            values = _matrix(batch.column("v"))
            for _, asked, at in _pieces(batch, of_list):
                x = values[at]
                both = norm[asked, None] + (x**2).sum(1)
                d, room = both - 2 * vectors[asked] @ x.T, 1e-12 * both
                if len(at) >= k:  # of one list, where no row stands twice
                    bound[asked] = np.minimum(bound[asked], np.partition(d + room, k - 1, axis=1)[:, k - 1])
                query, row = np.nonzero(d - room <= bound[asked, None])
                if len(row):
                    taken = pa.array(at[row])
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(asked[query])), batch.column("id").take(taken), batch.column("v").take(taken)], names=["query_id", "id", "v"])

    as_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    rows = index.lists(np.flatnonzero(may.any(0))).select("list", "id", "v")
    return rows.mapInArrow(run, f"query_id {id_type}, id {dict(rows.dtypes)['id']}, v array<double>")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query; a row that stands in several lists counts once."""
    once = rows.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return once.withColumn("place", place).where(F.col("place") <= k)


def _searched(index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int, shortlist: int, at_once: int) -> Iterator[tuple[list, np.ndarray, DataFrame]]:
    kind = dict(queries.dtypes)[query_id]
    for ids, vectors in _query_blocks(queries, query_id, query_vector, at_once):
        candidates = _shortlisted(index, ids, vectors, kind, probes, shortlist)
        asked = index.spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], f"query_id {kind}, q array<double>")
        # list as an expression, so that partitions are not pruned once more by running the shortlist twice
        rows = index.lists(np.unique(_closest(vectors, index.quantiser.centroids, probes))).select((F.col("list") + 0).alias("list"), "id", "v")
        exact = rows.join(F.broadcast(candidates.select("query_id", "list", "id")), ["list", "id"]).join(F.broadcast(asked), "query_id")
        yield ids, vectors, _first(exact.select("query_id", "id", tn.euclidean(F.col("v"), F.col("q")).alias("distance")), k)


def search(index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int, shortlist: int, at_once: int = 4000) -> DataFrame:
    """V2, V7, V8: approximate neighbours ``query_id, id, distance, place`` of a stated set of queries, ``at_once`` of them at a time.

    The ``probes`` nearest lists are read; codes choose ``shortlist`` rows a query; those are fetched and ranked by exact distance. Broadcast are
    the queries of a part and their shortlists (``at_once * shortlist`` rows), both bounded. Null vectors find nothing.
    """
    return _together(index, queries, query_id, [rows for _, _, rows in _searched(index, queries, query_id, query_vector, k, probes, shortlist, at_once)])


def _together(index: Index, queries: DataFrame, query_id: str, parts: list[DataFrame]) -> DataFrame:
    if parts:
        return reduce(DataFrame.unionByName, parts)
    kinds = dict(queries.dtypes)[query_id], dict(index.lists().dtypes)["id"]
    return index.spark.createDataFrame([], "query_id {}, id {}, distance double, place int".format(*kinds))


def exact_search(index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int, shortlist: int, at_once: int = 4000) -> DataFrame:
    """V1: the true neighbours through the index: an approximate answer bounds the distance, and only lists that may hold a nearer row are read.

    By the triangle inequality a row is no nearer than the difference of its own and the query's distance to a centroid. Lists that are out of the
    bounds of all queries are not read; the others meet the queries that may find something there in matrix products.
    """
    kind, out = dict(queries.dtypes)[query_id], []
    for ids, vectors, near in _searched(index, queries, query_id, query_vector, k, probes, shortlist, at_once):
        bound = {r[0]: r[1] for r in near.groupBy("query_id").agg(F.max("distance"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        # fewer rows than k in the lists probed: anything may be nearer; a little room for rounding
        most = np.array([bound.get(i, np.inf) * (1 + 1e-9) + 1e-9 for i in ids])
        apart = np.stack([np.sqrt(((v - index.quantiser.centroids) ** 2).sum(1)) for v in vectors])
        may = (apart - index.radii <= most[:, None]) & (index.sizes > 0)
        vector_of = index.spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], f"query_id {kind}, q array<double>")
        pairs = _reachable(index, ids, vectors, kind, may, most, k).join(F.broadcast(vector_of), "query_id")
        out.append(_first(pairs.select("query_id", "id", tn.euclidean(F.col("v"), F.col("q")).alias("distance")), k))
    return _together(index, queries, query_id, out)


def tuned_probes(index: Index, calibration: DataFrame, query_id: str, query_vector: str, k: int, recall: float) -> int:
    """How many lists must be probed so that a share ``recall`` of the true neighbours of some calibration queries (a bounded set) lies in them.

    The rank that a neighbour's list has among the query's lists is known from the exact answer, so one exact search settles it.
    """
    true = exact_search(index, calibration, query_id, query_vector, k, max(1, len(index.sizes) // 8), 10 * k)
    found = true.join(index.lists().select("id", "list"), "id").groupBy("query_id", "id").agg(F.collect_set("list").alias("lists")).collect()
    vectors = {r[0]: np.array(r[1], np.float64) for r in calibration.where(F.col(query_vector).isNotNull()).select(query_id, query_vector).collect()}
    order = {i: np.argsort(np.argsort(((v - index.quantiser.centroids) ** 2).sum(1), kind="stable")) for i, v in vectors.items()}
    ranks = sorted(1 + min(int(order[r.query_id][c]) for c in r.lists) for r in found)
    return ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)] if ranks else 1
