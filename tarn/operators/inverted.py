"""An inverted index in written tables: positions in blocks with their largest impact, read by phrases, proximity and a pruning weakAnd."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.postings import bm25_weight, idf
from tarn.sources.scan import small_batches

#: Columns of a posting, and the arrays of a block that hold them.
_ARRAYS = {"id": "ids", "tf": "tfs", "length": "lengths", "positions": "positions"}
#: Places between the last word of an element and the first of the next, where phrases must not cross.
APART = 1000


def term_rows(docs: DataFrame, id_col: str, fields: dict[str, Column], gaps: dict[str, int] | None = None) -> DataFrame:
    """``id, field, term, tf, positions, length``: a row for each term of each field of a document, counted within the row; no shuffle.

    ``fields`` maps names to token arrays, or to arrays of token arrays for fields that ``gaps`` names: there the first word of an element stands that
    many places after the last one of the element before (1: adjacent). Positions start at 0. Each document also has one row of each field with a null term and its
    length (0 for a null field), so that statistics come from the same table. Null tokens do not count.
    """
    gaps = gaps or {}
    names = list(fields)
    own = docs.select(F.col(id_col).alias("id"), *[fields[f].alias(f"f{k}") for k, f in enumerate(names)])
    id_type = dict(own.dtypes)["id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(names):
                yield _grouped(batch.column("id"), batch.column(f"f{k}"), name, gaps.get(name))

    return own.mapInArrow(count, f"id {id_type}, field string, term string, tf int, positions array<int>, length int")


def _grouped(ids: pa.Array, tokens: pa.Array, name: str, gap: int | None) -> pa.RecordBatch:
    """Occurrences of a batch, sorted by document and term: all in Arrow and numpy."""
    n = len(ids)
    doc = pc.list_parent_indices(tokens).to_numpy()
    flat = tokens.flatten()
    element = np.zeros(len(doc), np.int64)
    if gap is not None:
        inner = pc.list_parent_indices(flat).to_numpy()
        before = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])[:-1]
        element, doc, flat = inner - before[doc[inner]], doc[inner], flat.flatten()
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    doc, element, flat = doc[known], element[known], flat.filter(pa.array(known))
    length = np.bincount(doc, minlength=n)
    start = np.concatenate([[0], np.cumsum(length)])[:-1]
    place = np.arange(len(doc)) - start[doc] + element * ((gap or 1) - 1)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.argsort(doc * (len(coded.dictionary) + 1) + code, kind="stable")
    doc, code, place = doc[order], code[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(doc) else np.empty(0, np.int64)
    tf = np.diff(np.append(first, len(doc)))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))
    nothing = pa.nulls(n, pa.list_(pa.int32()))
    of = pa.array(np.concatenate([doc[first], np.arange(n)]).astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(of),
            pa.array([name]).take(pa.array(np.zeros(len(of), np.int64))),
            pa.concat_arrays([coded.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.nulls(n, pa.string())]),
            pa.array(np.concatenate([tf, np.zeros(n, np.int64)]).astype(np.int32)),
            pa.concat_arrays([positions, nothing]),
            pa.array(length[of.to_numpy()].astype(np.int32)),
        ],
        names=["id", "field", "term", "tf", "positions", "length"],
    )


def statistics(rows: DataFrame) -> DataFrame:
    """``field, n_docs, average_length`` from the null terms of :func:`term_rows`."""
    return rows.where("term IS NULL").groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("length").alias("average_length"))


def write_inverted(docs: DataFrame, id_col: str, fields: dict[str, Column], path: str, gaps: dict[str, int] | None = None, block_docs: int = 64, buckets: int = 16, spread: int = 16, k1: float = 1.2, b: float = 0.75) -> None:
    """The index under ``path``: ``rows`` (one pass over the texts), ``statistics``, and ``blocks``, partitioned by ``bucket``, a hash of the term.

    Documents of like length share a range of about ``block_docs``, chosen by a hash of the id within the class of their length, so that impacts in a range are alike and its maximum is tight. A
    block is a term's postings in one range: ``field, term, range, n, most`` and the arrays ``ids, tfs, lengths, positions``, with ``most`` the largest BM25 weight in it. Blocks of one term are
    dealt to ``spread`` tasks, so a term that all documents hold is no task's alone.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        term_rows(docs, id_col, fields, gaps).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    spark_stats = statistics(rows).withColumn("k1", F.lit(k1)).withColumn("b", F.lit(b))
    spark_stats.coalesce(1).write.parquet(f"{path}/statistics")
    stats = spark.read.parquet(f"{path}/statistics")

    size = F.floor(2 * F.log2(F.col("length") + 1.0)).cast("int")
    classes = rows.where("term IS NULL").groupBy("field", size.alias("class")).agg(F.ceil(F.count("*") / block_docs).cast("long").alias("ranges"))
    placed = rows.where("term IS NOT NULL").withColumn("class", size).join(F.broadcast(classes), ["field", "class"]).join(F.broadcast(stats), "field")
    within = F.pmod(F.xxhash64("id"), F.col("ranges"))
    placed = placed.select(
        F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"),
        F.pmod(within, F.lit(spread)).cast("int").alias("salt"),
        "field",
        "term",
        (F.col("class").cast("long") * F.lit(1 << 40) + within).alias("range"),
        F.struct("id", "tf", "length", "positions").alias("p"),
        bm25_weight(F.col("tf"), F.col("length"), F.col("average_length"), k1, b).alias("w"),
    )
    # dealt by bucket and salt alone, which the grouping that follows and the order of the files both keep
    blocks = placed.repartition("bucket", "salt").groupBy("bucket", "salt", "field", "term", "range").agg(F.count("*").alias("n"), F.max("w").alias("most"), F.collect_list("p").alias("p"))
    arrays = [F.col("p")[c].alias(to) for c, to in _ARRAYS.items()]
    blocks.select("bucket", "field", "term", "range", "n", "most", *arrays).sortWithinPartitions("bucket", "field", "term", "range").write.partitionBy("bucket").parquet(f"{path}/blocks")


def opened(blocks: DataFrame, *columns: str) -> DataFrame:
    """``term, range`` and the named columns of every posting of some blocks; no other array is read."""
    zipped = F.arrays_zip(*[_ARRAYS[c] for c in columns])
    return blocks.select("term", "range", F.explode(zipped).alias("p")).select("term", "range", *[F.col(f"p.{_ARRAYS[c]}").alias(c) for c in columns])


@dataclass
class Inverted:
    """An index that was written by :func:`write_inverted`."""

    spark: SparkSession
    path: str
    buckets: int = 16

    @property
    def statistics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/statistics")

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """All blocks, or those of a table ``term`` of the words in use: only the partitions of their buckets are read."""
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        return blocks if terms is None else self._of(blocks, terms)

    def _of(self, blocks: DataFrame, terms: DataFrame) -> DataFrame:
        wanted = terms.select("term").distinct()
        found = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return blocks.where(F.col("bucket").isin(found)).join(wanted, "term", "left_semi")


# ---- blocks without positions ---------------------------------------------------------------------------------------

_IMPACTS = "term string, range long, n long, most_tf long, least_length long, total long, ids array<{id}>, tfs array<int>, lengths array<int>"


def write_impacts(docs: DataFrame, id_col: str, field: str, tokens: Column, path: str, block_docs: int = 64, buckets: int = 16) -> None:
    """The index of one field without positions under ``path``, partitioned by ``bucket`` as :func:`write_inverted` does, in one pass over the texts and without a shuffle.

    Ranges are cut where documents are read: those of an Arrow batch, in order of length, in runs of ``block_docs``. A block has the largest ``tf`` and the least ``length`` of its postings, whose weight none of
    them exceeds. Bucket -1 has, in ``n`` and ``total``, the number of documents of each batch and of their words, null fields included.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    id_type = dict(own.dtypes)["id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield _impacts(batch.column("id"), batch.column("tokens"), first, block_docs)
                first += -(-batch.num_rows // block_docs)

    with small_batches(spark):
        blocks = own.mapInArrow(count, _IMPACTS.format(id=id_type))
        bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
        blocks.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/impacts")
    spark.createDataFrame([(field, id_type)], "field string, id_type string").coalesce(1).write.parquet(f"{path}/field")


def _impacts(ids: pa.Array, tokens: pa.Array, first: int, block_docs: int) -> pa.RecordBatch:
    """Blocks of a batch by range and term, and a row with a null term for its documents and words."""
    n = len(ids)
    doc, flat = pc.list_parent_indices(tokens).to_numpy(), tokens.flatten()
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    doc, coded = doc[known].astype(np.int64), flat.filter(pa.array(known)).dictionary_encode()
    length = np.bincount(doc, minlength=n)
    place = np.empty(n, np.int64)
    place[np.argsort(length, kind="stable")] = np.arange(n) // block_docs
    size = len(coded.dictionary)
    key, tf = np.unique((place[doc] * size + coded.indices.to_numpy()) * n + doc, return_counts=True)
    group, doc = key // n, key % n
    start = np.flatnonzero(np.diff(group, prepend=-1))
    held = length[doc]
    of = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.append(np.append(start, len(key)), len(key)), pa.int32()), pa.array(values, kind) if kind else values)
    least = np.minimum.reduceat(held, start) if len(start) else held
    most = np.maximum.reduceat(tf, start) if len(start) else tf
    group = group[start]
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([coded.dictionary.take(pa.array(group % max(size, 1))).cast(pa.string()), pa.nulls(1, pa.string())]),
            pa.array(np.append(first + group // max(size, 1), 0), pa.int64()),
            pa.array(np.append(np.diff(np.append(start, len(key))), n), pa.int64()),
            pa.array(np.append(most, 0), pa.int64()),
            pa.array(np.append(least, 0), pa.int64()),
            pa.array(np.append(np.zeros(len(start), np.int64), length.sum()), pa.int64()),
            of(ids.take(pa.array(doc)), None),
            of(tf, pa.int32()),
            of(held, pa.int32()),
        ],
        names=["term", "range", "n", "most_tf", "least_length", "total", "ids", "tfs", "lengths"],
    )


@dataclass
class Impacts(Inverted):
    """An index that was written by :func:`write_impacts`; its blocks have no positions."""

    k1: float = 1.2
    b: float = 0.75

    def _table(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/field").first().id_type
        return self.spark.read.schema(f"{_IMPACTS.format(id=kind)}, bucket int").parquet(f"{self.path}/impacts")

    @property
    def statistics(self) -> DataFrame:
        counted = self._table().where("bucket = -1").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("average_length"))
        return self.spark.read.parquet(f"{self.path}/field").select("field").join(F.broadcast(counted)).withColumns({"k1": F.lit(self.k1), "b": F.lit(self.b)})

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        stats = self.statistics.first()
        most = bm25_weight(F.col("most_tf"), F.col("least_length"), F.lit(stats.average_length), self.k1, self.b)
        blocks = self._table().where("bucket >= 0").select("bucket", F.lit(stats.field).alias("field"), "term", "range", "n", most.alias("most"), "ids", "tfs", "lengths")
        return blocks if terms is None else self._of(blocks, terms)


# ---- weakAnd --------------------------------------------------------------------------------------------------------


@dataclass
class Pruned:
    """The best documents of each query, and ``query_id, term, range, n, used`` of every block of its terms: whether its postings were read."""

    hits: DataFrame
    blocks: DataFrame


def weak_and_blocks(index: Inverted, queries: DataFrame, field: str, target_hits: int, work: str, lead: int = 4096, digits: int = 6) -> Pruned:
    """the ``target_hits`` best documents of each query by BM25, as :func:`postings.weak_and_top` finds them, reading only blocks that may hold one.

    ``queries`` is ``query_id, term``. The rarest words of a query, with ``lead`` postings together (one word at least), give partial scores; the
    ranges of the best documents by those are scored with all words, and the k-th best of them is a bound that the true k-th score is not below. Words whose largest impacts, least first, add up to less than the bound cannot make a hit by
    themselves: documents come from the other words, in ranges where the sum of the blocks' maxima reaches the bound. The words
    set aside are looked up only in ranges where a document is left that they may lift over the bound. ``work`` is a folder for what passes between the steps.
    """
    spark, k = index.spark, target_hits
    queries = queries.select("query_id", "term").distinct()
    stats = index.statistics.where(F.col("field") == field)
    # what the words of all queries have in the index, read from it once: the steps below go through this alone
    index.blocks(queries).where(F.col("field") == field).select("term", "range", "n", "most", *[_ARRAYS[c] for c in ("id", "tf", "length")]).write.parquet(f"{work}/known")
    known = spark.read.parquet(f"{work}/known")
    light = known.select("term", "range", "n", "most")
    terms = light.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).join(F.broadcast(stats))
    terms = queries.join(terms, "term").select("query_id", "term", "df", "k1", "b", "average_length", idf(F.col("n_docs"), F.col("df")).alias("idf"), "most")
    rising = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = terms.withColumn("leads", (F.sum("df").over(rising) <= lead) | (F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term")) == 1))
    terms.write.parquet(f"{work}/terms")
    terms = spark.read.parquet(f"{work}/terms")

    weights = ["idf", "k1", "b", "average_length"]

    def scored(chosen: DataFrame) -> DataFrame:
        """``query_id, id, range, w`` of the postings of some ``query_id, term, range``; blocks are read once, however many queries use them."""
        read = known.join(chosen.select("term", "range").distinct(), ["term", "range"], "left_semi")
        rows = opened(read, "id", "tf", "length").join(chosen, ["term", "range"])
        weight = F.col("idf") * bm25_weight(F.col("tf"), F.col("length"), F.col("average_length"), F.col("k1"), F.col("b"))
        return rows.select("query_id", "id", "range", weight.alias("w"))

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    by_score = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w")))
    leads = scored(light.select("term", "range").join(terms.where("leads"), "term").select("query_id", "term", "range", *weights))
    leads = leads.groupBy("query_id", "id", "range").agg(F.sum("w").alias("w")).withColumn("place", by_score).where(F.col("place") <= k)
    # all words in the ranges of those documents: whole scores
    around = kept(leads.select("query_id", "range").distinct(), "around").join(terms.select("query_id", "term", *weights), "query_id")
    whole = scored(around).groupBy("query_id", "id").agg(F.sum("w").alias("w")).withColumn("place", by_score).where(F.col("place") <= k)
    bound = whole.groupBy("query_id").agg(F.min("w").alias("w"), F.count("*").alias("n"))
    # scores are compared after rounding, so what is less by no more than that may still win
    bound = bound.select("query_id", F.when(F.col("n") >= k, F.col("w") - 2 * 10.0**-digits).otherwise(F.lit(0.0)).alias("bound"))

    top = F.col("idf") * F.col("most")
    least_first = Window.partitionBy("query_id").orderBy(top, "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = terms.withColumn("summed", F.sum(top).over(least_first)).join(bound, "query_id", "left").na.fill({"bound": 0.0}).withColumn("makes", F.col("summed") >= F.col("bound"))
    aside = F.sum(F.when(~F.col("makes"), top).otherwise(0.0)).over(Window.partitionBy("query_id"))
    bounded = kept(bounded.select("query_id", "term", "bound", "makes", aside.alias("aside"), *weights), "bounded")

    # ranges that a maker's blocks and the largest impacts of all words set aside may lift to the bound; then by the blocks of those words
    makers = light.join(bounded.where("makes"), "term")
    may = makers.groupBy("query_id", "range").agg(F.sum(top).alias("made"), F.first("aside").alias("aside"), F.first("bound").alias("bound")).where(F.col("made") + F.col("aside") >= F.col("bound"))
    may = kept(may, "may")
    lifters = may.join(bounded.where("NOT makes").select("query_id", "term", *weights), "query_id").join(light, ["term", "range"])
    lifters = kept(lifters.select("query_id", "term", "range", "n", "most", *weights), "lifters")
    rest = lifters.groupBy("query_id", "range").agg(F.sum(top).alias("rest"))
    alive = may.join(rest, ["query_id", "range"], "left").na.fill({"rest": 0.0}).where(F.col("made") + F.col("rest") >= F.col("bound"))
    alive = kept(alive.select("query_id", "range", "rest", "bound"), "alive")

    read_first = makers.select("query_id", "term", "range", *weights).join(alive.select("query_id", "range"), ["query_id", "range"], "left_semi")
    near = scored(read_first).groupBy("query_id", "id", "range").agg(F.sum("w").alias("w")).join(alive, ["query_id", "range"]).where(F.col("w") + F.col("rest") >= F.col("bound"))
    near = kept(near.select("query_id", "range", "id", "w"), "near")
    read_then = lifters.join(near.select("query_id", "range").distinct(), ["query_id", "range"], "left_semi")
    more = scored(read_then.select("query_id", "term", "range", *weights)).join(near.select("query_id", "id"), ["query_id", "id"], "left_semi")
    total = near.select("query_id", "id", "w").unionByName(more.select("query_id", "id", "w")).groupBy("query_id", "id").agg(F.round(F.sum("w"), digits).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    used = read_first.select("query_id", "term", "range").unionByName(read_then.select("query_id", "term", "range")).withColumn("__used", F.lit(True))
    blocks = light.join(queries, "term").select("query_id", "term", "range", "n").join(used, ["query_id", "term", "range"], "left")
    return Pruned(total.withColumn("place", place).where(F.col("place") <= k), blocks.select("query_id", "term", "range", "n", F.coalesce("__used", F.lit(False)).alias("used")))


# ---- phrases and proximity ------------------------------------------------------------------------------------------


def _held(index: Inverted, words: DataFrame, field: str, whole: bool) -> DataFrame:
    """``query_id, id, length, n_words, held``: for each document the positions of each word of a query, from postings.

    ``words`` is ``query_id, place, term``. With ``whole``, ranges that lack a word of the query are not read.
    """
    size = words.groupBy("query_id").agg(F.count("*").alias("n_words"), F.countDistinct("term").alias("n_terms"))
    blocks = index.blocks(words).where(F.col("field") == field)
    if whole:
        here = blocks.select("term", "range").join(words.select("query_id", "term").distinct(), "term").groupBy("query_id", "range").agg(F.count("*").alias("n")).join(size, "query_id")
        alive = here.where("n = n_terms").select("query_id", "range").join(words.select("query_id", "term").distinct(), "query_id").select("term", "range").distinct()
        blocks = blocks.join(alive, ["term", "range"], "left_semi")
    rows = opened(blocks, "id", "length", "positions").join(words, "term")
    held = rows.groupBy("query_id", "id").agg(F.max("length").alias("length"), F.countDistinct("term").alias("found"), F.array_sort(F.collect_list(F.struct("place", "positions"))).alias("held"))
    held = held.join(size, "query_id")
    return held.where("found = n_terms") if whole else held


def phrases(index: Inverted, words: DataFrame, field: str) -> DataFrame:
    """``query_id, id, starts`` of the documents that hold all words of a query one after another, for many phrases at once.

    ``words`` is ``query_id, place, term`` with places from 0; words may repeat. The positions of each word, moved back by its place, are
    intersected; texts are not read.
    """
    held = _held(index, words, field, True)
    moved = F.transform("held", lambda h: F.transform(h["positions"], lambda p: p - h["place"].cast("int")))
    starts = F.aggregate(F.slice(moved, 2, F.size("held")), F.element_at(moved, 1), F.array_intersect)
    return held.select("query_id", "id", F.array_sort(starts).alias("starts")).where(F.size("starts") > 0)


def proximity(index: Inverted, words: DataFrame, field: str) -> DataFrame:
    """``query_id, id, matched, smallest_window, proximity, orderness, earliness`` from positions; our own formulas.

    ``smallest_window`` is the number of places from the first to the last of some run of tokens that holds all words of the query that the document
    holds; ``proximity`` is their number over that; ``orderness`` the share of neighbouring words of the query that somewhere stand next to
    each other in that order; ``earliness`` is one less the first position over the length. ``words`` is ``query_id, place, term``, each word of a query once.
    """
    held = _held(index, words, field, False)
    # one pass over all positions in order: where each word was seen last, and the smallest window that ended so far
    marks = F.array_sort(F.flatten(F.transform("held", lambda h, k: F.transform(h["positions"], lambda p: F.struct(p.alias("p"), k.alias("k"))))))

    def step(state: Column, mark: Column) -> Column:
        last = F.transform(state["last"], lambda x, k: F.when(k == mark["k"], mark["p"]).otherwise(x))
        width = F.when(F.array_min(last) >= 0, mark["p"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state["best"], width).alias("best"))

    start = F.struct(F.array_repeat(F.lit(-1), F.size("held")).alias("last"), F.lit(None).cast("int").alias("best"))
    window = F.aggregate(marks, start, step, lambda s: s["best"])
    pairs = F.transform("held", lambda h: F.coalesce(F.get(F.filter("held", lambda o: o["place"] == h["place"] + 1), F.lit(0))["positions"], F.array().cast("array<int>")))
    ordered = F.zip_with("held", pairs, lambda h, after: F.arrays_overlap(F.transform(h["positions"], lambda p: p + 1), after).cast("int"))
    share = F.when(F.col("n_words") > 1, F.aggregate(ordered, F.lit(0), lambda s, x: s + x) / (F.col("n_words") - 1)).otherwise(F.lit(1.0))
    rows = held.select("query_id", "id", F.size("held").alias("matched"), window.alias("smallest_window"), share.alias("orderness"), F.array_min(F.transform("held", lambda h: F.array_min(h["positions"]))).alias("__first"), "length")
    return rows.select("query_id", "id", "matched", "smallest_window", (F.col("matched") / F.col("smallest_window")).alias("proximity"), "orderness", (1 - F.col("__first") / F.col("length")).alias("earliness"))


def query_words(queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    """``query_id, place, term`` of queries with token arrays."""
    return queries.select(F.col(query_id).alias("query_id"), F.posexplode(tokens).alias("place", "term"))
