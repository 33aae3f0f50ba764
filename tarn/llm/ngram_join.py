"""N-gram Jaccard join: MinHash bands as candidates, pairs verified on their full n-gram sets.

No pair of documents is ever a row. Documents of one n-gram set are one node; a
bucket of nodes is cut into blocks of bounded size, and each pair of blocks is
compared inside one task, which returns link counts and a spanning set of links.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

_WORDS = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """``(bands, rows)``: the most rows whose bands find a pair at the threshold with probability ``recall``."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("most_hashes is too small for this recall")
    return best


# ---- n-gram sets and signatures -----------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams as sorted 64-bit hashes; a text of fewer than ``n`` words is one n-gram, one without words none."""

    def __init__(self, n: int, cache: int = 150_000):
        self.n, self.cache = n, cache
        self.words: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > self.cache:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The sets one after another, and their sizes."""
        lists = [_WORDS.findall((t or "").lower()) for t in texts]
        size = np.array([len(x) for x in lists], np.int64)
        flat = self._hashes([w for x in lists for w in x])
        stop = np.cumsum(size)
        out = []
        for a, b in zip(stop - size, stop, strict=True):
            k = min(self.n, b - a)
            if not k:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.zeros(b - a - k + 1, np.uint64)
            for i in range(k):
                h = h * _WORD_BASE + flat[a + i : b - k + 1 + i]
            out.append(np.unique(_mixed(h + np.uint64(k))))
        return np.concatenate([np.zeros(0, np.uint64), *out]), np.array([len(x) for x in out], np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray, n_hashes: int) -> np.ndarray:
    """Low 16 bits of the ``n_hashes`` smallest hash values of each set; an empty set has zeros."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    out = np.zeros((len(sizes), n_hashes), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    # some documents at a time, so that the values stay in the processor's cache
    cuts = np.flatnonzero(np.diff(starts // 16_384, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(full)], strict=True):
        part = flat[starts[a] : starts[b] if b < len(full) else len(flat)]
        local = starts[a:b] - starts[a]
        for k in range(n_hashes):
            least = np.minimum.reduceat(part * factor[k] + shift[k], local)
            out[full[a:b], k] = _mixed(least).astype(np.uint16)
    return out


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, row_key, set_key, n_grams, sig``: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for part in (part for batch in batches for part in base.slices(batch)):
            flat, sizes = shingler.sets(part.column("text").to_pylist())
            sig = signatures(flat, sizes, bands * rows)
            stop = np.cumsum(sizes)
            keys = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(stop - sizes, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "row_key", "set_key", "n_grams", "sig"],
            )

    return docs.mapInArrow(base.frugal(run), "doc_id long, row_key binary, set_key binary, n_grams long, sig binary")


# ---- blocks of buckets --------------------------------------------------------------------------------------------

_GROUP = ["bucket", "left", "right"]


def _blocked(members: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """``bucket, band, n, grams, sid`` to ``bucket, left, right, block, band, sid``: each row once for each pair of blocks that holds its own.

    A bucket is cut so that a block has about ``block_rows`` rows and ``block_bytes`` of sets at most, whichever asks for more blocks.
    """
    count = F.greatest(F.ceil(F.col("n") / block_rows), F.least(F.col("n"), F.ceil(8 * F.col("grams") / block_bytes))).cast("int")
    own = members.withColumn("__blocks", count).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("__blocks")).cast("int"))
    other = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return other.select("bucket", F.least("block", "__other").alias("left"), F.greatest("block", "__other").alias("right"), "block", "band", "sid")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in batches that are sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _first_shared(sig: np.ndarray, bucket_band: int, bands: int, rows: int) -> np.ndarray:
    """Pairs of rows whose first shared band is the bucket's; sig is ``(m, bands * rows)``."""
    by_band = sig.reshape(len(sig), bands, rows)
    same = (by_band[:, None, bucket_band] == by_band[None, :, bucket_band]).all(2)
    for band in range(bucket_band):
        if not same.any():
            break
        code = np.unique(by_band[:, band], axis=0, return_inverse=True)[1].reshape(-1)
        same &= code[:, None] != code[None, :]
    return same


def _pairs_in(group: pa.Table, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs ``i, j`` of a group that belong to it, each once, and the signatures."""
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(group.num_rows, bands * rows)
    same = _first_shared(sig, group.column("band")[0].as_py(), bands, rows)
    left, right, block = group.column("left")[0].as_py(), group.column("right")[0].as_py(), group.column("block").to_numpy()
    if left == right:
        i, j = np.nonzero(np.triu(same, 1))
    else:
        i, j = np.nonzero(same & (block[:, None] == left) & (block[None, :] == right))
    return i, j, sig


def _paired(rows_in: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Of blocked rows with signatures, those with a pair of their own whose sizes allow the similarity.

    A pair cannot be more alike than the smaller set's share of the larger one, so nothing that verification would accept is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _GROUP):
            if group.num_rows < 2:
                continue
            i, j, _ = _pairs_in(group, bands, rows)
            size = group.column("n_grams").to_numpy()
            good = np.minimum(size[i], size[j]) >= (threshold - 1e-12) * np.maximum(size[i], size[j])
            keep = np.union1d(i[good], j[good])
            if len(keep):
                yield group.take(pa.array(keep)).combine_chunks().to_batches()[0]

    return rows_in.mapInArrow(base.frugal(run), rows_in.schema)


def jaccard_of_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact similarity of pairs of sorted sets; many pairs of few sets go through a product of 0/1 matrices."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) < 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times[where] > 1  # what one set alone holds is in no intersection
        column = np.cumsum(times > 1) - 1
        owner, where = owner[shared], column[where[shared]]
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], where[order]
        product = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(where[-1]) + 1 if len(where) else 0, 4096):
            lo, hi = np.searchsorted(where, [a, a + 4096])
            part = np.zeros((len(sets), min(4096, int(where[-1]) + 1 - a)), np.float32)
            part[owner[lo:hi], where[lo:hi] - a] = 1
            product += part @ part.T
        both = product[i, j].astype(np.int64)
    union = size[i] + size[j] - both
    return both / np.maximum(union, 1)


def _spanning(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of links between rows, a set that joins the same rows without a cycle."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def _verified(rows_in: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """``a, b, links``: link counts of nodes (``b`` null; in documents), and spanning links between nodes (``links`` 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _GROUP):
            if group.num_rows < 2:
                continue
            i, j, _ = _pairs_in(group, bands, rows)
            if not len(i):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            good = jaccard_of_pairs(sets, i, j) >= threshold - 1e-12
            i, j = i[good], j[good]
            if not len(i):
                continue
            sid, copies = group.column("sid").to_numpy(), group.column("copies").to_numpy()
            links = np.bincount(i, weights=copies[j], minlength=len(sid)) + np.bincount(j, weights=copies[i], minlength=len(sid))
            some = np.flatnonzero(links)
            edges = _spanning(i, j)
            a = np.concatenate([sid[some], [sid[x] for x, _ in edges]]).astype(np.int64)
            b = [None] * len(some) + [int(sid[y]) for _, y in edges]
            n = np.concatenate([links[some], np.zeros(len(edges))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(n)], names=["a", "b", "links"])

    return rows_in.mapInArrow(base.frugal(run), "a long, b long, links long")


# ---- classes ------------------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, label: str = "components", most_rounds: int = 40) -> DataFrame:
    """``node, root`` for each node of the edges ``a, b``: the least node of its component.

    Large-star and small-star rounds; each round's edges are a written table, so the
    plan stays short and lost executors cost one round. Rounds end when they change
    nothing. No component is gathered anywhere.
    """
    spark = edges.sparkSession

    def starred(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if large:
            least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = near.where("v < u")
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        moved = low.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    def digest(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    path = base.fresh_path(spark, label)
    edges.select("a", "b").where("a <> b").distinct().write.parquet(f"{path}/0")
    current = spark.read.schema("a long, b long").parquet(f"{path}/0")
    before = digest(current)
    for k in range(1, most_rounds + 1):
        starred(starred(current, True), False).write.parquet(f"{path}/{k}")
        current = spark.read.schema("a long, b long").parquet(f"{path}/{k}")
        base.drop_table(spark, f"{path}/{k - 1}")
        after = digest(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())


def row_key(id_col: str, text_col: str):
    """128 bits that tell rows apart by id and text, where ids may be null or repeat."""
    known = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("/", known, F.coalesce(F.md5(F.col(text_col)), F.lit("-")))))


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    recall: float = 0.9999,
    block_rows: int = 512,
    block_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, row_key, class_id, n_links, n_grams, kept`` of every row.

    Two documents are linked if the Jaccard similarity of their sets of word
    ``n``-grams (lower-cased word characters) is ``threshold`` or more; ``n_links``
    counts the other documents that a document is linked to, copies included, and
    ``class_id`` is the least doc_id that links lead to, whose document is ``kept``. Band and row counts follow
    from ``recall`` at the threshold. Pairs are looked at in the first band they share, and every
    such pair is verified on its full sets, but for those whose sets differ too much in size to
    be that similar: links are lost by the bands alone. Large buckets are compared in pairs of blocks, which
    ``block_rows`` and ``block_bytes`` bound, whatever the number and the length of the texts.

    A null or empty text, or one without a word, has no n-gram: it is alone, with no
    link. A text of fewer than ``n`` words is one n-gram. Very long texts are read in slices of bounded bytes, a text at least. Rows with null ids take part;
    a class of such rows alone has a null class_id. Rows that repeat count as documents
    of their own: one row of each class is kept. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.withColumn("row_key", row_key("doc_id", "text"))
    signed = base.written(_signed(keyed, n, bands, rows).withColumn("row_no", F.monotonically_increasing_id()), "ngram-signed")
    nodes = (
        signed.where("n_grams > 0")
        .groupBy("set_key")
        .agg(F.count("*").alias("copies"), F.min(_place()).alias("first"), F.min("row_key").alias("row_key"), F.any_value("sig").alias("sig"), F.any_value("n_grams").alias("n_grams"))
    )
    nodes = base.written(nodes.withColumn("sid", F.monotonically_increasing_id()), "ngram-nodes")

    # buckets with two nodes or more
    width = 2 * rows
    band_keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width))).alias("bucket")))
    rows_of = nodes.select("sid", "n_grams", F.inline(band_keys))
    full = rows_of.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).where("n > 1")
    members = rows_of.drop("n_grams").join(full, "bucket")
    blocked = _blocked(members, block_rows, block_bytes).join(nodes.select("sid", "sig", "n_grams"), "sid")
    dealt = blocked.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "sid")
    paired = base.written(_paired(dealt, bands, rows, threshold).drop("n_grams"), "ngram-paired")

    # the full sets of nodes that have a pair
    wanted = paired.select("sid").distinct().join(nodes.select("sid", "row_key", "copies"), "sid")
    grams = _grams_of(keyed, wanted, n)
    with_sets = paired.join(grams, "sid").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "sid")
    found = base.written(_verified(with_sets, bands, rows, threshold), "ngram-links")

    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b IS NOT NULL"), "ngram-components")
    placed = nodes.select("sid", "set_key", "copies", "first").join(roots, F.col("sid") == F.col("node"), "left").drop("node")
    placed = placed.join(links, F.col("sid") == F.col("a"), "left").drop("a")
    several = placed.where("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "sid"))
    first = several.groupBy("root").agg(F.min("first").alias("class_first"))
    classes = several.join(first, "root").select("set_key", "class_first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("class_first").isNull()
    return signed.join(classes, "set_key", "left").select(
        "doc_id",
        "row_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_grams",
        (alone | (F.col("class_first") == _place())).alias("kept"),
    )


def _place():
    """Orders the rows of a class: by id, null ids last, then by what the row holds, then by a number that no other row has."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"), F.col("row_no"))


def _grams_of(keyed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``sid, copies, grams``: the sets of the wanted nodes, each from one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for part in (part for batch in batches for part in base.slices(batch)):
            flat, sizes = shingler.sets(part.column("text").to_pylist())
            stop = np.cumsum(sizes)
            grams = pa.array([flat[a:b].tobytes() for a, b in zip(stop - sizes, stop, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("sid"), part.column("copies"), grams], names=["sid", "copies", "grams"])

    rows = keyed.select("row_key", "text").join(wanted, "row_key").groupBy("sid", "copies").agg(F.any_value("text").alias("text"))
    return rows.mapInArrow(base.frugal(run), "sid long, copies long, grams binary")


def op8_ngram_join(spark, sf_dir):
    """Every document with its class and number of links at 0.8 on word 5-grams."""
    return similar_documents(base.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_grams")
