"""Language identification by known words, with backoff to shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; characters that only count as numeric are cut out."""
    found = _RUNS.findall(text.lower()) if isinstance(text, str) else []
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams_of(word: str, n: int) -> list[str]:
    """Runs of ``n`` characters of the word, whose ends are marked; single characters without the marks."""
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language, a row of ``rows`` for each known word and for each known n-gram.

    Row 0 is what nothing is known about (all languages alike). Texts are cut into
    pieces at white space, which no word holds. Rows of pieces that are not known words
    (sums over their words; of unseen words the backoff) are added while there is room, and computed anew after.
    """

    #: Pieces of more characters are not kept.
    LONGEST = 64

    def __init__(self, langs: list[str], words: tuple[list[str], np.ndarray], grams: dict[int, tuple[list[str], np.ndarray]], cache: int = 250_000):
        self.langs, self.cache = langs, cache
        self.words = dict(zip(words[0], range(1, len(words[0]) + 1), strict=True))
        tables, at = [np.zeros((1, len(langs))), words[1]], len(words[0]) + 1
        self.grams: dict[int, dict[str, int]] = {}
        for n, (names, rows) in sorted(grams.items(), reverse=True):
            self.grams[n] = dict(zip(names, range(at, at + len(names)), strict=True))
            tables.append(rows)
            at += len(names)
        self.rows = np.concatenate(tables).astype(np.float64)
        self.clear()

    def clear(self) -> None:
        """Drop the rows of pieces."""
        self.pieces = {"": 0}
        self.scored = np.zeros((1, len(self.langs) + 1))  # of pieces: a column for each language, and the number of words

    def backoff(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean over its longest n-grams that are known at all."""
        if not words:
            return self.rows[:0]
        flat: list[int] = []
        sizes = []
        for word in words:
            known = [0]
            for n, table in self.grams.items():
                padded = f"<{word}>" if n > 1 else word
                if found := [table[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in table]:
                    known = found
                    break
            flat += known
            sizes.append(len(known))
        size = np.array(sizes, np.int64)
        return np.add.reduceat(self.rows[np.array(flat, np.int64)], np.cumsum(size) - size) / size[:, None]

    def sums(self, pieces: list[str]) -> np.ndarray:
        """A row for each piece: summed log frequencies of its words, and their number."""
        lists = [words_of(p) for p in pieces]
        size = np.array([len(x) for x in lists], np.int64)
        flat = [w for x in lists for w in x]
        unseen = [*dict.fromkeys(w for w in flat if w not in self.words)]
        place = dict(zip(unseen, range(len(self.rows), len(self.rows) + len(unseen)), strict=True))
        rows = np.concatenate([self.rows, self.backoff(unseen)])
        at = np.fromiter((self.words.get(w) or place[w] for w in flat), np.int64, len(flat))
        own = np.repeat(np.arange(len(pieces)), size)
        each = [np.bincount(own, weights=rows[at, k], minlength=len(pieces)) for k in range(rows.shape[1])]
        return np.stack([*each, size], 1)

    def _rows_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces in a table, and the table; long pieces have their rows at its end, for this call alone."""
        if len(self.scored) > self.cache:
            self.clear()
        fresh = [p for p in pieces if p not in self.pieces and len(p) <= self.LONGEST]
        long = [p for p in pieces if len(p) > self.LONGEST]
        if fresh:
            self.pieces.update(zip(fresh, range(len(self.scored), len(self.scored) + len(fresh)), strict=True))
            self.scored = np.concatenate([self.scored, self.sums(fresh)])
        beyond = iter(range(len(self.scored), len(self.scored) + len(long)))
        at = np.fromiter((self.pieces[p] if len(p) <= self.LONGEST else next(beyond) for p in pieces), np.int64, len(pieces))
        return at, np.concatenate([self.scored, self.sums(long)]) if long else self.scored

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies by text and language, and the texts' numbers of words."""
        spaced = pc.fill_null(texts, "").cast(pa.large_string())
        for space in "\n\t":
            spaced = pc.replace_substring(spaced, space, " ")
        cut = pc.split_pattern(spaced, " ")
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = pc.dictionary_encode(cut.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        index = coded.indices.to_numpy(zero_copy_only=False)
        del spaced, cut
        at, table = self._rows_of(coded.dictionary.to_pylist())
        own = at[index]
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        sums = np.stack([np.bincount(doc, weights=table[own, k], minlength=len(texts)) for k in range(table.shape[1])], 1)
        return sums[:, :-1], sums[:, -1].astype(np.int64)

    def predict(self, texts: list[str | None] | pa.Array) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its share of the posterior under equal priors; ties go to the first by name."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, size = self.scores(texts)
        share = np.exp(total - total.max(1, keepdims=True))
        best = share.argmax(1)
        score = np.where(size > 0, share.max(1) / share.sum(1), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)], score


def _table(counts: dict[str, dict[str, int]], langs: list[str], shared: float) -> tuple[list[str], np.ndarray]:
    """Keys, and the logs of their relative frequencies by language, mixed with the mean over all languages.

    A key that a language lacks has the same small share in all of them, so that a language
    with few rows is not taken for one in which unseen keys are likely.
    """
    at = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((len(counts), len(langs)))
    for row, by in enumerate(counts.values()):
        for lang, c in by.items():
            n[row, at[lang]] = c
    share = n / np.maximum(n.sum(0), 1)
    return list(counts), np.log((1 - shared) * share + shared * share.mean(1, keepdims=True)) if counts else n


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_docs: int = 4_000,
    least_docs: int = 200,
    min_count: int = 2,
    orders: tuple[int, ...] = (5, 4, 3, 2, 1),
    shared: float = 0.02,
) -> Model:
    """Fit on a bounded sample of labelled rows, chosen by a hash of id and text within each language.

    Of each language about ``max_docs`` divided by the number of languages are taken, ``least_docs`` at least
    (all where it has fewer): the sample has at most about ``max(max_docs, least_docs * languages)`` rows at any size of
    input, and a rare language is in it: every language with a word in the sample can be predicted.
    Words and n-grams of fewer than ``min_count`` occurrences in the sample are left to the (next) backoff; n-grams are
    counted over all words of the sample. The model's size is bounded by the sample's.
    """
    labelled = docs.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    goal = max(least_docs, max_docs // max(1, len(sizes)))
    buckets = 1 << 30
    limits = base.small_table(labelled.sparkSession, [(lang, math.ceil(min(1.0, goal / n) * buckets)) for lang, n in sizes.items()], "__lang string, __limit long")
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(buckets))
    sample = labelled.join(F.broadcast(limits), F.col(lang_col) == F.col("__lang")).where(place < F.col("__limit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: Counter) -> pa.RecordBatch:
            grams: Counter = Counter()
            for (lang, word), n in found.items():
                for k in orders:
                    for g in grams_of(word, k):
                        grams[lang, k, g] += n
            langs, orders_, keys = zip(*((lang, 0, w) for lang, w in found), *grams, strict=True)
            counts = [*found.values(), *grams.values()]
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(orders_, pa.int32()), pa.array(keys), pa.array(counts, pa.int64())], names=["lang", "k", "key", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                found.update((lang.as_py(), w) for w in words_of(text.as_py()))
                if len(found) > 50_000:
                    yield table(found)
                    found.clear()
        if found:
            yield table(found)

    counts = (
        sample.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .mapInArrow(base.frugal(count), "lang string, k int, key string, n long")
        .groupBy("k", "key", "lang")
        .agg(F.sum("n").alias("n"))
    )
    counts = base.written(counts, "lang-counts")
    langs = sorted(r.lang for r in counts.where("k = 0").select("lang").distinct().collect())
    often = counts.groupBy("k", "key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("all") >= min_count)
    tables: dict[int, dict[str, dict[str, int]]] = {k: {} for k in (0, *orders)}
    for r in often.select("k", "key", "by").toLocalIterator():
        tables[r.k][r.key] = r.by
    return Model(langs, _table(tables[0], langs, shared), {k: _table(tables[k], langs, shared) for k in orders})


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; whole texts, one pass, no shuffle.

    A null text, and one without a letter, is ``und`` with score 0. Columns of these
    two names are replaced; others, rows that repeat and their order stay as they are.
    Very long texts are read in slices of bounded bytes, a text at least.
    The model is a broadcast of the size that ``fit`` bounds.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        for texts in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = [np.zeros(0)]
            for part in base.slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                own, share = model.predict(part.column(0))
                langs += own
                scores.append(share)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["lang", "score"])
        model.clear()

    label = F.arrow_udf(base.frugal(label), "struct<lang: string, score: double>", F.ArrowUDFType.SCALAR_ITER)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    guess = docs.select(*kept, label(F.col(text_col)).alias("__guess"))
    return guess.select(*kept, F.col("__guess.lang").alias("lang_pred"), F.col("__guess.score").alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may see: the CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir):
    """Contract query: fit on the rows that are not held out, predict every row."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
