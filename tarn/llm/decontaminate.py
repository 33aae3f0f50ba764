"""Benchmark decontamination: BM25 index of test items, block-max WAND, then question and answer overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

_WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer.

    The answer follows the last question mark; without one it is the last sentence,
    grown by sentences before it to a quarter of the words. One sentence is cut at
    three quarters of its words. An item of fewer than eight words is all question.
    """
    cut = text.rfind("?") + 1
    if cut and words_of(text[cut:]):
        return words_of(text[:cut]), words_of(text[cut:])
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    total = sum(map(len, parts))
    if total < 8:
        return [w for p in parts for w in p], []
    if len(parts) == 1:
        at = total * 3 // 4
        return parts[0][:at], parts[0][at:]
    answer: list[str] = []
    while len(parts) > 1 and len(answer) < total / 4:
        answer = parts.pop() + answer
    return [w for p in parts for w in p], answer


def grams(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], words: list[str], held: dict[int, set[tuple[str, ...]]]) -> float:
    """The share of the part's word 5-grams that ``words`` holds; shorter parts are one n-gram, an empty part is held.

    ``held`` keeps the n-grams of ``words`` by n, for the next part that is compared with them.
    """
    if not part:
        return 1.0
    own = grams(part)
    n = min(5, len(part))
    if n not in held:
        held[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(own & held[n]) / len(own)


@dataclass
class Index:
    """Postings by term number from 1, sorted by item: items, impacts, and the largest impact of each block of postings.

    Impacts are BM25 weights divided by the item's own sum, so a score is the share
    of the item's weight that a passage holds, and one threshold serves all items.
    """

    ids: list[int]
    questions: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float], list[float]]]
    top: np.ndarray
    essential: dict[str, int]
    rest: np.ndarray
    block: int
    longest: int
    starts: np.ndarray  # of each term's postings in the next two
    flat_items: np.ndarray
    flat_impacts: np.ndarray


@dataclass
class Statistics:
    """What all items together say: their number, mean and greatest length, and the document frequencies of (at least) the terms in use."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


def statistics(bags: list[Counter]) -> Statistics:
    sizes = [sum(c.values()) for c in bags]
    return Statistics(len(bags), sum(sizes) / max(1, len(sizes)), max(sizes, default=1), Counter(w for c in bags for w in c))


def build(items: list[tuple[int, str]], threshold: float, block: int = 8, k1: float = 1.2, b: float = 0.75, stats: Statistics | None = None) -> Index:
    """Items without a word are left out; equal texts stay separate items. ``stats`` are those of ``items`` unless these are a part of more."""
    items = [(i, t) for i, t in items if words_of(t)]
    bags = [Counter(words_of(t)) for _, t in items]
    stats = stats or statistics(bags)
    sizes, mean = [sum(c.values()) for c in bags], stats.mean
    df = {w: stats.df[w] for c in bags for w in c}
    idf = {w: math.log(1 + (stats.n - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    terms = {w: k for k, w in enumerate(sorted(df), 1)}
    lists: list[tuple[list[int], list[float], list[float]]] = [([], [], []) for _ in range(len(terms) + 1)]
    for at, bag in enumerate(bags):
        raw = {w: idf[w] * n * (k1 + 1) / (n + k1 * (1 - b + b * sizes[at] / mean)) for w, n in bag.items()}
        own = sum(raw.values())
        for w in bag:
            lists[terms[w]][0].append(at)
            lists[terms[w]][1].append(raw[w] / own)
    for _, impacts, tops in lists:
        tops += [max(impacts[i : i + block]) for i in range(0, len(impacts), block)]
    top = np.array([max(x[1], default=0.0) for x in lists])
    # Frequent terms are inessential as long as no item gets half the threshold from them alone: a passage must then
    # hold essential terms of an item for the other half.
    essential = set(terms.values())
    held = np.zeros(len(bags))
    for t in sorted(range(1, len(lists)), key=lambda t: (-len(lists[t][0]), t)):
        own, impacts, _ = lists[t]
        if len(own) < 3 or (held[own] + impacts).max() > threshold / 2:
            break
        held[own] += impacts
        essential.discard(t)
    qa = [question_and_answer(t) for _, t in items]
    starts = np.concatenate([[0], np.cumsum([len(x[0]) for x in lists])]).astype(np.int64)
    flat = [np.array([v for x in lists for v in x[c]], kind) for c, kind in ((0, np.int64), (1, np.float64))]
    return Index([i for i, _ in items], [q for q, _ in qa], [a for _, a in qa], terms, lists, top, {w: t for w, t in terms.items() if t in essential}, held, block, stats.longest, starts, *flat)


def search(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: all items (by place in the index) whose score from these distinct terms reaches the threshold."""
    postings, block = index.postings, index.block
    live = [[postings[t][0][0], t, 0] for t in terms if postings[t][0]]  # current item, term, place in its list
    out = []
    slack = threshold - 1e-9
    while live:
        live.sort()
        bound, pivot = 0.0, -1
        for k, (_, t, _) in enumerate(live):
            bound += index.top[t]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == item:
            pivot += 1
        # the block maxima that hold for the pivot item; a shallow move does not touch postings
        tight, ahead = 0.0, len(index.ids)
        for own, t, at in live[: pivot + 1]:
            items, _, tops = postings[t]
            b = at // block
            while b < len(tops) and items[min(len(items), (b + 1) * block) - 1] < item:
                b += 1
            if b < len(tops):
                tight += tops[b]
                ahead = min(ahead, items[min(len(items), (b + 1) * block) - 1] + 1)
        if tight >= slack:
            if live[0][0] == item:
                score = sum(postings[t][1][at] for own, t, at in live[: pivot + 1])
                if score >= slack:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
        else:
            target = ahead
            if pivot + 1 < len(live):
                target = min(target, live[pivot + 1][0])
            target = max(target, item + 1)
        kept = []
        for k, (own, t, at) in enumerate(live):
            if k <= pivot and own < target:
                items = postings[t][0]
                while at < len(items) and items[at] < target:
                    at += 1
                if at == len(items):
                    continue
                own = items[at]
            kept.append([own, t, at])
        live = kept
    return out


def _scan(index: Index, docs: list[list[str]], threshold: float, min_overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """``document, item, score, question overlap, answer overlap`` of what a batch of documents holds.

    The bound is exact: essential postings summed over the passage, plus the most that an item can get from the other
    terms, is never less than its score, so passages below it need no search. Passages are two neighbouring steps of a document; a step is as long as the longest item (64 words at least), so
    each item's words lie in one passage. Whole batches are tested against the bound before any passage is searched.
    """
    step, size, n_items = max(64, index.longest), len(index.postings), len(index.ids)
    get = index.essential.get
    found = [np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)) for ws in docs]
    steps = [max(1, -(-len(ws) // step)) for ws in docs]
    first = np.concatenate([[0], np.cumsum(steps)])
    keys = np.concatenate([np.zeros(0, np.int64), *[((f + np.arange(len(t)) // step) * size + t)[t > 0] for f, t in zip(first[:-1], found, strict=True)]])
    keys = np.unique(keys)
    at, term = keys // size, keys % size
    # essential postings of each step, summed by passage and item: with the rest that an item can get, a bound on its score
    count = index.starts[term + 1] - index.starts[term]
    place = np.repeat(index.starts[term] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
    at, item, weight = np.repeat(at, count), index.flat_items[place], index.flat_impacts[place]
    inner = ~np.isin(at, first)  # the first step of a document belongs to no passage before it
    pairs = np.concatenate([at * n_items + item, (at[inner] - 1) * n_items + item[inner]])
    pairs, where = np.unique(pairs, return_inverse=True)
    bound = np.bincount(where, weights=np.concatenate([weight, weight[inner]]), minlength=len(pairs)) + index.rest[pairs % n_items]
    best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
    for k in np.unique(pairs[bound >= threshold - 1e-9] // n_items):
        doc = int(np.searchsorted(first, k, "right")) - 1
        place, words = int(k - first[doc]), docs[doc]
        own = {index.terms.get(w, 0) for w in words[place * step : (place + 2) * step]} - {0}
        # the passage and a step to either side, so that no part of the item is cut off
        near, held = words[max(0, (place - 1) * step) : (place + 3) * step], {}
        for item, score in search(index, sorted(own), threshold):
            q, a = overlap(index.questions[item], near, held), overlap(index.answers[item], near, held)
            if q >= min_overlap and a >= min_overlap:
                best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0.0, 0.0)), (min(q, a), score, q, a))
    for (doc, item), (_, score, q, a) in sorted(best.items()):
        yield doc, item, score, q, a


_OUT = "item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    min_overlap: float = 0.8,
    items_at_once: int = 20_000,
    chars_at_once: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    id_type: str = "long",
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: each pair of a document row and a test item it holds.

    Every passage of every document is a query against the index of the items. An
    item is a candidate where the passage's words make up ``threshold`` of its BM25
    weight, and a hit where ``min_overlap`` of the word 5-grams of its question and of
    its answer are found there. Every candidate passage is compared; of those that hit,
    the one with the best overlap, then the best score, is reported. The index is broadcast for about ``items_at_once``
    items and ``chars_at_once`` characters of them at most; more take further passes over the documents, so its size is bounded, however long
    items are, and all passes share the statistics of all items.

    Null and empty texts hold nothing; items without a word are never found. A null
    doc_id is reported as null; ids are cast to ``id_type``. Rows that repeat are reported each; items of equal
    text are each reported. Very long texts are read in slices of bounded bytes, a text at least. Other columns are
    ignored; without documents or items the result is empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull())
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size.n // items_at_once), -(-size.chars // chars_at_once))
    shared = _shared_statistics(tests) if passes > 1 else None
    out = None
    for k in range(passes):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        own = sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = build(own, threshold, stats=shared(part) if shared else None)
        hits = texts.mapInArrow(_search_batches(spark.sparkContext.broadcast(index), threshold, min_overlap), f"doc_id {id_type}, {_OUT}")
        out = hits if out is None else out.unionByName(hits)
    return out


def _shared_statistics(tests: DataFrame):
    """A function from a part of the items to the statistics of all of them, with the frequencies of the part's terms alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [Counter(words_of(t)) for t in batch.column("t").to_pylist()]
            rows = [(at, w, sum(c.values())) for at, c in enumerate(bags) for w in c]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            first = [n for _, n in sorted({at: n for at, _, n in rows}.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*columns[1], *[None] * len(first)], pa.string()), pa.array([*[None] * len(rows), *first], pa.int64())], names=["term", "size"]
            )

    words = tests.select("t").mapInArrow(count, "term string, size long")
    size = words.where("size IS NOT NULL").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("longest")).first()
    df = base.written(words.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")), "leak-terms")

    def of_part(part: DataFrame) -> Statistics:
        used = part.select("t").mapInArrow(count, "term string, size long").where("term IS NOT NULL").select("term").distinct()
        return Statistics(size.n, size.mean or 0.0, size.longest or 1, {r.term: r.df for r in df.join(used, "term", "left_semi").collect()})

    return of_part


def _search_batches(shipped, threshold: float, min_overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for part in (part for batch in batches for part in base.slices(batch) if index.ids):
            rows = list(_scan(index, [words_of(t) for t in part.column("text").to_pylist()], threshold, min_overlap))
            columns = [[index.ids[r[1]] for r in rows], *[[r[c] for r in rows] for c in (2, 3, 4)]]
            ids = part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.float64(), pa.float64(), pa.float64()], strict=True)]],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return base.frugal(run)


def op7_decontamination(spark, sf_dir):
    """All pairs of a document and a benchmark item that it holds."""
    return contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))

