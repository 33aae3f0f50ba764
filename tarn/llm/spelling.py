"""Spelling variants: every word's distance-one Levenshtein automaton is intersected with broadcast trie shards of all words."""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

#: Contract values: what a run is, one run in so many loses a code point, and which words count.
RUN = "[A-Za-zÀ-ÿ]+"
ONE_IN = 31
LEAST_LENGTH = 7
LEAST_N = 2
RATIO = 10

_LOWER = {upper: upper + 32 for upper in range(65, 91)}

#: Words of one trie shard, and of the shards that are broadcast at once (about 30 bytes a word).
SHARD_WORDS = 100_000
PASS_WORDS = 1_000_000
#: Words whose automata go through a shard together, and states expanded at once.
BLOCK_WORDS = 20_000
MOST_STATES = 400_000

_EXACT, _SHORTER, _SAME, _LONGER = 1, 2, 4, 8


def lower_ascii(run: str) -> str:
    """Lower-cases only A to Z."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def altered(doc_id, run: str, one_in: int = ONE_IN) -> str:
    """The contract's planted misspelling: where ``one_in`` divides the crc32 of ``<doc_id>:<run>``, a code point goes. A null id is empty text."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


# ---- trie -----------------------------------------------------------------------------------------------------------


@dataclass
class Trie:
    """A trie as arrays, nodes level by level: children of node k are ``first[k]`` up to ``first[k + 1]``.

    ``label`` is the code point that leads to a node; ``word`` the place of the word that ends there in sorted order, or -1. ``n``
    holds the counts of the words, which stand one after another in ``text``, cut at ``cuts``.
    """

    first: np.ndarray
    label: np.ndarray
    word: np.ndarray
    n: np.ndarray
    cuts: np.ndarray
    text: str

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, first=self.first, label=self.label, word=self.word, n=self.n, cuts=self.cuts, text=np.frombuffer(self.text.encode(), np.uint8))
        return zlib.compress(out.getvalue(), 1)

    @classmethod
    def unpacked(cls, blob: bytes) -> Trie:
        with np.load(io.BytesIO(zlib.decompress(blob))) as f:
            return cls(f["first"], f["label"], f["word"], f["n"], f["cuts"], f["text"].tobytes().decode())

    def spelled(self, places: np.ndarray) -> list[str]:
        return [self.text[self.cuts[k] : self.cuts[k + 1]] for k in places]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each word, two zeros at least behind each, and the lengths."""
    length = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    chars = np.zeros((len(words), int(length.max(initial=0)) + 2), np.uint32)
    chars[np.arange(chars.shape[1])[None, :] < length[:, None]] = flat
    return chars, length


def build_trie(words: list[str], n: list[int]) -> Trie:
    """A trie of distinct words in code-point order."""
    chars, length = code_points(words)
    group = np.zeros(len(words), np.int64)  # the node that each word is at, within its level
    first, label, ends, alive, made = [], [np.zeros(1, np.uint32)], [], np.arange(len(words)), 1
    parents = 1
    for depth in range(chars.shape[1]):
        over = length[alive] == depth
        end = np.full(parents, -1, np.int64)
        end[group[over]] = alive[over]
        ends.append(end)
        alive, group = alive[~over], group[~over]
        c = chars[alive, depth]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (c[1:] != c[:-1])
        children = np.bincount(group[new], minlength=parents)
        first.append(made + np.concatenate([[0], np.cumsum(children)[:-1]]))
        made += int(new.sum())
        if not len(alive):
            break
        label.append(c[new])
        group, parents = np.cumsum(new) - 1, int(new.sum())
    first.append(np.array([made]))
    cuts = np.concatenate([[0], np.cumsum(length)])
    # the root, which is no child, is node 0
    return Trie(np.concatenate(first).astype(np.int32), np.concatenate(label), np.concatenate(ends).astype(np.int32), np.asarray(n, np.int64), cuts, "".join(words))


def neighbours(trie: Trie, words: list[str], most_states: int = MOST_STATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place in words, place in the trie)`` of every two words at distance exactly one, each pair once.

    The automaton of a word, after ``depth`` characters of a path, is in a set of four states: all matched;
    one error with ``depth - 1``, ``depth`` or ``depth + 1`` characters of the word read. Sets that are empty end a path. The search is
    depth-first over blocks: the block of states found last is expanded next, and a large one is halved first, so that memory is bounded by the
    depth of the trie times ``most_states``.
    """
    if not words or not len(trie.n):
        return
    chars, length = code_points(words)
    stack = [(0, np.arange(len(words)), np.zeros(len(words), np.int32), np.full(len(words), _EXACT, np.uint8))]
    while stack:
        depth, who, node, state = stack.pop()
        low = trie.first[node].astype(np.int64)
        fan = trie.first[node + 1] - low
        if fan.sum() > most_states and len(who) > 1:
            half = len(who) // 2
            stack += [(depth, who[part], node[part], state[part]) for part in (slice(half, None), slice(half))]
            continue
        here, gap = trie.word[node], length[who] - depth
        # the word is read to its end, or its last character is the error
        accepted = (here >= 0) & (((gap == 1) & (state & (_EXACT | _LONGER) > 0)) | ((gap == 0) & (state & _SAME > 0)) | ((gap == -1) & (state & _SHORTER > 0)))
        if accepted.any():
            yield who[accepted], here[accepted]
        if fan.any():
            stack.append(_expanded(depth, who, node, state, low, fan, trie, chars, length))


def _expanded(depth, who, node, state, low, fan, trie, chars, length):
    """All children of a block of states, but for those whose set of states is empty."""
    at = np.repeat(np.arange(len(who)), fan)
    node = (low[at] + np.arange(len(at)) - (np.cumsum(fan) - fan)[at]).astype(np.int32)
    who, state, c = who[at], state[at], trie.label[node]
    last = chars.shape[1] - 1
    read = lambda k: chars[who, min(max(k, 0), last)] == c  # noqa: E731  beyond a word's end there are zeros
    before, this, after = (read(depth - 1) if depth else np.zeros(len(who), bool)), read(depth), read(depth + 1)
    exact = state & _EXACT > 0
    new = np.where(exact & this, _EXACT, 0)
    new |= np.where(exact | ((state & _SHORTER > 0) & before), _SHORTER, 0)
    new |= np.where((exact & ~this & (depth < length[who])) | ((state & _SAME > 0) & this), _SAME, 0)
    new |= np.where((exact | (state & _LONGER > 0)) & after, _LONGER, 0)
    # a set that cannot end: more characters read than the word has and one more
    keep = (new > 0) & (depth < length[who] + 1)
    return depth + 1, who[keep], node[keep], new[keep].astype(np.uint8)


# ---- words ----------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, id_col: str, text_col: str, pattern: str, least_length: int, alter: Callable | None) -> DataFrame:
    """``word, n`` of all documents: the runs of ``pattern``, ASCII letters lower-cased, altered where ``alter(doc_id, run)`` says so.

    A run of fewer than ``least_length`` code points can become no longer one, so it is skipped. A task counts the words of
    a slice of bounded bytes before it hands them on.
    """
    runs = re.compile(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in base.slices(batch, "text", 16 << 20, 5000)):
            found: Counter = Counter()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                own = Counter(w for w in runs.findall(text) if len(w) >= least_length)
                for raw, n in own.items():
                    run = lower_ascii(raw)
                    found[alter(doc_id, run) if alter else run] += n
            kept = {w: n for w, n in found.items() if len(w) >= least_length}
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(base.frugal(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trie_shards(words: DataFrame, shard_words: int) -> DataFrame:
    """``shard, n_words, trie``: ranges of the sorted words as packed tries of at most ``shard_words`` words, made where the words are."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []

        def made(part):
            trie = build_trie([w for w, _ in part], [n for _, n in part])
            return pa.RecordBatch.from_arrays([pa.array([part[0][0]]), pa.array([len(part)], pa.int64()), pa.array([trie.packed()], pa.binary())], names=["least", "n_words", "trie"])

        for batch in batches:
            held += zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)
            while len(held) > shard_words:
                yield made(held[:shard_words])
                held = held[shard_words:]
        if held:
            yield made(held)

    total = words.count()
    parts = max(1, -(-total // shard_words))
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(build, "least string, n_words long, trie binary")


def near_words(words: DataFrame, shards: DataFrame, pass_words: int) -> DataFrame:
    """``word, n_near, best_n, best``: for each word and shard with a neighbour their number, the largest count, and the first word with it.

    Shards are broadcast in passes of at most ``pass_words`` words (one shard at least), so that what the driver and a worker hold is bounded, however many words there are; each pass
    reads all words and writes what it finds.
    """
    spark = words.sparkSession
    sizes = [(r.least, r.n_words) for r in shards.select("least", "n_words").orderBy("least").collect()]
    passes: list[list[str]] = []
    room = 0
    for least, size in sizes:
        if size > room:
            passes.append([])
            room = max(pass_words, size)
        passes[-1].append(least)
        room -= size
    schema = "word string, n_near long, best_n long, best string"
    path = base.fresh_path(spark, "near-words")
    for wanted in passes:
        blobs = [bytes(r.trie) for r in shards.where((F.col("least") >= wanted[0]) & (F.col("least") <= wanted[-1])).orderBy("least").collect()]
        shipped = spark.sparkContext.broadcast(blobs)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            tries = [Trie.unpacked(b) for b in shipped.value]
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_WORDS):
                    block = batch.column("word").slice(start, BLOCK_WORDS).to_pylist()
                    for trie in tries:
                        yield from _reduced(trie, block)

        words.select("word").mapInArrow(base.frugal(search), schema).write.mode("append").parquet(path)
        shipped.destroy()
    return spark.read.schema(schema).parquet(path) if passes else spark.createDataFrame([], schema)


def _reduced(trie: Trie, block: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a block with a neighbour in the shard."""
    found = list(neighbours(trie, block))
    if not found:
        return
    who, near = np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found])
    # of a word's neighbours the largest count first, then code-point order, which is that of places
    order = np.lexsort((near, -trie.n[near], who))
    who, near = who[order], near[order]
    start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    many = np.diff(np.append(start, len(who)))
    best = near[start]
    yield pa.RecordBatch.from_arrays(
        [pa.array([block[k] for k in who[start]], pa.string()), pa.array(many, pa.int64()), pa.array(trie.n[best], pa.int64()), pa.array(trie.spelled(best), pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: forms are followed to the last by doubling, with a written table each round.

    A form counts ``ratio`` times as often as its word, so that chains end and are short.
    """
    at = base.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = base.written(at.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(
    docs: DataFrame,
    pattern: str = RUN,
    least_length: int = LEAST_LENGTH,
    least_n: int = LEAST_N,
    ratio: int = RATIO,
    alter: Callable | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_words: int = SHARD_WORDS,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a row for each word of ``least_length`` code points and ``least_n`` occurrences at least.

    Words are the runs of ``pattern`` in all texts with A to Z lower-cased; ``alter(doc_id, run)`` may replace one. Two words are near at Levenshtein distance one. A
    word's form is its near word of the largest count (ties: the first in code-point order) if that is ``ratio`` times its own at least, else null; its root is where forms lead.

    All words are cut into sorted ranges of ``shard_words``, each a compact trie built by the task that holds the
    range; tries are broadcast in passes of ``pass_words`` words, and every word's automaton searches every shard. Only
    sums and best forms leave a search, no pairs.

    Null and empty texts have no word; a null id is empty text to ``alter``; repeated rows count each. Other columns are ignored; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their words, else they might lead round")
    counted = base.written(word_counts(docs, id_col, text_col, pattern, least_length, alter).where(F.col("n") >= least_n), "spelling-words")
    shards = base.written(trie_shards(counted, shard_words), "spelling-tries")
    found = near_words(counted, shards, pass_words)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    best = best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")
    joined = counted.join(best, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    words = base.written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
        "spelling-forms",
    )
    last = roots(words.where("form IS NOT NULL"))
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    """Contract query: words of seven letters or more of all documents, with the contract's planted misspellings."""
    return spelling_variants(base.table(spark, sf_dir, "documents"), alter=altered)
