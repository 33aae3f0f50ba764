import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
import pytest

from tarn.llm import ngram_join as nj
from tests.llm.conftest import ODD


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t, *_ in rows]
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in classes.items()}
    return Counter((rows[i][0], least[root(i)] if len(classes[root(i)]) > 1 else rows[i][0], links[i], len(sets[i])) for i in range(len(rows)))


def corpus(rng, groups, members, words=60):
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(rng.randint(1, members)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                text[rng.randrange(words)] = f"x{rng.randrange(3000)}"
            rows.append((at, rng.choice([" ", ", "]).join(text).title() if at % 3 else " ".join(text), None, None))
            at += 1
    return rows


@pytest.mark.parametrize("block_rows", [512, 8])
def test_links_and_classes_equal_brute_force(as_docs, block_rows):
    rng = random.Random(11)
    rows = corpus(rng, 60, 6) + [(10_000 + i, t, None, None) for i, (_, t, *_) in enumerate(corpus(rng, 1, 1) * 25)]
    hot = [f"h{i}" for i in range(80)]
    for i in range(60):
        text = list(hot)
        text[rng.randrange(80)] = f"y{i}"
        rows.append((20_000 + i, " ".join(text), None, None))
    got = nj.similar_documents(as_docs(rows, "class_id", "sid", "copies"), block_rows=block_rows).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_grams) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.class_id for r in got}) and all(r.doc_id == r.class_id for r in kept)


def test_odd_rows(as_docs):
    got = nj.similar_documents(as_docs(ODD, "text2", "sig")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_grams) for r in got) == brute(ODD)
    assert nj.similar_documents(as_docs([])).collect() == []


def test_bands_meet_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = nj.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_similarity_by_products_equals_similarity_by_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 150))).astype(np.uint64) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert np.allclose(nj.jaccard_of_pairs(sets, i, j), want) and np.allclose(nj.jaccard_of_pairs(sets, i[:20], j[:20]), want[:20])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in nj.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_recall_of_links_on_a_skewed_corpus(as_docs):
    """Every banded pair is verified, so what is lost is lost by the bands: one in 10,000 at the threshold, less above it."""
    rng = random.Random(23)
    words, rows = 90, []
    hot = [f"h{i}" for i in range(words)]
    for i in range(260):  # a third of the rows around one text, most pairs near the threshold
        text = list(hot)
        for _ in range(rng.choice([0, 1, 1, 1])):
            text[rng.randrange(words)] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(text), None, None))
    rows += [(1000 + i, t, None, None) for i, (_, t, *_) in enumerate(corpus(rng, 90, 12))]
    sets = [grams(t) for _, t, *_ in rows]
    want = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.update((rows[i][0], rows[j][0]))
    got = {r.doc_id: r.n_links for r in nj.similar_documents(as_docs(rows), block_rows=64).collect()}
    total = sum(want.values())
    assert total > 20_000 and all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9999 * total


def test_blocks_are_bounded_by_bytes(spark, as_docs):
    """A bucket is cut into more blocks where its sets are large, and the result stays the same."""
    members = spark.createDataFrame([(7, 0, 100, 100 * 20_000, k) for k in range(100)] + [(8, 0, 100, 100 * 10, k) for k in range(100)], "bucket long, band int, n long, grams long, sid long")
    blocks = {r.bucket: r for r in nj._blocked(members, 512, 1 << 20).groupBy("bucket").agg(F.max("right").alias("last"), F.count("*").alias("n")).collect()}
    assert (blocks[7].last, blocks[7].n) == (15, 1600) and (blocks[8].last, blocks[8].n) == (0, 100)
    rng = random.Random(5)
    base_text = [f"h{i}" for i in range(300)]
    rows = [(k, " ".join([*base_text[: (at := rng.randrange(300))], f"y{k % 9}", *base_text[at + 1 :]]), None, None) for k in range(60)]
    plain, cut = (sorted(map(tuple, nj.similar_documents(as_docs(rows), block_bytes=size).select("doc_id", "class_id", "n_links", "n_grams", "kept").collect())) for size in (32 << 20, 20_000))
    assert plain == cut and plain[0][2] > 30


def test_long_texts_and_the_contract_query(spark, as_docs, saved):
    long = " ".join(f"w{i}" for i in range(600_000))
    rows = [(1, long, None, None), (2, long + " more", None, None), (3, long.upper(), None, None), (4, "a b c", None, None)]
    got = nj.op8_ngram_join(spark, saved(documents=as_docs(rows))).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2, 599_996), (2, 1, 2, 599_997), (3, 1, 2, 599_996), (4, 4, 0, 1)]
