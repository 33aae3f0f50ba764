import random
import re
import zlib
from collections import Counter

import pytest

from tarn.llm.spelling import Trie, altered, build_trie, neighbours, op13_spelling_variants, spelling_variants
from tests.llm.conftest import ODD


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows, least_length=7, least_n=2, ratio=10, alter=True):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if alter and h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    form, many = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(v, w)]
        many[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, many[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def as_set(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdé", "aÀ÷😀"])
def test_automaton_against_all_pairs(letters):
    pick = random.Random(len(letters))
    for most in (1, 7, 200, 100_000):
        for _ in range(12):
            words = sorted({"".join(pick.choice(letters) for _ in range(pick.randint(1, 7))) for _ in range(50)})
            trie = Trie.unpacked(build_trie(words, [1] * len(words)).packed())
            found = [(a, b) for who, near_ in neighbours(trie, words, most) for a, b in zip(who.tolist(), near_.tolist(), strict=True)]
            assert len(found) == len(set(found))
            assert set(found) == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if near(x, y)}
            assert trie.spelled(range(len(words))) == words


def test_empty_trie_and_no_words():
    assert list(neighbours(build_trie([], []), ["abcdefg"])) == []
    assert list(neighbours(build_trie(["abcdefg"], [2]), [])) == []


def corpus():
    """Words of syllables in very different numbers, so that variants, chains of forms and ties arise."""
    pick = random.Random(5)
    stems = ["".join(pick.choice(["tion", "ment", "Lich", "éa", "ver", "ÀB", "ou"]) for _ in range(3)) for _ in range(12)]
    texts = []
    for k in range(250):
        words = []
        for _ in range(60):
            w = stems[min(int(pick.expovariate(0.7)), 11)]
            at = pick.randrange(len(w))
            words.append(pick.choices([w, w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "q" + w[at + 1 :], w + "ab"], [40, 1, 1, 1, 1])[0])
        texts.append((k, pick.choice([" ", "\n", "-", "1"]).join(words), "en", "a"))
    texts += [(1000, "aaaaaaaaa " * 200 + "aaaaaaaab " * 20 + "aaaaaaabb " * 2 + "aaaaaabbb abcdefgh abcdefgh abcdefgi abcdefgi", "en", "b")]
    return texts


def test_against_brute_force(spark, as_docs, saved):
    rows = [*corpus(), *ODD]
    wanted = brute(rows)
    assert any(root not in (word, form) for word, form, root, *_ in wanted) and sum(form is not None for _, form, *_ in wanted) > 20
    assert as_set(op13_spelling_variants(spark, saved(documents=as_docs(rows, "word", "n", "root")))) == wanted


def test_many_shards_and_passes(spark, as_docs):
    rows = corpus()
    small = spelling_variants(as_docs(rows), least_length=5, least_n=1, ratio=3, shard_words=17, pass_words=60)
    assert as_set(small) == brute(rows, 5, 1, 3, alter=False)


def test_empty_and_odd(spark, as_docs):
    assert spelling_variants(as_docs([])).count() == 0
    assert spelling_variants(as_docs([(1, None, None, None), (2, "", None, None), (3, "short", None, None)])).count() == 0
    assert as_set(spelling_variants(as_docs(ODD), least_n=1, alter=altered)) == brute(ODD, least_n=1)
    with pytest.raises(ValueError, match="commoner"):
        spelling_variants(as_docs([]), ratio=1)
