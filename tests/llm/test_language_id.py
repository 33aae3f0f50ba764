import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tarn.llm import language_id as li
from tests.llm.conftest import ODD

SYLLABLES = {"en": ["the", "ing", "er", "th", "on"], "fr": ["é", "eau", "ou", "ré", "les"], "de": ["sch", "ung", "ü", "ein", "keit"]}


def make(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, make(rng, lang, rng.randint(3, 40)), lang if i % 7 else None, f"s{i % 4}") for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy(spark, as_docs, saved, rows):
    got = {r.doc_id: r for r in li.op10_language_id(spark, saved(documents=as_docs(rows))).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    test = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if lang and got[i].held_out]
    assert len(test) > 50 and sum(a == b for a, b in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_predictions_see_only_the_text(as_docs, rows):
    model = li.fit(as_docs(rows))
    one = li.predict(as_docs(rows), model).collect()
    other = li.predict(as_docs([(i + 5, t, "zz", "other") for i, t, *_ in rows]), model).collect()
    assert [(r.lang_pred, r.score) for r in one] == [(r.lang_pred, r.score) for r in other]


def test_unseen_words_fall_back_to_shorter_grams(as_docs, rows):
    model = li.fit(as_docs(rows))
    assert model.predict(["schungkeitschungkeitung", "éeaurééeaurésleseau"])[0] == ["de", "fr"]
    assert model.predict(["日本"])[1][0] == pytest.approx(1 / 3)
    model.cache = 5
    before = model.predict([t for _, t, *_ in rows])[0]
    assert model.predict([t for _, t, *_ in rows])[0] == before


def test_odd_rows(as_docs, rows):
    model = li.fit(as_docs(rows))
    got = li.predict(as_docs(ODD, "lang_pred", "__x"), model).collect()
    und = [r for r in got if r.lang_pred == li.UNKNOWN]
    assert len(got) == len(ODD) and sorted(str(r.doc_id) for r in und) == ["1", "2", "3", "6", "None"] and all(r.score == 0 for r in und)
    assert li.predict(as_docs([]), model).collect() == []
    assert {r.lang_pred for r in li.predict(as_docs(ODD), li.fit(as_docs([]))).collect()} == {li.UNKNOWN}


def test_characters_that_are_no_letters():
    assert li.words_of("x²y ½ _a_ 3b") == ["x", "y", "a", "b"]


def test_a_rare_language_is_predicted(spark):
    """Five labelled rows among 100,000 of another language."""
    docs = spark.range(100_000).selectExpr("id AS doc_id", "concat('the ring on the thing', ' other', id % 50) AS text", "'en' AS lang")
    rare = [(200_000 + k, f"zhoq wabbe zhoqi umbu{'abcde'[k]} zhoqi wabbe", "qq") for k in range(5)]
    model = li.fit(docs.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string")))
    assert model.langs == ["en", "qq"]
    assert model.predict(["zhoqi wabbe umbuz", "wabbezhoq", "the other thing", "ringing on"])[0] == ["qq", "qq", "en", "en"]


def brute(texts_by_lang, text, orders=(5, 4, 3, 2, 1), shared=0.02):
    """Scores by language from the definition, word by word."""
    langs = sorted(texts_by_lang)
    count = {lang: Counter(w for t in texts_by_lang[lang] for w in li.words_of(t)) for lang in langs}

    def logs(tables, key):
        every = Counter()
        for t in tables.values():
            every.update(t)
        kept = {k for k, n in every.items() if n >= 2}
        if key not in kept:
            return None
        p = [tables[lang][key] / max(1, sum(n for k, n in tables[lang].items() if k in kept)) for lang in langs]
        return [math.log((1 - shared) * x + shared * sum(p) / len(p)) for x in p]

    grams = {k: {lang: Counter() for lang in langs} for k in orders}
    for k in orders:
        for lang in langs:
            for w, n in count[lang].items():
                for g in li.grams_of(w, k):
                    grams[k][lang][g] += n
    total = [0.0] * len(langs)
    for w in li.words_of(text):
        own = logs(count, w)
        for k in orders:
            if own is not None:
                break
            found = [x for g in li.grams_of(w, k) if (x := logs(grams[k], g)) is not None]
            own = [sum(c) / len(found) for c in zip(*found)] if found else None
        total = [a + b for a, b in zip(total, own or [0.0] * len(langs))]
    return langs, total


def test_scores_equal_brute_force(as_docs):
    rng = random.Random(8)
    rows = [(i, make(rng, lang, 6), lang, None) for i in range(25) for lang in [rng.choice(list(SYLLABLES))]]
    model = li.fit(as_docs(rows))
    by = {}
    for _, t, lang, _ in rows:
        by.setdefault(lang, []).append(t)
    for text in [make(rng, rng.choice(list(SYLLABLES)), 4) for _ in range(8)] + ["thequuxé", "日本 the", "the\tthe\nOn er"]:
        langs, want = brute(by, text)
        total, size = model.scores(pa.array([text]))
        assert langs == model.langs and size[0] == len(li.words_of(text)) and total[0] == pytest.approx(want, abs=1e-9)


def test_very_long_texts(as_docs, rows):
    model = li.fit(as_docs(rows))
    long = make(random.Random(3), "fr", 300_000)
    got = li.predict(as_docs([(1, long, None, None), (2, "x" * 3_000_000, None, None), (3, long, None, None)]), model).collect()
    assert [r.lang_pred for r in got][::2] == ["fr", "fr"] and len(got) == 3
