import random
from collections import Counter

from tarn.llm import decontaminate as dc
from tests.llm.conftest import ODD

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60


def make(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_search_equals_exhaustive_scoring():
    rng = random.Random(5)
    items = [(i, make(rng, rng.randint(3, 60))) for i in range(60)]
    index = dc.build(items, 0.6, block=3)
    for _ in range(400):
        terms = sorted({rng.randrange(1, len(index.postings)) for _ in range(rng.randint(1, 30))} | {index.terms[w] for w in rng.choice(items)[1].split()[: rng.randint(0, 60)]})
        threshold = rng.choice([0.1, 0.3, 0.6])
        score = Counter()
        for t in terms:
            for i, x in zip(*index.postings[t][:2], strict=True):
                score[i] += x
        assert {i for i, _ in dc.search(index, terms, threshold)} == {i for i, x in score.items() if x >= threshold - 1e-9}


def test_planted_items_are_found_wherever_they_stand(spark, as_docs):
    rng = random.Random(2)
    items = [(i, f"What is {make(rng, 20)}? It is {make(rng, 10)}." if i % 2 else make(rng, 30)) for i in range(40)]
    docs, truth = [], set()
    for d in range(150):
        words = make(rng, rng.randint(0, 400)).split()
        for i in rng.sample(range(40), rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(words))
            words = [*words[:at], *items[i][1].upper().split(), *words[at:]] if not truth & {(d, k) for k in range(40)} else words
            if " ".join(items[i][1].upper().split()) in " ".join(words):
                truth.add((d, i))
        docs.append((d, " ".join(words), None, None))
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(as_docs(docs, "item_id", "score"), tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    again = dc.contaminated(as_docs(docs), tests, items_at_once=7).collect()
    assert {(r.doc_id, r.item_id) for r in again} == truth


def test_a_question_without_its_answer_is_no_hit(spark, as_docs):
    rng = random.Random(9)
    question, answer = make(rng, 30), make(rng, 12)
    tests = spark.createDataFrame([(1, f"{question}? {answer}"), (2, make(rng, 40))], "item_id long, text string")
    docs = as_docs([(1, f"{question}? {make(rng, 40)}", None, None), (2, f"so: {question}? {answer}", None, None)])
    assert [(r.doc_id, r.item_id) for r in dc.contaminated(docs, tests).collect()] == [(2, 1)]


def test_a_copy_is_found_behind_a_passage_of_its_scattered_words(spark, as_docs):
    rng = random.Random(4)
    item = [f"v{i}" for i in range(20)]
    filler = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    scattered = [w for v in rng.sample(item, 20) for w in (v, *filler(3))]
    edited = [*item[:10], *item[11:]]
    docs = [(1, scattered + filler(600) + item), (2, scattered + filler(600) + edited + filler(300)), (3, scattered + filler(600))]
    tests = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = dc.contaminated(as_docs([(i, " ".join(ws), None, None) for i, ws in docs]), tests, min_overlap=0.5).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (2, 7)]
    assert {r.doc_id: (r.question_overlap, r.answer_overlap) for r in got}[1] == (1.0, 1.0)


def test_question_and_answer():
    assert dc.question_and_answer("Is it so? Yes it is") == (["is", "it", "so"], ["yes", "it", "is"])
    q, a = dc.question_and_answer("One two three four five. Six seven eight nine.")
    assert (len(q), a) == (5, ["six", "seven", "eight", "nine"])
    assert dc.question_and_answer("only a few words") == (["only", "a", "few", "words"], [])


def test_odd_rows(spark, as_docs):
    tests = spark.createDataFrame([(None, None), (1, ""), (2, "!!"), (3, "alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    got = dc.contaminated(as_docs(ODD), tests).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(d, i): n for d, n in ((None, 1), (4, 2), (5, 1)) for i in (3, 4)})
    assert dc.contaminated(as_docs([]), tests).collect() == []
    assert dc.contaminated(as_docs(ODD), tests.limit(0)).collect() == []


def test_scores_do_not_depend_on_the_number_of_passes(spark, as_docs):
    rng = random.Random(12)
    items = [(i, make(rng, rng.randint(5, 50))) for i in range(30)]
    docs = as_docs([(d, " ".join([make(rng, 60), rng.choice(items)[1], make(rng, 60)]), None, None) for d in range(40)])
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda n, chars=10**7: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in dc.contaminated(docs, tests, items_at_once=n, chars_at_once=chars).collect())
    assert rows(4) == rows(100) == rows(100, 900) and len(rows(100)) >= 40


def test_long_texts_and_the_contract_query(spark, as_docs, saved):
    rng = random.Random(3)
    item = make(rng, 30)
    long = "filler words " * 800_000 + item
    sf = saved(documents=as_docs([(1, long, None, None), (2, long, None, None), (3, "x", None, None)]), benchmark=spark.createDataFrame([(5, item)], "item_id long, text string"))
    got = dc.op7_decontamination(spark, sf)
    assert got.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 5), (2, 5)]
