import random

import corpus_pipeline as cp
from tests.llm.conftest import ODD
from tests.llm.test_language_id import make
from tests.llm.test_ngram_join import grams


def test_stages_do_what_they_say(spark, as_docs, saved):
    rng = random.Random(6)
    rows = [(i, make(rng, rng.choice(["en", "fr", "de"]), 60), "en", f"s{i % 3}") for i in range(120)]
    items = [(k, make(rng, "en", 25)) for k in range(5)]
    near = [(200 + i, f"{rows[i][1]} more", "en", "s0") for i in range(10)]
    leaks = [(300 + k, f"{make(rng, 'en', 30)} {t} {make(rng, 'en', 30)}", "en", "s1") for k, t in items]
    junk = [(400, "12 34 !!", "en", "s2"), (401, None, "en", "s2"), (402, "", None, None)]
    docs = as_docs(rows + near + leaks + junk)
    sf = saved(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/stage-{name}")
        docs = spark.read.parquet(f"{sf}/stage-{name}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "token_output":
            assert set(as_docs([]).columns) <= set(docs.columns)
        if name == "language_id":
            assert ids == {r[0] for r in rows + near + leaks}
        elif name == "near_duplicates":
            assert ids == {r[0] for r in rows + leaks}
        elif name in ("decontamination", "mixing", "token_output"):
            assert ids == {r[0] for r in rows}
    assert all(len(grams(a[1]) & grams(b[1])) >= 0.8 * len(grams(a[1]) | grams(b[1])) for a, b in zip(rows, near))
    mixed = {r.doc_id: r.mix_pos for r in spark.read.parquet(f"{sf}/stage-mixing").collect()}
    starts = {r.doc_id: r.start for r in docs.collect()}
    assert sorted(mixed, key=mixed.get) == sorted(starts, key=starts.get)
    assert sorted(tuple(r) for r in cp.run(spark, sf).collect()) == sorted(tuple(r) for r in docs.collect())


def test_one_row_of_a_repeated_document_stays(spark, as_docs):
    text = "one two three four five six seven eight"
    rows = [(1, text, "en", "a")] * 5 + [(2, text, "en", "b")] + [(None, f"{text} {text[::-1]}", "en", "c")] * 4 + [(3, "", "en", "d")] * 2 + [(4, "quite another text with words of its own", "en", "e")]
    got = cp.drop_near_duplicates(spark, as_docs(rows), "").collect()
    assert sorted(r.source for r in got) == ["a", "c", "d", "d", "e"] and {r.text for r in got if r.source == "a"} == {text}


def test_odd_rows(spark, as_docs, saved):
    sf = saved(documents=as_docs(ODD), benchmark=spark.createDataFrame([], "item_id long, text string"))
    got = cp.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in ODD}
    assert cp.run(spark, saved(documents=as_docs([]), benchmark=spark.createDataFrame([], "item_id long, text string"))).collect() == []


def test_columns_that_clash_stay(spark, as_docs, saved):
    rng = random.Random(2)
    rows = [(i, make(rng, rng.choice(["en", "fr"]), 30), "en", f"s{i % 2}") for i in range(60)]
    extra = ("mix_pos", "slot", "score", "lang_pred", "row_key", "kept")
    docs, sf = as_docs(rows, *extra), saved(benchmark=spark.createDataFrame([(1, make(rng, "de", 20))], "item_id long, text string"))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and {tuple(r[c] for c in extra) for r in out.collect()} == {("x",) * len(extra)}
        docs = out
    assert docs.columns[-1] == "mix_pos_"
    got = cp.write_tokens(spark, docs, sf).collect()
    order = [r.doc_id for r in sorted(docs.collect(), key=lambda r: r["mix_pos_"])]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == order


def test_languages_are_told_in_small_batches(spark, as_docs):
    """Whoever reads the stage, its texts met Python in batches that the stage bounds, not the session."""
    rng = random.Random(3)
    docs = as_docs([(i, make(rng, rng.choice(["en", "fr"]), 20), "en", "s") for i in range(40)])
    kept = cp.identify_languages(spark, docs, "")
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 40
