"""Each opN_ query by its contract: names, types and what follows from the rows alone."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tarn.llm import registry
from tests.llm.conftest import ODD
from tests.llm.test_spelling import brute as spelling_rows

COLUMNS = {
    "op1_pii": [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op3_sharding": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op5_url_filter": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op6_token_store": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op9_exact_dedup": [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
    "op10_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op11_filter_audit": [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split()]],
    "op12_html_extract": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op13_spelling_variants": [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")],
}
TEXTS = ["the ring on the thing", "The Ring on the Thing", "un deux trois quatre", "mail a@b.co now", None, "", "Été É", "the ring on the thing"]


@pytest.fixture(scope="module")
def sf(spark, as_docs, saved):
    rows = [(i, TEXTS[i % len(TEXTS)], "en" if i % 3 else None, f"s{i % 4}") for i in range(160)]
    pages = spark.createDataFrame([(1, "http://a.example.com/fr/1", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    return saved(documents=as_docs(rows), pages=pages, benchmark=items, labels=labels), rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_columns(spark, sf, name):
    got = registry.QUERIES[name](spark, sf[0])
    assert got.dtypes[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    assert len(got.collect()) >= 0


def test_sharding(spark, sf):
    got = registry.QUERIES["op3_sharding"](spark, sf[0]).collect()
    size = {i: len((t or "").encode()) + 16 for i, t, *_ in sf[1]}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t, *_ in sf[1]}
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load[k] for k in range(40)) <= max(size.values()) * 2


def test_mixing(spark, sf):
    got = registry.QUERIES["op2_mixing"](spark, sf[0]).collect()
    assert sorted(r.doc_id for r in got) == [i for i, *_ in sf[1]] and len({r.mix_pos for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_exact_dedup(spark, sf):
    got = registry.QUERIES["op9_exact_dedup"](spark, sf[0]).collect()
    groups = defaultdict(list)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t, *_ in sf[1]:
        groups[lower(t)].append(i)
    want = {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


def test_odd_documents(spark, as_docs, saved):
    empty = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    other = {"benchmark": empty, "pages": pages, "labels": labels}
    odd, none = saved(documents=as_docs(ODD, "slot", "keep_id"), **other), saved(documents=as_docs([]), **other)
    own = {"op11_filter_audit": 600 * len({s or "" for *_, s in ODD}), "op13_spelling_variants": len(spelling_rows(ODD))}
    per_row = {"op1_pii", "op2_mixing", "op3_sharding", "op6_token_store", "op8_ngram_join", "op9_exact_dedup", "op10_language_id"}
    for name, run in registry.QUERIES.items():
        assert run(spark, none).collect() == []
        assert len(run(spark, odd).collect()) == own.get(name, len(ODD) if name in per_row else 0)
