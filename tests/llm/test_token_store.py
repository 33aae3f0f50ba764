import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import base
from tarn.llm import token_store as ts
from tests.llm.conftest import ODD


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    values = np.random.default_rng(n).choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], n).astype(np.uint32)
    control, data = ts.encode_block(values)
    assert len(control) == -(-n // 4) and ts.decode_block(control, data, n).tolist() == values.tolist()


def test_damage_is_noticed():
    control, data = ts.encode_block(np.array([1, 300], np.uint32))
    with pytest.raises(ValueError):
        ts.decode_block(control, data[:-1], 2)


PARTS = [
    "a", "B", "é", "é", "क़", "ß", "Σ", "İ", "²", "½", "9", "٣", "'s", "'t", "'", "''re", "_", ",", ".", "!!", "&&&", " ", "  ", "\n", "\t", " ", "​",
    "<|endoftext|>", "<|", "|>", "日本", "😀", "ﬁ", "Ǆ", "̀", "word", "The", "don't", "I'LL", "C++", "\x1c", "\x85",
]


def test_pieces_give_the_library_ids():
    encoder, rng = ts.WordEncoder(ts.vocabulary()), random.Random(1)
    texts = [None, ""] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    ids, sizes = encoder.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
        at += n


def expected(rows):
    tokenizer, start, out = ts.WordEncoder(ts.vocabulary()).tokenizer, 0, []
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [ts.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(spark, as_docs, saved):
    rows = [(i, f"Text {i}, with words{i % 7}! " * (i % 40), None, None) for i in range(500)]
    got = ts.op6_token_store(spark, saved(documents=as_docs(rows[::-1]).repartition(5)))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_odd_rows_and_own_order(spark, as_docs):
    rows = [r for r in ODD if r[0] is not None and r != ODD[6]]
    path = base.fresh_path(spark, "t")
    ts.write_store(as_docs(rows, "seq", "ids").selectExpr("*", "-doc_id AS place"), path, ts.vocabulary(), order_col="place")
    got = ts.token_digests(ts.read_store(spark, path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected(sorted(rows, key=lambda r: -r[0])))


def test_null_and_repeated_ids(spark, as_docs):
    path = base.fresh_path(spark, "t")
    ts.write_store(as_docs(ODD), path, ts.vocabulary())
    got = sorted((tuple(r) for r in ts.token_digests(ts.read_store(spark, path)).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:]))


def test_empty_table(spark, as_docs):
    path = base.fresh_path(spark, "t")
    ts.write_store(as_docs([]), path, ts.vocabulary())
    assert ts.read_store(spark, path).collect() == []


def test_another_vocabulary_goes_through_the_library(spark, as_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = ts.WordEncoder(path)
    assert ts.WordEncoder(ts.vocabulary()).by_piece and not encoder.by_piece
    texts = [None, "", "Two  words", "Ünïcode 😀\n\n x"]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_ranges_follow_the_bytes(spark, as_docs, monkeypatch):
    monkeypatch.setattr(ts, "_RANGE_BYTES", 4000)
    rows = [(i, f"Text {i}, with words{i % 7}! " * 20, None, None) for i in range(200)]
    path = base.fresh_path(spark, "t")
    ts.write_store(as_docs(rows), path, ts.vocabulary())
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 5
    assert sorted(tuple(r) for r in ts.token_digests(ts.read_store(spark, path)).collect()) == expected(rows)


def test_the_library_gets_few_words_at_once():
    """Pipeline: its records take many times the ids, so a slice of new words must not go through it in one call."""
    encoder, calls = ts.WordEncoder(ts.vocabulary()), []
    plain, whole = encoder.plain, encoder.tokenizer

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            calls.append(sum(len(t.split()) for t in texts))
            return self.inner.encode_batch_fast(texts, **options)

    encoder.plain, encoder.tokenizer = Counted(plain), Counted(whole)
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [str(k).translate(letters) for k in range(30_000)] + [f"é{k}" for k in range(5_000)]
    ids, _ = encoder.encode(pa.array([" ".join(words)]))
    assert ids.tolist() == whole.encode(" ".join(words), add_special_tokens=False).ids
    assert sum(calls) >= len(words) and max(calls) <= 8_000
