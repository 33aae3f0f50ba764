import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import scalar as sc
from tarn.functions import tensor as tn
from tarn.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(values):
    return F.array(*[F.lit(v) for v in values])


def test_word_and_pattern_tokens(spark):
    assert value(spark, tx.word_tokens(F.lit("Learning-to Rank, 2x!"))) == ["learning", "to", "rank", "2x"]
    assert value(spark, tx.pattern_tokens(F.lit("c++ (fast) code"))) == ["c++", "fast", "code"]
    assert value(spark, tx.word_tokens(F.lit(""))) == []


def test_folding_and_stemming(spark):
    df = spark.createDataFrame([("Ｃafé ÉTÉ",), (None,)], "t string")
    assert [r.x for r in df.select(tx.folded_tokens(F.col("t")).alias("x")).collect()] == [["cafe", "ete"], None]
    assert value(spark, tx.stemmed(lits(["running", "cities", "glass", "cat", "as"]))) == ["runn", "city", "glass", "cat", "as"]


def test_suffix_phrases_and_prefixes(spark):
    assert value(spark, tx.suffix_phrases(F.lit("learning to rank"))) == ["learning to rank", "to rank", "rank"]
    path = "Media > Music & Sound Recordings > Music Cassette Tapes"
    prefixes = value(spark, tx.all_prefixes(F.lit(path)))
    assert len(prefixes) == 55 and prefixes[0] == "M" and prefixes[-1] == path
    assert value(spark, tx.path_levels(lits(["A", "B", "C"]))) == ["A", "A|B", "A|B|C"]
    assert value(spark, tx.suffix_phrases(F.lit(""))) == [] and value(spark, tx.all_prefixes(F.lit(""))) == []


def test_token_windows_skip_stop_words(spark):
    got = value(spark, tx.token_windows(lits(["how", "to", "rank"]), 2, ("to",)))
    assert got == ["how", "rank"]
    assert value(spark, tx.token_windows(lits(["a", "b", "c"]), 3)) == ["a", "b", "c", "a b", "b c", "a b c"]


def test_phonetic_and_grams(spark):
    assert value(spark, tx.phonetic(lits(["hela"]))) == ["H400"]
    assert value(spark, tx.character_grams(F.lit("xgbo"), 3)) == ["xgb", "gbo"]
    assert value(spark, tx.character_grams(F.lit("x"), 3)) == []


def test_phrase_merge_compounds_segments(spark):
    df = spark.createDataFrame([(["空气", "净化器", "x"],)], "t array<string>")
    assert df.select(tx.phrase_merger(["空气净化器"])("t").alias("x")).first().x == ["空气净化器", "x"]
    df = spark.createDataFrame([(["fussballspiel", "tor"],)], "t array<string>")
    assert df.select(tx.compound_splitter(["fussball", "spiel", "ball"])("t").alias("x")).first().x == ["fussballspiel", "fussball", "spiel", "tor"]
    df = spark.createDataFrame([("我喜欢音乐",)], "t string")
    assert df.select(tx.dictionary_segmenter(["喜欢", "音乐"])("t").alias("x")).first().x == ["我", "喜欢", "音乐"]


def test_synonyms_stop_words_cleanup(spark):
    assert value(spark, tx.with_synonyms(lits(["tv", "x"]), {"tv": ["television"]})) == ["tv", "television", "x"]
    assert value(spark, tx.without_stop_words(lits(["the"]), ("the",))) == ["the"]
    assert value(spark, tx.spaced_words(F.lit("endOf it.Next-one"))) == "end Of it Next one"
    assert value(spark, tx.without_control(F.lit("a\u0007b"))) == "ab"


def test_chunks_sections_snippet(spark):
    assert value(spark, tx.fixed_chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"]
    df = spark.createDataFrame([("aa bb\n\ncc dd ee", 6)], "t string, n int")
    assert df.select(tx.recursive_chunks("t", "n").alias("x")).first().x == ["aa bb", "cc dd", "ee"]
    df = spark.createDataFrame([("<h1>T</h1><p>one</p><script>x</script><h2>U</h2>two",), (None,)], "t string")
    rows = [[tuple(s) for s in r.x] for r in df.select(tx.html_sections("t").alias("x")).collect()]
    assert rows == [[("T", "one"), ("U", "two")], []]
    assert value(spark, tx.snippet(F.lit("a b c match d e f"), ["match"], 1)) == "<sep />c <hi>match</hi> d<sep />"


def test_cross_encoder_input(spark):
    got = tx.cross_encoder_input(lits([7]), lits([8, 9]), 8)
    assert value(spark, got["input_ids"]) == [101, 7, 102, 8, 9, 102, 0, 0]
    assert value(spark, got["token_type_ids"]) == [0, 0, 0, 1, 1, 1, 0, 0]
    assert value(spark, got["attention_mask"]) == [1, 1, 1, 1, 1, 1, 0, 0]


def test_scalars(spark):
    assert value(spark, sc.freshness(F.lit(90), 100, 100.0)) == pytest.approx(0.9)
    assert value(spark, sc.log_freshness(F.lit(75), 100, 100.0, 25.0)) == pytest.approx(0.5)
    assert value(spark, sc.joined_bits(F.lit(1), F.lit(-1))) == (1 << 32) | 0xFFFFFFFF
    assert [value(spark, sc.fibonacci(F.lit(n))) for n in range(7)] == [0, 1, 1, 2, 3, 5, 8]
    assert value(spark, sc.scaled_byte(F.lit(3.0))) == 127 and value(spark, sc.scaled_byte(F.lit(float("nan")))) == 0
    assert value(spark, sc.bytes_from_hex(F.lit("00ff7f80"))) == [0, -1, 127, -128]
    assert value(spark, sc.mapped_from_json(F.lit('{"cells": [{"address": {"x": "a"}, "value": 2}]}'), "x")) == {"a": 2.0}
    assert value(spark, sc.mapped_from_json(F.lit('{"a": 1.5}'), "x")) == {"a": 1.5}
    assert value(spark, sc.after_last(F.lit("a|b|c"), "|")) == "c"


def test_tensors(spark):
    a, b = tn.literal([1, 2, 2]), tn.literal([2, 0, 1])
    assert value(spark, tn.dot(a, b)) == 4.0 and value(spark, tn.norm(a)) == 3.0
    assert value(spark, tn.euclidean(a, b)) == pytest.approx(math.sqrt(6))
    assert value(spark, tn.sparse_dot(tn.mapped_literal({"Python": 3, "AWS": 1}), tn.mapped_literal({"Java": 2, "Python": 2}))) == 6.0
    packed = tn.packed_bits(tn.literal([1, -1, 1, 0, 0, 0, 0, 1, 1]))
    assert value(spark, packed) == [-95, -128]
    assert value(spark, tn.unpacked_bits(F.array(F.lit(-95)))) == [1.0, 0, 1, 0, 0, 0, 0, 1]
    assert value(spark, tn.hamming(F.array(F.lit(-1)), F.array(F.lit(0)))) == 8
    q, d = F.array(tn.literal([1, 0]), tn.literal([0, 1])), F.array(tn.literal([1, 1]), tn.literal([3, 0]))
    assert value(spark, tn.max_sim(q, d)) == 4.0
    assert value(spark, tn.top_labels(tn.mapped_literal({"a": 1, "b": 3, "c": 3}), 2)) == ["b", "c"]
    assert value(spark, tn.min_max_scaled(tn.literal([1, 3]), -1.0, 1.0)) == [-1.0, 1.0]
    assert value(spark, tn.top_mean(tn.literal([1, 5, 3]), 2)) == 4.0


def test_query_network_layer_normalises(spark):
    import numpy as np

    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    net = tn.query_network([(np.eye(2), np.zeros(2))], np.array([1.0, 1.0]))
    assert df.select(net("v").alias("x")).first().x == pytest.approx(3.0, abs=1e-4)


def test_subword_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["small ring", "Ünï code 😀", "", None]
    library = Tokenizer.from_file(path)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.subword_ids(F.col("t"), F.lit(path)).alias("x")).collect()
    assert [r.x for r in got] == [None if t is None else library.encode(t, add_special_tokens=False).ids for t in texts]


def test_soundex_follows_its_rules(spark):
    words = ["Robert", "Rupert", "Tymczak", "Pfister", "Honeyman", "Ashcraft"]
    got = value(spark, tx.phonetic(lits([w.lower() for w in words])))
    assert got == ["R163", "R163", "T522", "P236", "H555", "A261"]


def test_segments_by_a_table_of_words(spark):
    """The join gives what the small dictionary's function gives."""
    words = ["喜欢", "音乐", "ab", "abc", "cd", "b c", "x"]
    texts = [(1, "我喜欢音乐"), (2, "abcd"), (3, "ab cd"), (4, ""), (5, None), (6, "a"), (7, "zzabzzabcabd")]
    df = spark.createDataFrame(texts, "id int, t string")
    table = spark.createDataFrame([(w,) for w in words], "w string")
    wanted = {r.id: r.x for r in df.select("id", tx.dictionary_segmenter(words)("t").alias("x")).collect()}
    assert {r.id: r.tokens for r in tx.segmented(df, "id", "t", table, "w").collect()} == wanted
    assert tx.segmented(df, "id", "t", table.limit(0), "w").where("id = 2").first().tokens == list("abcd")
