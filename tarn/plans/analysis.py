"""Text analysis chains over names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.operators import predicates as p
from tarn.operators import postings as ps
from tarn.plans.registry import query, spread, table
from tarn.plans.texts import _BM25, _held

_TOKENS = "list_filter(string_split_regex({}, '[^a-z0-9]+'), lambda t: t <> '')"
_JOINED = "array_to_string({}, ' ')"


def _names(spark, sf_dir, column, *more):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(column, " ").alias("tokens"), *more)


@query("folded_tokens", "SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') AS tokens FROM documents")
def folded_tokens(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(tx.folded_tokens(F.col("text")), " ").alias("tokens"))


def _stem_sql(word: str) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{s}') AND NOT ends_with({word}, 'ss') AND length({word}) >= {len(s) + 3} THEN {word}[1:length({word}) - {len(s)}] || '{put}'" for s, put in tx._STEPS)
    return f"CASE {cases} ELSE {word} END"


@query("stemmed_terms", f"SELECT doc_id, array_to_string(list_transform({_TOKENS.format('lower(text)')}, lambda t: {_stem_sql('t')}), ' ') AS tokens FROM documents WHERE lang = 'en'")
def stemmed_terms(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(tx.stemmed(tx.word_tokens(F.col("text"))), " ").alias("tokens"))


@query(
    "synonym_graph",
    "SELECT p_partkey, array_to_string(flatten(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'ring' THEN ['ring', 'band', 'hoop'] WHEN 'red' THEN ['red', 'crimson'] ELSE [w] END)), ' ') AS tokens FROM part",
)
def synonym_graph(spark, sf_dir):
    return _names(spark, sf_dir, tx.with_synonyms(tx.word_tokens(F.col("p_name")), {"ring": ["band", "hoop"], "red": ["crimson"]}))


@query("separate_profiles", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['band', 'ring'])")
def separate_profiles(spark, sf_dir):
    """T5: synonyms on the index side only, a plain analyzer for the query."""
    indexed = table(spark, sf_dir, "part").select("p_partkey", tx.with_synonyms(tx.word_tokens(F.col("p_name")), {"ring": ["band"]}).alias("index"))
    return indexed.where(F.arrays_overlap("index", tx.word_tokens(F.lit("BAND")))).select("p_partkey")


@query("pattern_tokens", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(p_brand || ' (' || p_type || ') c++', '\\s|\\(|\\)'), lambda t: t <> ''), ' ') AS tokens FROM part")
def pattern_tokens(spark, sf_dir):
    return _names(spark, sf_dir, tx.pattern_tokens(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(") c++"))))


@query("reversed_tokens", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: reverse(w)), ' ') AS tokens FROM part")
def reversed_tokens(spark, sf_dir):
    return _names(spark, sf_dir, tx.reversed_tokens(tx.word_tokens(F.col("p_name"))))


_DICTIONARY = ["ring", "widget", "gadget", "bolt", "screw", "gear", "small", "large", "shiny", "blue", "green", "steel", "brass", "valve", "plate"]
_IN = "({})".format(", ".join(f"'{w}'" for w in _DICTIONARY))


@query(
    "compound_words",
    f"SELECT p_partkey, CASE WHEN w[1] IN {_IN} AND w[2] IN {_IN} THEN w[1] || w[2] || ' ' || w[1] || ' ' || w[2] ELSE w[1] || w[2] END AS tokens FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
)
def compound_words(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.replace("p_name", F.lit(" "), F.lit(""))).alias("t"))
    return rows.select("p_partkey", F.array_join(tx.compound_splitter(_DICTIONARY)("t"), " ").alias("tokens"))


@query("dictionary_segments", "SELECT p_partkey, replace(p_name, ' ', '|') AS tokens FROM part")
def dictionary_segments(spark, sf_dir):
    """The words of all names are the dictionary, a table; names without spaces are cut into them."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    rows = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("t"))
    return tx.segmented(rows, "p_partkey", "t", words, "w").select("p_partkey", F.array_join("tokens", "|").alias("tokens"))


@query("character_folding", "SELECT p_partkey, translate(p_name, 'aeiou', 'AEIOU') AS folded FROM part")
def character_folding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.character_folding(F.col("p_name"), "aeiou", "AEIOU").alias("folded"))


@query("phrase_merge", "SELECT p_partkey, CASE WHEN p_name IN ('red ring', 'small widget', 'small ring') THEN replace(p_name, ' ', '') ELSE p_name END AS tokens FROM part")
def phrase_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", tx.word_tokens(F.col("p_name")).alias("t"))
    return rows.select("p_partkey", F.array_join(tx.phrase_merger(["redring", "smallwidget", "smallring"])("t"), " ").alias("tokens"))


@query("subword_ids")
def subword_ids(spark, sf_dir):
    """No SQL: held against the library in the tests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.subword_ids(F.col("p_name"), F.lit(path)).cast("array<string>"), " ").alias("ids"))


@query("recursive_chunks", "SELECT p_partkey, array_to_string(CASE WHEN length(p_name) <= 8 THEN [p_name] ELSE string_split(p_name, ' ') END, '|') AS chunks FROM part")
def recursive_chunks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.recursive_chunks(F.col("p_name"), F.lit(8)), "|").alias("chunks"))


@query(
    "cross_encoder_input",
    """
    SELECT p_partkey, array_to_string(([101, 7, 8, 102] || list_transform(range(0, p_size % 5), lambda i: 200 + i) || [102] || [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ' ') AS input_ids,
           array_to_string(([0, 0, 0, 0] || list_transform(range(0, p_size % 5 + 1), lambda i: 1) || [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ' ') AS token_type_ids, CAST(least(8, 5 + p_size % 5) AS INTEGER) AS held FROM part
    """,
)
def cross_encoder_input(spark, sf_dir):
    many = F.col("p_size") % 5
    doc = F.when(many > 0, F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: i + 200)).otherwise(F.array().cast("array<int>"))
    out = tx.cross_encoder_input(F.array(F.lit(7), F.lit(8)), doc, 8)
    shown = [F.array_join(out[k].cast("array<string>"), " ").alias(k) for k in ("input_ids", "token_type_ids")]
    return table(spark, sf_dir, "part").select("p_partkey", *shown, F.aggregate(out["attention_mask"], F.lit(0), lambda s, x: s + x).alias("held"))


@query(
    "text_cleanup",
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_name || p_type || '-x', '([a-z.])([A-Z])', '\\1 \\2', 'g'), '\\W', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced, lower(regexp_replace(p_brand, '[^\\w ]', ' ', 'g')) AS asked FROM part",
)
def text_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.spaced_words(F.concat("p_name", "p_type", F.lit("-x"))).alias("spaced"), tx.query_text(F.col("p_brand")).alias("asked"))


@query(
    "stop_word_fallback",
    "SELECT p_partkey, array_to_string(CASE WHEN len(list_filter(w, lambda x: x NOT IN ('small', 'ring'))) > 0 THEN list_filter(w, lambda x: x NOT IN ('small', 'ring')) ELSE w END, ' ') AS tokens FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
)
def stop_word_fallback(spark, sf_dir):
    return _names(spark, sf_dir, tx.without_stop_words(tx.word_tokens(F.col("p_name")), ("small", "ring")))


@query("token_dump", f"SELECT item_id, {_JOINED.format(_TOKENS.format('lower(text)'))} AS tokens FROM benchmark")
def token_dump(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.tokens_of(F.col("text")), " ").alias("tokens"))


@query("control_filter", "SELECT p_partkey, p_name AS clean FROM part")
def control_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.without_control(F.concat(F.lit("\u0007"), "p_name", F.lit("​"))).alias("clean"))


@query("good_phrases", "SELECT DISTINCT p_type || ' ' || p_name AS phrase FROM part WHERE length(p_type || ' ' || p_name) BETWEEN 3 AND 16")
def good_phrases(spark, sf_dir):
    phrase = F.concat("p_type", F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select(phrase.alias("phrase")).distinct().where(p.good_phrase(F.col("phrase"), 3, 16))


# ---- query trees ---------------------------------------------------------------------------------------------------

_NAMES = p.Fields(text={"p_name": tx.word_tokens, "text": tx.word_tokens})


@query("suggestion_query", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'red ri') OR list_contains(string_split(p_name, ' '), 'red')")
def suggestion_query(spark, sf_dir):
    node = p.suggestion_query("red ri", "p_name_raw", "p_name")
    return table(spark, sf_dir, "part").withColumn("p_name_raw", F.col("p_name")).where(p.compiled(node, _NAMES)).select("p_partkey")


@query("negated_missing", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 1, false)")
def negated_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(p.compiled(~p.compare("toxic", "=", 1))).select("doc_id")


@query(
    "unranked_filters",
    "SELECT p_partkey, CAST((CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN 1 ELSE 0 END) AS INTEGER) AS matched FROM part WHERE p_size < 20 AND p_type = 'ECONOMY'",
)
def unranked_filters(spark, sf_dir):
    asked = p.term("p_name", "ring") | p.term("p_name", "red") | p.ALL
    node = asked & p.compare("p_size", "<", 20).unranked() & p.term("p_type", "ECONOMY").unranked()
    return table(spark, sf_dir, "part").where(p.compiled(node, _NAMES)).select("p_partkey", p.matched_terms(node, _NAMES).alias("matched"))


_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


@query(
    "nearest_or_text",
    f"""
    WITH n AS (SELECT vec_id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_QV}), vec_id LIMIT 25)
    SELECT vec_id FROM embeddings WHERE (vec_id IN (SELECT vec_id FROM n) OR label = 3) AND vec_id % 2 = 1
    """,
)
def nearest_or_text(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("odd", F.col("vec_id") % 2)
    asked = rows.where("vec_id = 7").first()["embedding"]
    node = (p.nearest_to("embedding", asked, 25) | p.compare("label", "=", 3)) & p.compare("odd", "=", 1)
    return p.searched(rows, node, p.Fields(), "vec_id").select("vec_id")


@query(
    "element_phrase",
    """
    WITH t AS (SELECT conv_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM conversations)
    SELECT DISTINCT conv_id FROM t WHERE contains(x, ' of the ')
    """,
)
def element_phrase(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    return turns.where(p.compiled(p.element_phrase("texts", "of the"))).select("conv_id")


@query(
    "element_gap_phrase",
    """
    SELECT p_partkey FROM part WHERE contains(' ' || p_name || ' ' || lower(p_type) || ' ', ' ring economy ')
    """,
)
def element_gap_phrase(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("texts", F.array("p_name", "p_type"))
    return rows.where(p.compiled(p.element_phrase("texts", "ring economy", gap=1))).select("p_partkey")


@query(
    "predicate_expressions",
    """
    SELECT c_custkey FROM customer
    WHERE CASE c_custkey % 3 WHEN 0 THEN 32 BETWEEN c_nationkey AND 40 AND 'sports' <> 'sports' OR c_nationkey <= 10
                             WHEN 1 THEN NOT (c_nationkey >= 12) OR c_mktsegment = 'BUILDING' ELSE false END
    """,
)
def predicate_expressions(spark, sf_dir):
    """Stored expressions with alternatives, negation and parentheses against ``age 32, hobby sports, nation 0, segment BUILDING``."""
    nation = F.col("c_nationkey").cast("string")
    first = F.concat(F.lit("age in ["), nation, F.lit("..40] and hobby not in ['sports', 'music'] or nation in [.."), (10 - F.col("c_nationkey")).cast("string"), F.lit("]"))
    second = F.concat(F.lit("not (nation in [.."), (F.col("c_nationkey") - 12).cast("string"), F.lit("]) or (segment in ['"), F.col("c_mktsegment"), F.lit("'])"))
    stored = F.when(F.col("c_custkey") % 3 == 0, first).when(F.col("c_custkey") % 3 == 1, second)
    rows = p.with_expressions(table(spark, sf_dir, "customer").withColumn("target", stored), "target", "parsed")
    return rows.where(p.compiled(p.stored_expression("parsed", {"age": 32, "hobby": "sports", "nation": 0, "segment": "BUILDING"}))).select("c_custkey")


@query("weak_and_top", _BM25 + "SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS place FROM m) WHERE place <= 20")
def weak_and_top(spark, sf_dir):
    return ps.best_in_documents(_held(spark, sf_dir), 20).select("query_id", "id")
