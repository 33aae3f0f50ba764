"""Token analysis, term statistics and text relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.operators import grouping as g
from tarn.operators import postings as ps
from tarn.plans.registry import query, scratch, spread, table
from tarn.sources.scan import portioned

_WORDS = "SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> ''"


#: Letters to digits, after a first letter, without H and W; runs of a digit count once, vowels part them.
_SOUNDEX = "translate(regexp_replace(upper({w}), '[HW]', '', 'g'), 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556')"
for _d in "0123456":
    _SOUNDEX = f"regexp_replace({_SOUNDEX}, '{_d}+', '{_d}', 'g')"
_SOUNDEX = f"rpad(substr(upper({{w}}), 1, 1) || substr(replace(substr({_SOUNDEX}, 2), '0', ''), 1, 3), 4, '0')"


@query("soundex_tokens", f"SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_SOUNDEX.format(w='w')}), ' ') AS codes FROM part")
def soundex_tokens(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", tx.phonetic(tx.word_tokens(F.col("p_name"))).alias("codes"))
    return parts.select("p_partkey", F.array_join("codes", " ").alias("codes"))


@query("prefix_tokens", "SELECT p_partkey, p_type[1:i] AS prefix FROM part, unnest(range(1, 30)) AS t(i) WHERE i <= length(p_type)")
def prefix_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.all_prefixes(F.col("p_type"))).alias("prefix"))


@query("suffix_phrases", "SELECT p_partkey, array_to_string(string_split(p_name, ' ')[i:], ' ') AS phrase FROM part, unnest(range(1, 10)) AS t(i) WHERE i <= len(string_split(p_name, ' '))")
def suffix_phrases(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.suffix_phrases(F.col("p_name"))).alias("phrase"))


@query("path_levels", "SELECT s_suppkey, CASE i WHEN 1 THEN r_name ELSE r_name || '|' || n_name END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, unnest([1, 2]) AS t(i)")
def path_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", F.explode(tx.path_levels(F.array("r_name", "n_name"))).alias("path"))


@query(
    "term_ngram_counts",
    f"""
    WITH w AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
                 SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS ws FROM documents)) WHERE w <> ''),
         t AS (SELECT doc_id, w AS term FROM w WHERE w NOT IN ('the', 'of')
               UNION ALL SELECT a.doc_id, a.w || ' ' || b.w FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.w NOT IN ('the', 'of') AND b.w NOT IN ('the', 'of'))
    SELECT term, count(*) AS corpus_count, count(DISTINCT doc_id) AS document_count FROM t GROUP BY 1
    """,
)
def term_ngram_counts(spark, sf_dir):
    docs = portioned(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return g.term_counts(docs, tx.token_windows(tx.word_tokens(F.col("text")), 2, ("the", "of")))


_BM25 = """
    WITH p AS (SELECT doc_id, w AS term, count(*) AS tf FROM ({words}) GROUP BY 1, 2),
         l AS (SELECT d.doc_id, count(w) AS len FROM documents d LEFT JOIN ({words}) x ON d.doc_id = x.doc_id GROUP BY 1),
         s AS (SELECT count(*) AS n, avg(len) AS av FROM l),
         q AS (SELECT DISTINCT item_id, w AS term FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark) WHERE w <> ''),
         df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
         m AS (SELECT q.item_id AS query_id, p.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score
               FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON p.doc_id = l.doc_id, s GROUP BY 1, 2)
""".format(words=_WORDS)


def _held(spark, sf_dir):
    """Documents as the terms in use and statistics of all documents, from one pass over the texts that is written once."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.word_tokens(F.col("text"))).alias("term"))
    return ps.held_terms(docs, "doc_id", tx.word_tokens(F.col("text")), queries, scratch(spark, "postings"))


@query("bm25_topk", _BM25 + "SELECT query_id, id, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INTEGER) AS place FROM m) WHERE place <= 10")
def bm25_topk(spark, sf_dir):
    return ps.best_in_documents(_held(spark, sf_dir), 10).select("query_id", "id", "score", "place")


@query(
    "bm25f_topk",
    """
    WITH f AS (SELECT p_partkey AS id, 'name' AS field, string_split(p_name, ' ') AS ws FROM part UNION ALL SELECT p_partkey, 'kind', string_split(lower(p_type), ' ') FROM part),
         l AS (SELECT id, field, len(ws) AS len FROM f), s AS (SELECT field, count(*) AS n, avg(len) AS av FROM l GROUP BY 1),
         p AS (SELECT id, field, w AS term, count(*) AS tf FROM (SELECT id, field, unnest(ws) AS w FROM f) GROUP BY 1, 2, 3),
         df AS (SELECT term, sum(df) AS df FROM (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2) GROUP BY 1),
         q AS (SELECT unnest(['red', 'widget', 'economy']) AS term),
         t AS (SELECT p.id, term, sum(CASE field WHEN 'name' THEN 2.0 ELSE 1.0 END * tf / (0.25 + 0.75 * len / av)) AS wtf, max(n) AS n FROM p JOIN q USING (term) JOIN l USING (id, field) JOIN s USING (field) GROUP BY 1, 2)
    SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf / (1.2 + wtf)), 6) AS score FROM t JOIN df USING (term) GROUP BY 1
    """,
)
def bm25f_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", tx.word_tokens(F.col("p_name")).alias("name"), tx.word_tokens(F.col("p_type")).alias("kind"))
    fields = {"name": F.col("name"), "kind": F.col("kind")}
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, ("red", "widget", "economy")))).alias("term"))
    scored = ps.bm25f(ps.postings(docs, "p_partkey", fields), ps.field_statistics(docs, fields), queries, {"name": 2.0, "kind": 1.0})
    return scored.select("id", F.round("score", 6).alias("score"))


_BAYES = (
    _BM25
    + """
    , z AS (SELECT item_id AS query_id, count(*) AS nq FROM q GROUP BY 1), t AS (SELECT item_id AS query_id, doc_id AS id, sum(tf) AS tf FROM p JOIN q USING (term) GROUP BY 1, 2),
      x AS (SELECT query_id, id, score - 3 AS e, 0.2 + 0.7 * least(1.0, tf / nq / 10) AS a, 0.3 + 0.6 * (1 - least(1.0, abs(len / av - 0.5) * 2)) AS b FROM m JOIN t USING (query_id, id) JOIN z USING (query_id) JOIN l ON l.doc_id = m.id, s),
      y AS (SELECT *, 1 / (1 + exp(-e)) AS lk, greatest(0.1, least(0.9, 0.7 * a + 0.3 * b)) AS pr FROM x)
    """
)


def _bayes(spark, sf_dir, *names):
    held = _held(spark, sf_dir)
    sizes = F.broadcast(spark.createDataFrame(list(held.n_terms.items()), f"query_id {dict(held.queries.dtypes)['query_id']}, n int"))
    rows = ps.bm25_in_documents(held).join(sizes, "query_id")
    scores = ps.bayesian_scores(F.col("score"), F.col("tf") / F.col("n"), F.col("length") / F.lit(held.average_length))
    return rows.select("query_id", "id", *[F.round(scores[n], 6).alias(n) for n in names])


@query("bayesian_bm25", _BAYES + "SELECT query_id, id, round(lk, 6) AS likelihood, round(lk * pr / (lk * pr + (1 - lk) * (1 - pr)), 6) AS posterior FROM y")
def bayesian_bm25(spark, sf_dir):
    return _bayes(spark, sf_dir, "likelihood", "posterior")


@query("bayesian_logodds", _BAYES + "SELECT query_id, id, round(1 / (1 + exp(-(e + ln(a / (1 - a)) + ln(b / (1 - b))))), 6) AS log_odds, round(1 / (1 + exp(-(e + ln(a / (1 - a)) + ln(b / (1 - b)) + ln(0.05 / 0.95)))), 6) AS log_odds_calibrated FROM y")
def bayesian_logodds(spark, sf_dir):
    return _bayes(spark, sf_dir, "log_odds", "log_odds_calibrated")


@query(
    "match_features",
    """
    WITH q AS (SELECT unnest(['red', 'ring', 'small']) AS term), p AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS term, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)
    SELECT id, count(DISTINCT term) AS match_count, CAST(min(pos) AS INTEGER) AS first_position, round(count(DISTINCT term) / 3.0, 6) AS query_completeness FROM p JOIN q USING (term) GROUP BY 1
    """,
)
def match_features(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", tx.word_tokens(F.col("p_name")).alias("name"))
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, ("red", "ring", "small")))).alias("term"))
    found = ps.match_features(ps.postings(docs, "p_partkey", {"name": F.col("name")}), queries)
    return found.select("id", "match_count", "first_position", F.round("query_completeness", 6).alias("query_completeness"))


@query("html_sections")
def html_sections(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(tx.html_sections(F.col("html"))).alias("place", "s")).select("page_id", "place", "s.title", "s.body")


@query("text_chunks", "SELECT doc_id, CAST(i AS INTEGER) AS chunk, text[i * 1024 + 1:(i + 1) * 1024] AS body FROM documents, unnest(range(0, 100)) AS t(i) WHERE i < ceil(length(text) / 1024.0)")
def text_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.fixed_chunks(F.col("text"), 1024)).alias("chunk", "body"))


@query(
    "element_bm25",
    """
    WITH e AS (SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS element, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM conversations),
         s AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM e), p AS (SELECT id, element, len, w AS term, count(*) AS tf FROM (SELECT id, element, len(ws) AS len, unnest(ws) AS w FROM e) GROUP BY 1, 2, 3, 4),
         q AS (SELECT unnest(['the', 'erth', 'thing']) AS term), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    SELECT id, element, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score FROM p JOIN q USING (term) JOIN df USING (term), s GROUP BY 1, 2
    """,
)
def element_bm25(spark, sf_dir):
    turns = g.struct_list(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "turns")
    docs = turns.select("conv_id", F.transform("turns", lambda t: t["text"]).alias("texts"))
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, ("the", "erth", "thing")))).alias("term"))
    return ps.element_scores(docs, "conv_id", "texts", tx.word_tokens, queries).select("id", F.col("element").cast("int").alias("element"), F.round("score", 6).alias("score"))
