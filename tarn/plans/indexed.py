"""Queries over the written inverted index: weakAnd by blocks, phrases and proximity from positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.operators import inverted as iv
from tarn.plans.registry import query, scratch, spread, table

_POSITIONS = """
    w AS (SELECT {id} AS id, {extra} ws[i] AS term, CAST(i - 1 AS INTEGER) AS pos, len(ws) AS len
          FROM (SELECT {id}, {extra} list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM {table}), unnest(range(1, len(ws) + 1)) AS u(i))
"""


def _index(spark, docs, id_col, fields, gaps=None):
    path = scratch(spark, "inverted")
    iv.write_inverted(docs, id_col, fields, path, gaps)
    return iv.Inverted(spark, path)


def _documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _index(spark, docs, "doc_id", {"text": tx.word_tokens(F.col("text"))})


def _phrases(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    return iv.query_words(rows, "q", tx.word_tokens(F.col("text")))


@query(
    "weak_and_blocks",
    f"""
    WITH {_POSITIONS.format(id="doc_id", extra="", table="documents")},
         l AS (SELECT doc_id AS id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS len FROM documents), s AS (SELECT count(*) AS n, avg(len) AS av FROM l),
         p AS (SELECT id, term, len, count(*) AS tf FROM w GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
         q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1:4]) AS term FROM benchmark),
         m AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY 1, 2)
    SELECT query_id, id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM m) WHERE place <= 10
    """,
)
def weak_and_blocks(spark, sf_dir):
    """ten documents for the first four words of each test item."""
    docs, path = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), scratch(spark, "impacts")
    iv.write_impacts(docs, "doc_id", "text", tx.word_tokens(F.col("text")), path)
    index = iv.Impacts(spark, path)
    first = F.slice(tx.word_tokens(F.col("text")), 1, 4)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(first).alias("term"))
    return iv.weak_and_blocks(index, queries, "text", 10, scratch(spark, "weak-and")).hits.select("query_id", "id", "score", "place")


_PHRASES = ("of the", "the thing", "in the and", "thing")


@query(
    "phrase_postings",
    f"""
    WITH {_POSITIONS.format(id="doc_id", extra="", table="documents")},
         q AS (SELECT * FROM (VALUES (0, 0, 'of'), (0, 1, 'the'), (1, 0, 'the'), (1, 1, 'thing'), (2, 0, 'in'), (2, 1, 'the'), (2, 2, 'and'), (3, 0, 'thing')) AS v(query_id, place, term)),
         f AS (SELECT query_id, id, pos - place AS start FROM w JOIN q USING (term) GROUP BY 1, 2, 3, query_id HAVING count(*) = (SELECT count(*) FROM q z WHERE z.query_id = q.query_id))
    SELECT query_id, id, CAST(count(*) AS INTEGER) AS n, CAST(min(start) AS INTEGER) AS first FROM f GROUP BY 1, 2
    """,
)
def phrase_postings(spark, sf_dir):
    """four phrases at once, with the number of their places in each document."""
    found = iv.phrases(_documents(spark, sf_dir), _phrases(spark, *_PHRASES), "text")
    return found.select("query_id", "id", F.size("starts").alias("n"), F.element_at("starts", 1).alias("first"))


@query(
    "element_phrase_postings",
    f"""
    WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS e, text FROM conversations),
         {_POSITIONS.format(id="conv_id", extra="e,", table="t")},
         f AS (SELECT a.id FROM w a JOIN w b ON a.id = b.id AND a.e = b.e AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'),
         n AS (SELECT a.id FROM w a JOIN w b ON a.id = b.id AND (a.e = b.e AND b.pos = a.pos + 1 OR b.e = a.e + 1 AND a.pos = a.len - 1 AND b.pos = 0) WHERE a.term = 'of' AND b.term = 'the')
    SELECT id, count(*) FILTER (within) AS n_within, count(*) FILTER (NOT within) AS n_across FROM (SELECT id, true AS within FROM f UNION ALL SELECT id, false FROM n) GROUP BY 1
    """,
)
def element_phrase_postings(spark, sf_dir):
    """a phrase in the turns of a conversation, once within a turn and once with turns that go on in the next."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    tokens = F.transform("t", lambda t: tx.word_tokens(t["text"]))
    index = _index(spark, turns, "conv_id", {"apart": tokens, "joined": tokens}, {"apart": iv.APART, "joined": 1})
    words = _phrases(spark, "of the")
    counted = lambda field, name: iv.phrases(index, words, field).select("id", F.size("starts").cast("long").alias(name))
    return counted("apart", "n_within").join(counted("joined", "n_across"), "id", "full").na.fill(0, ["n_within", "n_across"])


@query(
    "proximity_features",
    f"""
    WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {_POSITIONS.format(id="id", extra="", table="t")},
         q AS (SELECT * FROM (VALUES (0, 'thing'), (1, 'the'), (2, 'of')) AS v(place, term)), m AS (SELECT id, place, pos, len FROM w JOIN q USING (term)),
         h AS (SELECT id, count(DISTINCT place) AS k, min(pos) AS first, max(len) AS len FROM m GROUP BY 1),
         o AS (SELECT m.*, max(pos) FILTER (place = 0) OVER z AS a, max(pos) FILTER (place = 1) OVER z AS b, max(pos) FILTER (place = 2) OVER z AS c FROM m WINDOW z AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
         v AS (SELECT id, min(pos - least(a, b, c) + 1) AS window_ FROM o JOIN h USING (id) WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = k GROUP BY 1),
         r AS (SELECT x.id, count(DISTINCT x.place) AS n FROM m x JOIN m y ON x.id = y.id AND y.place = x.place + 1 AND y.pos = x.pos + 1 GROUP BY 1)
    SELECT h.id, CAST(k AS INTEGER) AS matched, CAST(window_ AS INTEGER) AS smallest_window, round(k / window_, 6) AS proximity, round(coalesce(n, 0) / 2, 6) AS orderness, round(1 - first / h.len, 6) AS earliness
    FROM h JOIN v USING (id) LEFT JOIN r USING (id)
    """,
)
def proximity_features(spark, sf_dir):
    """B3, B4 over every turn of every conversation."""
    turns = spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    index = _index(spark, turns, "id", {"text": tx.word_tokens(F.col("text"))})
    near = iv.proximity(index, _phrases(spark, "thing the of"), "text")
    return near.select("id", "matched", "smallest_window", *[F.round(c, 6).alias(c) for c in ("proximity", "orderness", "earliness")])
