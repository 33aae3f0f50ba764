"""Filters, predicates, sorting, paging and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import scalar as sc
from tarn.functions import text as tx
from tarn.operators import fuzzy
from tarn.operators import predicates as p
from tarn.operators import stored as st
from tarn.operators import vector as v
from tarn.plans.registry import query, scratch, table
from tarn.sources.feeds import page

_TEXT = p.Fields(text={"text": tx.word_tokens, "p_name": tx.word_tokens}, sets={"default": ("p_name", "p_type")})
_TOKENS = "string_split_regex(lower({}), '[^a-z0-9]+')"


def _part(spark, sf_dir, node, *columns):
    return table(spark, sf_dir, "part").where(p.compiled(node, _TEXT)).select("p_partkey", *columns)


@query("hit_range_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F' AND o_custkey <> 7")
def hit_range_filters(spark, sf_dir):
    node = p.between("o_totalprice", 100000.0, 200000.0) & p.compare("o_orderstatus", "=", "F") & p.compare("o_custkey", "!=", 7)
    return table(spark, sf_dir, "orders").where(p.compiled(node)).select("o_orderkey", "o_totalprice")


@query("json_form_filter", "SELECT p_partkey FROM part WHERE (p_type = 'ECONOMY' OR p_size >= 40) AND NOT p_brand = 'Brand#2'")
def json_form_filter(spark, sf_dir):
    tree = {"and": [{"or": [{"equals": ["p_type", "ECONOMY"]}, {"range": ["p_size", {">=": 40}]}]}, {"not": {"equals": ["p_brand", "Brand#2"]}}]}
    return _part(spark, sf_dir, p.from_json_form(tree))


@query("term_search", f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS.format('text')}, 'thing') OR list_contains({_TOKENS.format('text')}, 'onin')")
def term_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(p.compiled(p.term("text", "Thing") | p.term("text", "onin"), _TEXT)).select("doc_id")


@query("weak_and_search", f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS.format('text')}, ['thing', 'onin', 'erer'])")
def weak_and_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(p.compiled(p.weak_and("text", "thing onin, erer"), _TEXT)).select("doc_id")


@query("phrase_search", "SELECT doc_id FROM documents WHERE ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' LIKE '% of the %'")
def phrase_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(p.compiled(p.phrase("text", "of the"), _TEXT)).select("doc_id")


@query("prefix_search", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'ECO') AND regexp_matches(lower(p_name), '(^|[^a-z0-9])wid')")
def prefix_search(spark, sf_dir):
    return _part(spark, sf_dir, p.prefix("p_type", "ECO") & p.prefix("p_name", "wid"), "p_name")


@query("regex_search", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#1[0-4]$')")
def regex_search(spark, sf_dir):
    return _part(spark, sf_dir, p.regex("p_brand", "#1[0-4]$"))


@query("fuzzy_search", f"SELECT p_partkey, p_name FROM part WHERE len(list_filter({_TOKENS.format('p_name')}, lambda t: starts_with(t, 'wi') AND levenshtein(t, 'wigdet') <= 1)) > 0 OR list_contains({_TOKENS.format('p_name')}, 'red')")
def fuzzy_search(spark, sf_dir):
    return _part(spark, sf_dir, p.fuzzy("p_name", "wigdet") | p.fuzzy("p_name", "red"), "p_name")


@query(
    "fuzzy_words",
    """
    WITH v AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> ''),
         b AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark) WHERE w <> ''),
         q AS (SELECT w AS word FROM b UNION SELECT w[1:3] || w[5:] FROM b UNION SELECT w[1:4] || 'q' || w[5:] || 'z' FROM b),
         n AS (SELECT word, term, CASE WHEN word = term THEN 0 ELSE levenshtein(word, term) END AS distance, length(word) AS n FROM q JOIN v ON word[1:2] = term[1:2] AND abs(length(word) - length(term)) <= 2)
    SELECT word, term, CAST(distance AS INTEGER) AS distance FROM n WHERE distance <= CASE WHEN n <= 3 THEN 0 WHEN n <= 6 THEN 1 ELSE 2 END
    """,
)
def fuzzy_words(spark, sf_dir):
    """the words of all test items, right and misspelt, against the vocabulary of all documents."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(tx.word_tokens(F.col("text"))).alias("w")).distinct()
    b, w = words("benchmark"), F.col("w")
    wrong = F.array(w, F.concat(F.substring(w, 1, 3), F.expr("substring(w, 5)")), F.concat(F.substring(w, 1, 4), F.lit("q"), F.expr("substring(w, 5)"), F.lit("z")))
    return fuzzy.fuzzy_terms(fuzzy.deletion_index(words("documents"), "w"), b.select(F.explode(wrong).alias("word")), "word")


@query("gram_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'idg') AND contains(lower(p_name), 'dge')")
def gram_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(p.compiled(p.grams("p_name", "idge", 3))).select("p_partkey", "p_name")


@query("set_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') AND p_size IN (1, 2, 3)")
def set_filter(spark, sf_dir):
    return _part(spark, sf_dir, p.one_of("p_brand", ["Brand#1", "Brand#3"]) & p.one_of("p_size", [1, 2, 3]))


@query("equiv_search", f"SELECT p_partkey FROM part WHERE list_has_any({_TOKENS.format('p_name')}, ['ring', 'widget'])")
def equiv_search(spark, sf_dir):
    q = p.rewritten(p.term("p_name", "ring"), p.expand_synonyms({"ring": ["widget"]}))
    return _part(spark, sf_dir, q)


@query("query_rewrite", "SELECT p_partkey FROM part WHERE (p_name LIKE '%ring%' OR p_type = 'PROMO') AND p_size < 20")
def query_rewrite(spark, sf_dir):
    q = p.rewritten(p.term("p_name", "ring"), p.inject_term(["ring"], p.compare("p_type", "=", "PROMO")), p.inject_filter(p.compare("p_size", "<", 20)))
    return _part(spark, sf_dir, q)


@query("fieldset_search", "SELECT p_partkey FROM part WHERE contains(' ' || p_name || ' ', ' red ') OR p_type = 'red'")
def fieldset_search(spark, sf_dir):
    return _part(spark, sf_dir, p.term("default", "red"))


@query("stored_predicate", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND 3000 BETWEEN c_acctbal AND c_acctbal + 2000")
def stored_predicate(spark, sf_dir):
    clause = "named_struct('attribute', {}, 'values', {}, 'low', {}, 'high', {})"
    segment = clause.format("'segment'", "array(c_mktsegment)", "cast(null as double)", "cast(null as double)")
    income = clause.format("'income'", "cast(null as array<string>)", "c_acctbal", "c_acctbal + 2000")
    rows = table(spark, sf_dir, "customer").withColumn("target", F.expr(f"array({segment}, {income})"))
    return rows.where(p.compiled(p.stored_predicate("target", {"segment": ["BUILDING", "MACHINERY"], "income": 3000}))).select("c_custkey")


@query(
    "predicate_index",
    """
    SELECT c_custkey, s_suppkey FROM customer, supplier
    WHERE CASE s_suppkey % 4
            WHEN 0 THEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = s_nationkey AND c_acctbal BETWEEN floor(s_acctbal) AND floor(s_acctbal) + 2000
            WHEN 1 THEN c_acctbal <= -900 AND NOT (c_mktsegment = 'AUTOMOBILE') OR c_nationkey = s_nationkey AND c_acctbal >= 9000
            WHEN 2 THEN c_nationkey BETWEEN s_nationkey AND s_nationkey + 1 AND c_acctbal BETWEEN floor(s_acctbal) AND floor(s_acctbal) + 300
            ELSE NOT (c_acctbal >= -950) AND NOT (c_mktsegment IN ('BUILDING', 'FURNITURE')) END
    """,
)
def predicate_index(spark, sf_dir):
    """every customer as a request against the stored expression of every supplier."""
    nation, low = F.col("s_nationkey").cast("string"), F.floor("s_acctbal")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    kind = F.col("s_suppkey") % 4
    own = (
        F.when(kind == 0, text("segment in ['BUILDING', 'MACHINERY'] and nation in ['", nation, "'] and balance in [", low, "..", low + 2000, "]"))
        .when(kind == 1, text("balance in [..-900] and segment not in ['AUTOMOBILE'] or nation in ['", nation, "'] and balance in [9000..]"))
        .when(kind == 2, text("nations in [", nation, "..", F.col("s_nationkey") + 1, "] and balance in [", low, "..", low + 300, "]"))
        .otherwise(F.lit("not (balance in [-950..] or segment in ['BUILDING', 'FURNITURE'])"))
    )
    stored = p.with_expressions(table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("target")), "target", "parsed")
    one = lambda c: F.array(c)
    texts = F.create_map(F.lit("segment"), one(F.col("c_mktsegment")), F.lit("nation"), one(F.col("c_nationkey").cast("string")))
    numbers = F.create_map(F.lit("balance"), one(F.col("c_acctbal").cast("double")), F.lit("nations"), one(F.col("c_nationkey").cast("double")))
    met = st.matches(stored, "s_suppkey", "parsed", table(spark, sf_dir, "customer"), "c_custkey", texts, numbers, path=scratch(spark, "classes"))
    return met.select(F.col("request_id").alias("c_custkey"), F.col("id").alias("s_suppkey"))


@query(
    "wand_sparse_dot",
    "SELECT o_custkey, CAST(sum(CASE l_partkey WHEN 1 THEN 2 WHEN 5 THEN 1 ELSE 3 END) AS DOUBLE) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IN (1, 5, 9) GROUP BY 1 ORDER BY score DESC, o_custkey LIMIT 25",
)
def wand_sparse_dot(spark, sf_dir):
    from tarn.operators.grouping import count_map

    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("l_partkey").isin(1, 5, 9))
    return v.weighted_and(count_map(lines, "o_custkey", "l_partkey"), "o_custkey", "counts", {1: 2.0, 5: 1.0, 9: 3.0}, 25)


@query("order_by_attribute_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def order_by_attribute_page(spark, sf_dir):
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 10)


@query("freshness_score", "SELECT event_id, round(greatest(0, 1 - (1704153600 - floor(epoch(ts))) / 43200.0), 6) AS freshness FROM events WHERE epoch(ts) <= 1704153600")
def freshness_score(spark, sf_dir):
    seconds = sc.epoch_seconds(F.col("ts"))
    rows = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return rows.select("event_id", F.round(sc.freshness(seconds, 1704153600, 43200.0), 6).alias("freshness"))


@query(
    "score_normalisers",
    "SELECT event_id, round(value / (value + 11), 6) AS saturated, round(2 * atan(value / 8) / pi(), 6) AS arc, round(CASE WHEN value > 0 THEN ln(value) ELSE 0 END, 6) AS logged, round(1 / (1 + exp(-value)), 6) AS sig FROM events",
)
def score_normalisers(spark, sf_dir):
    x = F.col("value")
    cols = {"saturated": sc.saturated(x), "arc": sc.arctan_normalised(x), "logged": sc.safe_log(x), "sig": sc.sigmoid(x)}
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("score_drop_limit", "SELECT p_partkey, round(CASE WHEN p_size BETWEEN 10 AND 20 THEN p_retailprice / 1000 ELSE -200 END, 6) AS relevance FROM part WHERE p_size BETWEEN 10 AND 20")
def score_drop_limit(spark, sf_dir):
    from tarn.operators.ranking import Profile, ranked

    prof = Profile("windowed", first=lambda s: F.when(F.col("p_size").between(s.q("low"), s.q("high")), F.col("p_retailprice") / 1000).otherwise(-200.0), inputs={"low": 10, "high": 20}, drop_below=-100.0)
    return ranked(table(spark, sf_dir, "part"), prof, "p_partkey").select("p_partkey", F.round("relevance", 6).alias("relevance"))


@query("blocklist_filter", f"SELECT doc_id FROM documents WHERE NOT list_has_any({_TOKENS.format('text')}, ['license', 'token'])")
def blocklist_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(p.allowed_tokens(tx.word_tokens(F.col("text")), ["license", "token"])).select("doc_id")


@query("clean_text", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS clean FROM documents WHERE NOT contains(text, chr(26))")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(p.clean_text(F.col("text"))).select("doc_id", F.trim(tx.collapsed(F.col("text"))).alias("clean"))


@query("projection_defaults", "SELECT p_partkey AS id, coalesce(p_name, '-') AS title, 'passage: ' || p_name AS passage, CAST(least(127, trunc(p_retailprice / 10)) AS INTEGER) AS price_byte FROM part")
def projection_defaults(spark, sf_dir):
    from tarn.operators.schema import with_default

    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), with_default(F.col("p_name")).alias("title"), F.concat(F.lit("passage: "), "p_name").alias("passage"), sc.scaled_byte(F.col("p_retailprice") / 1000).alias("price_byte")
    )


@query(
    "popularity_sorted",
    """
    WITH c AS (SELECT event_id % 10 AS size, count(*) AS shown, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks FROM events GROUP BY 1)
    SELECT p_partkey, round(-p_retailprice + 100 * clicks / shown, 6) AS relevance FROM part JOIN c ON p_size % 10 = c.size
    """,
)
def popularity_sorted(spark, sf_dir):
    from tarn.operators import ranking as r
    from tarn.operators.grouping import click_rates

    rates = click_rates(table(spark, sf_dir, "events").withColumn("size", F.col("event_id") % 10), "size", F.col("event_type") == "click")
    rows = table(spark, sf_dir, "part").withColumn("size", F.col("p_size") % 10).join(rates, "size")
    prof = r.Profile("popular", first=lambda s: r.popularity_blend(r.sorting_score(F.col("p_retailprice"), True), F.col("clicks"), F.col("impressions")))
    return r.ranked(rows, prof, "p_partkey").select("p_partkey", F.round("relevance", 6).alias("relevance"))
