import pytest
from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.operators import grouping, joins, metrics, predicates, ranking, updates, vector
from tarn.operators.schema import DocumentType, elements_by_labels, routed_scan


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# ---- intervals ----------------------------------------------------------------------------------------------------

#: Own values: touching, contained, equal, repeated, empty and null intervals of three keys.
LEFT = [("p", 1, 9), ("p", 9, 9), ("q", 0, 40), ("q", 41, 60), ("q", 60, 75), ("q", 80, 70), ("r", 5, None), ("s", 3, 4)]
RIGHT = [("p", 9, 20), ("p", 2, 3), ("p", 2, 3), ("q", 40, 41), ("q", 10, 12), ("q", 75, 90), ("q", 61, 59), ("r", 1, 9), ("t", 3, 4)]
_DDL = "k string, start long, end long"


def brute_pairs(left, right):
    whole = lambda s, e: s is not None and e is not None and s <= e
    return sorted((k, a, b, c, d) for k, a, b in left for m, c, d in right if k == m and whole(a, b) and whole(c, d) and max(a, c) <= min(b, d))


@pytest.mark.parametrize("unit", [None, 1, 7, 1000])
def test_interval_join(spark, unit):
    got = joins.interval_join(spark.createDataFrame(LEFT, _DDL), spark.createDataFrame(RIGHT, _DDL), ["k"], unit=unit)
    assert rows(got, "k", "a_start", "a_end", "b_start", "b_end") == brute_pairs(LEFT, RIGHT)
    assert all(r.start == max(r.a_start, r.b_start) and r.end == min(r.a_end, r.b_end) for r in got.collect())
    assert len(brute_pairs(LEFT, RIGHT)) == 8


def test_interval_semi_join(spark):
    got = joins.interval_semi_join(spark.createDataFrame(RIGHT, _DDL), spark.createDataFrame(LEFT, _DDL), ["k"])
    met = {(k, c, d) for k, _, _, c, d in brute_pairs(LEFT, RIGHT)}
    assert rows(got) == sorted(x for x in RIGHT if x in met)


# ---- stored predicates --------------------------------------------------------------------------------------------

#: Own values.
READERS = [
    ("ada", "level in ['gold'] and visits in [10..90] and spend in [500..]"),
    ("ben", "level in ['gold'] and visits in [5..40] and club in ['chess']"),
    ("cleo", "level in ['gold', 'silver'] and visits in [1..60]"),
]


def test_stored_predicates(spark):
    readers = predicates.with_clauses(spark.createDataFrame(READERS, "name string, target string"), "target", "clauses")
    match = lambda **a: [r.name for r in readers.where(predicates.compiled(predicates.stored_predicate("clauses", a))).orderBy("name").collect()]
    assert match(level="gold", visits=32, spend=3000) == ["ada", "cleo"]
    assert match(level="gold", visits=32, club="chess", spend=100) == ["ben", "cleo"]
    assert match(visits=32) == [] and match(level=["bronze", "silver"], visits=60) == ["cleo"]
    with pytest.raises(ValueError):
        predicates.parse_predicate("visits ~ 3")


def test_stored_expressions(spark):
    stored = [
        ("a", "level in ['gold'] or visits in [50..]"), ("b", "not (level in ['gold'] or visits in [..9])"), ("c", "level not in ['gold', 'silver'] and (visits in [1..5] or club in ['chess'])"),
        ("d", ""), ("e", None), ("f", "not not level in ['gold']"),
    ]
    readers = predicates.with_expressions(spark.createDataFrame(stored, "name string, target string"), "target", "parsed")
    match = lambda **a: [r.name for r in readers.where(predicates.compiled(predicates.stored_expression("parsed", a))).orderBy("name").collect()]
    assert match(level="gold", visits=3) == ["a", "d", "f"] and match(level="iron", visits=60) == ["a", "b", "d"]
    assert match(level="iron", visits=3) == ["c", "d"] and match(level="iron", visits=20, club="chess") == ["b", "c", "d"]
    for broken in ("level in ['x'] and", "(level in ['x']", "level ['x']", "level in ['x'] )"):
        with pytest.raises(ValueError):
            predicates.parse_expression(broken)


def test_element_phrases_and_missing_fields(spark):
    docs = spark.createDataFrame([(1, ["learning to", "rank well"], "x"), (2, ["to rank"], None), (3, None, None)], "id int, texts array<string>, kind string")
    ids = lambda n: [r.id for r in docs.where(predicates.compiled(n)).orderBy("id").collect()]
    p = predicates
    assert ids(p.element_phrase("texts", "to rank")) == [2] and ids(p.element_phrase("texts", "to rank", gap=1)) == [1, 2]
    assert ids(p.element_phrase("texts", "!!")) == [] and ids(~p.element_phrase("texts", "to rank")) == [1, 3]
    assert ids(~p.compare("kind", "=", "x")) == [2, 3] and ids(~p.compare("kind", "!=", "x")) == [1, 2, 3]
    assert [r.ok for r in docs.select(p.allowed_tokens(F.col("texts"), ["rank well"]).alias("ok")).collect()] == [False, True, True]


def test_nearest_in_a_tree_and_unranked_parts(spark):
    docs = spark.createDataFrame([(k, [float(k), 0.0], f"word{k % 3}") for k in range(20)], "id int, v array<double>, t string")
    p, fields = predicates, predicates.Fields(text={"t": tx.word_tokens})
    node = p.nearest_to("v", [0.0, 0.0], 3) | (p.term("t", "word1") & p.compare("id", ">", 15))
    got = p.searched(docs, node, fields, "id")
    assert got.columns == docs.columns and sorted(r.id for r in got.collect()) == [0, 1, 2, 16, 19]
    assert sorted(r.id for r in p.searched(docs, ~p.nearest_to("v", [0.0, 0.0], 18), fields, "id").collect()) == [18, 19]
    with pytest.raises(ValueError):
        p.compiled(p.nearest_to("v", [0.0, 0.0], 3), fields)
    tree = (p.term("t", "word1") | p.term("t", "word2")) & p.term("t", "word1").unranked()
    assert len(p.ranking_terms(tree)) == 2 and p.ranking_terms((p.term("t", "a") & p.ALL).unranked()) == []


def test_models_are_told_apart(spark):
    rows_ = spark.createDataFrame([(1, 2.0, 1.0), (2, 4.0, 3.0)], "id int, a float, b float")
    for weights, bias in (([1.0, 0.0], 0.5), ([0.0, 10.0], 0.0)):
        got = {r.id: r.s for r in rows_.select("id", ranking.onnx_scorer(ranking.linear_onnx(weights, bias), ["a", "b"]).alias("s")).collect()}
        assert got == {i: pytest.approx(weights[0] * a + weights[1] * b + bias) for i, a, b in ((1, 2.0, 1.0), (2, 4.0, 3.0))}


def test_counts_of_reranked_hits_are_inherited(spark):
    hits = spark.range(50).withColumnRenamed("id", "doc")
    base = ranking.Profile("base", first=lambda s: F.col("doc"), second=lambda s: s.q("w") * F.col("doc"), rerank=7, inputs={"w": 1.0})
    child = ranking.Profile("child", parents=(base,), inputs={"w": -1.0})
    wider = ranking.Profile("wider", parents=(child,), rerank=9)
    count = lambda p: ranking.ranked(hits, p, "doc").where("phase = 2").count()
    assert (count(base), count(child), count(wider)) == (7, 7, 9)
    assert ranking.Profile("alone").resolved().rerank is None


def test_predicate_tree(spark):
    fields = predicates.Fields(text={"title": tx.word_tokens}, sets={"default": ("title", "author")})
    books = spark.createDataFrame([(1, "Ranking with XGBoost Models", "Tolkien", 1954, ["x"]), (2, "Learning to rank", "Doe", 2000, ["y", "z"])], "id int, title string, author string, year int, tags array<string>")
    fields.arrays = frozenset(["tags"])
    ids = lambda n: [r.id for r in books.where(predicates.compiled(n, fields)).orderBy("id").collect()]
    p = predicates
    assert ids(p.grams("title", "xgb")) == [1] and ids(p.grams("title", "x")) == []
    assert ids(p.phrase("title", "to rank")) == [2] and ids(p.phrase("title", "rank to")) == []
    assert ids(p.term("default", "Tolkien")) == [1] and ids(p.term("tags", "z")) == [2]
    assert ids(p.between("year", 1950, 1960)) == [1] and ids(p.between("year", low=1954)) == [1, 2] and ids(p.compare("year", "<", 1000)) == []
    assert ids(p.fuzzy("title", "lxarning")) == [] and ids(p.fuzzy("title", "learnin")) == [2]
    assert ids(p.one_of("tags", ["x", "q"])) == [1] and ids(~p.term("title", "rank")) == [1]
    assert ids(p.from_json_form({"or": [{"contains": ["title", "models"]}, {"range": ["year", {">": 1999}]}]})) == [1, 2]
    assert ids(p.suggestion_query("learnin qqq", "author", "title")) == [2] and ids(p.suggestion_query("Tol", "author", "tags")) == [1]
    assert ids(p.fuzzy("tags", "z")) == [2]


def test_rewrites():
    p = predicates
    q = p.conjunction(p.term("artist", "hetfield"), p.term("album", "master"))
    extra = p.term("album", "metal")
    assert p.rewritten(q, p.inject_term(["hetfield", "pantera"], extra)) == p.Node("or", args=(q, extra))
    assert p.rewritten(q, p.inject_term(["abba"], extra)) == q
    assert p.expand_synonyms({"master": ["lord"]})(q).args[1] == p.equivalent("album", ("master", "lord"))


# ---- grouping, ranking, vectors -----------------------------------------------------------------------------------


def test_buckets_and_nesting(spark):
    df = spark.createDataFrame([(5.0, "a", "x"), (10.0, "a", "y"), (-1.0, "b", "x")], "price double, k string, l string")
    assert rows(grouping.facet_buckets(df, F.col("price"), [0, 10, None], [F.count("*").alias("n")])) == [("[0,10)", 1), ("[10,inf)", 1)]
    nested = rows(grouping.nested_groups(df, ["k", "l"], [F.count("*").alias("n")]).fillna("-"), "k", "l", "n", "depth")
    assert nested == [("a", "-", 2, 1), ("a", "x", 1, 2), ("a", "y", 1, 2), ("b", "-", 1, 1), ("b", "x", 1, 2)]
    assert grouping.constant_columns(df.withColumn("c", F.lit(1)).withColumn("n", F.lit(None).cast("int"))) == ["c", "n"]


def test_phases_keep_the_tail_below(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, s double")
    base = ranking.Profile("base", first=lambda s: F.col("s") * s.f("w"), functions={"w": lambda s: s.q("weight")}, inputs={"weight": 1.0})
    child = ranking.Profile("child", parents=(base,), second=lambda s: -F.col("first_phase"), rerank=2, functions={"w": lambda s: F.lit(10.0)})
    got = [(r.id, r.phase, r.relevance) for r in ranking.ranked(df, child, "id").collect()]
    assert got[:3] == [(4, 2, -40.0), (5, 2, -50.0), (3, 1, 30.0)]
    everything = ranking.ranked(df, ranking.Profile("all", parents=(child,), rerank=10), "id").select("id").collect()
    assert [r.id for r in everything] == [0, 1, 2, 3, 4, 5]
    dropped = ranking.ranked(df, ranking.Profile("d", first=lambda s: F.col("s"), drop_below=3.0), "id")
    assert [r.id for r in dropped.collect()] == [5, 4]


def test_tree_ensembles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    lgb = {"feature_names": ["x"], "tree_info": [{"tree_structure": {"split_feature": 0, "threshold": 1.0, "left_child": {"leaf_value": 1}, "right_child": {"leaf_value": 2}}}]}
    assert [r.y for r in df.select(ranking.tree_ensemble(ranking.lightgbm_trees(lgb)).alias("y")).collect()] == [1, 2, 1, 1]
    xgb = [{"nodeid": 0, "split": "x", "split_condition": 2.0, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": 5}, {"nodeid": 2, "leaf": 7}]}]
    assert [r.y for r in df.limit(2).select(ranking.tree_ensemble(ranking.xgboost_trees(xgb)).alias("y")).collect()] == [5, 7]


def test_all_centroids_equal_exact_search(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "id int, v array<double>")
    cents = df.where("id % 6 = 0").select(F.col("id").alias("centroid"), F.col("v").alias("centroid_vector"))
    lists = vector.closest_centroids(df, cents, "id", "v", "centroid", "centroid_vector", 7)
    queries = df.where("id = 3").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    got = rows(vector.centroid_search(df, lists, cents, queries, "id", "v", 5, 7, 0.0), "id")
    exact = rows(vector.nearest(df, "v", F.array(F.lit(3.0), F.lit(3.0)), "id", 5), "id")
    assert got == exact
    assert vector.pruned(lists, "id", 1.0).count() == 40
    in_parts = vector.closest_centroids(df, cents, "id", "v", "centroid", "centroid_vector", 3, at_once=2)
    assert rows(in_parts) == rows(vector.closest_centroids(df, cents, "id", "v", "centroid", "centroid_vector", 3))
    each = vector.nearest_each(df, queries.unionByName(queries.withColumn("query_id", F.lit(9))), "v", "id", "query_id", "query_vector", 5, at_once=1)
    assert rows(each.where("query_id = 9"), "id") == exact


def test_collapse_counts_dropped_hits(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.8, 0.6]), (4, [0.0, 1.0])], "r int, v array<double>")
    assert rows(vector.near_duplicates_collapsed(df, "v", "r", 0.95), "r") == [(1,), (3,), (4,)]
    assert rows(vector.near_duplicates_collapsed(df, "v", "r", 2.0), "r") == [(1,), (2,), (3,), (4,)]
    assert rows(vector.near_duplicates_collapsed(df, "v", "r", 0.1), "r") == [(1,)]


def test_weighted_and_needs_a_common_key(spark):
    df = spark.createDataFrame([(1, {196: 2, 5: 1}), (2, {7: 9})], "u int, m map<int,int>")
    assert rows(vector.weighted_and(df, "u", "m", {196: 1.0, 25133: 1.0}, 10)) == [(1, 2.0)]


# ---- updates, metrics, schema -------------------------------------------------------------------------------------


def test_updates(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    ops = spark.createDataFrame([("a", "n", "5", 1), ("a", "n", "7", 2), ("c", "s", "new", 1), ("b", "s", None, 3)], "id string, field string, value string, seq int")
    assert rows(updates.assigned(table, ops, "id", "field", "value", "seq").fillna("-")) == [("a", 7, "x"), ("b", 2, "-")]
    assert rows(updates.assigned(table, ops, "id", "field", "value", "seq", create=True).where("id = 'c'").select("id", "s")) == [("c", "new")]
    deltas = spark.createDataFrame([("a", 3), ("a", -1), ("z", 9)], "id string, n int")
    assert rows(updates.incremented(table.select("id", "n"), deltas, "id", ["n"])) == [("a", 3), ("b", 2)]
    assert rows(updates.incremented(table.select("id", "n"), deltas, "id", ["n"], create=True)) == [("a", 3), ("b", 2), ("z", 9)]
    puts = spark.createDataFrame([("a", 8, "p", 1), ("a", 9, "q", 2)], "id string, n int, s string, seq int")
    assert rows(updates.upsert(table, puts, "id", ["seq"])) == [("a", 9, "q"), ("b", 2, "y")]
    sets = spark.createDataFrame([({"k": 1, "l": 2}, {"k": -1, "m": 4})], "a map<string,bigint>, b map<string,bigint>")
    assert sets.select(updates.weighted_set_sum(F.col("a"), F.col("b")).alias("x")).first().x == {"l": 2, "m": 4}


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a", 3.0, 0), (1, "b", 2.0, 1), (1, "c", 1.0, 1), (2, "d", 1.0, 0)], "q int, d string, s double, y int")
    mrr = {r.q: r.mrr for r in metrics.mean_reciprocal_rank(df, "q", "s", F.col("y"), "d").collect()}
    assert mrr == {1: pytest.approx((1 / 2 + 1 / 3) / 2), 2: 0.0}
    auc = {r.q: r.auc for r in metrics.group_auc(df, "q", "s", F.col("y")).collect()}
    assert auc == {1: 0.0, 2: None}
    ndcg = {r.q: r.ndcg for r in metrics.ndcg(df, "q", "s", F.col("y"), "d", 10).collect()}
    assert ndcg[1] == pytest.approx((1 / 1.5849625 + 1 / 2) / (1 + 1 / 1.5849625)) and ndcg[2] == 0.0


def test_types_and_scans(spark):
    base = DocumentType("base", "id string, start long", derived={"doubled": lambda: F.col("start") * 2})
    tag = DocumentType("tag", "score int", parents=(base,), summaries={"short": ("id", "score as s")})
    assert tag.schema().fieldNames() == ["id", "start", "score"]
    df = tag.ingested(spark.createDataFrame([("x", 3)], "id string, start int"))
    assert df.first().asDict() == {"id": "x", "start": 3, "score": None, "doubled": 6}
    assert tag.summary(df, "short").columns == ["id", "s"]
    both = routed_scan({"a": df, "b": spark.createDataFrame([("y",)], "id string")}, ["a", "b"])
    assert sorted(r._type for r in both.collect()) == ["a", "b"]
    assert spark.range(1).select(elements_by_labels(F.array(*map(F.lit, "abc")), F.array(F.lit(2), F.lit(9), F.lit(0))).alias("x")).first().x == ["c", "a"]


def test_mined_phrases(spark):
    df = spark.createDataFrame([("red ring",), ("the ring",), ("ab",), ("ring (new)",), ("x" * 65,), ("ring 24",)], "t string")
    assert rows(df.where(predicates.good_phrase(F.col("t")))) == [("red ring",)]


def test_fusion_ranks_all_rows(spark):
    rows = spark.range(120_000).selectExpr("id", "cast(pmod(xxhash64(id), 5000) AS double) AS a", "IF(id % 3 = 0, cast(id AS double), NULL) AS b")
    got = ranking.reciprocal_rank_fusion(rows, ["a", "b"], "id", most=None)
    placed = ranking.places(rows, "a", "id", "pa").join(ranking.places(rows.where("b IS NOT NULL"), "b", "id", "pb").select("id", "pb"), "id", "left")
    want = placed.selectExpr("id", "1D / (60 + pa) + coalesce(1D / (60 + pb), 0) AS want")
    both = got.join(want, "id")
    assert got.count() == both.where("abs(relevance - want) < 1e-12").count() == 120_000
    few = rows.limit(1000)
    ranged = ranking.all_places(few, "a", "id", "at", rows_in_range=30)
    assert ranged.join(ranking.places(few, "a", "id", "pa").select("id", "pa"), "id").where("at = pa").count() == 1000
