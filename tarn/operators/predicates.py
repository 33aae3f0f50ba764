"""Query trees: a small algebra of predicates that compiles to one ``Column``, JSON forms, and rewrite rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as tx


@dataclass(frozen=True)
class Node:
    """An operator, the field it looks at, and its arguments."""

    op: str
    field: str | None = None
    args: tuple = ()
    ranked: bool = True

    def __and__(self, other: Node) -> Node:
        return Node("and", args=(self, other))

    def __or__(self, other: Node) -> Node:
        return Node("or", args=(self, other))

    def __invert__(self) -> Node:
        return Node("not", args=(self,))

    def unranked(self) -> Node:
        """filters, but adds nothing to the score."""
        return Node(self.op, self.field, self.args, False)


ALL = Node("true")


def term(field: str, word) -> Node:
    """an analysed term of a text field, an element of an array, or the value of an attribute."""
    return Node("term", field, (word,))


def compare(field: str, op: str, value) -> Node:
    """F2, F4."""
    return Node(op, field, (value,))


def between(field: str, low=None, high=None) -> Node:
    """inclusive limits; an open side is unbounded."""
    return Node("range", field, (low, high))


def phrase(field: str, words: str) -> Node:
    """F12."""
    return Node("phrase", field, (words,))


def prefix(field: str, start: str) -> Node:
    """F13."""
    return Node("prefix", field, (start,))


def regex(field: str, pattern: str) -> Node:
    """F14."""
    return Node("regex", field, (pattern,))


def fuzzy(field: str, word: str) -> Node:
    """3 letters exact, to 6 one edit, else two; the first two letters are fixed."""
    return Node("fuzzy", field, (word,))


def one_of(field: str, values) -> Node:
    """F16."""
    return Node("in", field, tuple(values))


def grams(field: str, words: str, n: int = 3) -> Node:
    """all n-grams of the query must be in the field; a shorter query matches nothing."""
    return Node("grams", field, (words, n))


def equivalent(field: str, words) -> Node:
    """synonyms as one term."""
    return Node("equiv", field, tuple(words))


def nearest_to(field: str, query, k: int, distance: str = "euclidean") -> Node:
    """The ``k`` rows nearest to a vector, as a predicate that joins with others; needs :func:`searched`."""
    return Node("nearest", field, (tuple(float(x) for x in query), k, distance))


def element_phrase(field: str, words: str, gap: int | None = None) -> Node:
    """a phrase within one text of an array field; with a ``gap`` it may go on in the next text, whose first word is that many places on."""
    return Node("element_phrase", field, (words, gap))


def stored_expression(field: str, attributes: dict[str, object]) -> Node:
    """as ``stored_predicate`` for expressions of :func:`with_expressions`, with ``or``, ``not in`` and parentheses."""
    return Node("expression", field, stored_predicate(field, attributes).args)


def weak_and(field: str, words: str) -> Node:
    """any of the analysed words; ranking decides the rest."""
    return Node("any", field, (words,))


def stored_predicate(field: str, attributes: dict[str, object]) -> Node:
    """rows whose stored clauses all hold for the query's attributes (values, lists of values, or numbers)."""
    return Node("stored", field, (tuple(sorted((k, tuple(v) if isinstance(v, (list, tuple)) else (v,)) for k, v in attributes.items())),))


def conjunction(*nodes: Node) -> Node:
    return reduce(lambda a, b: a & b, nodes) if nodes else ALL


def disjunction(*nodes: Node) -> Node:
    return reduce(lambda a, b: a | b, nodes) if nodes else Node("false")


@dataclass
class Fields:
    """How fields are matched: ``text`` fields through their analyzer, others as attributes; fieldsets by name (F8)."""

    text: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    sets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    arrays: frozenset[str] = frozenset()

    def tokens(self, name: str) -> Column:
        return self.text[name](F.col(name))


def _query_words(words: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", words.lower()) if w]


def _fuzzy(token: Column, word: str) -> Column:
    edits = 0 if len(word) <= 3 else 1 if len(word) <= 6 else 2
    if not edits:
        return token == word
    return token.startswith(word[:2]) & (F.levenshtein(token, F.lit(word), edits) >= 0)


def _contains_phrase(tokens: Column, words: list[str]) -> Column:
    """Adjacent tokens, looked for in the joined tokens: the analyzer runs once a row."""
    if not words:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def compiled(node: Node, fields: Fields = Fields()) -> Column:
    """The predicate as one expression: Spark pushes its comparisons and prefixes to the scan."""
    op, name, args = node.op, node.field, node.args
    if op in ("and", "or"):
        parts = [compiled(a, fields) for a in args]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":  # a document without the field is no match of what is negated
        return ~F.coalesce(compiled(args[0], fields), F.lit(False))
    if op in ("true", "false"):
        return F.lit(op == "true")
    if name in fields.sets:
        return reduce(lambda a, b: a | b, [compiled(Node(op, f, args), fields) for f in fields.sets[name]])
    column = F.col(name)
    if op in ("=", "!=", "<", "<=", ">", ">="):
        value = F.lit(args[0])
        return {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]
    if op == "range":
        low, high = args
        sides = [column >= F.lit(low)] * (low is not None) + [column <= F.lit(high)] * (high is not None)
        return reduce(lambda a, b: a & b, sides) if sides else column.isNotNull()
    if op == "prefix":
        return F.exists(fields.tokens(name), lambda t: t.startswith(args[0].lower())) if name in fields.text else column.startswith(args[0])
    if op == "regex":
        return column.rlike(args[0])
    if op == "in":
        return F.arrays_overlap(column, F.array(*[F.lit(v) for v in args])) if name in fields.arrays else column.isin(*args)
    if op == "grams":
        words, n = args
        own = sorted({words.lower()[i : i + n] for i in range(len(words) - n + 1)})
        if not own:
            return F.lit(False)
        return F.size(F.array_except(F.array(*[F.lit(g) for g in own]), tx.character_grams(F.lower(column), n))) == 0
    if op == "stored":
        return _stored(column, dict(args[0]))
    if op == "expression":
        return column.isNotNull() & F.exists(column, lambda both: F.forall(both, lambda c: F.when(c["negated"], ~_clause_holds(c, dict(args[0]))).otherwise(_clause_holds(c, dict(args[0])))))
    if op == "nearest":
        raise ValueError("nearest_to needs searched()")
    if op == "flag":
        return F.coalesce(column, F.lit(False))
    if op == "element_phrase":
        return _element_phrase(column, *args)
    if name not in fields.text:
        if op in ("term", "phrase"):
            return F.array_contains(column, args[0]) if name in fields.arrays else column == F.lit(args[0])
        if op == "equiv":
            return F.arrays_overlap(column, F.array(*[F.lit(v) for v in args])) if name in fields.arrays else column.isin(*args)
        if op == "fuzzy":
            word = args[0].lower()
            return F.exists(column, lambda x: _fuzzy(F.lower(x), word)) if name in fields.arrays else _fuzzy(F.lower(column), word)
        raise ValueError(f"{op} needs a text field, {name} is none")
    tokens = fields.tokens(name)
    if op == "fuzzy":
        return F.exists(tokens, lambda t: _fuzzy(t, args[0].lower()))
    if op == "equiv":
        return F.arrays_overlap(tokens, F.array(*[F.lit(w.lower()) for w in args]))
    words = _query_words(str(args[0]))
    if op == "any":
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    if op in ("term", "phrase"):
        return F.array_contains(tokens, words[0]) if len(words) == 1 else _contains_phrase(tokens, words)
    raise ValueError(f"unknown operator {op}")


# ---- F21: stored predicates ---------------------------------------------------------------------------------------

CLAUSES = "array<struct<attribute: string, values: array<string>, low: double, high: double>>"
_CLAUSE = re.compile(r"(\w+)\s+in\s+\[\s*(?:(-?[\d.]*)\s*\.\.\s*(-?[\d.]*)|((?:'[^']*'\s*,?\s*)*))\s*\]")


def parse_predicate(expression: str | None) -> list[dict] | None:
    """``a in ['x', 'y'] and n in [1..5]`` as clauses; an open end of a range is unbounded."""
    if expression is None:
        return None
    out = []
    for part in re.split(r"\s+and\s+", expression.strip()) if expression.strip() else []:
        m = _CLAUSE.fullmatch(part.strip())
        if not m:
            raise ValueError(f"cannot read clause {part!r}")
        name, low, high, values = m.groups()
        numeric = values is None
        out.append({"attribute": name, "values": None if numeric else re.findall("'([^']*)'", values), "low": float(low) if numeric and low else None, "high": float(high) if numeric and high else None})
    return out


def with_clauses(df: DataFrame, column: str, out: str) -> DataFrame:
    """Parse stored expressions once, on the write path."""

    @F.pandas_udf(CLAUSES)
    def parse(expressions: pd.Series) -> pd.Series:
        return expressions.map(lambda e: parse_predicate(e if isinstance(e, str) else None))

    return df.withColumn(out, parse(F.col(column)))


def _clause_holds(c: Column, attributes: dict[str, tuple]) -> Column:
    """Whether one of the attributes' values is in the clause's list or range; false without the attribute."""
    texts = {k: [v for v in vs if isinstance(v, str)] for k, vs in attributes.items()}
    numbers = {k: [float(v) for v in vs if not isinstance(v, str)] for k, vs in attributes.items()}

    any_of = F.lit(False)
    for k, vs in texts.items():
        if vs:
            any_of = any_of | ((c["attribute"] == k) & F.arrays_overlap(c["values"], F.array(*[F.lit(v) for v in vs])))
    for k, vs in numbers.items():
        for v in vs:
            inside = F.coalesce(c["low"] <= v, F.lit(True)) & F.coalesce(c["high"] >= v, F.lit(True))
            any_of = any_of | ((c["attribute"] == k) & c["values"].isNull() & inside)
    return F.coalesce(any_of, F.lit(False))


def _stored(clauses: Column, attributes: dict[str, tuple]) -> Column:
    return clauses.isNotNull() & F.forall(clauses, lambda c: _clause_holds(c, attributes))


EXPRESSIONS = "array<array<struct<attribute: string, values: array<string>, low: double, high: double, negated: boolean>>>"
_PIECE = re.compile(r"\s*(\(|\)|and\b|or\b|not\b|\w+\s+(?:not\s+)?in\s+\[[^\]]*\])", re.I)


def parse_expression(expression: str | None) -> list[list[dict]] | None:
    """Clauses joined by ``and``, ``or``, ``not`` and parentheses, as alternatives of clauses that must all hold; an empty one always holds."""
    if expression is None:
        return None
    if not expression.strip():
        return [[]]
    pieces, at = [], 0
    while at < len(expression.rstrip()):
        m = _PIECE.match(expression, at)
        if not m:
            raise ValueError(f"cannot read {expression[at:]!r}")
        pieces.append(m.group(1))
        at = m.end()

    def either(no: bool) -> list[list[dict]]:
        out = both(no)
        while pieces and pieces[0].lower() == "or":
            pieces.pop(0)
            more = both(no)
            out = [a + b for a in out for b in more] if no else out + more
        return out

    def both(no: bool) -> list[list[dict]]:
        out = single(no)
        while pieces and pieces[0].lower() == "and":
            pieces.pop(0)
            more = single(no)
            out = out + more if no else [a + b for a in out for b in more]
        return out

    def single(no: bool) -> list[list[dict]]:
        if not pieces:
            raise ValueError(f"cannot read {expression!r}")
        piece = pieces.pop(0)
        if piece.lower() == "not":
            return single(not no)
        if piece == "(":
            out = either(no)
            if not pieces or pieces.pop(0) != ")":
                raise ValueError(f"no closing parenthesis in {expression!r}")
            return out
        turned = re.sub(r"\s+not\s+in\s+", " in ", piece, flags=re.I)
        return [[parse_predicate(turned)[0] | {"negated": no != (turned != piece)}]]

    out = either(False)
    if pieces:
        raise ValueError(f"cannot read {expression!r}")
    return out


def with_expressions(df: DataFrame, column: str, out: str) -> DataFrame:
    """parse stored expressions once, on the write path."""

    @F.pandas_udf(EXPRESSIONS)
    def parse(expressions: pd.Series) -> pd.Series:
        return expressions.map(lambda e: parse_expression(e if isinstance(e, str) else None))

    return df.withColumn(out, parse(F.col(column)))


def _element_phrase(texts: Column, words: str, gap: int | None) -> Column:
    """Tokens joined by spaces, elements by a mark that no token holds and, with a gap of one, by a space."""
    own = _query_words(words)
    if not own:
        return F.lit(False)
    joined = F.transform(texts, lambda t: F.concat(F.lit(" "), F.array_join(tx.word_tokens(t), " "), F.lit(" ")))
    if gap == 1:
        joined = F.array(F.regexp_replace(F.array_join(joined, ""), " +", " "))
    return F.coalesce(F.exists(joined, lambda t: t.contains(" " + " ".join(own) + " ")), F.lit(False))


# ---- F20: nearest neighbours in a query tree, F23: what adds to the score -------------------------------------------


def searched(docs: DataFrame, node: Node, fields: Fields, id_col: str) -> DataFrame:
    """Rows that match a tree with ``nearest_to`` nodes: each gives ``k`` ids (a bounded list, broadcast), which then count like any predicate."""
    from tarn.functions import tensor as tn
    from tarn.operators.vector import nearest

    flags: list[DataFrame] = []

    def flagged(n: Node) -> Node:
        if n.op == "nearest":
            query, k, distance = n.args
            best = nearest(docs, n.field, tn.literal(query), id_col, k, tn.DISTANCES[distance])
            flags.append(best.select(F.col(id_col).alias(f"__id{len(flags)}"), F.lit(True).alias(f"__near{len(flags)}")))
            return Node("flag", f"__near{len(flags) - 1}")
        return Node(n.op, n.field, tuple(flagged(a) for a in n.args), n.ranked) if n.op in ("and", "or", "not") else n

    tree, rows = flagged(node), docs
    for k, best in enumerate(flags):
        rows = rows.join(F.broadcast(best), F.col(id_col) == F.col(f"__id{k}"), "left").drop(f"__id{k}")
    return rows.where(compiled(tree, fields)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ranking_terms(node: Node) -> list[Node]:
    """the positive terms that add to the score; unranked parts of the tree only filter."""
    if not node.ranked:
        return []
    if node.op in ("and", "or"):
        return [t for a in node.args for t in ranking_terms(a)]
    return [node] if node.op in ("term", "phrase", "prefix", "fuzzy", "equiv", "any") else []


def matched_terms(node: Node, fields: Fields) -> Column:
    """How many of the ranking terms a document holds."""
    held = [F.coalesce(compiled(t, fields), F.lit(False)).cast("int") for t in ranking_terms(node)]
    return reduce(lambda a, b: a + b, held, F.lit(0))


# ---- F5: JSON form, C6-C8: rewrites -------------------------------------------------------------------------------


def from_json_form(tree: dict) -> Node:
    """``{"and": [..]}``, ``{"or": [..]}``, ``{"not": x}``, ``{"contains": [f, v]}``, ``{"range": [f, {">=": a, "<": b}]}``, ``{"equals": [f, v]}``."""
    ((op, args),) = tree.items()
    if op == "and":
        return conjunction(*map(from_json_form, args))
    if op == "or":
        return disjunction(*map(from_json_form, args))
    if op == "not":
        return ~from_json_form(args)
    if op == "contains":
        return term(*args)
    if op == "equals":
        return compare(args[0], "=", args[1])
    if op == "range":
        return conjunction(*[compare(args[0], k, v) for k, v in sorted(args[1].items())])
    if op in ("prefix", "regex", "fuzzy", "phrase"):
        return {"prefix": prefix, "regex": regex, "fuzzy": fuzzy, "phrase": phrase}[op](*args)
    raise ValueError(f"unknown operator {op}")


def positive_terms(node: Node) -> list[Node]:
    if node.op in ("and", "or"):
        return [t for a in node.args for t in positive_terms(a)]
    return [node] if node.op in ("term", "equiv") else []


def inject_term(trigger_words, extra: Node) -> Callable[[Node], Node]:
    """Where a positive term is in the list, the whole query becomes ``query OR extra``."""
    words = {w.lower() for w in trigger_words}
    return lambda q: q | extra if any(str(a).lower() in words for t in positive_terms(q) for a in t.args) else q


def inject_filter(extra: Node) -> Callable[[Node], Node]:
    """``query AND extra``, without rank."""
    return lambda q: q & extra.unranked()


def expand_synonyms(synonyms: dict[str, list[str]]) -> Callable[[Node], Node]:
    """terms with synonyms become EQUIV."""

    def rewrite(q: Node) -> Node:
        if q.op in ("and", "or", "not"):
            return Node(q.op, args=tuple(map(rewrite, q.args)))
        if q.op == "term" and str(q.args[0]).lower() in synonyms:
            w = str(q.args[0]).lower()
            return equivalent(q.field, (w, *synonyms[w]))
        return q

    return rewrite


def suggestion_query(typed: str, whole: str = "query", words: str = "words") -> Node:
    """The typed text as a prefix, or any of its tokens as a fuzzy word; the prefix alone where it has no token."""
    tokens = _query_words(typed)
    start = prefix(whole, typed)
    return start | disjunction(*[fuzzy(words, t) for t in tokens]) if tokens else start


def rewritten(query: Node, *rules: Callable[[Node], Node]) -> Node:
    """Rules in order."""
    return reduce(lambda q, rule: rule(q), rules, query)


# ---- write-path and mining filters --------------------------------------------------------------------------------


def allowed_tokens(tokens: Column, blocked=(), allowed=()) -> Column:
    """no blocked token, and no token outside the allow-list where there is one. No tokens at all are allowed."""
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    ok = ~F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in blocked])) if blocked else F.lit(True)
    return ok & (F.size(F.array_except(tokens, F.array(*[F.lit(w) for w in allowed]))) == 0) if allowed else ok


# What rules a mined phrase out, and how one may not start.
PHRASE_SYMBOLS = (
    ";", "*", "&gt", "gt;", "&lt", "lt;", "{", "}", "(", ")", "<", ">", ":", "=", '"', "'", "%", "$", "191", "24", "]", "[", "|", "e.g", "1.", "2.", "3.", "4.", "5.",
)
PHRASE_STARTS = ("a ", "an ", "any ", "another ", "the ", "either ", "more ", "only ")


def good_phrase(text: Column, least: int = 3, most: int = 64) -> Column:
    """length within limits, none of the symbols, none of the starts."""
    ok = F.length(text).between(least, most)
    for symbol in PHRASE_SYMBOLS:
        ok = ok & ~text.contains(symbol)
    for start in PHRASE_STARTS:
        ok = ok & ~text.startswith(start)
    return ok


def clean_text(text: Column) -> Column:
    """rows without the substitute character."""
    return ~text.contains("\u001a")
