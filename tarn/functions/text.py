"""Text analysis: analyzers from a string column to a token array, n-grams, prefixes, paths, snippets, clean-up.

Anything Spark's expressions can say stays an expression; the rest are Arrow UDFs.
Null text gives null or, where noted, an empty array.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLES = ("the", "a", "an")


# ---- tokenizers ---------------------------------------------------------------------------------------------------


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9]``."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def pattern_tokens(text: Column, pattern: str = r"\s|\(|\)") -> Column:
    """Pieces between matches of a pattern, so that ``c++`` stays whole."""
    return F.filter(F.split(text, pattern), lambda t: t != "")


@F.pandas_udf(T.StringType())
def fold_width_and_accents(text: pd.Series) -> pd.Series:
    """Compatibility forms folded (full and half width), accents dropped, lower case."""

    def fold(s):
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()

    return text.map(fold)


def folded_tokens(text: Column) -> Column:
    """Tokens of folded text; letters and digits of any script."""
    return F.filter(F.split(fold_width_and_accents(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


_STEPS = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("ingly", ""), ("edly", ""),
    ("ements", ""), ("ement", ""), ("ments", ""), ("ment", ""), ("ness", ""), ("ings", ""), ("ing", ""), ("ies", "y"), ("ied", "y"),
    ("ed", ""), ("es", ""), ("ly", ""), ("s", ""),
)


def stemmed(tokens: Column) -> Column:
    """A light suffix stemmer; the longest suffix that leaves three characters or more goes."""

    def stem(t: Column) -> Column:
        out = t
        for suffix, put in reversed(_STEPS):
            cut = F.concat(F.substring(t, F.lit(1), F.length(t) - len(suffix)), F.lit(put))
            out = F.when(t.endswith(suffix) & ~t.endswith("ss") & (F.length(t) - len(suffix) >= 3), cut).otherwise(out)
        return out

    return F.transform(tokens, stem)


def with_synonyms(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """T4, T5: each token followed by its synonyms; apply to the index side, the query side or both."""
    if not synonyms:
        return tokens
    table = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(table, t), F.array().cast("array<string>")))))


def phonetic(tokens: Column) -> Column:
    """Soundex codes in place of the tokens."""
    return F.transform(tokens, lambda t: F.soundex(t))


def reversed_tokens(tokens: Column) -> Column:
    """T8."""
    return F.transform(tokens, lambda t: F.reverse(t))


def compound_splitter(dictionary: list[str], least: int = 4):
    """A UDF that adds the dictionary words that make up a token, longest first, of ``least`` letters or more."""
    words = frozenset(w for w in dictionary if len(w) >= least)
    longest = max(map(len, words), default=0)

    def split(token: str) -> list[str]:
        parts, at = [], 0
        while at < len(token):
            for size in range(min(longest, len(token) - at), least - 1, -1):
                if token[at : at + size] in words:
                    parts.append(token[at : at + size])
                    at += size
                    break
            else:
                at += 1
        return parts if len(parts) > 1 else []

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [x for t in ts for x in (t, *split(t))])

    return run


def dictionary_segmenter(dictionary: list[str]):
    """Forward maximum matching for scripts without spaces; characters of no word stand alone."""
    words = frozenset(dictionary)
    longest = max(map(len, words), default=1)

    def cut(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            size = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in words), 1)
            out.append(text[at : at + size])
            at += size
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else cut(s))

    return run


def segmented(rows: DataFrame, id_col: str, text: str, words: DataFrame, word: str, name: str = "tokens") -> DataFrame:
    """T11 with a dictionary in a table of any size: forward maximum matching by an equal join of the substrings of each text with the words.

    Ids must tell rows apart; a text is ``length * longest word`` rows while it is matched. Null texts have null tokens.
    """
    longest = words.agg(F.max(F.length(word))).first()[0] or 1
    start = rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).alias("__t"), F.explode(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))).alias("__at"))
    pieces = start.select("__id", "__at", F.explode(F.when(F.length("__t") > F.col("__at"), F.sequence(F.lit(2), F.least(F.greatest(F.lit(2), F.lit(longest)), F.length("__t") - F.col("__at") + 1)))).alias("__n"), "__t")
    pieces = pieces.select("__id", "__at", "__n", F.substring("__t", F.col("__at"), F.col("__n")).alias("__w"))
    known = pieces.join(words.select(F.col(word).alias("__w")).distinct(), "__w", "left_semi").groupBy("__id", "__at").agg(F.max("__n").alias("__n"))
    sizes = known.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("__at", "__n"))).alias("__sizes"))
    joined = rows.join(sizes, F.col(id_col) == F.col("__id"), "left")

    def step(state: Column, at: Column) -> Column:
        size = F.coalesce(F.col("__sizes")[at], F.lit(1))
        here = F.substring(F.col(text), at, size)
        skipped = (at < state["next"]) | ((size == 1) & (F.trim(here) == ""))
        return F.struct(F.when(skipped, state["next"]).otherwise(at + size).alias("next"), F.when(skipped, state["out"]).otherwise(F.concat(state["out"], F.array(here))).alias("out"))

    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    tokens = F.aggregate(places, F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"])
    return joined.withColumn(name, F.when(F.col(text).isNotNull(), tokens)).drop("__id", "__sizes")


def character_folding(text: Column, source: str, target: str) -> Column:
    """Characters of ``source`` replaced by those of ``target``, e.g. traditional by simplified forms."""
    return F.translate(text, source, target)


def phrase_merger(phrases: list[str], most_chars: int = 20):
    """Greedy longest merge of two or more adjacent tokens whose concatenation is in the dictionary."""
    known = frozenset(phrases)

    def merge(tokens: list[str]) -> list[str]:
        out, at = [], 0
        while at < len(tokens):
            best, joined = 1, tokens[at]
            for stop in range(at + 1, len(tokens)):
                joined += tokens[stop]
                if len(joined) > most_chars:
                    break
                if joined in known:
                    best = stop - at + 1
            out.append("".join(tokens[at : at + best]))
            at += best
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else merge(list(ts)))

    return run


# ---- n-grams, prefixes, paths -------------------------------------------------------------------------------------


def _shifted(items: Column, n: int, separator: str, without: tuple[str, ...] = ()) -> Column:
    """Runs of ``n`` neighbours that hold none of some items, joined. The array is read ``n`` times, not once a run: no lambda refers to it."""
    runs = F.size(items) - n + 1
    zipped = F.arrays_zip(*[F.slice(items, k + 1, F.greatest(runs, F.lit(0))) for k in range(n)])
    if without:
        zipped = F.filter(zipped, lambda z: reduce(lambda a, b: a & b, [~z[str(k)].isin(*without) for k in range(n)]))
    return F.transform(zipped, lambda z: F.concat_ws(separator, *[z[str(k)] for k in range(n)]))


def character_grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters; none where the text is shorter."""
    return _shifted(F.filter(F.split(text, ""), lambda c: c != ""), n, "")


def token_windows(tokens: Column, most: int, stop_words: tuple[str, ...] = ()) -> Column:
    """Space-joined windows of 1 to ``most`` tokens, without those that hold a stop word."""
    return reduce(F.concat, [_shifted(tokens, n, " ", stop_words) for n in range(1, most + 1)])


_NO_TEXTS = "array<string>"


def suffix_phrases(text: Column) -> Column:
    """T15: "learning to rank" gives itself, "to rank" and "rank"."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    longer = lambda done, w: F.concat(F.array(F.concat_ws(" ", w, F.get(done, F.lit(0)))), done)
    return F.aggregate(F.reverse(words), F.array().cast(_NO_TEXTS), longer)


def all_prefixes(text: Column) -> Column:
    """Every prefix from one character to the whole text."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def path_levels(parts: Column, separator: str = "|") -> Column:
    """``A``, ``A|B``, ``A|B|C`` of an array of levels."""
    deeper = lambda done, p: F.concat(done, F.array(F.concat_ws(separator, F.element_at(F.concat(F.array(F.lit(None).cast("string")), done), -1), p)))
    return F.aggregate(parts, F.array().cast(_NO_TEXTS), deeper)


def fixed_chunks(text: Column, size: int = 1024) -> Column:
    """Chunks of ``size`` characters, the last one shorter."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def recursive_chunks(text: pd.Series, size: pd.Series) -> pd.Series:
    """Chunks of at most ``size`` characters, cut at paragraphs, else lines, else spaces, else anywhere."""

    def cut(s: str, limit: int, marks=("\n\n", "\n", " ", "")) -> list[str]:
        if len(s) <= limit:
            return [s] if s.strip() else []
        mark = marks[0]
        pieces = [s[i : i + limit] for i in range(0, len(s), limit)] if mark == "" else s.split(mark)
        out, held = [], ""
        for p in pieces:
            joined = held + mark + p if held else p
            if len(joined) <= limit:
                held = joined
                continue
            if held.strip():
                out.append(held)
            held = ""
            if len(p) <= limit:
                held = p
            else:
                out += cut(p, limit, marks[1:])
        return out + ([held] if held.strip() else [])

    return pd.Series([None if s is None else cut(s, n) for s, n in zip(text, size, strict=True)])


# ---- clean-up -----------------------------------------------------------------------------------------------------


def spaced_words(text: Column) -> Column:
    """A space where a small letter or full stop meets a capital, other characters than word characters to spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?<=[a-z.])(?=[A-Z])", " "), r"\W", " "), r"\s+", " "))


def query_text(text: Column) -> Column:
    """Queries keep word characters and spaces, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\w ]", " "))


def without_stop_words(tokens: Column, stop_words: tuple[str, ...]) -> Column:
    """The tokens that are not stop words, or all of them where none would be left."""
    kept = F.filter(tokens, lambda t: ~t.isin(*stop_words))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def without_control(text: Column) -> Column:
    """characters of category C removed."""
    return F.regexp_replace(text, r"\p{C}", "")


def collapsed(text: Column) -> Column:
    """M8: trimmed, lower-cased, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


class _Sections(HTMLParser):
    _SKIP = {"script", "style", "nav", "head"}
    _BREAK = {"p", "div", "li", "tr", "br", "ul", "ol", "table", "pre"}

    def __init__(self):
        super().__init__()
        self.rows, self.title, self.text, self.in_title, self.skip = [], "", [], False, 0

    def flush(self):
        body = re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", "".join(self.text))).strip()
        if body:
            self.rows.append((self.title.strip(), body))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.title, self.in_title = "", True
        elif tag in self._BREAK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.in_title = False

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
        else:
            self.text.append(data)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])))
def html_sections(html: pd.Series) -> pd.Series:
    """Text of a page by heading; scripts, styles and navigation are left out."""

    def run(s):
        parser = _Sections()
        parser.feed(s or "")
        parser.close()
        parser.flush()
        return [{"title": t, "body": b} for t, b in parser.rows]

    return html.map(run)


# ---- model input and display --------------------------------------------------------------------------------------


def cross_encoder_input(query_ids: Column, doc_ids: Column, length: int, cls: int = 101, sep: int = 102) -> dict[str, Column]:
    """``[CLS] q [SEP] d [SEP]`` ids, type ids and mask, cut and padded to ``length``."""
    first = F.concat(F.array(F.lit(cls)), query_ids, F.array(F.lit(sep)))
    second = F.concat(doc_ids, F.array(F.lit(sep)))
    pad = lambda a: F.slice(F.concat(a, F.array_repeat(F.lit(0), length)), 1, length)
    return {
        "input_ids": pad(F.concat(first, second)),
        "token_type_ids": pad(F.concat(F.transform(first, lambda _: F.lit(0)), F.transform(second, lambda _: F.lit(1)))),
        "attention_mask": pad(F.transform(F.concat(first, second), lambda _: F.lit(1))),
    }


def snippet(text: Column, terms: list[str], around: int = 8) -> Column:
    """The words around the first match, matches in ``<hi>``, cuts as ``<sep />``."""
    words = F.split(text, r"\s+")
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    at = F.array_position(F.transform(bare, lambda w: F.array_contains(wanted, w)), True).cast("int")
    start = F.greatest(F.lit(1), at - around)
    part = F.array_join(F.slice(words, start, F.lit(2 * around + 1)), " ")
    marked = F.regexp_replace(part, r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b", "<hi>$1</hi>")
    before = F.when(start > 1, F.lit("<sep />")).otherwise(F.lit(""))
    after = F.when(start + 2 * around < F.size(words), F.lit("<sep />")).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(before, marked, after))


@F.pandas_udf(T.ArrayType(T.LongType()))
def subword_ids(text: pd.Series, vocabulary_path: pd.Series) -> pd.Series:
    """Ids of a byte-pair vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    cache = {}

    def run(s, path):
        if s is None:
            return None
        if path not in cache:
            cache[path] = Tokenizer.from_file(path)
        return cache[path].encode(s, add_special_tokens=False).ids

    return pd.Series([run(s, p) for s, p in zip(text, vocabulary_path, strict=True)])


def tokens_of(text: Column, analyzer=word_tokens) -> Column:
    """What an analyzer makes of a field, for display."""
    return F.coalesce(analyzer(text), F.array().cast("array<string>"))
