"""URL filter: longest-match rules, then unigram Viterbi segmentation and multinomial naive Bayes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import base
from tarn.llm.exact_dedup import ascii_lower

ALLOW, BLOCK = "allow", "block"

#: Contract rules: (host, path) to verdict.
RULES = {("org", "/"): ALLOW, ("example.org", "/es/"): BLOCK, ("example.org", "/en/1"): BLOCK, ("com", "/fr/"): ALLOW, ("com", "/de/"): BLOCK}

# Words of trades that pages one wants do not advertise, in the languages of the web's larger part. One of them says nothing; a page that is full
# of different ones is unwanted, and examples of unwanted URLs are made with them. Words with an ordinary sense ("bet", "cams", "slots") are left out.
SEED_WORDS = frozenset(
    # gambling
    "apuestas betting bingo blackjack casino casinos gambling glücksspiel jackpot lotto poker roulette sportsbook tragaperras wetten казино ставки "
    # medicines without a prescription, loans
    "cialis clenbuterol levitra payday pills potenzmittel steroids tramadol valium viagra xanax виагра кредит prestamos "
    # adult
    "camgirls escort escorts hentai hookup milf nude nudes porn porno pornos sexo sexshop swinger xxx порно секс "
    # stolen or harmful software, deceit
    "adserver adware clickbait cracked keygen malware nulled phishing serials spyware trojan warez "
    # copies of brands
    "fakewatches replicas knockoffs".split()
)

_LETTERS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"[^\W\d_]+|\d+")
_LINK = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.S | re.I)
_FOREIGN = re.compile(r"href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/\"'\s>?#]+)", re.I)
_MARKS = re.compile(r"[!%*#$&]{2}")
_MARKUP = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S | re.I)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` up to ``/ ? #``, and the path after it up to ``? #``; else empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def longest_rule(host: Column, path: Column, rules: dict[tuple[str, str], str]) -> tuple[Column, Column]:
    """The fitting rule of the longest host, then the longest path, as text, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[h, p])).otherwise(verdict)
    return rule, verdict


# ---- segmentation -------------------------------------------------------------------------------------------------


@dataclass
class Segmenter:
    """Unigram costs of words; a run of letters is split into the cheapest words (Viterbi)."""

    cost: dict[str, float]
    longest: int
    unknown: float
    cache: dict[str, list[str]] = field(default_factory=dict, repr=False)
    cache_size: int = 200_000

    def split(self, run: str) -> list[str]:
        """Ties take the split whose last word is longest; an unknown word costs more with each letter."""
        if (got := self.cache.get(run)) is not None:
            return got
        best, back = [0.0], [0]
        for stop in range(1, len(run) + 1):
            least, place = math.inf, 0
            for start in range(max(0, stop - self.longest), stop):
                word = run[start:stop]
                c = best[start] + self.cost.get(word, self.unknown * (1 + len(word)))
                if c < least:
                    least, place = c, start
            best.append(least)
            back.append(place)
        words, stop = [], len(run)
        while stop:
            words.append(run[back[stop] : stop])
            stop = back[stop]
        words.reverse()
        if len(self.cache) < self.cache_size:
            self.cache[run] = words
        return words


def segmenter(counts: dict[str, int], total: int) -> Segmenter:
    floor = math.log(max(total, 2))
    return Segmenter({w: math.log(total) - math.log(n) for w, n in counts.items()}, max([24, *map(len, counts)]), floor)


def word_shares(pages: DataFrame, html_col: str, least_share: float) -> tuple[dict[str, int], int]:
    """Counts of the words whose share of all words in all pages is ``least_share`` or more, and the number of all words.

    The share bounds the table (at most ``1 / least_share`` words) at any input size; rarer words are unknown to the segmenter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row for each word of a slice; slices are bounded, so is the dictionary
        for part in (part for batch in batches for part in base.slices(batch, "html")):
            found: Counter = Counter()
            for html in part.column("html").to_pylist():
                if html:
                    found.update(_LETTERS.findall(_MARKUP.sub(" ", html).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    words = pages.select(F.col(html_col).alias("html")).mapInArrow(base.frugal(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = base.written(words, "page-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.where(F.col("n") >= F.lit(least_share) * total).where(F.length("word") > 1).collect()
    return {r.word: r.n for r in rows}, total


# ---- labels from pages --------------------------------------------------------------------------------------------


def shouted(piece: str) -> bool:
    """Runs of marks, or four letters or more that are all capitals. Letters of scripts that have no capitals, and small letters of any script, are none."""
    if _MARKS.search(piece):
        return True
    return any(len(run) >= 4 and run.isupper() and run.lower() != run for run in _LETTERS.findall(piece))


def unwanted_page(
    html: str | None,
    seeds: frozenset[str] = SEED_WORDS,
    seed_share: float = 0.05,
    least_seeds: int = 4,
    shout_share: float = 0.3,
    link_share: float = 0.7,
    least_hosts: int = 8,
) -> bool | None:
    """A weak label from what a page shows, never from its URL; None where it shows no word.

    Unwanted are pages with ``seed_share`` of their words among ``seeds``, ``least_seeds`` different ones (all, where a page has fewer different words); with ``shout_share`` of their
    pieces shouted (:func:`shouted`); or link farms, with ``link_share`` of their words in links to ``least_hosts`` different hosts. Links within a
    site, such as menus and lists of chapters, are no farm, and a text that names trades is no advertisement.
    """
    if not html:
        return None
    shown = _MARKUP.sub(" ", html)
    pieces, words = shown.split(), _LETTERS.findall(shown.lower())
    if not words:
        return None
    held = [w for w in words if w in seeds]
    if len(held) >= seed_share * len(words) and len(set(held)) >= min(least_seeds, len(set(words))):
        return True
    if sum(map(shouted, pieces)) >= shout_share * len(pieces):
        return True
    hosts, linked = set(), 0
    for m in _LINK.finditer(html):
        if found := _FOREIGN.search(m.group(1)):
            hosts.add(found.group(1).lower())
            linked += len(_LETTERS.findall(_MARKUP.sub(" ", m.group(2))))
    return len(hosts) >= least_hosts and linked >= link_share * len(words)


# ---- classification -----------------------------------------------------------------------------------------------


def url_tokens(host: str, path: str, split: Segmenter) -> list[str]:
    """Host words as ``h:word``, path words as ``p:word``; numbers become their length, the two last host labels are kept whole."""
    labels = host.split(".")
    out = [f"d:{'.'.join(labels[-2:])}"] if host else []
    for label in labels[:-2] or labels[:1]:
        out += [f"h:{w}" for run in _TOKENS.findall(label) for w in (split.split(run) if not run[0].isdigit() else [f"#{min(len(run), 6)}"])]
    for run in _TOKENS.findall(path.lower()):
        out += [f"p:#{min(len(run), 6)}"] if run[0].isdigit() else [f"p:{w}" for w in split.split(run)]
    return out


@dataclass
class NaiveBayes:
    """Multinomial: log odds of ``block`` by token, and of the prior. A token outside the vocabulary says nothing."""

    prior: float
    odds: dict[str, float]

    def score(self, tokens: list[str]) -> float:
        x = self.prior + sum(self.odds.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def train(rows: list[tuple[list[str], bool]], smooth: float = 0.2) -> NaiveBayes:
    """Class priors are taken as equal where a class is empty; both classes share one vocabulary."""
    counts = {True: Counter(), False: Counter()}
    docs = Counter(label for _, label in rows)
    for tokens, label in rows:
        counts[label].update(tokens)
    vocabulary = counts[True].keys() | counts[False].keys()
    mass = {c: sum(counts[c].values()) + smooth * len(vocabulary) for c in counts}
    logp = lambda t, c: math.log(counts[c][t] + smooth) - math.log(mass[c])
    return NaiveBayes(
        prior=math.log(docs[True] + 1) - math.log(docs[False] + 1),
        odds={t: logp(t, True) - logp(t, False) for t in vocabulary},
    )


def seed_examples(seeds: frozenset[str], urls: list[list[str]]) -> list[tuple[list[str], bool]]:
    """An unwanted URL for each seed: a sampled URL with the seed put into host and path, so that only the seed stands out."""
    shape = lambda k: urls[k * len(urls) // len(seeds)] if urls else []
    return [([f"h:{s}", f"p:{s}", *shape(k)], True) for k, s in enumerate(sorted(seeds))]


def judge(
    pages: DataFrame,
    rules: dict[tuple[str, str], str] = RULES,
    seeds: frozenset[str] = SEED_WORDS,
    max_train: int = 20_000,
    least_share: float = 2e-5,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    Word costs come from the words of all pages, to which ``seeds`` are added. The
    classifier is fitted on about ``max_train`` URLs chosen by a hash of the URL; their labels come
    from what their pages show (``unwanted_page``; of several pages of a URL the greater part
    decides), and pages without a word give none; only where a seed is a word of the URL, it is unwanted
    whatever its page shows. Each seed also gives one example (``seed_examples``). Tokens that the sample lacks say nothing. Where a rule fits it decides; else a score of 0.5 or more
    blocks. ``score`` is null where a rule decides.

    A null URL, or one without ``://``, has empty host and path, and is allowed (score
    0) unless a rule fits. Repeated rows are judged alike; null ids and other columns
    are of no matter; null pages have no words. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    counts, total = word_shares(pages, html_col, least_share)
    usual = max(1, round(total * 1e-4))
    for s in seeds:
        counts[s] = max(counts.get(s, 0), usual)
    split = segmenter(counts, max(total, 2 * sum(counts.values())))

    host, path = host_and_path(F.col("__url"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"), F.col(html_col).alias("html"))
    own = own.select("page_id", host.alias("host"), path.alias("path"), "html")
    urls = own.select("page_id", "host", "path")
    n = pages.select(url_col).count()
    buckets = 1 << 20
    limit = math.ceil(min(1.0, max_train / max(1, n)) * buckets)

    @F.pandas_udf("boolean")
    def unwanted(html: pd.Series) -> pd.Series:
        return pd.Series([unwanted_page(h, seeds) for h in html], dtype=object)

    # one example a URL: a host with a third of all rows is no third of the sample
    picked = own.where((F.col("host") != "") & (F.pmod(F.xxhash64("host", "path"), F.lit(buckets)) < limit))
    picked = picked.select("host", "path", unwanted("html").cast("double").alias("y")).groupBy("host", "path").agg(F.avg("y").alias("y")).where("y IS NOT NULL")
    known = [(url_tokens(r.host, r.path, split), r.y >= 0.5) for r in sorted(picked.collect())]
    rows = [(tokens, y or any(t[0] in "hp" and t[2:] in seeds for t in tokens)) for tokens, y in known]
    rows += seed_examples(seeds, [tokens for tokens, _ in rows])
    shipped = spark.sparkContext.broadcast((split, train(rows)))

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        split, model = shipped.value
        return pd.Series([model.score(url_tokens(h, p, split)) if h else 0.0 for h, p in zip(hosts, paths, strict=True)])

    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("__verdict"), score("host", "path").alias("__score"))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("__verdict", F.when(F.col("__score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("__score")).alias("score"),
    )


def op5_url_filter(spark, sf_dir):
    """Contract query: every page's URL under the contract rules."""
    return judge(base.table(spark, sf_dir, "pages"))
