"""Personal data by weak supervision, in DataFrame functions only.

Regex, gazetteer and context labelers vote on candidate spans; expectation
maximisation over the counts of vote patterns estimates how reliable each labeler
is; the resulting soft labels train a naive Bayes span classifier, which decides
on the candidates that the base patterns alone do not settle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

#: Kinds in the order that sorts spans of one start.
KINDS = ("email", "ip", "card", "phone", "name", "secret", "address")
BASE_KINDS = KINDS[:4]

_LOCAL = r"[A-Za-z0-9._%+-]"
_HOST = r"[A-Za-z0-9-]"
_LABEL = r"(?i:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key|credential)s?"
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Ct|Square|Sq|Terrace|Way"


@dataclass(frozen=True)
class Pattern:
    """A regex labeler. A text with a match holds one of ``needs`` (where there are any) and matches ``gate``: others are not searched."""

    kind: str
    regex: str
    needs: tuple[str, ...] = ()
    gate: str | None = None


# Possessive loops keep the engine's stack flat and its time linear on long runs. Where a run cannot start a match at its
# first character it cannot at a later one either, so only run starts and the end of the previous match are tried.
PATTERNS = (
    Pattern("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", ("@",)),
    Pattern("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", gate=r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    # matches of fewer than 14 digits are neither spans nor candidates
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++", gate=r"[0-9](?:[\x20-]?[0-9]){13}"),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
    # candidates for the classifier only
    Pattern("email", rf"(?<!{_LOCAL}){_LOCAL}++ ?[(\[]at[)\]] ?{_HOST}++(?: ?(?:[(\[]dot[)\]]|\.) ?{_HOST}++)++", ("(at)", "[at]", "(at]", "[at)")),
    Pattern("phone", r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", gate=r"[0-9]{3}[ .-][0-9]{4}"),
    Pattern("name", r"\b(?:Mrs?|Ms|Dr|Prof)\b\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", ("Mr", "Ms", "Dr", "Prof")),
    Pattern(
        "secret", rf"(?<=\b{_LABEL}[\x22']?\s{{0,2}}[:=]\s{{0,2}}[\x22']?)(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{8,}}+",
        ("oken", "ecret", "assw", "redential", "OKEN", "ECRET", "ASSW", "REDENTIAL", "key", "Key", "KEY"), "[:=]",
    ),
    Pattern("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])", ("AKIA", "gh", "sk-", "xox")),
    Pattern("address", rf"(?<![0-9])[0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}(?:{_STREET})\b", gate=r"[0-9] [A-Z][a-z]"),
)
_N_BASE = len(BASE_KINDS)
_UNSURE = (6, 7)  # patterns that only name a candidate
_CONTEXT = 28  # characters before a span that the context labeler sees


@dataclass(frozen=True)
class Gazetteers:
    """Lists and rules of the gazetteer labelers."""

    #: Any country code of two letters, and these.
    domains: tuple[str, ...] = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "online", "site", "shop", "cloud", "tech", "blog", "eu")
    #: Country calling codes by the zones of the numbering plan.
    dialling: str = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9])"
    issuers: str = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30[0-5])"
    streets: tuple[str, ...] = ("street", "avenue", "road", "lane", "boulevard", "drive", "square", "terrace", "court")
    first_names: tuple[str, ...] = tuple(
        "adam ahmed alan albert alex alice amy ana andrea andrew angela ann anna anne anthony antonio barbara ben benjamin bernard bob brian carl carlos "
        "carmen carol catherine charles charlotte chris christian christine claire clara claudia daniel david deborah diana donald dorothy edward elena "
        "elisabeth elizabeth ellen emily emma eric ernst eva fatima felix francis francisco frank fred friedrich george gerald grace hannah hans harry "
        "helen helga henry hugo ines ingrid isabel ivan jack jacob james jan jane janet jason javier jean jennifer jessica jim joan joe john jonathan "
        "jorge jose joseph juan judith julia julie karen karl katharina kate kevin klaus larry laura lee leo linda lisa louis louise lucas lucia luis "
        "manuel marc marcel margaret maria marie mark marta martin mary matthew max michael miguel mohammed monica nancy nicholas nicole nina olga oliver "
        "oscar otto pablo patricia patrick paul pedro peter philip pierre rachel ralf ramon raymond rebecca richard robert roger rosa ruth samuel sandra "
        "sara sarah scott sofia sophie stephen steven susan sylvia teresa thomas tim ursula victor vincent walter werner william yusuf yves".split()
    )


_CUES = {
    "email": r"\b(e-?mail|mail|contact|write|reach)\b",
    "ip": r"\b(ip|host|server|address|from|login)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"\b(call|phone|tel|telephone|mobile|cell|fax|contact|dial)\b",
    "name": r"\b(name|dear|signed|patient|by|from|contact)\b",
    "secret": r"(token|secret|passw|key|credential|bearer|auth)",
    "address": r"\b(live|lives|living|address|at|home|located|ship|visit|office)\b",
}
_ANTI_CUES = r"\b(version|ver|order|isbn|issn|build|release|serial|ticket|invoice|section|chapter|doi)\W*$"


def _hits(text: Column, number: int) -> Column:
    """All matches of a pattern: ``array<struct<pat, i, gap, m, before>>``; ``gap`` is the length of the text since the last one."""
    own = PATTERNS[number]
    pattern = own.regex
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    found = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(number).alias("pat"),
            i.alias("i"),
            F.length(z["1"]).alias("gap"),
            z["0"].alias("m"),
            F.lower(F.right(z["1"], F.lit(_CONTEXT))).alias("before"),
        ),
    )
    found = F.filter(found, lambda h: h["m"].isNotNull())
    worth = [reduce(lambda a, b: a | b, [text.contains(n) for n in own.needs])] if own.needs else []
    worth += [text.rlike(own.gate)] if own.gate else []
    return F.when(reduce(lambda a, b: a & b, worth), found)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(pat: Column, match: Column) -> Column:
    """Whether a base pattern's match is a base span."""
    n = F.length(_digits(match))
    small = F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(pat == 0, F.lit(True))
        .when(pat == 1, small)
        .when(pat == 2, F.when(n.between(14, 19), luhn(_digits(match))).otherwise(F.lit(False)))
        .when(pat == 3, n.between(10, 15))
        .otherwise(F.lit(False))
    )


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table ``rid, doc_id, hits``: one row per document and no text; the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.concat(*[F.coalesce(_hits(F.col("t"), k), F.expr("array()").cast(_HITS)) for k in range(len(PATTERNS))])
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    return base.written(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", hits.alias("hits")), "pii-hits")


_HITS = "array<struct<pat: int, i: int, gap: int, m: string, before: string>>"


def _located(found: DataFrame, lists: Gazetteers) -> DataFrame:
    """A row for each base span or candidate: its place in code points, its votes and features."""
    rows = found.where(F.size("hits") > 0).select("rid", F.inline("hits"))
    rows = rows.selectExpr("*", "sum(gap + length(m)) OVER (PARTITION BY rid, pat ORDER BY i) AS stop")
    kind = F.element_at(F.array(*[F.lit(p.kind) for p in PATTERNS]), F.col("pat") + 1)
    rows = rows.select(
        "rid", "pat", kind.alias("kind"), (F.col("stop") - F.length("m")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
        "m", "before", _passes(F.col("pat"), F.col("m")).alias("is_base"),
    )
    digits = _digits(F.col("m"))
    # of failed base matches only those of a card's length are worth a vote
    rows = rows.where(F.col("is_base") | (F.col("pat") >= _N_BASE) | ((F.col("pat") == 2) & F.length(digits).between(14, 19)))
    lower = F.lower(F.col("m"))
    last = F.regexp_extract(lower, r"([a-z0-9-]+)$", 1)
    by_kind = lambda **v: F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in v.items()])
    sign = lambda yes, no=0: F.when(yes, F.lit(1)).otherwise(F.lit(no))
    regex = F.when(F.col("is_base"), 1).when(F.col("kind") == "card", -1).when(F.col("pat").isin(*_UNSURE), 0).otherwise(1)
    gazetteer = by_kind(
        email=sign(last.isin(*lists.domains) | last.rlike("^[a-z]{2}$")),
        ip=sign(~F.col("m").rlike(r"^0*(0|22[4-9]|2[345][0-9])\."), -1),
        card=sign(digits.rlike(lists.issuers), -1),
        phone=sign(F.col("m").rlike(lists.dialling)),
        name=sign(F.regexp_extract(lower, r"^\w+\.? (\w+)", 1).isin(*lists.first_names)),
        # a key of known form; else a value with letters and digits, which is no word
        secret=sign(~F.col("pat").isin(*_UNSURE) | (F.length(digits) >= 4) & (F.length(F.regexp_replace("m", "[^A-Za-z]", "")) >= 4), -1),
        address=sign(last.isin(*lists.streets)),
    )
    cue = by_kind(**{k: F.col("before").rlike(p) for k, p in _CUES.items()})
    context = F.when(F.col("before").rlike(_ANTI_CUES), -1).when(cue, 1).otherwise(0)
    return rows.select(
        "rid", "kind", "start", "stop", "is_base",
        regex.cast("int").alias("v_regex"), gazetteer.cast("int").alias("v_gaz"), context.cast("int").alias("v_ctx"),
        F.least(F.floor(F.length("m") / 6), F.lit(5)).cast("int").alias("f_len"),
        F.when(F.col("before") == "", "start").when(F.col("before").rlike(r"\s$"), "space").when(F.col("before").rlike(r"\w$"), "word").otherwise("mark").alias("f_edge"),
    )


_VOTES = ("v_regex", "v_gaz", "v_ctx")
_FEATURES = ("kind", *_VOTES, "f_len", "f_edge")


@dataclass
class Reliability:
    """By kind: the share of true spans; by kind, labeler, truth and vote: the vote's probability."""

    prior: dict[str, float]
    votes: dict[tuple, float]

    def posterior(self, kind: str, votes: tuple[int, ...]) -> float:
        yes, no = math.log(self.prior[kind]), math.log(1 - self.prior[kind])
        for j, v in enumerate(votes):
            yes += math.log(self.votes[kind, j, 1, v])
            no += math.log(self.votes[kind, j, 0, v])
        return 1 / (1 + math.exp(min(700.0, no - yes)))


def expectation_maximisation(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50, smooth: float = 1.0) -> Reliability:
    """Two-class Dawid-Skene over counts of ``(kind, votes)``; votes are -1, 0 (abstains) or 1. Starts from the majority."""
    kinds = sorted({k for k, _ in patterns})
    weight = {p: min(0.95, max(0.05, 0.5 + 0.3 * sum(p[1]))) for p in patterns}
    model = Reliability({}, {})
    for _ in range(rounds):
        for kind in kinds:
            own = [(p, n) for p, n in patterns.items() if p[0] == kind]
            true, total = sum(weight[p] * n for p, n in own), sum(n for _, n in own)
            model.prior[kind] = (true + smooth) / (total + 2 * smooth)
            for j in range(len(own[0][0][1])):
                for truth in (0, 1):
                    share = {v: smooth * (1.5 if v == (1 if truth else -1) else 0.75) for v in (-1, 0, 1)}
                    for p, n in own:
                        share[p[1][j]] += n * (weight[p] if truth else 1 - weight[p])
                    for v, x in share.items():
                        model.votes[kind, j, truth, v] = x / sum(share.values())
        weight = {p: model.posterior(*p) for p in patterns}
    return model


def train_span_classifier(rows: list[dict], model: Reliability, smooth: float = 1.0) -> dict[tuple, float]:
    """Naive Bayes on soft labels: the probability of each row's features; rows are feature values with a count ``n``."""
    soft = [model.posterior(r["kind"], tuple(r[v] for v in _VOTES)) for r in rows]
    mass: dict[tuple, float] = {}
    total = {1: smooth, 0: smooth}
    for r, p in zip(rows, soft, strict=True):
        for truth, w in ((1, p * r["n"]), (0, (1 - p) * r["n"])):
            total[truth] += w
            for f in _FEATURES:
                key = (truth, f, r[f] if f == "kind" else (r["kind"], r[f]))
                mass[key] = mass.get(key, 0.0) + w
    out = {}
    for r in rows:
        odds = math.log(total[1]) - math.log(total[0])
        for f in _FEATURES:
            value = r[f] if f == "kind" else (r["kind"], r[f])
            within = lambda t, r=r, f=f: total[t] + smooth if f == "kind" else mass.get((t, "kind", r["kind"]), 0.0) + smooth
            odds += math.log((mass.get((1, f, value), 0.0) + smooth / 4) / within(1)) - math.log((mass.get((0, f, value), 0.0) + smooth / 4) / within(0))
        out[tuple(r[f] for f in _FEATURES)] = 1 / (1 + math.exp(max(-700.0, min(700.0, -odds))))
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """One row per input row: ``doc_id, base, spans``, arrays of ``struct<start, kind_no, stop>`` in code points, sorted.

    ``base`` holds what the base patterns find; ``spans`` adds the candidates whose
    classifier probability reaches ``threshold`` and that overlap no base span. The
    two models are fitted on counts by vote pattern and by feature values, over all
    documents; their number is bounded by the label and feature sets, not by the
    input. Arrays belong to one document each.

    Kinds beyond the base ones are names after titles, secrets (values after a label such as
    "token =", and keys of known form) and street addresses.

    A null text is empty; empty texts give empty arrays. Texts are read whole, however long. Null and repeated ids stay
    apart, since rows are told apart by their place in the written table. Other
    columns are ignored, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    found = found_spans(docs, id_col, text_col)
    spans = base.written(_located(found, lists), "pii-spans")
    counts = [r.asDict() for r in spans.groupBy(*_FEATURES).agg(F.count("*").alias("n")).collect()]
    patterns: dict = {}
    for r in counts:
        key = (r["kind"], tuple(r[v] for v in _VOTES))
        patterns[key] = patterns.get(key, 0) + r["n"]
    chosen = train_span_classifier(counts, expectation_maximisation(patterns))
    table = base.small_table(
        spark, [(*k, p) for k, p in chosen.items()], "kind string, v_regex int, v_gaz int, v_ctx int, f_len int, f_edge string, p double"
    )
    kind_no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    scored = spans.join(F.broadcast(table), list(_FEATURES), "left").where(F.col("is_base") | (F.col("p") >= threshold))
    by_doc = scored.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", kind_no.alias("kind_no"), "stop", "is_base"))).alias("all"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["stop"].alias("stop"))
    by_doc = by_doc.select("rid", F.filter("all", lambda s: s["is_base"]).alias("b"), F.filter("all", lambda s: ~s["is_base"]).alias("c"))
    free = F.filter("c", lambda c: ~F.exists("b", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    by_doc = by_doc.select("rid", F.transform("b", plain).alias("b"), F.transform(free, plain).alias("c"))
    none = F.expr("array()").cast("array<struct<start: bigint, kind_no: int, stop: bigint>>")
    return found.select("rid", "doc_id").join(by_doc, "rid", "left").select(
        "doc_id",
        F.coalesce("b", none).alias("base"),
        F.coalesce(F.when(F.size("c") > 0, F.array_sort(F.array_distinct(F.concat("b", "c")))).otherwise(F.col("b")), none).alias("spans"),
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_pii(spark, sf_dir):
    """Contract query over whole texts of ``documents``; ``n_spans`` counts all spans, added ones too."""
    found = detect(base.table(spark, sf_dir, "documents"))
    of_kind = lambda number: lambda s: s["kind_no"] == number  # noqa: E731  (a second parameter would be the index)
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
