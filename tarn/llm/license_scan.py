"""License scan: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Lines such as "Released under the MIT License" count word for word. Longer templates are
aligned; versions and words that tell families apart must agree, whatever the coverage.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base
from tarn.llm import license_texts

_WORDS = re.compile(r"\w+")
_VERSION = re.compile(r"\b(?:version|v\.?)\s*(\d+(?:\.\d+)*)", re.I)
#: What a line of its own gives a license after; what parts the licenses of a choice; and what turns a line into its opposite.
_LABEL = re.compile(r"\b(?:SPDX[-\s]License[-\s]Identifier|licen[sc]e)[\"']?\s*[:=]\s*[\"'(\s]*", re.I)
_BETWEEN = re.compile(r"[\s,()\"'/]*(?:(?:and/or|and|or|as well as|with the option of)\b[\s(\"',]*|/\s*)(?:(?:at your option|alternatively|under|the|a)\b[\s,]*)*", re.I)
_EXCEPTION = re.compile(r"\s+with\s+[\w.-]+", re.I)
_EITHER = re.compile(r"\b(?:" + "|".join(license_texts.VERBS) + r")\s+under\s+(?:the\s+terms\s+of\s+)?(?:either|both|any)(?:\s+of)?:?\s+(?:the\s+|a\s+)?", re.I)
_NEGATED = re.compile(r"(?:\b(?:not|never|neither|no\s+longer|cannot)|n['\u2019]t)\s+(?:\w+\s+){0,2}$", re.I)
_CUES = ("license", "licence", "either", "both", "any", "under")
#: Templates of so many words at most are lines.
LINE_WORDS = 16
#: In templates of more words only the first few hold what must agree; only the neighbourhood of seeds is aligned.
_LONG_WORDS, _TITLE_WORDS, _MARGIN = 400, 12, 64


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _gram_hashes(terms: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` term numbers."""
    h = np.zeros(max(0, len(terms) - k + 1), np.uint64)
    for i in range(k if len(h) else 0):
        h = (h ^ terms[i : len(terms) - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of each window of ``window`` (the last one on ties); one place at least where there is a hash."""
    if not len(hashes):
        return []
    picked = {}
    for a in range(max(1, len(hashes) - window + 1)):
        part = hashes[a : a + window]
        picked[a + len(part) - 1 - int(part[::-1].argmin())] = True
    return list(picked)


@dataclass
class Index:
    """Templates as term numbers (from 1), and where each fingerprint stands in them."""

    names: list[str]
    licenses: list[str]
    terms: dict[str, int]
    texts: list[np.ndarray]
    prints: np.ndarray  # sorted hashes
    places: dict[int, list[tuple[int, int]]]  # (template, place); lines together, as template -1
    k: int
    lines: dict[bytes, int] = field(default_factory=dict)  # words of a line to its template
    lengths: list[int] = field(default_factory=list)  # of lines, falling
    marks: dict[int, frozenset[int]] = field(default_factory=dict)  # places of a longer template that must agree
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # words and their counts
    family: frozenset[int] = frozenset()
    numbers: frozenset[int] = frozenset()
    called: dict[tuple[str, ...], int] = field(default_factory=dict)  # words of a name or an identifier to a template
    by_license: dict[str, int] = field(default_factory=dict)
    longest_name: int = 0


def mark_places(text: str) -> frozenset[int]:
    """Places of the words that another license would not share: versions, words of families, and "later"."""
    words = list(_WORDS.finditer(text))
    spans = [m.span(1) for m in _VERSION.finditer(text)]
    first = len(words) if len(words) <= _LONG_WORDS else _TITLE_WORDS
    return frozenset(
        k for k, m in enumerate(words[:first])
        if m.group().lower() in license_texts.FAMILY_WORDS or m.group().lower() == "later" or any(a <= m.start() < b for a, b in spans)
    )


def build(templates=None, k: int = 4, window: int = 3) -> Index:
    """Any run of ``k + window - 1`` template words in a text holds a fingerprint of it; so does each template as a whole.

    Templates of equal words are one (the first); those of fewer than ``k`` words cannot be found and are left out.
    """
    terms: dict[str, int] = {}
    number = lambda w: terms.setdefault(w, len(terms) + 1)
    family = frozenset(number(w) for w in sorted(license_texts.FAMILY_WORDS))
    numbers = frozenset(number(str(n)) for n in range(1, 10))
    index = Index([], [], terms, [], np.zeros(0, np.uint64), {}, k, family=family, numbers=numbers)
    places: dict[int, dict[tuple[int, int], None]] = defaultdict(dict)
    known: set[bytes] = set()
    for name, license, text in license_texts.templates() if templates is None else templates:
        words = np.array([number(w) for w in words_of(text)], np.int64)
        if len(words) < k or words.tobytes() in known:
            continue
        known.add(words.tobytes())
        at = len(index.texts)
        index.names.append(name)
        index.licenses.append(license)
        index.texts.append(words)
        if line := len(words) <= LINE_WORDS:
            index.lines[words.tobytes()] = at
        else:
            index.marks[at] = mark_places(text)
            index.bags[at] = np.unique(words, return_counts=True)
        hashes = _gram_hashes(words, k)
        for p in winnow(hashes, window):
            places[int(hashes[p])][-1 if line else at, p] = None
    # names and identifiers alone, for labels and for what goes on after a line; no fingerprint leads to them
    for license, name in [*((i, i) for i in license_texts.identifiers()), *license_texts.names()] if templates is None else []:
        words = words_of(re.sub(r"^(?:the|a) ", "", name))
        if license not in index.by_license:
            index.by_license[license] = len(index.texts)
            index.names.append(f"name:{license}")
            index.licenses.append(license)
            index.texts.append(np.array([number(w) for w in words], np.int64))
        index.called.setdefault(tuple(words), index.by_license[license])
    index.longest_name = max(map(len, index.called), default=0)
    for w in _CUES:
        number(w)
    index.lengths = sorted({len(index.texts[t]) for t in index.lines.values()}, reverse=True)
    index.prints, index.places = np.array(sorted(places), np.uint64), {h: list(p) for h, p in places.items()}
    return index


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """``matched words, first, last + 1`` of ``aligned``."""
    pairs = aligned(text, template, diagonal, band, match, mismatch, gap)
    return (len(pairs), pairs[0][0], pairs[-1][0] + 1) if pairs else (0, 0, 0)


def aligned(text: np.ndarray, template: np.ndarray, diagonal: int, band: int, match: int = 2, mismatch: int = -1, gap: int = -1) -> list[tuple[int, int]]:
    """The matched words (text place, template place) of the best local alignment within ``band`` of the diagonal ``text place - template place``.

    A row of the band is computed at once: steps along the text are a running maximum. Ties prefer a diagonal step, then one in the text.
    """
    low, width = diagonal - band, 2 * band + 1
    # column c of row t stands for text place t + low + c (from 0); the same column one row up is one text word earlier
    score = np.zeros((len(template) + 1, width + 1), np.int64)
    ramp = -gap * np.arange(width)
    padded = np.concatenate([np.full(max(0, -low), -1), text, np.full(max(0, low + len(template) + width - len(text)), -1)]) if len(template) else text
    shift = low + max(0, -low)
    best, end = 0, (0, 0)
    for t in range(1, len(template) + 1):
        part = padded[t - 1 + shift : t - 1 + shift + width]
        above = score[t - 1]
        value = np.maximum(above[:width] + np.where(part == template[t - 1], match, mismatch), above[1:] + gap)
        value = np.maximum.accumulate(np.maximum(value, 0) + ramp) - ramp
        value[part < 0] = 0
        score[t, :width] = value
        top = int(value.max())
        if top > best:
            best, end = top, (t, int(value.argmax()))
    t, c = end
    pairs = []
    while t > 0 and score[t, c] > 0:
        p = t - 1 + low + c
        same = 0 <= p < len(text) and text[p] == template[t - 1]
        if score[t, c] == score[t - 1, c] + (match if same else mismatch):
            if same:
                pairs.append((p, t - 1))
            t -= 1
        elif c and score[t, c] == score[t, c - 1] + gap:
            c -= 1
        else:
            t, c = t - 1, c + 1
    return pairs[::-1]


def joined(pieces: list[list[tuple[int, int]]], reach: int) -> list[list[tuple[int, int]]]:
    """Chains of aligned pieces that follow each other in text and template, as matched words.

    What two neighbours share counts once; a chain spans at most ``reach`` words of the text. Each piece ends the best chain it can.
    """
    pieces = sorted({tuple(p) for p in pieces if p}, key=lambda p: (p[0], p[-1]))
    ends = [(p[0][0], p[-1][0] + 1, p[0][1], p[-1][1] + 1) for p in pieces]
    best: list[tuple[int, int, int]] = []  # matched words, first text place, piece before
    for k, (first, last, begin, stop) in enumerate(ends):
        chain = (len(pieces[k]), first, -1)
        for j, (_, last_, _, stop_) in enumerate(ends[:k]):
            total, start, _ = best[j]
            if ends[j][0] < first and last_ < last and ends[j][2] < begin and stop_ < stop and last - start <= reach:
                chain = max(chain, (total + len(pieces[k]) - max(0, last_ - first, stop_ - begin), start, j))
        best.append(chain)
    out = []
    for k in range(len(pieces)):
        path, at = [], k
        while at >= 0:
            path.append(at)
            at = best[at][2]
        pairs: list[tuple[int, int]] = []
        for at in reversed(path):
            p, t = pairs[-1] if pairs else (-1, -1)
            pairs += [x for x in pieces[at] if x[0] > p and x[1] > t]
        out.append(pairs)
    return out


def _agrees(index: Index, template: int, terms: np.ndarray, pairs: list[tuple[int, int]]) -> bool:
    """Whether all marks of the template are matched, and no word between two neighbours of it makes it another license."""
    if not index.marks[template] <= {t for _, t in pairs}:
        return False
    for (p, t), (q, u) in zip(pairs[:-1], pairs[1:], strict=True):
        if u == t + 1 and 1 < q - p <= 4:
            between = terms[p + 1 : q].tolist()
            if not index.family.isdisjoint(between) or (t in index.marks[template] and between[0] in index.numbers):
                return False
    return True


def _runs(seeds: list[tuple[int, int]], band: int, reach: int) -> list[list[tuple[int, int]]]:
    """Seeds ``(diagonal, text place)`` in text order, parted into runs that stay near one diagonal and within a reach of the text."""
    runs: list[list[tuple[int, int]]] = []
    last: dict[int, int] = {}  # by band of diagonals, the run that was there last
    for diagonal, place in seeds:
        own = diagonal // (band + 1)
        near = [r for b in (own, own - 1, own + 1) if (r := last.get(b)) is not None and abs(runs[r][-1][0] - diagonal) <= band and place - runs[r][0][1] <= reach]
        if near:
            r = max(near)
            runs[r].append((diagonal, place))
        else:
            r = len(runs)
            runs.append([(diagonal, place)])
        last[own] = r
    return runs


def _room(run: list[tuple[int, int]], k: int, length: int, band: int, n_terms: int) -> tuple[int, int, int, int, int]:
    """The part of a long template that is aligned for a run, its diagonal, and the part of the text."""
    a, b = max(0, min(p - d for d, p in run) - _MARGIN), min(length, max(p - d for d, p in run) + k + _MARGIN)
    diagonal = sorted(d for d, _ in run)[len(run) // 2]
    return a, b, diagonal, max(0, a + diagonal - band), min(n_terms, b + diagonal + band)


def _chains(runs: list[list[tuple[int, int]]], extent: np.ndarray, reach: int, least: float) -> Iterator[list[int]]:
    """Runs that follow each other in text and template, most seeds first; each chain whose ``extent``, of words that may match, is ``least`` or more.

    A copy of a template gives one run for each stretch between insertions; its inner repeats give runs across it, which are in no chain with it and are not
    aligned. What lies in the text of a chain is settled with it.
    """
    first, last = np.array([r[0][1] for r in runs]), np.array([r[-1][1] for r in runs])
    low, high = np.array([min(p - d for d, p in r) for r in runs]), np.array([max(p - d for d, p in r) for r in runs])
    weight = np.array([len(r) for r in runs])
    alive = np.argsort(first, kind="stable")
    while len(alive):
        best, width, start, back = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), first[alive].copy(), np.full(len(alive), -1)
        f, e, a, b = first[alive], last[alive], low[alive], high[alive]
        for i in range(len(alive)):
            ok = np.flatnonzero((f[:i] < f[i]) & (e[:i] < e[i]) & (a[:i] < a[i]) & (b[:i] < b[i]) & (e[i] - start[:i] <= reach))
            best[i], width[i] = weight[alive[i]], extent[alive[i]]
            if len(ok):
                j = ok[int(best[ok].argmax())]
                best[i], start[i], back[i] = best[i] + best[j], start[j], j
                width[i] += int(width[ok].max())
        if width.max() < least:
            return
        at, chain = int(best.argmax()), []
        while at >= 0:
            chain.append(int(alive[at]))
            at = int(back[at])
        chain.reverse()
        if extent[chain].sum() >= least:
            yield chain
        inside = (first[alive] >= first[chain[0]]) & (last[alive] <= last[chain[-1]])
        alive = alive[~inside]


def _short_pieces(index: Index, template: int, terms: np.ndarray, runs: list[list[tuple[int, int]]], reach: int, least: float, piece) -> list[list[tuple[int, int]]]:
    """The alignments of the runs of a template that is aligned whole, most seeds first.

    Left out are runs round which the text, as far as a chain reaches, lacks the template's words in any order, and runs in the text of an
    alignment that is a match by itself.
    """
    words, times = index.bags[template]
    place = np.full(len(index.terms) + 1, -1)
    place[words] = np.arange(len(words))
    at = place[terms]
    pieces: list[list[tuple[int, int]]] = []
    settled: list[tuple[int, int]] = []
    for run in sorted(runs, key=lambda r: (-len(r), r[0][1])):
        first, last = run[0][1], run[-1][1]
        if any(a <= first and last < b for a, b in settled):
            continue
        near = at[max(0, first - reach) : last + index.k + reach]
        if np.minimum(np.bincount(near[near >= 0], minlength=len(words)), times).sum() < least:
            continue
        pairs = piece(run, False)
        pieces.append(pairs)
        if len(pairs) >= least:
            settled.append((pairs[0][0], pairs[-1][0] + 1))
    return pieces


def _places(index: Index, terms: np.ndarray, min_coverage: float, band: int) -> list[tuple[int, int, float, int, int, float]]:
    """``template, matched words, coverage, first, last + 1, share`` in words of a text; overlapping matches included."""
    hashes = _gram_hashes(terms, index.k)
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    starts = set()
    for p in np.flatnonzero(np.isin(hashes, index.prints)).tolist():
        for template, place in index.places[int(hashes[p])]:
            if template < 0:
                starts.add(p - place)
            else:
                seeds[template].append((p - place, p))
    found = []
    for s in sorted(starts):
        for n in index.lengths:
            if s >= 0 and s + n <= len(terms) and (template := index.lines.get(terms[s : s + n].tobytes())) is not None:
                found.append((template, n, 1.0, s, s + n, 1.0))
                break
    counts = np.bincount(terms, minlength=len(index.terms) + 1) if seeds else None
    for template, own in seeds.items():
        goal, length = index.texts[template], len(index.texts[template])
        words, times = index.bags[template]
        if np.minimum(counts[words], times).sum() < min_coverage * length:
            continue  # the whole text lacks the words, in any order
        own.sort(key=lambda s: (s[1], s[0]))
        runs, reach = _runs(own, band, 2 * length), 2 * length + band
        done: dict[tuple, list[tuple[int, int]]] = {}

        def piece(run, long, goal=goal, length=length, done=done):
            """The alignment of the words around a run; of equal words it is made once."""
            if long:
                a, b, diagonal, lo, hi = _room(run, index.k, length, band, len(terms))
            else:
                a, b, diagonal = 0, length, sorted(d for d, _ in run)[len(run) // 2]
                lo, hi = max(0, diagonal - band), min(len(terms), length + diagonal + band)
            key = (a, b, diagonal - lo, terms[lo:hi].tobytes())
            if key not in done:
                done[key] = aligned(terms[lo:hi], goal[a:b], diagonal + a - lo, band)
            return [(lo + p, a + t) for p, t in done[key]]

        if length > _LONG_WORDS:
            extent = np.zeros(len(runs), np.int64)  # words that the two parts share, in any order
            for r, run in enumerate(runs):
                a, b, _, lo, hi = _room(run, index.k, length, band, len(terms))
                extent[r] = np.minimum(*(np.bincount(x, minlength=len(index.terms) + 1)[1:] for x in (goal[a:b], terms[lo:hi]))).sum()
            groups = [[piece(runs[r], True) for r in chain] for chain in _chains(runs, extent, reach, min_coverage * length)]
        else:
            groups = [_short_pieces(index, template, terms, runs, reach, min_coverage * length, piece)]
        for pieces in groups:
            for pairs in joined(pieces, reach):
                if len(pairs) >= min_coverage * length and _agrees(index, template, terms, pairs):
                    first, last = pairs[0][0], pairs[-1][0] + 1
                    found.append((template, len(pairs), len(pairs) / length, first, last, len(pairs) / (last - first)))
    return found


def _named(index: Index, text: str, at: int) -> tuple[int, int, int] | None:
    """``template, words, end`` of the longest name or identifier of a license that starts at a place of the text; a "+" after it means "or later"."""
    words = []
    for m in _WORDS.finditer(text, at):
        # a name goes on over spaces, hyphens, points and commas only
        if (m.start() > at if not words else re.search(r"[^\s.,-]|\n\s*\n", text[words[-1].end() : m.start()])) or len(words) == index.longest_name:
            break
        words.append(m)
    for n in range(len(words), 0, -1):
        template = index.called.get(tuple(m.group().lower() for m in words[:n]))
        end = words[n - 1].end()
        if template is not None and not re.match(r"\.\d|-\w", text[end : end + 2]):
            return _or_later(index, text, template, end) + (n,) if text[end : end + 1] == "+" else (template, end, n)
    return None


def _or_later(index: Index, text: str, template: int, end: int) -> tuple[int, int]:
    later = license_texts.has_later(index.licenses[template])
    return (index.by_license[later], end + 1) if later in index.by_license else (template, end)


def _choices(index: Index, text: str, at: int) -> Iterator[tuple[int, int, float, int, int, float]]:
    """Licenses named one after another from a place on, parted by "and", "or" and the like; an exception after "with" is passed over."""
    while (found := _named(index, text, at)) is not None:
        template, end, n = found
        yield template, n, 1.0, at, end, 1.0
        if m := _EXCEPTION.match(text, end):
            end = m.end()
        m = _BETWEEN.match(text, end)
        if not m:
            return
        at = m.end()


def _ruled(index: Index, text: str, spans: list[tuple[int, int, float, int, int, float]]) -> list[tuple[int, int, float, int, int, float]]:
    """Lines with what their neighbourhood makes of them: negated ones go, a "+" means "or later", further licenses of a choice are added; and labels, by rule."""
    out = []
    for f in spans:
        if f[0] in index.marks:
            out.append(f)
            continue
        if re.match(r"\.\d", text[f[4] : f[4] + 2]) or _NEGATED.search(text[max(0, f[3] - 40) : f[3]]):
            continue  # a number that goes on names another version
        template, end = _or_later(index, text, f[0], f[4]) if text[f[4] : f[4] + 1] == "+" else (f[0], f[4])
        out.append((template, *f[1:4], end, f[5]))
        if m := _BETWEEN.match(text, end):
            out += _choices(index, text, m.end())
    for pattern in (_LABEL, _EITHER):
        for m in pattern.finditer(text):
            if not _NEGATED.search(text[max(0, m.start() - 40) : m.start()]):
                out += _choices(index, text, m.end())
    return out


def scan(index: Index, text: str, min_coverage: float, band: int, terms: np.ndarray | None = None) -> list[tuple[int, int, float, int, int, float]]:
    """``template, matched words, coverage, start, end, share`` of a text; start and end in code points.

    ``share`` is the share of the span's words that are matched.
    """
    words = None
    if terms is None:
        words = list(_WORDS.finditer(text))
        terms = np.fromiter((index.terms.get(m.group().lower(), 0) for m in words), np.int64, len(words))
    found = _places(index, terms, min_coverage, band)
    words = words or (list(_WORDS.finditer(text)) if found else [])
    spans = _ruled(index, text, [(t, m, c, words[a].start(), words[b - 1].end(), share) for t, m, c, a, b, share in found])
    # of overlapping matches the one stays with most matched words less the template's unmatched ones, then the better covered, then the first template
    spans.sort(key=lambda f: (len(index.texts[f[0]]) - 2 * f[1], -f[2], f[0], f[3]))
    kept: list[tuple[int, int, float, int, int, float]] = []
    for f in spans:
        if all(f[4] <= g[3] or g[4] <= f[3] for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[3], f[0]))


_OUT = "doc_id long, template string, license string, matched_words long, coverage double, start long, stop long, text_share double"


def license_matches(
    docs: DataFrame, index: Index | None = None, min_coverage: float = 0.8, band: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, template, license, matched_words, coverage, start, stop, text_share``: a row for each license text in each whole document.

    A document whose words hold a fingerprint of a template is a candidate for it. A template
    of at most ``LINE_WORDS`` words must stand in the text word for word, and a number at its end
    must not go on (".1"); a "+" there means "or later", a negation before it rules it out, and
    licenses that follow after "or" or "and" are reported too. SPDX lines, labels ("License: MIT")
    and "under either of" are read by rule: a name or an identifier of the list must follow. Of a longer one the banded alignment of the words around its seeds
    must match ``min_coverage`` of the words, among them all versions, words of families and
    "later" (of a whole legal text those of its title); a word such as "Affero" put between two
    matched ones rules it out, so that a license that is not in the index is not taken for its
    sibling. Runs that an insertion of any kind parts are joined, within twice the template's
    length. Of matches that overlap, the one with most matched words less the template's
    unmatched ones is reported; a document may hold several. ``start`` and ``stop`` are code
    points, end exclusive; ``text_share`` is the share of the span's words that are matched.

    Null and empty texts have no match. Null ids are reported as null, repeated rows
    each. Very long texts are read in slices of bounded bytes, a text at least. Other
    columns are ignored; an empty table gives an empty one. The index holds
    the templates alone, whose number the caller sets; it is broadcast.
    """
    spark = docs.sparkSession
    index = index or build()
    shipped = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        get = index.terms.get
        cued, chosen, under = (np.zeros(len(index.terms) + 2, bool) for _ in range(3))
        cued[[get("license"), get("licence")]] = chosen[[get("either"), get("both"), get("any")]] = under[get("under")] = True
        for part in (part for batch in batches for part in base.slices(batch)):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            # all documents' words in one array, with a word of no template between documents
            lists = [words_of(t) for t in texts]
            size = np.array([len(x) + 1 for x in lists], np.int64)
            terms = np.concatenate([np.zeros(0, np.int64), *[np.fromiter((*map(get, x, repeat(0)), 0), np.int64, len(x) + 1) for x in lists]])
            live = terms > 0
            run_of_k = np.ones(max(0, len(terms) - index.k + 1), bool)
            for i in range(index.k):
                run_of_k &= live[i : len(terms) - index.k + 1 + i]
            starts = np.flatnonzero(run_of_k)
            grams = terms[starts[:, None] + np.arange(index.k)].reshape(-1) if len(starts) else np.zeros(0, np.int64)
            hashes = _gram_hashes(grams, index.k)[:: index.k]
            hit = np.concatenate([starts[np.isin(hashes, index.prints)], np.flatnonzero(cued[terms]), np.flatnonzero(under[terms[:-1]] & chosen[terms[1:]])])
            stop, rows = np.cumsum(size), []
            for k in np.unique(np.searchsorted(stop, hit, "right")).tolist():
                own = terms[stop[k] - size[k] : stop[k] - 1]
                rows += [(ids[k], index.names[t], index.licenses[t], m, c, a, b, s) for t, m, c, a, b, s in scan(index, texts[k], min_coverage, band, own)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            names = ["doc_id", "template", "license", "matched_words", "coverage", "start", "stop", "text_share"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(base.frugal(run), _OUT)


def op4_license_scan(spark, sf_dir):
    """All license texts of ``documents``."""
    return license_matches(base.table(spark, sf_dir, "documents"))
