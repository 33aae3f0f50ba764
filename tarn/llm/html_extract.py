"""HTML extraction by tag-path ratios: text and punctuation per root-to-leaf path, smoothed over the tree, fused and cut at a threshold."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base

#: A path counts as content from this share of the page's best fused ratio on.
LEAST_SHARE = 0.03
#: Of paths outside the article element; and, on a page that has none, outside the container with most text.
OUTSIDE = 0.05
OUTSIDE_CONTAINER = 0.2
#: Of a path's ratio what its own blocks say; the rest is its container's. Headings take their container's.
OWN = 0.5

#: Elements that start and end a block of text; all others stand within one.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
_RAW = frozenset("script style title textarea iframe noembed noscript noframes template svg".split())
#: Never article text.
_NEVER = frozenset("nav footer aside button select option optgroup datalist dialog menu audio video canvas object map label legend".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())

#: Words of classes and ids that name what surrounds an article.
_AROUND = frozenset(
    "advert adverts advertisement advertisements advertising adsense adbox adslot adunit ad ads sponsor sponsors sponsored promo promos promotion banner banners nav navbar navigation navi menu menus submenu "
    "breadcrumb breadcrumbs crumbs sidebar side rail widget widgets footer colophon copyright masthead cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay toast newsletter subscribe "
    "subscription signup login signin search share sharing social related recommended recommendations trending popular teaser teasers outbrain taboola pagination pager toolbar skip hidden printonly invisible".split()
)
_COMMENTS = frozenset("comment comments commentlist commentary reply replies disqus respond responses discussion".split())
_HEADER = frozenset("header topbar".split())
#: Words that say that an element goes with a thing, not that it is one; and that a header is the article's own.
_WITH = frozenset("has with no without layout open enabled".split())
_OF_ARTICLE = frozenset("article entry post story content".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"  # a quote that nothing closes
    r"|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
_NO_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Start tags close an open element of these, if no element of the second set lies between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_IMPLIED |= {"thead": _IMPLIED["tbody"], "tfoot": _IMPLIED["tbody"]}
#: An end tag reaches no further than these, unless it ends one of them.
_FENCES = {"li": frozenset(("ul", "ol", "menu", "dir"))}
_CELLS = frozenset("td th table".split())
_TABLE = frozenset("td th tr tbody thead tfoot table".split())


@dataclass(frozen=True)
class _Kind:
    """What a start tag says: its label in paths, and whether its content is out for certain, is named like what surrounds articles or like a header, or is the article."""

    label: str
    out: bool
    around: bool
    comments: bool
    header: bool
    main: bool


def _kind(tag: str, attributes: str) -> _Kind:
    values = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t") else {}
    tokens = f"{values.get('class', '')} {values.get('id', '')}".split()
    label = ".".join([tag, *sorted({w for t in tokens if (w := re.sub(r"\d+", "", t))})])
    role = values.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower()
    out = tag in _NEVER or role in _ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _NO_STYLE.search(values.get("style", "")) is not None
    around = comments = False
    header = tag == "header"
    if tag not in ("html", "body"):
        for token in tokens:
            words = {w.lower() for w in _WORD.findall(token)}
            if words & _WITH:
                continue
            comments |= bool(words & _COMMENTS)
            around |= not main and bool(words & _AROUND)
            header |= tag not in _HEADINGS and bool(words & _HEADER) and not words & _OF_ARTICLE
    return _Kind(label, out, around or comments, comments, header, main and not comments)


@dataclass
class Page:
    """Blocks of text in page order, each with the path of its element; paths are numbered, each with its parent and label."""

    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[str] = field(default_factory=lambda: [""])
    within: list[bool] = field(default_factory=lambda: [False])  # below an article or main element
    text: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    fence: list[int] = field(default_factory=list)


def parse(html: str, kinds: dict[tuple[str, str], _Kind] | None = None) -> Page:
    """The blocks of a page but for those that are out for certain. Tag soup is read as browsers do where that matters: implied ends, stray ends, raw text.

    Elements named like what surrounds articles, forms, and headers outside articles are fences. Blocks behind one go, unless it is a wrapper: it holds an
    article or main element and no such element stands outside all fences; or the page has none, and it is a form with half of all text.
    """
    kinds = {} if kinds is None else kinds
    page, known = Page(), {}
    fences: list[tuple[int, bool, bool]] = []  # outer fence, whether it may be a wrapper, and is a form
    mains: list[int] = []
    # tag, path, out, fence, in an article
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, -1, False)]
    opened: Counter = Counter()
    pieces: list[str] = []
    linked = link_depth = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.text.append(text)
                page.path.append(stack[-1][1])
                page.linked.append(min(linked, len(text)))
                page.fence.append(stack[-1][3])
            pieces.clear()
        linked = 0

    def close(k: int):
        """Ends the elements from place k of the stack on."""
        nonlocal link_depth
        if any(s[0] in _BLOCKS for s in stack[k:]):
            flush()
        for s in stack[k:]:
            opened[s[0]] -= 1
        del stack[k:]
        if link_depth > len(stack):
            link_depth = 0

    def find(tags, stop) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return 0
        return 0

    at, low = 0, html.lower()
    if len(low) != len(html):  # a few letters change their length
        low = re.sub("[A-Z]", lambda m: m.group().lower(), html)

    def add(piece: str):
        nonlocal linked
        if piece and not stack[-1][2]:
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if link_depth:
                linked += len(piece.strip())

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        ends, attributes = (m.group(1) or m.group(4)), (m.group(3) or m.group(6) or "")
        block = tag in _BLOCKS
        if ends:
            if tag == "a":
                link_depth = 0
            if opened[tag] > 0 and tag not in ("html", "body"):
                stop = _FENCES.get(tag, _CELLS if tag not in _TABLE else ())
                if k := find({tag}, stop):
                    close(k)
                    continue
            if block:
                flush()
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if block:
            if opened["p"] > 0 and (k := find({"p"}, _CELLS)):
                close(k)
            if tag in _IMPLIED:
                wanted, stop = _IMPLIED[tag]
                while k := find(wanted, stop):
                    close(k)
            flush()
        if tag == "br":
            add(" ")
        elif tag == "a":
            link_depth = len(stack)
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag != "svg":
                end = low.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
                closing = _TOKEN.match(html, at)
                at = closing.end() if closing else at
            continue
        kind = kinds.get((tag, attributes))
        if kind is None:
            if len(kinds) > 20_000:
                kinds.clear()
            kind = kinds[tag, attributes] = _kind(tag, attributes)
        _, path, out, fence, inside = stack[-1]
        fenced = kind.around or tag == "form" or (kind.header and not inside)
        if not block and not kind.out and not kind.around:
            continue
        if fenced and block:
            fences.append((fence, not kind.comments, tag == "form" and not kind.around))
            fence = len(fences) - 1
        if kind.main and not out:
            mains.append(fence)
        inside = inside or kind.main
        if block:
            key = (path, kind.label)
            if key not in known:
                known[key] = len(page.labels)
                page.parents.append(path)
                page.labels.append(kind.label)
                page.within.append(inside)
            path = known[key]
        stack.append((tag, path, out or kind.out or (kind.around and not block), fence, inside))
        opened[tag] += 1
    flush()

    wrappers = set()
    if mains and min(mains) >= 0:
        for fence in mains:
            while fence >= 0:
                if fences[fence][1]:
                    wrappers.add(fence)
                fence = fences[fence][0]
    if not mains and any(form for _, _, form in fences):
        held = Counter()
        for text, fence in zip(page.text, page.fence, strict=True):
            while fence >= 0:
                held[fence] += len(text)
                fence = fences[fence][0]
        wrappers |= {k for k, (_, _, form) in enumerate(fences) if form and 2 * held[k] >= sum(map(len, page.text))}
    shut: list[bool] = []
    for k, (outer, *_) in enumerate(fences):
        shut.append(k not in wrappers or (outer >= 0 and shut[outer]))
    keep = [k for k, fence in enumerate(page.fence) if fence < 0 or not shut[fence]]
    for name in ("text", "path", "linked", "fence"):
        values = getattr(page, name)
        setattr(page, name, [values[k] for k in keep])
    return page


def path_ratios(page: Page) -> dict[int, float]:
    """The fused ratio of each path that has a block.

    Per path: characters outside links a block, and punctuation a block. Both are smoothed over the tree: a container's ratio is that
    of all blocks right below it, averaged with its own container's where that is larger; a path's is its own averaged with its container's, a heading's
    its container's. So a heading or a short list among paragraphs takes part in their ratio, a line between menus does not. Fused: text times one more than punctuation, times the share
    outside links squared, times ``OUTSIDE`` where the page has an article that the path is not in. On a page without one it is times
    ``OUTSIDE_CONTAINER`` for paths outside the container that has most text right below it.
    """
    own: dict[int, list[float]] = {}
    around: dict[int, list[float]] = {}
    for text, path, linked in zip(page.text, page.path, page.linked, strict=True):
        found = (1, len(text) - linked, len(_MARKS.findall(text)), len(text))
        for sums in (own.setdefault(path, [0, 0, 0, 0]), around.setdefault(page.parents[path], [0, 0, 0, 0])):
            for k, x in enumerate(found):
                sums[k] += x
    smooth: list[tuple[float, float]] = []
    for path in range(len(page.parents)):  # parents come first
        above = smooth[page.parents[path]] if path else (0.0, 0.0)
        if path in around:
            n, plain, marks, _ = around[path]
            above = tuple(max(x / n, (x / n + y) / 2) for x, y in zip((plain, marks), above, strict=True))
        smooth.append(above)
    within, outside = page.within, OUTSIDE
    if own and not any(within[path] for path in own):
        most, outside = max(around, key=lambda c: around[c][1]), OUTSIDE_CONTAINER
        within = []
        for path, parent in enumerate(page.parents):
            within.append(path == most or (path > 0 and within[parent]))
    out = {}
    for path, (n, plain, marks, chars) in own.items():
        text, points = smooth[page.parents[path]] if path else (0.0, 0.0)
        own_share = 0.0 if page.labels[path].partition(".")[0] in _HEADINGS and path else OWN
        text, points = own_share * plain / n + (1 - own_share) * text, own_share * marks / n + (1 - own_share) * points
        out[path] = text * (1 + points) * (plain / chars) ** 2 * (1.0 if within[path] else outside)
    return out


def main_text(html: str | None, kinds: dict | None = None, least_share: float = LEAST_SHARE) -> tuple[str, int, int]:
    """The text of the content blocks, joined by empty lines, their number and the number of all blocks outside menus and the like.

    Content are all blocks whose path has ``least_share`` of the page's best fused ratio or more, and more than nothing.
    """
    page = parse(html or "", kinds)
    fused = path_ratios(page)
    least = least_share * max(fused.values(), default=0.0)
    chosen = [t for t, path in zip(page.text, page.path, strict=True) if fused[path] > 0 and fused[path] >= least]
    return "\n\n".join(chosen), len(chosen), len(page.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_share: float = LEAST_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_seen`` of every row: the main text of the whole html.

    Each page is judged by its own paths, so there is no shuffle. Of a block, character references are decoded, and white space becomes
    one space; ``<br>`` is white space. Blocks stand in page order with an empty line between.

    Null and empty html, and pages without text, give the empty text. Null ids and urls and repeated rows are kept as they are; other columns
    are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict = {}
        for part in (part for batch in batches for part in base.slices(batch, "html")):
            found = [main_text(h, kinds, least_share) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32())))],
                names=["page_id", "url", "text", "n_blocks", "n_seen"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(base.frugal(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks int, n_seen int")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_seen")


def op12_html_extract(spark, sf_dir):
    """Contract query: the main text of every page."""
    return extract(base.table(spark, sf_dir, "pages"))
