import html
import random
import time
from html.parser import HTMLParser

import pytest

from tarn.llm.html_extract import extract, main_text, op12_html_extract, parse, path_ratios

PAGES = "page_id long, url string, html string"
WORDS = "river stone winter garden council market signal theory harbour engine paper measure village".split()


def prose(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n)).capitalize() + pick.choice([".", "; so it was.", ", he said!"])


def blocks_of(pick):
    """A title and paragraphs, the shortest of one word."""
    return [prose(pick, pick.randint(2, 6))] + [prose(pick, pick.choice([1, 8, 20, 60, 150])) for _ in range(pick.randint(1, 9))]


def as_html(pick, text):
    out = html.escape(text)
    return out.replace(" ", pick.choice([" ", "\n  ", " <b>", "&nbsp;", "<br>"]), 1).replace("said", "<a href='#'>said</a>")


def navigation(pick):
    return "".join(f'<li><a href="/{w}">{w}, {w}.</a></li>' for w in pick.sample(WORDS, 5))


def page_with_article(pick, blocks):
    body = "".join(f"<p>{as_html(pick, b)}{pick.choice(['</p>', '', '<!-- x -->'])}" for b in blocks[1:])
    return (
        f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{}}</style><script>var t='<p>';</script></head><body>"
        f"<header>{prose(pick, 9)}</header><nav><ul>{navigation(pick)}</ul></nav><div class='ad'>{prose(pick, 30)}</div>"
        f"<article><h1>{as_html(pick, blocks[0])}</h1>{body}<aside>{prose(pick, 40)}</aside></article>"
        f"<section id=comments><div class=comment><p>{prose(pick, 80)}</p></div></section><form><label>{prose(pick, 4)}</label><p>{prose(pick, 20)}</p></form>"
        f"<footer>&copy; {prose(pick, 12)}</footer>" + pick.choice(["</body></html>", ""])
    )


def page_of_divs(pick, blocks):
    blocks.append(prose(pick, 60))
    body = "".join(f"<p>{as_html(pick, b)}</p>" for b in blocks[1:])
    return (
        f"<html><body class='has-sidebar'><div id='site-header'><p>{prose(pick, 9)}</p></div><div id='menu2'><ul>{navigation(pick)}</ul></div>"
        f"<div class='cookie-notice'>{prose(pick, 50)}</div><div id='content'><h2>{as_html(pick, blocks[0])}</h2>{body}<div class='share'>Share it</div></div>"
        f"<div class='sidebar-left'><p>{prose(pick, 70)}</p></div><div class=footer>{prose(pick, 9)}</div>"
    )


def page_in_form(pick, blocks):
    body = "".join(f"<p class='t{k}'>{as_html(pick, b)}</p>" for k, b in enumerate(blocks[1:]))
    return f"<form id=aspnet><main><h1>{as_html(pick, blocks[0])}</h1>{body}<ol class='commentlist'><li>{prose(pick, 50)}</li></ol></main><button>Go, now.</button></form>"


class Plain(HTMLParser):
    """Brute force for the given tables: text of article by the standard parser, blocks by h1 and p."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [[]] if tag in ("h1", "p") else []
        self.blocks[-1].append(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks += [[]] if tag in ("h1", "p") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def plain_text(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return "\n\n".join(t for b in parser.blocks if (t := " ".join("".join(b).split())))


@pytest.mark.parametrize("make", [page_with_article, page_of_divs, page_in_form])
def test_articles_among_what_surrounds_them(make):
    pick = random.Random(make.__name__)
    for _ in range(60):
        blocks = blocks_of(pick)
        page = make(pick, blocks)
        assert main_text(page)[0].split("\n\n") == blocks


def test_query_against_the_standard_parser(spark, saved):
    pick = random.Random(3)
    rows = []
    for k in range(300):
        words = navigation(pick)
        inner = "".join(pick.choice([f"<p>{html.escape(b)}</p>", f"<p><b>{html.escape(b)}<br>"]) for b in blocks_of(pick))
        rows.append((k % 290, f"https://a.example/{k}", f"<html><body><nav><ul>{words}</ul></nav><div class='ad'>{prose(pick, 8)}</div><article><h1>{prose(pick, 3)}</h1>{inner}</article><footer>&copy; x, y &middot; z.</footer>"))
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS path")
    got = op12_html_extract(spark, saved(pages=pages)).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got) == sorted((i, u, plain_text(h), len(plain_text(h))) for i, u, h in rows)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, "u", ""), (2, "u", "<"), (3, "u", "a &lt;b&gt; &amp;amp; \n\t c"), (4, "u", "<!-- never closed <p>x"), (5, "u", "<script>x<p>y"), (6, "u", 'see <a href="x'), (7, "u", "<p>" + "so it is, 😀 " * 100_000)]
    got = extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert [by_id[k].text for k in (None, 1, 2, 3, 4, 5, 6)] == ["", "", "<", "a <b> &amp; c", "", "", "see"]
    assert by_id[7].n_chars == len("so it is, 😀 " * 100_000) - 1
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_tag_soup():
    assert parse("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td><p>d<td>e</table></div></p>f").text == ["a", "b", "c", "d", "e", "f"]
    assert parse("x<br>y<wbr>z <span class=ad>no</span><i>w</i>").text == ["x yz w"]
    assert parse("<textarea><p>no</textarea><svg><text>no</text></svg>yes<noscript>no</noscript>").text == ["yes"]
    assert parse("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes").text == ["yes"]
    assert parse("İ<SCRIPT>no</SCRIPT>yes").text == ["İyes"]


def test_ratios_of_paths():
    page = parse("<div id=a><p>One, two, three.</p><p>Four.</p></div><div id=b><p><a>five six</a></p></div>")
    by_label = {page.labels[page.parents[p]]: r for p, r in path_ratios(page).items()}
    # 21 characters and 4 marks in two blocks, below a container of the same ratio
    assert by_label["div.a"] == pytest.approx(10.5 * 3) and by_label["div.b"] == 0


def test_time_of_hostile_pages():
    for page in ('<a "' * 50_000, "<div>" * 50_000 + "x", "<p>x" * 50_000, "<li><ul>" * 50_000, "</p>" * 50_000, "<!--" * 50_000, "<td><p>x" * 50_000, "<b>" * 50_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 5
