import math
import random
from itertools import product

import pytest

from tarn.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "https://cheap-pills.example.com/en/1", "http://blog.cheappills.example.com/x", "HTTP://WWW.Example.ORG/en/1?q=1", "http://example.org/es/7",
    "http://a.example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://notcom/de/", "http://therin.example.net/en/3#top", "http://x.org", "http://x.org?y=/", "ftp://É.net/Ä/a b",
    "http://casinowin.example.net/en/5", "http://thing.example.net/en/5://x.com/de/1",
]


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [h + p for h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, u, "<p>the thing in cheap rain</p>") for k, u in enumerate(URLS)]
    rows += [(1000 + k, f"http://{h}.example.net/en/{k}", "<p>the</p>") for k, h in enumerate(["therin", "thing", "m.rain", "blog.the"] * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'x' AS rule")
    return {r.page_id: r for r in uf.judge(pages).collect()}


def test_hosts_paths_and_rules(judged):
    for k, u in enumerate(URLS):
        assert (judged[k].host, judged[k].path, judged[k].rule) == brute(u)
        if judged[k].rule:
            assert judged[k].verdict == {h + p: v for (h, p), v in uf.RULES.items()}[judged[k].rule]
        assert judged[k].verdict in ("allow", "block")


def test_unwanted_names_are_blocked_hyphened_or_run_together(judged):
    verdict = {u: judged[k].verdict for k, u in enumerate(URLS)}
    assert verdict["https://cheap-pills.example.com/en/1"] == "block" and verdict["http://blog.cheappills.example.com/x"] == "block"
    assert verdict["http://casinowin.example.net/en/5"] == "block" and verdict["http://therin.example.net/en/3#top"] == "allow"
    assert sum(r.verdict == "block" for k, r in judged.items() if k >= 1000) == 0


def test_viterbi_finds_the_cheapest_split():
    split = uf.segmenter({"a": 5, "ab": 9, "abc": 2, "c": 4, "bc": 1}, 21)
    for n in range(1, 8):
        for letters in product("abc", repeat=n):
            run = "".join(letters)
            cost = lambda ws: sum(split.cost.get(w, split.unknown * (1 + len(w))) for w in ws)
            best = min(cost([run[i:j] for i, j in zip([0, *cuts], [*cuts, n])]) for cuts in _cuts(n))
            assert "".join(split.split(run)) == run and abs(cost(split.split(run)) - best) < 1e-9


def _cuts(n):
    return [[i for i in range(1, n) if mask >> (i - 1) & 1] for mask in range(1 << (n - 1))]


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_unseen_tokens_say_nothing():
    """Ordinary hosts that no sample held are allowed, however few URLs are unwanted."""
    split = uf.segmenter({w: 100 for w in "museum of modern art nature articles wiki cat cheese monger about farm track cheap slots visit edu".split()}, 10_000)
    rows = [(uf.url_tokens(f"www.site{k % 40}.example.com", f"/en/{k}", split), k % 20 == 0) for k in range(2000)]
    model = uf.train(rows + [([f"h:{s}", f"p:{s}"], True) for s in sorted(uf.SEED_WORDS)])
    for host, path in (("museumofmodernart.edu", "/visit"), ("nature.com", "/articles/1"), ("en.wikipedia.net", "/wiki/Cat"), ("cheesemonger.co.uk", "/about"), ("cheapfarmtrack.org", "/slots")):
        assert model.score(uf.url_tokens(host, path, split)) < 0.5
    assert model.score(["h:never", "p:seen"]) == pytest.approx(1 / (1 + math.exp(-model.prior)))


def test_naive_bayes_equals_brute_force():
    rng = random.Random(4)
    rows = [([f"t{rng.randrange(12)}" for _ in range(rng.randint(1, 8))], rng.random() < 0.3) for _ in range(200)]
    model, smooth = uf.train(rows), 0.2
    vocabulary = {t for ts, _ in rows for t in ts}

    def probability(tokens, label):
        all_tokens = [t for ts, y in rows if y == label for t in ts]
        p = (sum(y == label for _, y in rows) + 1) / (len(rows) + 2)
        for t in tokens:
            if t in vocabulary:
                p *= (all_tokens.count(t) + smooth) / (len(all_tokens) + smooth * len(vocabulary))
        return p

    for tokens, _ in rows[:60] + [(["t1", "unknown"], True), ([], True)]:
        yes, no = probability(tokens, True), probability(tokens, False)
        assert model.score(tokens) == pytest.approx(yes / (yes + no))


def test_labels_come_from_what_pages_show():
    good = "<html><head><style>p{}</style></head><body><p>A page about art with many ordinary words in it.</p><a href='/x'>more</a></body></html>"
    assert uf.unwanted_page(good) is False and uf.unwanted_page(None) is None and uf.unwanted_page("<p></p>") is None
    assert uf.unwanted_page("<p>casino poker roulette bingo for you</p>") and uf.unwanted_page("<p>BUY!! NOW!! best### thing</p>")
    assert uf.unwanted_page("<p>casino viagra</p>") and not uf.unwanted_page("<p>The law of 1906 names casino, gambling and poker; courts read it narrowly ever since.</p>")
    farm = "".join(f"<a href='https://h{k}.example/x'>one two three</a>" for k in range(9))
    assert uf.unwanted_page(farm) and not uf.unwanted_page(farm.replace("https://h", "/h"))
    assert not uf.unwanted_page("".join(f"<a href='chapter{k}.html'>Chapter {k}: of things</a>" for k in range(40)))
    assert not uf.unwanted_page("".join(f"<a href='//one.example/{k}'>of things</a>" for k in range(40)))


#: Ordinary sentences in small letters, and the shouted one where the script has capitals.
SCRIPTS = {
    "english": "the old bridge over the river was closed for repairs during the winter",
    "russian": "старый мост через реку был закрыт на ремонт в течение всей зимы",
    "greek": "η παλιά γέφυρα πάνω από το ποτάμι ήταν κλειστή όλο τον χειμώνα",
    "chinese": "冬天的时候 河上的旧桥 因为维修而关闭 人们只能坐船过河",
    "arabic": "كان الجسر القديم فوق النهر مغلقا للإصلاح طوال فصل الشتاء",
    "georgian": "ძველი ხიდი მდინარეზე დაკეტილი იყო მთელი ზამთარი",
    "armenian": "գետի վրայի հին կամուրջը փակ էր ամբողջ ձմռանը",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_no_script_is_unwanted_by_itself(script):
    text = SCRIPTS[script]
    assert not uf.unwanted_page(f"<p>{text}</p>") and not uf.unwanted_page(f"<p>{text.capitalize()}. {text.title()}</p>")
    if script in ("english", "russian", "greek", "armenian"):
        assert uf.unwanted_page(f"<p>{text.upper()}</p>")


def test_verdicts_do_not_follow_the_script(spark):
    """Ordinary hosts of pages in four scripts are allowed, shouting ones blocked, held out too."""
    rng = random.Random(9)
    rows, truth = [], {}
    names = {"english": "lake hill barn moss", "russian": "озеро холм амбар мох", "greek": "λίμνη λόφος αχυρώνας βρύα", "armenian": "լիճ բլուր գոմ մամուռ"}
    for k in range(1600):
        script = list(names)[k % 4]
        bad = k % 20 < 4
        host = "".join(rng.sample("zorb quim flax drub".split() if bad else names[script].split(), 2)) + f".site{k % 50}.example.net"
        words = SCRIPTS[script].split()
        rng.shuffle(words)
        text = " ".join(words)
        rows.append((k, f"http://{host}/en/{k}", f"<p>{text.upper() if bad else text} {' '.join(names[script].split())}</p>" if k < 1300 else None))
        truth[k] = "block" if bad else "allow"
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for first, last in ((0, 1300), (1300, 1600)):
        for j in range(4):
            own = [k for k in range(first, last) if k % 4 == j and got[k].rule is None]
            assert sum(got[k].verdict == truth[k] for k in own) >= 0.97 * len(own), (first, list(names)[j])


def test_held_out_hosts(spark):
    """Hosts of words that go with unwanted pages are blocked though no sample held them; the others are allowed."""
    rng = random.Random(7)
    bad, fine = "zorb quim flax drub".split(), "lake hill barn moss".split()
    rows, truth = [], {}
    for k in range(1200):
        names = rng.sample(bad if k % 4 == 0 else fine, 2)
        host = "".join(names) + f".site{k % 50}.example.net"
        text = "WIN!! NOW!! BIG!! prize!!" if k % 4 == 0 else "an ordinary page on " + " ".join(rng.sample(bad + fine, 5))
        rows.append((k, f"http://{host}/en/{k}", f"<p>{text} {' '.join(names)}</p>" if k < 1000 else None))
        truth[k] = "block" if k % 4 == 0 else "allow"
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    held = [k for k in range(1000, 1200) if got[k].rule is None]
    assert sum(got[k].verdict == truth[k] for k in held) >= 0.97 * len(held)


def test_the_contract_query(spark, saved):
    pages = spark.createDataFrame([(k, u, "<p>the thing</p>") for k, u in enumerate(URLS)], "page_id long, url string, html string")
    got = uf.op5_url_filter(spark, saved(pages=pages))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.host, r.path, r.rule) for r in got.collect()} == {(k, *brute(u)) for k, u in enumerate(URLS)}
