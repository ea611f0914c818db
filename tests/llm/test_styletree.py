import time
from collections import Counter, defaultdict
from math import log

import pytest

from lattica.llm import styletree


def slow_tree(sources):
    """(low branches, low texts) of one host's pages, counted and weighed page by page and path by path."""
    parsed = {}
    for source in sources:
        blocks, nodes = styletree.parse(source)
        parsed[styletree._page_key(blocks)] = blocks, nodes  # copies of a page count once
    shapes, said, kind, links, shares = defaultdict(Counter), defaultdict(Counter), {}, defaultdict(lambda: [0, 0]), {}
    for blocks, nodes in parsed.values():
        for n in nodes:
            kind[n.path] = n
        for path, shape in {(n.path, tuple(n.children) if n.noise < 0.8 else ()) for n in nodes if n.noise < 0.8 or n.parent.noise < 0.8}:
            shapes[path][shape] += 1
        for path, text, linked in {(b.node.path, b.text): (b.node.path, b.text, b.linked) for b in blocks if b.node.noise < 0.8}.values():
            said[path][text] += 1
            links[path][0] += linked * len(text)
            links[path][1] += len(text)
            shares[path, text] = linked
    m = {p: sum(c.values()) for p, c in shapes.items()}
    used = {p for p in m if m[p] >= 2 or kind[p].noise > 0}

    def weigh(p):
        inner = [weigh(c) for c in used if kind[c].parent is not None and kind[c].parent.path == p and kind[c].noise < 0.8]
        parts = inner + ([1 - sum(log(n) for n in said[p].values()) / len(said[p]) / log(m[p] + 1)] if said[p] else [])
        shown = 1 - sum(n * log(n) for n in shapes[p].values()) / m[p] / log(m[p] + 1)
        own = sum(parts) / len(parts) if parts else 1.0
        return 0.1 * shown + 0.9 * own if inner else own

    def final(value, p, share):
        doubt = kind[p].noise + (0.6 * share if 0 < kind[p].noise < 0.8 else 0)
        return (1 - min(doubt, 1)) * (0.1 + 0.9 * value if kind[p].main else value)

    low = {p for p in used if (kind[p].depth > 2 or kind[p].noise >= 0.8) and final(weigh(p) if kind[p].noise < 0.8 else 1, p, links[p][0] / links[p][1] if links[p][1] else 0) <= 0.2}
    texts = {(p, t) for p in used for t, n in said[p].items() if n > 1 and final(1 - log(n) / log(m[p] + 1), p, shares[p, t]) <= 0.2}
    return low, texts


def slow_texts(sources):
    low, texts = slow_tree(sources)

    def gone(n):
        return n is not None and (n.path in low or gone(n.parent))

    return ["\n\n".join(b.text for b in styletree.parse(s)[0] if not gone(b.node) and (b.node.path, b.text) not in texts) for s in sources]


def text(source):
    """A page's text on a host of its own."""
    low, _ = slow_tree([source])
    return styletree.main_text(source, low, set())


def test_noise_goes_and_blocks_stay():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>x";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold<br>line</b>  of&nbsp;text<p>Two &#233; <a href="x>y">link</a></p>
    <ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class="ad-box">Buy!</div><pre>x
      y</pre><form><label>Name</label><input></form></article>
    <section id="comments"><article class="comment"><p>First!</p></article></section></main>
    <aside>Side</aside><footer>Foot</footer></body></html>"""
    assert text(page).split("\n\n") == ["Title & more", "One bold line of text", "Two é link", "a", "b", "c", "d", "x y"]


def test_odd_pages():
    assert text("") == "" and text("just text") == "just text" and text("a < b && c") == "a < b && c"
    assert text("<p>one<p>two</div></p>three") == "one\n\ntwo\n\nthree"
    assert text("<div><p>open <b>bold<div>next") == "open bold\n\nnext"
    assert text("<article><p>x<script>if (a<b) { '</p>' }") == "x"
    assert text("<!-- no end <p>x") == "" and text("<article>&lt;p&gt; &bogus; &#x41;</article>") == "<p> &bogus; A"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert styletree.main_text(deep, set(), set()) == "deep"
    assert text("<span class='ad'>Buy <b>now</b></span> and read <b><i>on</b> here</i>") == "and read on here"
    assert text("<p title='it's'>a</p><p title=don't>b</p><p>c</p>") == "a\n\nb\n\nc"


@pytest.mark.parametrize("part, n", [("<div>", 1_000_000), ("<a '", 500_000), ("<a b=\"", 400_000), ("<p><b>", 400_000), ("</div>", 500_000), ("<table><div></p>", 200_000), ("<li><span class='ad'>x", 60_000), ("<!-", 500_000)])
def test_parse_is_linear(part, n):
    began = time.process_time()
    blocks, nodes = styletree.parse(part * n)
    assert time.process_time() - began < 12


def test_names_are_a_feature_and_not_a_verdict():
    for name in ("long-form", "social-history", "side-effects", "article-header", "formula", "adder"):
        assert text(f"<article><div class='{name}'><p>Body of it</p></div><p>More</p></article>") == "Body of it\n\nMore"
    for name in ("share", "social-links", "related-posts", "search-box", "ad", "cookie-notice", "site-header", "comment-list", "side"):
        assert text(f"<article><div class='{name}'><p>Body of it</p></div><p>More</p></article>") == "More"
    assert text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == "So x=1 holds"
    # a doubtful name goes where nearly all of it is links
    linked = "<article><div class='related-reading'><p><a href='/1'>One story</a></p><p><a href='/2'>Another one</a></p></div><p>More</p></article>"
    assert text(linked) == "More"


def test_only_the_tree_cuts():
    page_ = "<body><nav>Menu</nav><article><p>Text</p></article><footer>Foot</footer></body>"
    assert text(page_) == "Text" and styletree.main_text(page_, set(), set()) == "Menu\n\nText\n\nFoot"


def test_as_brute_force(spark):
    def site(i):
        extra = "<div class='ad'>Offer %d</div>" % i if i % 2 else "<div class='social-history'><p>Part %d</p></div>" % i
        return f"<html><body><nav><a href='/'>Home</a></nav><div class='top'><p>Welcome to us</p></div><article><h1>Story {i}</h1>{extra}<p>Text {i} goes on.</p>{'<p>Read more stories</p>' * (i % 3)}</article><div class='end'><p>{'Legal words' if i % 4 else f'Note {i}'}</p></div></body></html>"

    hosts = {"one": [site(i) for i in range(40)], "two": [site(i) for i in range(3)], "three": [site(7)] * 5, "four": ["", "<p>x</p>", *[page(i) for i in range(9)]]}
    rows = [(1000 * k + i, f"http://{h}.net/{i}", source) for k, (h, own) in enumerate(hosts.items()) for i, source in enumerate(own)]
    got = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for k, own in enumerate(hosts.values()):
        assert [got[1000 * k + i] for i in range(len(own))] == slow_texts(own)


def page(i, extra=""):
    return f"<html><body><div class='top'><div class='line'>Welcome to our site</div></div><div class='content'><p>Story number {i} is about {i * i}.</p>{extra}</div><div class='low'><div class='legal'>All rights reserved by us</div></div></body></html>"


def test_site_statistics(spark):
    rows = [(i, f"http://Big.net/{i}", page(i, "<p>Read more stories here</p>"), "clash") for i in range(20)]
    rows += [(100 + i, f"http://small{i}.net/", page(i), "") for i in range(3)]
    rows += [(200, "http://big.net/x", None, ""), (201, None, "<p>no url</p>", ""), (None, "http://big.net/y", page(77), ""), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    for most in (50_000, -1):
        styletree.BROADCAST_ROWS, before = most, styletree.BROADCAST_ROWS
        got = {r["page_id"]: r for r in styletree.extract(pages).collect()}
        styletree.BROADCAST_ROWS = before
        assert all(got[i]["text"] == f"Story number {i} is about {i * i}." for i in range(20))
        assert got[None]["text"] == "Story number 77 is about 5929."
        assert got[100]["text"].split("\n\n") == ["Welcome to our site", "Story number 0 is about 0.", "All rights reserved by us"]
        assert (got[200]["text"], got[200]["n_chars"], got[201]["text"]) == ("", 0, "no url")
    assert styletree.extract(pages).count() == len(rows)
    assert styletree.extract(spark.createDataFrame([], pages.schema)).count() == 0


def test_articles_copied_on_one_host_keep_their_text(spark):
    rows = [(i, f"http://c.net/{i}", "<body><nav>Menu</nav><article><h1>Same</h1><p>Same story</p></article></body>") for i in range(30)]
    got = styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Same\n\nSame story"}


def test_articles_are_judged_by_the_tree_too(spark):
    def odd(i, article):
        return f"<body><div class='top'><div class='line'>Welcome to us</div></div>{article}<div class='rest'><p>The rest of story {i} told.</p></div></body>"

    teaser = "<article><p>Read our other story</p></article>"
    split = "<article><p>Start of story {0} with words that are {0} times its own.</p><div class='x'><p>Follow us for more</p></div></article>"
    rows = [(i, f"http://teaser.net/{i}", odd(i, teaser)) for i in range(20)]
    rows += [(100 + i, f"http://split.net/{i}", odd(i, split.format(i))) for i in range(20)]
    # copies of one article, next to other words on each page
    rows += [(200 + i, f"http://copies.net/{i}", f"<body><article><h1>Same</h1><p>Same long story everywhere.</p></article><div class='d'><p>Seen {i}</p></div></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == f"The rest of story {i} told."
        assert got[100 + i] == f"Start of story {i} with words that are {i} times its own.\n\nThe rest of story {i} told."
        assert got[200 + i].startswith("Same\n\nSame long story everywhere.")


def test_small_hosts_and_rare_templates(spark):
    rows = [(1000 * n + i, f"http://h{n}.net/{i}", page(i)) for n in range(1, 9) for i in range(n)]
    rare = "<html><body><section><div class='x'><div class='y'>Printed for you</div></div><p>Print {0} of {0}</p></section></body></html>"
    rows += [(10000 + i, f"http://large.net/{i}", rare.format(i) if i < 5 else page(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(1, 9):
        want = "Story number {0} is about {1}." if n > 3 else "Welcome to our site\n\nStory number {0} is about {1}.\n\nAll rights reserved by us"
        assert [got[1000 * n + i] for i in range(n)] == [want.format(i, i * i) for i in range(n)]
    assert [got[10000 + i] for i in range(5)] == [f"Print {i} of {i}" for i in range(5)]
    assert got[10007] == "Story number 7 is about 49."


def test_composite():
    out = styletree.composite({"": (0.0, None), "/a": (1.0, None), "/a/b": (None, 0.0), "/a/c": (None, 1.0), "/d": (None, 0.1)})
    assert out["/a/b"] == 0 and out["/a/c"] == 1 and abs(out["/a"] - 0.55) < 1e-9 and abs(out[""] - 0.9 * (0.55 + 0.1) / 2) < 1e-9
