import html
import itertools
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pages
from tessera.session import read_table
from tests.conftest import SF01

LONG = "The committee met on Tuesday to go through the findings of the survey, and after some hours of talk it agreed on most of them."
OTHER = "Several members asked for more time, since the figures of the last quarter had not reached them before the meeting began."


def text(page):
    return pages.main_text(page)[0]


def test_cut_is_least_by_trying_all():
    r = random.Random(1)
    for _ in range(400):
        n = r.randrange(1, 9)
        gains = [r.randrange(-12, 13) for _ in range(n)]
        edges = [(a, b, r.randrange(1, 9)) for a in range(n) for b in range(a + 1, n) if r.random() < .6]

        def cost(side):
            return sum(-g if s else 0 for g, s in zip(gains, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        least = min(map(cost, itertools.product([False, True], repeat=n)))
        most = max(sum(s) for s in itertools.product([False, True], repeat=n) if cost(s) == least)
        got = pages.minimum_cut(gains, edges)
        assert cost(got) == least and sum(got) == most


def test_long_undecided_chain():
    n = 3000
    gains = [(5, -5, 3, -4)[i % 4] for i in range(n)]
    got = pages.minimum_cut(gains, [(i, i + 1, 6) for i in range(n - 1)])
    # least cost of a chain by dynamic programming
    on, off = -gains[0], 0
    for g in gains[1:]:
        on, off = min(on, off + 6) - g, min(off, on + 6)
    assert sum(-g for g, s in zip(gains, got) if s) + 6 * sum(a != b for a, b in zip(got, got[1:])) == min(on, off)


def test_landmarks():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
    <header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
    <div id="cookie-notice">We use cookies to make this long notice look like a real sentence of prose, we really do.</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>{LONG}<script>track("x")</script><p>Short.
    <div class="ad">Buy this great thing now, it is cheaper than ever before and will not be for long.</div>
    <p>One<br>two <b>bo</b>ld &lt;tag&gt;&nbsp;&eacute;</p><!-- <p>hidden</p> --><ul><li>first item</li><li>second item</li></ul>
    <form><label>Your mail</label><input value=x><button>Send</button></form><p>{OTHER}</p><footer>Filed under news</footer></article></main>
    <aside><p>{LONG}</p></aside><section id="comments"><article class="comment"><p>{OTHER}</p></article></section>
    <noscript>Please enable scripts.</noscript><footer>&copy; 2020</footer>"""
    assert text(page) == f"Title & more\n{LONG}\nShort.\nOne two bold <tag> é\nfirst item\nsecond item\n{OTHER}"


def test_class_words():
    page = f"""<html><body><div class="topNav"><a href=/>Home</a> <a href=/x>About us</a></div><div id="page"><div class="post-content">
    <h2>A heading</h2><p>{LONG}</p><p>Yes.</p><div class="related-posts"><a href=1>{OTHER}</a></div><p>{OTHER}</p></div>
    <div class="sidebar"><p>{LONG}</p></div></div><div class="comment-list"><div class="post-content"><p>{OTHER}</p></div></div>
    <div class="footer">All rights reserved</div></body></html>"""
    assert text(page) == f"A heading\n{LONG}\nYes.\n{OTHER}"


def test_no_landmarks():
    page = f"<html><body><table><tr><td><a href=1>News</a><td><a href=2>Sport</a></table><div><p>{LONG}<p>So it was.<p>{OTHER}</div><div><a href=3>Next</a> | <a href=4>Back</a></div><div>Copyright 2019 by us</div>"
    assert text(page) == f"{LONG}\nSo it was.\n{OTHER}"


def test_odd_markup():
    assert text(None) == text("") == text("   ") == text("<p>") == text("<nav>" + LONG) == text("<script>" + LONG) == ""
    assert text(LONG) == LONG
    assert text(f"<article><p>{LONG}") == LONG
    assert text(f"</div></p><article></b><p><b>{LONG}<br><p>{OTHER}</article></article>") == f"{LONG}\n{OTHER}"
    assert text(f"<article><![if x]><p>{LONG}<![endif]><?php x ?><!weird></article>") == LONG
    assert text("<article>" + "<div>" * 20000 + LONG) == LONG
    assert text(f"<article><p>{'word ' * 200000}.</p></article>") == "word " * 200000 + "."
    assert text("<article>" + f"<p>{OTHER}</p>" * 5000 + "</article>").count("\n") == 4999
    r = random.Random(4)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<", ">", "&amp", "&#0;", "<!--", "-->", "<![", "<!DOCTYPE", "text here", "<script>", "</script>", "<li>", "<b", "</", "\x00", "é", "<article>", "<nav>"]
    for _ in range(3000):
        assert isinstance(text("".join(r.choice(bits) for _ in range(r.randrange(30)))), str)


def test_whole_table(spark):
    """The given pages declare their article, so its inner text is the right result."""
    table = read_table(spark, SF01, "pages")
    got = {r.id: r for r in pages.extract_pages(table, keep=("url",)).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].url == r.url


def test_cases_of_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}", "x"), (1, "v", f"<article><p>{OTHER}", "x"), (2, None, None, None), (None, "w", "<p>x", "y"), (3, "z", "", "y"), (4, "u", f"<article><p>{LONG}", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.id: (r.url, r.text) for r in pages.extract_pages(frame, keep=("url",)).collect()}
    assert got == {1: ("v", OTHER), 2: (None, ""), 3: ("z", ""), 4: ("u", LONG)}
    assert pages.extract_pages(frame.limit(0)).columns == ["id", "text", "n_blocks", "n_kept"] and pages.extract_pages(frame.limit(0)).count() == 0
    clash = frame.withColumn("id", F.lit(9)).withColumn("k0", F.lit(1)).withColumn("n_blocks", F.lit(1))
    assert pages.extract_pages(clash).count() == 4
