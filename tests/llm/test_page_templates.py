import random
import re
import time

import pytest

from veilgraph.llm.page_templates import clean, extract, main_text, markup, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>A &amp; B {i}</h1><p><b>First  one<br>two<p>Second &lt;x&gt;</p><div class="share">share</div><ul><li>item {i}</li></ul><!-- <p>no</p> --></article>
<section id="comments"><article class="comment"><p>nice</p></article></section><aside>side</aside><form><p>mail</p></form><footer>&copy; us</footer></body></html>"""
PLAIN = """<html><body><div id="top"><p>Welcome to us</p></div><div class="content"><h1>Story {i}</h1><p>Long text number {i} with many words to read here</p></div><div class="sidebar">links</div><div id="bottom"><p>All rights</p></div>"""


def test_extract(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.format(i=i)) for i in range(5)] + [(10 + i, f"http://b.org/{i}", PLAIN.format(i=i)) for i in range(6)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://c.org", "just words &eacute;"), (22, "http://c.org", "just words &eacute;"), (None, "http://d.org/", "<article>open <p>end")]
    got = {}
    for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[3] == ["A & B 3\nFirst one two\nSecond <x>\nitem 3"]
    assert got[12] == ["Story 2\nLong text number 2 with many words to read here"]
    assert got[20] == [""] and got[21] == [""] and got[22] == ["just words é"] * 2 and got[None] == ["open\nend"]


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.format(i=7)) for i in range(6)]
    assert {r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"A & B 7\nFirst one two\nSecond <x>\nitem 7"}


DECOY = """<html><body><div id="top"><p>Welcome</p></div><article><p>Teaser of our shop, the same everywhere</p></article><div class="text"><h1>Story {i}</h1><div class="long"><p>Long text number {i} with many words to read here</p><p>{same}</p></div></div></body></html>"""


def test_the_template_decides_on_pages_with_an_article_element(spark):
    rows = [(i, f"http://a.org/{i}", DECOY.format(i=i, same=f"End {i}")) for i in range(6)]
    got = {r.id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\nLong text number {i} with many words to read here\nEnd {i}" for i in range(6)}


def test_copies_of_a_page_without_article_stay(spark):
    rows = [(i, f"http://a.org/{i}", PLAIN.format(i=7)) for i in range(6)] + [(10 + i, f"http://b.org/{i}", PLAIN.format(i=7 if i < 6 else i)) for i in range(10)]
    got = {r.id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in (*range(6), *range(10, 16))} == {"Story 7\nLong text number 7 with many words to read here"}
    assert got[18] == "Story 8\nLong text number 8 with many words to read here"


NEUTRAL = """<html><body><div><div>Home</div><div>About {odd}</div></div><div class="k1">Buy {odd} now</div><div><p>Title {i}</p><p>{body}</p><div>More of {i}</div></div><div class="k2"><div>Reader {odd}</div></div><div>{terms}</div></body></html>"""


def test_neutral_names(spark):
    """Elements and classes that say nothing: the template finds the text, and without it the result is another."""
    r = random.Random(3)
    words = lambda n: " ".join(r.choice(["ka", "lo", "mi", "tur", "ben"]) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body = words(r.randrange(5, 80))
        rows.append((i, f"http://h{i % 2}.org/{i}", NEUTRAL.format(i=i, body=body, odd=words(2), terms="Imprint and terms of use " * 20)))
        want[i] = f"Title {i}\n{body}\nMore of {i}"
    got = {x.id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want
    assert any(main_text(h, None, frozenset()) != want[i] for i, _, h in rows)


def by_regular_expression(page):
    """Text nodes of a well-formed page, another way."""
    page = re.sub(r"(?s)<!--.*?-->|<(script|style|head|select|textarea|button|template|iframe)\b.*?</\1>", " ", page)
    return [x for t in re.split(r"<[^>]*>", page) if (x := clean(t))]


def test_scanner_against_regular_expressions():
    for page in (PAGE.format(i=1), PLAIN.format(i=2), DECOY.format(i=3, same="x"), NEUTRAL.format(i=1, body="b", odd="o", terms="t"), "<p>1 < 2 <b>x</b><math><mi>y</mi></math><noscript>z</noscript>"):
        assert [x for t, _, _ in parse(page)[0] if (x := clean(t))] == by_regular_expression(page.replace("1 < 2", "1 &lt; 2"))
    assert [x[3:] for x in markup("<a href='x>y' b=\"<c>\"><br/><!-- <i> --></A><? x><u \"v>")] == [("a", " href='x>y' b=\"<c>\""), ("br", "/"), ("", ""), ("a", ""), ("", ""), ("u", ' "v')]


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '>", "<div>", "</div>", "<svg>", "<select>", "<!", "<!--", "<", "<a x=\">\" ", "<div class=\"a b\">", "&amp", "</select", "<script>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.process_time()
    main_text(piece * (1_000_000 // len(piece)) + "'>", None, frozenset())
    assert time.process_time() - start < 5
