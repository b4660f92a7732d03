"""Main text: single rules, random pages whose text is known by construction, and sites whose boxes have no telling names."""

import random

import pytest

from wastelens.llm import html_text


def text(page):
    return html_text.main_text(html_text.parse(page))


@pytest.mark.parametrize("page, want", [
    ('<div class="layout with-sidebar"><article><p>Body</p></article></div>', "Body"),
    ('<div class="no-sidebar"><p>Body</p></div>', "Body"),
    ('<article><h1 class="entry-header">Title</h1><p class="social-history">Text</p></article>', "Title\nText"),
    ('<div class="sidebar"><article><p>Body</p></article><p>x</p></div><div class="sidebar"><p>menu</p></div>', "Body"),
    ('<div class="banner"><p>All of the page is in here</p></div><p>tail</p>', "All of the page is in here\ntail"),
    ('<p>Short</p><div class="comments"><p>A reader writes much more than the page itself</p></div>', "Short"),
    ('<article><p>A</p></article><div class="comments"><article class="comment"><p>reader</p></article></div>', "A"),
    ('<div class="site-footer">f</div><div id="cookie-banner">c</div><div class="ad-slot ad-2">a</div><div class="post"><p>B</p></div>', "B"),
    ("<p>a&not<i>in;</i></p>", "a¬in;"), ("<p>AT&am<b>p;x</b></p>", "AT&amp;x"), ("<p>a &amp;lt; b</p>", "a &lt; b"),
    ("<p>a<object data=x>fallback</p><p>kept</p>", "afallback\nkept"),
    ("<p>a</p><svg><text>drawn</text></svg><p>b</p><svg><p>open</p>", "a\nb\nopen"),
    ("<p>x</p><noscript><p>y</p>", "x\ny"), ("<p>x</p><template><p>y</p>", "x\ny"), ("<p>x</p><noscript>on</noscript><p>y</p>", "x\ny"),
    ("<p>x</p><script>var a = '</p>'", "x"), ("<p>x</p><title>t</titlex></title><p>y</p>", "x\ny"),
    ("<figure><p>p</p><figcaption>Caption</figcaption></figure>", "p\nCaption"), ("<p>E = <math><mi>m</mi>c</math></p>", "E = mc"),
    ("<p class=it's>one 'two</p><p>three</p> four>", "one 'two\nthree\nfour>"), ('<p title="a>b">x</p>', "x"), ("<p title='a>b' class=c>x</p>", "x"),
    ('<p title="open>x</p><p>y</p>', "x\ny"), ("", "")])
def test_rules(page, want):
    assert text(page) == want


WORDS = "river stone &amp; green walk moun&shy;tain l&eacute;ger house 3 &lt; 5 AT&T x&#8217;s".split(" ")
PLAIN = "river stone & green walk moun­tain léger house 3 < 5 AT&T x’s".split(" ")


def built(draw, boxes=()):
    """A page and its text, built together."""
    blocks, out = [], []
    for _ in range(draw.randint(1, 6)):
        at = [draw.randrange(len(WORDS)) for _ in range(draw.randint(3, 12))]
        gap = lambda: draw.choice([" ", "\n ", "  ", "<br>", " <!-- x --> "])
        body = WORDS[at[0]] + "".join(gap() + (f"<b>{WORDS[i]}</b>" if draw.random() < 0.2 else WORDS[i]) for i in at[1:])
        tag = draw.choice(["p", "h2", "li", "blockquote", "p class='entry-header'"])
        end = "" if tag == "p" and draw.random() < 0.3 else f"</{tag.split()[0]}>"
        blocks.append(f"<{tag}>{body}{end}")
        out.append(" ".join(PLAIN[i] for i in at))
    noise = ["<nav><ul><li>Home<li>News</ul></nav>", "<header><h1>Site</h1></header>", "<footer>All rights</footer>", "<aside>Also</aside>",
             "<form><label>Mail</label><input></form>", "<script>if (a < b) { x('<p>no</p>') }</script>", "<style>p > b {}</style>",
             "<div class='ad'>Buy</div>", "<div class='cookie-banner'><p>We use cookies</p></div>", "<div id=comments><p>First!</p></div>"]
    inner, outer = list(blocks), draw.sample(noise, 4)
    for n in draw.sample(noise[4:], 2):
        inner.insert(draw.randrange(len(inner) + 1), n)
    body = "".join(inner)
    body = f"<article>{body}</article>" if draw.random() < 0.5 else f"<div class='layout with-sidebar'>{body}</div>"
    parts = [*outer[:2], *boxes[:1], body, *boxes[1:], *outer[2:]]
    return "<html><head><title>t</title></head><body>" + "\n".join(parts) + "</body></html>", "\n".join(out)


def test_random_pages_give_the_text_they_were_built_from():
    draw = random.Random(11)
    for _ in range(400):
        page, want = built(draw)
        assert text(page) == want, page


def test_boxes_without_telling_names_go_by_their_counts(spark):
    """Ten sites with boxes of their own on most pages, and passages that articles share: the counts alone decide. Recall and precision are 1."""
    draw, pages, want, plain = random.Random(12), [], {}, 0
    for site in range(10):
        boxes = [f"<div class='k{site}a'><p>Site {site} tells you about itself</p><ul><li>One of {site}<li>Two of {site}</ul></div>",
                 f"<section><p>Made by the people of site {site}</p></section>"]
        for i in range(12):
            page, body = built(draw, boxes if i < 10 else ())
            pages.append((site * 100 + i, f"https://s{site}.example.org/{i}", page))
            want[site * 100 + i] = body
            plain += text(page) != body
    assert plain > 40  # the rules alone leave the boxes where a page has no article
    out = html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    kept = {r["page_id"]: r["text"] for r in html_text.extracted(
        spark.createDataFrame(pages, "page_id long, url string, html string"), min_pages=10**9).collect()}
    assert sum(kept[i] != want[i] for i in want) == plain


def test_very_long_and_repeated_pages(spark):
    long = "<article>" + "<p>word and word</p>" * 30_000 + "</article>"
    rows = [(1, "http://a.example.com/1", long), (1, "http://a.example.com/1", long), (None, None, "<p>x</p>"), (2, "::bad", "")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 14 * 30_000 - 1), (1, 14 * 30_000 - 1), (2, 0)]
