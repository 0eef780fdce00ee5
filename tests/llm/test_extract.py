import re
from html import unescape

import pytest
from helpers import real

from lodestar.llm import extract as E
from lodestar.llm import html as H

ARTICLE = "<h1>The  title</h1><p>First, a paragraph that is long enough, with commas, and &amp; more &eacute; of it.<p>Second <b>bold</b>\n one<br>here<ul><li>item one<li>item two</ul><pre>x\n  y</pre>"
WANT = "The title\nFirst, a paragraph that is long enough, with commas, and & more é of it.\nSecond bold one here\nitem one\nitem two\nx y"


def page(article, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T &lt; x</title><style>p{{}}</style><script>if (a < b) document.write("<p>no</p>");</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>menu</a></ul></nav><div id="cookie-notice">We use cookies, many of them, and you should agree to every one of them.</div>
<div class="ad-box">Buy now, cheap</div>{article}<aside class=x>Side, bar</aside><!-- <p>gone</p> --><form><p>Your name<input></form>{extra}<footer>&copy; foot</footer></body></html>"""


def test_article():
    assert E.main_text(page(f"<article>{ARTICLE}<div class='comments'><p>A reader says, at length, that this is, in their view, wrong.</div><section class='share-buttons'>Share</section></article>"), None) == WANT
    assert E.main_text(page(f"<div class=wrap><div class='post-body p123'>{ARTICLE}</div></div>", "<div id=comments><p>A reader says, at length, that this is wrong.</div>"), None) == WANT


def test_classes_that_only_tell_of_a_sidebar():
    long = "<p>A paragraph, which is long enough, for the score, of a container, on this page.</p>"
    for open_, close in (("<div class='entry with-sidebar'>", "</div>"), ("<div class='sidebar-right layout'><article class='post has-comments'>", "</article></div>"), ("<div id='headerWrap'><main>", "</main></div>")):
        assert E.main_text(page(f"{open_}{long}<div class='SideBar'>{long}</div><article class='comment'>{long}</article>{close}"), None) == long[3:-4]


def test_names_made_from_headings_are_no_marks():
    text = "A paragraph, which is long enough, for the score, of a container, on this page."
    kept = f"""<article><h1 id=header>The title</h1><p>{text}</p><h2 id="related-work" class="header">Related work</h2><p id="comment-on-it" class="notice">{text}</p>
<h2 id="search-algorithms">Search algorithms</h2><ul><li id="login">item one<li class="related">item two</ul><table><tr><td class="header">cell<td id="menu">other cell</table>
<section id="social-history"><h2>Social history</h2><p>A sentence of <span class="search">some</span> length.</p></section><section id="search-trees"><p>{text}</p></section></article>"""
    want = ["The title", text, "Related work", text, "Search algorithms", "item one", "item two", "cell", "other cell", "Social history", "A sentence of some length.", text]
    assert E.main_text(page(kept), None) == "\n".join(want)
    links = "".join(f"<li><a href=/{k}>Another page, of this site, with a long name</a>" for k in range(9))
    for mark in ("id=related-stories-today", "class=social-bookmarks", "class='related-reading x'", "id=comments", "class=CommentList", "class=sidebar-inner", "id=cookie-notice"):
        gone = f"<ul>{links}</ul>" if "related" in mark or "social" in mark else f"<p>{text}</p><p>{text}</p>"
        assert E.main_text(page(f"<article><p>{text}</p><div {mark}><h3>Related</h3>{gone}</div><p class='advertisement'>Advertisement</p></article>"), None) == text


def test_article_is_more_than_its_best_container():
    text = "A paragraph, with commas, and words, of an article, that is long, " * 9
    part = lambda n, k: [f"{k}{i}. {text}".strip() for i in range(n)]
    html = lambda x: "".join(f"<p>{t}" for t in x)
    a, b, links = part(12, "a"), part(3, "b"), "<ul><li><a href=/x>Another page, of this site, with a long name</a></ul>"
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=wrap>", "</div>")):
        beside = page(f"{open_}<h1>The title</h1><div class=content>{html(a)}</div><p>Beside it, and not in it.</p>{'' if open_[1] == 'a' else links}{close}")
        assert E.main_text(beside, None) == "\n".join(["The title", *a, "Beside it, and not in it."])
        sections = page(f"{open_}<section class=x>{html(a)}</section><section class=y><h2>Second</h2>{html(b)}</section>{close}")
        assert E.main_text(sections, None) == "\n".join([*a, "Second", *b])
    two = page(f"<div class=wrap><div class='part p1'>{html(a)}</div><div class=links>{links}</div><div class='part p2'><p>Short.</div></div><div class=teaser><p>Other</div>")
    assert E.main_text(two, "html>body.has-sidebar>div.wrap>div.p.part") == E.main_text(two, None) == "\n".join([*a, "Short."])
    menu = page(f"<div class=col>{links}</div><div class=col>{html(b)}</div><h2>More</h2>{links}")
    assert E.main_text(menu, "html>body.has-sidebar>div.col") == "\n".join(b)


def test_host_vote_saves_short_pages(spark):
    good = page(f"<div class='post-{{n}}'>{ARTICLE}</div><div class=teaser><p>Other</p></div>")
    odd = page("<div class='post-9'><p>Short.</p></div><div class=teaser><p>A long teaser, which has, in all, many commas, and words, and more, than the article has on this page.</p></div>")
    rows = [(k, f"https://User@Example.COM:80/{k}", good.replace("{n}", str(k))) for k in range(4)] + [(9, "http://example.com/9", odd), (10, None, odd), (11, "x", None), (None, "http://example.com/e", ""), (12, "http://example.com", "no markup, only text")]
    df = spark.createDataFrame([(*r, "p", "h") for r in rows], "page_id long, url string, html string, path string, host string")
    out = {r.page_id: r for r in E.extract(spark, df).collect()}
    assert len(out) == 9
    assert all(out[k].text == WANT and out[k].n_chars == len(WANT) for k in range(4))
    assert out[9].text == "Short." and out[10].text.startswith("A long teaser")
    assert out[11].text == out[None].text == "" and out[12].text == "no markup, only text" and out[12].url == "http://example.com"
    assert E.extract(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("raw", ["<", "<p", "<p>a<", "</", "<!--", "<!-- x", "&#xD800;&#55357;&amp", "<p><p><p>", "</p></p>x", "<a <b>c", "<script>", "<div " * 50, "<table><tr><td>a<td>b<tr><td>c</table>d", "<p>a</p " + "x" * 100_000, "<div>" * 20_000 + "deep", "<p a='" + "\"" * 30_000])
def test_broken_pages(raw):
    text = E.main_text(raw, "html>body")
    text.encode("utf-8", "replace")
    if "table" in raw:
        assert text == "a\nb\nc\nd" or text == "a\nb\nc"


def test_paths_are_general():
    root = H.parse("<html><body><div class='post-12 wide' id=x3><p>a</div><div id=main-7></div></body></html>")
    assert [n.path() for n in H.elements(root)][2:] == ["html>body>div.post.wide", "html>body>div.post.wide>p", "html>body>div.main"]


def test_real_pages(spark):
    pages = real(spark, "pages")
    out = {r.page_id: r.text for r in E.extract(spark, pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r.page_id] == "\n".join(x for x in want if x)


N = 300_000
HOSTILE = {
    "stray end tags": "</a>" * (N // 4), "stray end tags deep down": "<div>" * (N // 10) + "</b>" * (N // 8), "unclosed end tags": "</a " * (N // 4), "unclosed tags": "<a " * (N // 3), "open quotes": '<a b="' * (N // 6), "quotes": "<a " + "\"'" * (N // 2) + ">x", "numbered end tags": "</1" * (N // 3),
    "open spans with paragraphs": "<span>" * (N // 12) + "<p>some text" * (N // 24), "spans and paragraphs": "<span><p>text, of a paragraph" * (N // 28), "lists in deep boxes": "<div>" * (N // 10) + "<li>x" * (N // 10), "lists in deep tables": "<table>" * (N // 14) + "<li>x" * (N // 10), "cells in deep lists": "<td><table>" + "<ul>" * (N // 8) + "<td>" * (N // 8), "table feet": "<tfoot>" * (N // 7),
    "marked boxes": "<div class='related-x'><p>A paragraph, which is long enough, for a score." * (N // 75), "headings around marked boxes": "<h1>" * (N // 8) + "<div class='related-x'>" * (N // 46), "comments": "<!-- " * (N // 5), "number": "&#" + "9" * N + ";", "class of dashes": "<p class='" + "-" * N + "'>x", "spaces": "<p a" + " " * N + "=x>b", "articles in articles": "<article><p>A paragraph of some length, with commas, here." * (N // 58),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_in_proportion_to_the_page(name):
    import time

    began = time.perf_counter()
    E.main_text(HOSTILE[name], None)
    E.main_text(HOSTILE[name], "div>div>div")
    assert time.perf_counter() - began < 6  # a quadratic step takes minutes


def test_tags_that_the_end_cuts_off_are_no_text():
    for cut in ("<a ", "<a href='x", "</a", "</", "<!-- x", "<p class=\"y"):
        assert E.main_text(page(f"<article>{ARTICLE}</article>") + cut * 3, None) == WANT
    assert E.main_text("<p>one" + "<a " * 99, None) == "one"
    assert E.main_text('<p title="5 > 3">a < b and c > d, "quoted" <b>bold</b>', None) == 'a < b and c > d, "quoted" bold'


def test_boxes_of_an_article_and_pages_of_menus():
    text = "A paragraph, which is long enough, for the score, of a container, on this page."
    inside = f'<article><p>{text}</p><p class="social">{text}</p><div class="related-work"><h2>Related work</h2><p>{text}</p></div><div class="widget-text"><p>{text}</p></div></article>'
    assert E.main_text(page(inside), None) == "\n".join([text, text, "Related work", text, text])
    two = f"<article class=a><p>{text} One.</p><p>{text}</p></article><article class=a><p>{text} Two.</p><p>{text}</p></article>"
    assert E.main_text(page(two), "html>body.has-sidebar>article.a") == "\n".join([f"{text} One.", text, f"{text} Two.", text])
    assert E.main_text("<html><body><nav><a href=/>Home</a></nav><ul class=links><li><a href=/a>About</a><li><a href=/b>Contact</a></ul></body></html>", None) == ""
    assert E.main_text("<html><body>Just a line.</body></html>", None) == "Just a line."


def scores_by_hand(root):
    """The scores as they are defined, each container by itself."""
    out = {}
    for box in H.elements(root):
        if box.tag not in H.CONTAINERS:
            continue
        total, used = {"article": 30.0, "main": 15.0, "body": -10.0}.get(box.tag, 0.0), False
        for node in H.elements(root):
            if node.tag not in H.PARAGRAPHS:
                continue
            up, depth = node, 0
            while up is not None and up is not box:
                depth += up.tag in H.CONTAINERS
                up = up.parent
            text, links = H._own_text(node)
            if up is box and text and 0.5**depth > 0.2:
                total, used = total + H._worth(node, text, links) * 0.5**depth, True
        if used:
            out[id(box)] = total
    return out


def test_scores_match_brute_force(spark):
    for r in real(spark, "pages").limit(20).collect():
        root = H.parse(r.html)
        got, want = {id(n): s for s, n in H.scores(root)}, scores_by_hand(root)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        assert H.best(root)[0] == max(got.values())
