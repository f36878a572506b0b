import html
import os
import re
import time

import pytest

from panelfx.llm.html_text import Page, RatioOptions, extract_text, main_text, path_scores

SF_DIR = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header>Site name</header><nav><ul><li><a href="/class=ad">Home</a></ul></nav>
<div class="main-column"><h1>A title</h1><p>First &amp; foremost, a paragraph of the story, with commas.
It goes <b>on</b><br>and on.<p>Second one, here; too.<div class="adBox">Buy, now, this.</div>
<ul><li>a point<li>two</ul><script>var a = "<p>no, no, no.</p>";</script><aside>Aside, with, commas, and text.</aside></div>
<section id="comments"><article>I comment, a lot, really, every day.</article></section>
<form>Your name, please: <input></form><div style="display: none">hidden, text.</div>
<div class="cookie-notice">We use cookies, all right?</div><footer>&copy; us</footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE) == (
        "A title\n\nFirst & foremost, a paragraph of the story, with commas. It goes on and on.\n\n"
        "Second one, here; too.\n\na point\n\ntwo"
    )


def test_article_keeps_short_blocks_and_its_header():
    page = "<body><header>x</header><article><header><h1>Head</h1></header><p>Yes.</p><p>No<p></article><footer>f</footer>"
    assert main_text(page) == "Head\n\nYes.\n\nNo"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>open <b>x", "open x"),
        ("<script>never closed", ""),
        ("a <!-- open comment", "a"),
        ("1 < 2 & 3 > 2 &lt;b&gt;", "1 < 2 & 3 > 2 <b>"),
        ("</p></div></b>", ""),
        ("<p>&nbsp;a&#x41;&eacute;&bogus; </p>", "aAé&bogus;"),
        ("<P>Upper</P><SCRIPT>x</Script><p>case</p>", "Upper\n\ncase"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_long_pages():
    deep = "far below, but with as many words as a paragraph has, and its commas too."
    page = "<article>" + "<p>some words, here.</p>" * 20_000 + "<div>" * 3_000 + deep + "</article>"
    assert main_text(page).count("some words, here.") == 20_000 and main_text(page).endswith(deep)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "mine"), (1, "u", PAGE, "mine"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = extract_text(pages)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in rows.collect()) == [0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_articles_of_the_small_tables(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", inner))).split("\0")
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        assert got[row.page_id] == "\n\n".join(b for b in blocks if b)


PAPER = """<body><nav>Home</nav><article><h1 id="share">On search</h1><p>Some, words, to begin with, and then more of them.</p>
<section id="discussion"><h2 id="how-search-works">How search works</h2><p>It looks, and finds, what there is; mostly.</p></section>
<section class="related-work"><h3 id="related-work">Related work</h3><p>Others, too, have looked, and found, and written.</p></section>
<div id="social-media"><h2><span id="Social_media">Social media</span></h2><p id="comment-1">A long, long text, about what people say, and why.</p></div>
<div class="share-buttons">Share, please.</div><div id="related-posts"><ul><li><a href="x">One</a><li><a href="y">Two</a></ul></div>
<p class="ad">Buy, now.</p></article></body>"""


def test_ids_made_from_titles_stay():
    assert main_text(PAPER).split("\n\n") == [
        "On search", "Some, words, to begin with, and then more of them.",
        "How search works", "It looks, and finds, what there is; mostly.",
        "Related work", "Others, too, have looked, and found, and written.",
        "Social media", "A long, long text, about what people say, and why.",
    ]


LONG = "A paragraph, long enough to be one; with commas, and with a few more words than a button has."
FRAME = "<body><nav><a href=x>Home</a> <a href=y>News</a></nav>%s<footer>&copy; us, all rights reserved, for ever.</footer></body>"


@pytest.mark.parametrize(
    ("inner", "blocks"),
    [
        # names that cover the whole main text
        (f"<div class='login-guide'><h1>How to log in</h1><p>{LONG}</p><p>{LONG}</p></div>", ["How to log in", LONG, LONG]),
        (f"<div id='search-results-explained'><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG]),
        # a teaser beside the text
        (f"<article>A teaser here</article><div><h1>Real title</h1><p>{LONG}</p><p>{LONG}</p></div>", ["Real title", LONG, LONG]),
        # an advert without a telling class within the article, and a short list
        (f"<article><h1>Title</h1><p>{LONG}</p><div>Buy now, pay later!</div><p>{LONG}</p><ul><li>one<li>two</ul></article>",
         ["Title", LONG, LONG, "one", "two"]),
        # an introduction of some length in a plain block stays
        (f"<article><div>{LONG} {LONG}</div><p>{LONG}</p></article>", [f"{LONG} {LONG}", LONG]),
        # quotes within values that have none
        (f"<article><img alt=it's src=a><p class=x data=it's>{LONG}</p><p>It's so.</p></article>", [LONG, "It's so."]),
        # comments longer than the article
        (f"<article><p>{LONG}</p></article><section id=comments>" + f"<article><p>{LONG} {LONG}</p></article>" * 20 + "</section>", [LONG]),
        # a dropped inline element leaves one block
        (f"<article><p>{LONG} <span class=ad>Buy!</span> {LONG}</p></article>", [f"{LONG} {LONG}"]),
        (f"<article><p>{LONG}</p><div role=complementary><p>{LONG}</p></div><div aria-hidden=true><p>{LONG}</p></div></article>", [LONG]),
    ],
)
def test_ratios_and_priors_decide(inner, blocks):
    assert main_text(FRAME % inner).split("\n\n") == blocks


def test_without_the_threshold_results_differ():
    page = FRAME % f"<article><p>{LONG}</p><div>Buy now, pay later!</div></article><div>Other, short.</div>"
    assert main_text(page) == LONG
    everything = main_text(page, RatioOptions(threshold=0.0))
    assert "Buy now" in everything and "Other, short." in everything and "all rights reserved" in everything
    # and so they do without smoothing, or without the ratio of punctuation
    plain, pauses = "words without any sign " * 9, "A, b, c; d, e."
    page = f"<body><div>{plain}</div><section>{pauses}</section></body>"
    nodes = Page(page)
    raw = path_scores(nodes.nodes, nodes.paths, RatioOptions(radius=0))
    smoothed = path_scores(nodes.nodes, nodes.paths, RatioOptions())
    assert raw.max() / raw[raw > 0].min() > smoothed.max() / smoothed[smoothed > 0].min() > 1


def test_paths_are_shared_by_equal_tags_and_marks():
    page = Page("<div><p>one</p><p>two <b>bold</b></p></div><div class=ad><p>three</p></div><div><p>four</p></div>")
    paths = [n.path for n in page.nodes]
    assert paths[0] == paths[1] == paths[3] != paths[2]
    assert [n.text for n in page.nodes] == ["one", "two bold", "three", "four"]


MEGABYTE = {
    "nested blocks": "<article>" + "<div>text, here " * 66_000,
    "nested inline": "<article>" + "<b>x " * 200_000,
    "unclosed tags": "<a " * 340_000,
    "unclosed names": "<a" * 500_000,
    "signs": "< " * 500_000,
    "ends of others": "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000,
    "paragraphs in inline": "<b>" * 150_000 + "<p>x" * 150_000,
    "ends without starts": "<div>" * 90_000 + "</x>" * 120_000,
    "lists": "<ul>" * 100_000 + "<li>x" * 120_000,
    "open quotes": "<a b=\"x " * 120_000,
    "mixed quotes": "<a b='x \" " * 100_000,
    "comments": "<!-- " * 200_000,
    "scripts": "<script> " * 110_000,
    "wrong ends of scripts": "<script></scrip>" * 60_000,
    "references": "&" * 1_000_000,
    "gaps": "<p" + " " * 500_000 + "a" + " " * 500_000,
    "attributes": "<p " + "a= " * 330_000,
    "marked inline": "<span class=ad>x</span> y " * 40_000,
    "classes": "<div class='" + "aB " * 330_000 + "'>x",
    "one word": "x" * 1_000_000,
}


@pytest.mark.parametrize("name", MEGABYTE)
def test_a_megabyte_takes_no_time(name):
    start = time.perf_counter()
    main_text(MEGABYTE[name])
    # a second or so; a quadratic step would take minutes
    assert time.perf_counter() - start < 10
