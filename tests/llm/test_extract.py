from __future__ import annotations

import itertools
import random

import pytest

from hourvault.llm import extract

COSTS = {"<article": 60.0, "</article": 60.0, "<body": 60.0, "</body": 60.0, "<html": 60.0}
SHELL = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    '<div class="ad">Buy this thing now it is a very good thing to buy</div>{}<footer>&copy; nobody at all</footer></body></html>'
)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p></p>", ""),
        (SHELL.format("<article><h1>A  title</h1><p>One\n two<b>three</b>.<br>Next</p></article>"), "A title One twothree. Next"),
        (SHELL.format("<article><p>a &amp; b &lt;p&gt; caf&eacute; &#233;&nbsp;x</p></article>"), "a & b <p> café é x"),
        (SHELL.format('<article><p>first part</p><aside>see also</aside><p class="x">second part</p></article>'), "first part second part"),
        (SHELL.format('<article><p>first part</p><div class="comments"><p>I like it a lot</p></div></article>'), "first part"),
        (SHELL.format("<article><p>kept<script>var t='</p> no'; if (a<b) {}</script> whole</p></article>"), "kept whole"),
        (SHELL.format("<article><p>one</p><form><input value='>'><button>Send</button></form><p>two</p></article>"), "one two"),
        ("<html><body><nav><a>menu</a></nav><article><p>cut off in the mid", "cut off in the mid"),
        ("<html><body><article><p>cut off at a tag <a href='x", "cut off at a tag"),
        ("<html><body><div class='menu'>never closed<article><p>the text</p></article>", "the text"),
        (SHELL.format("<!-- note --><article><p>a<!-- <p>hidden</p> -->b</p></article>"), "ab"),
        (SHELL.format('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p></article>'), "yes"),
    ],
)
def test_pages(page, text):
    assert extract.main_text(page, COSTS) == text


@pytest.mark.parametrize(
    "body, text",
    [
        ('<div class="layout has-sidebar"><p>one two</p></div>', "one two"),
        ('<div id="page" class="no-sidebar"><p>one two</p></div>', "one two"),
        ('<div class="post comments-open"><p>one two</p></div>', "one two"),
        ('<section class="social-history"><p>one two</p></section>', "one two"),
        ('<p title="hidden gems" data-id="menu">one two</p>', "one two"),
        ('<p>one two</p><div class="sidebar-left"><p>no no no no no</p></div>', "one two"),
        ("<nav><ul><li><a>menu</a></li></ul><div><p>one two three</p></div>", "one two three"),
        ("<div><form><input></div><div><p>one two three</p></div>", "one two three"),
        ('<div class="comments"><article class="comment"><p>I like it</p></article></div>', ""),
        ("<aside><article><p>a teaser</p></article></aside><div><p>one two three</p></div>", "one two three"),
    ],
)
def test_pages_without_a_marked_article(body, text):
    assert extract.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>", {}) == text
    assert extract.main_text(f"<html><head><title>t</title><meta name='x'><body>{body}</body></html>", {}) == text


@pytest.mark.parametrize("costs", [{}, {"<section": 30.0, "</section": 30.0, "<div": 30.0, "</div": 30.0, "<header": 30.0, "</header": 30.0}])
@pytest.mark.parametrize(
    "page",
    [
        "<article><header><h1>News</h1></header>{}<div>End</div></article>",
        "<article><section>News</section>{}<section>End</section></article>",
        "<article><div>News</div><section>{}</section><section><div>End</div></section></article>",
        "<div id='content'><div>News</div>{}<section>End</section></div>",
    ],
)
def test_short_first_and_last_blocks(page, costs):
    body = "<p>" + "w " * 40 + "</p>"
    page = SHELL.format("<div><p>x</p></div>" + page.format(body) + "<div><p>y</p></div>")
    assert extract.main_text(page, COSTS | costs) == "News " + "w " * 40 + "End"


LONG = "<h1>Heading</h1><p>" + "first words of it " * 30 + "</p><p>" + "more words " * 40 + "</p>"
LONG_TEXT = " ".join(("Heading " + "first words of it " * 30 + "more words " * 40).split())
CHAPTER = "<h2>Chapter</h2><p>" + "a chapter's words " * 25 + "</p>"
CHAPTER_TEXT = " ".join(("Chapter " + "a chapter's words " * 25).split())
LINKS = "<h2>See also</h2><ul>" + "<li><a href='/x'>a page that is named at some length</a></li>" * 12 + "</ul>"


@pytest.mark.parametrize("costs", [{}, COSTS])
@pytest.mark.parametrize(
    "body, text",
    [
        (f"<article>{LONG}<section id='discussion'>{CHAPTER}</section></article>", f"{LONG_TEXT} {CHAPTER_TEXT}"),
        (f"<article>{LONG}<section id='related'>{CHAPTER}</section><p>End</p></article>", f"{LONG_TEXT} {CHAPTER_TEXT} End"),
        (f"<form id='aspnetForm' method='post'><input type='hidden'><article>{LONG}</article></form>", LONG_TEXT),
        (f"<form id='aspnetForm'><nav>{LINKS}</nav><div id='x'>{LONG}</div></form>", LONG_TEXT),
        (f"<div class='widget'>{LONG}</div>", LONG_TEXT),
        (f"<div class='widget'><div class='widget'>{LONG}</div></div>", LONG_TEXT),
        # The same names without words of their own, or with a second name that is clear.
        (f"<article>{LONG}<section id='related'>{LINKS}</section></article>", LONG_TEXT),
        (f"<article>{LONG}<section id='discussion' class='comments'>{CHAPTER}</section></article>", LONG_TEXT),
        (f"<article>{LONG}<div class='discussion'>{CHAPTER}</div></article>", LONG_TEXT),
        (f"<article>{LONG}<form><p>{'leave your address ' * 20}</p><input></form><p>End</p></article>", f"{LONG_TEXT} End"),
        (f"<article>{LONG}<div class='widget'>{'a weather report ' * 20}</div><p>End</p></article>", f"{LONG_TEXT} End"),
        (f"<article>{LONG}</article><section id='discussion'>{CHAPTER}</section>", LONG_TEXT),
    ],
)
def test_names_of_two_meanings(body, text, costs):
    assert extract.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>", costs) == text
    assert extract.main_text(SHELL.format(body), costs) == text


def test_best_stretch_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(400):
        values = [rng.choice([-1, 1]) * rng.randint(0, 9) for _ in range(rng.randint(0, 14))]
        low, high = extract.best_stretch(values)
        assert sum(values[low:high]) == max(sum(values[a:b]) for a, b in itertools.product(range(len(values) + 1), repeat=2))


def test_best_stretch_is_contiguous():
    words = lambda n: ("text", "w " * n)
    wall = ("<x", "")
    sequence = [words(3), wall, wall, words(9), wall, words(8), wall, wall, wall, words(2)]
    assert extract.best_region(sequence, {"<x": 2.0}) == (3, 6)


def test_costs_are_learned_from_pages_that_mark_their_article(spark):
    rows = [(i, "u", SHELL.format(f"<article><p>words of page {i}</p><p>more</p></article>")) for i in range(40)]
    rows += [(100 + i, "u", "<div><p>no article</p></div>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    costs = extract.fit(df)
    assert costs["<article"] > 30 and costs["<p"] == extract.TEXT_COST and "<div" not in costs
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(df, costs).collect()}
    assert got[7] == ("words of page 7 more", 20)


def test_pages_of_the_table_that_mark_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract.extract(pages, extract.fit(pages)).collect()}
    for row in pages.collect():
        body = row.html.split("<article>")[1].split("</article>")[0]
        assert got[row.page_id] == extract.main_text(body, {})


def test_odd_rows_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "a", "b"), (1, "u", "<p>x</p>", "a", "b"), (None, "u", "<p>" + "y " * 300_000, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.page_id), r.url or "", r.n_chars) for r in extract.extract(df, extract.fit(df)).collect())
    assert got == [("1", "", 0), ("1", "u", 1), ("None", "u", 599_999)]
    none = spark.createDataFrame([], schema)
    assert extract.fit(none) == {} and extract.extract(none, {}).collect() == []
