import html as H
import re
import time

import pytest

from lodestone.llm.main_text import extract_main_text, main_blocks
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ONE = "The first paragraph tells, at some length, what the whole story is about and why it matters."
TWO = "The second one goes on with it, adds names, places and dates, and ends with a full stop."
THREE = "A third one closes the story; there is nothing left to say after it, or so it seems."
PARAGRAPHS = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
WHOLE = [ONE, TWO, THREE]
LINKS = "".join(f'<li><a href="/{i}">Another page number {i}</a></li>' for i in range(9))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul>{LINKS}</ul></nav><article>{PARAGRAPHS}</article><footer>All rights reserved, {ONE}</footer></body></html>",
        f"<body><header><h1>The paper</h1><p>{TWO}</p></header><main><div class=story-text>{PARAGRAPHS}</div><aside><p>{ONE}</p></aside></main>",
        f'<div id="wrap"><div class="sidebar"><p>{TWO}</p><p>{TWO}</p><p>{TWO}</p><p>{TWO}</p></div><div id="content">{PARAGRAPHS}</div></div>',
        f'<article>{PARAGRAPHS}</article><section id="comments"><article class="comment"><p>{TWO * 9}</p></article></section>',
        f'<article>{PARAGRAPHS}<div class="share-buttons"><p>Share it, {ONE}</p></div><form><p>{TWO}</p><textarea>{ONE}</textarea></form></article>',
        f'<div class="cookie-notice"><p>{TWO}</p><p>{THREE}</p><p>{ONE}</p><p>{ONE}</p></div><div><section>{PARAGRAPHS}</section></div>',
        f"<table><tr><td><ul>{LINKS}</ul></td><td>{PARAGRAPHS}</td></tr></table>",
        f"<article><p>{ONE}<p>{TWO}<ul>{LINKS}</ul><p>{THREE}</article>",
        f'<ARTICLE><P CLASS="lead">{ONE}</P><div hidden><p>{TWO}</p></div><p>{TWO}</p><p>{THREE}</p></ARTICLE>',
        f"<body><div>{ONE}<br></div><div>{TWO}</div><div>{THREE}</div></body>",
        f'<body class="has-sidebar"><div class="post no-comments">{PARAGRAPHS}</div></body>',
        f'<div class="comment-page"><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div>',
        f"<article><section><p>{ONE}</p></section><section><p>{TWO}</p></section><section><p>{THREE}</p></section></article>",
        f"<article><!-- <p>{TWO}</p> --><script>var t='</p></article>';</script>{PARAGRAPHS}<style>p{{}}</style></article>",
    ],
)
def test_only_the_text(page):
    assert main_blocks(page) == WHOLE


def test_headings_lists_and_tables_of_an_article_stay():
    page = (
        f"<article><header><h1>A title</h1><p>By somebody</p></header><p>{ONE}</p><h2>More</h2><ul><li>one thing<li>another</ul>"
        f"<table><tr><td>a<td>b</table><blockquote>{TWO}</blockquote><pre>x\n  y</pre><p>short</article>"
    )
    assert main_blocks(page) == ["A title", ONE, "More", "one thing", "another", "a", "b", TWO, "x y", "short"]


def test_references_and_white_space():
    page = f"<article><p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9; &copy 2\n\n\t x&nbsp;y <b>bo</b>ld<br>line {ONE}</p></article>"
    assert main_blocks(page) == [f"a&b <c> ééé © 2 x y bold line {ONE}"]


@pytest.mark.parametrize("page", ["", "  ", "<p>", "<a", "</", "<!--", "<script>x", "<p class='", "<!doctype html><title>x</title>", "<nav>a</nav>"])
def test_pages_without_text(page):
    assert main_blocks(page) == []


def test_plain_text_and_broken_markup():
    assert main_blocks("just text") == ["just text"]
    assert main_blocks(f"<article><p><b>{ONE}<p>{TWO}</b></div></article></article><p") == [ONE, TWO]
    assert main_blocks("<") == ["<"]
    assert main_blocks("a < b and 3 <4") == ["a < b and 3 <4"]


def test_time_is_linear():
    for piece in ("<b>x", "<div>x", "<p>x</p>", "</i>", "<i></b>", "<!--", "<a href=\"", "<li>x", "<", "&amp", "<p a='b"):
        start = time.perf_counter()
        main_blocks(piece * 60_000)
        assert time.perf_counter() - start < 8, piece


def test_given_pages(spark):
    """The pages of the test tables hold their text in one element."""
    rows = {r.page_id: r for r in QUERIES["op13_tree_scoring"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        inside = re.sub("</?b>", "", page.html.partition("<article>")[2].partition("</article>")[0]).replace("<br>", " ")
        blocks = [" ".join(H.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inside)]
        row = rows[page.page_id]
        assert row.text == "\n\n".join(b for b in blocks if b)
        assert (row.url, row.n_chars) == (page.url, len(row.text))


def test_awkward_rows(spark):
    long = "<article>" + f"<p>{ONE}</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", long), (3, "v", "<p>x"), (4, "v", "😀<p>é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 key", "2 blocks", "3 text", "4 n_chars")
    got = sorted(extract_main_text(pages).collect(), key=str)
    assert [(r.page_id, r.url, r.n_chars) for r in got if r.page_id != 2] == [(1, None, 0), (1, None, 0), (3, "v", 1), (4, "v", 4), (None, "u", 0)]
    assert [len(r.blocks) for r in got if r.page_id == 2] == [50_000]
    assert [r.text for r in got if r.page_id == 4] == ["😀\n\né"]
    assert extract_main_text(pages.filter("false")).count() == 0
