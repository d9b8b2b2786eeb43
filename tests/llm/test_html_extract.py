import re
from html import unescape

import pytest

from cdmspark.llm.html_blocks import blocks
from cdmspark.llm.html_extract import extract, main_text, op5_html_extraction, train
from cdmspark.llm.html_labels import labelled_table
from tests.conftest import SF_SMALL

TREE = train()
LONG = "This paragraph has enough words to look like the running text of an article, as it does here. "


def test_tree_learns_its_table():
    from cdmspark.llm.html_extract import share
    rows, labels = labelled_table()
    wrong = sum((share(TREE, r) >= 0.5) != bool(y) for r, y in zip(rows, labels))
    assert len(labels) > 150 and wrong <= 0.02 * len(labels)


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<", ""), ("<p", ""), ("<script>var a='<p>no</p>'", ""), ("<!-- <p>no</p>", ""),
    ("<article><p>a &amp;amp; b&nbsp;\n\t c&#x41;<br>d</p><p>e</p></article>", "a &amp; b cA d\n\ne"),
    ("<article><p>One<p>Two <b>bold</b>face<p>x < y & z</article>", "One\n\nTwo boldface\n\nx < y & z"),
    ("<article><script>var t=\"</p>\";</script><style>p{}</style><p>kept</p><svg><text>no</text></svg></article>", "kept"),
    (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>No.</p>"
     "<section class='comments'><p>First comment with quite a lot of words in it, as readers write them.</p></section>"
     "<p>End</p></article><aside><p>Side words that go on for long enough to look like text.</p></aside>"
     "<footer>&copy; 2020</footer>", f"Title\n\n{LONG.strip()}\n\nNo.\n\nEnd"),
    (f"<div id='header'>Site</div><div class='cookie-banner'><p>{LONG}</p></div><div class='content has-sidebar'><p>{LONG}</p>"
     f"<p>Short.</p><p>{LONG}</p></div><form><p>{LONG}</p></form><div class='footer'><p>{LONG}</p></div>",
     f"{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"),
    (f"<div style='display:none'>{LONG}</div><main><div hidden>{LONG}</div><p>{LONG}", LONG.strip()),
    (f"<form id=f><main><p>{LONG}</p></main></form>", LONG.strip()),
])
def test_pages(page, want):
    assert main_text(page, TREE) == want


def test_long_and_odd_markup():
    words = " ".join(["w"] * 300_000)
    assert main_text(f"<article><p>{words}</p>", TREE) == words
    assert len(blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    assert [b.text for b in blocks("a<![CDATA[b]]>c<?php x ?>d</p></div>e")] == ["abcd", "e"]
    assert blocks("<p " + '"' * 5001)[:1] == []


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (None, "<article><p>x</p></article>")], "page_id long, html string")
    got = df.withColumn("text", extract(df.html, TREE)).orderBy("page_id").collect()
    assert [r.text for r in got] == ["x", ""]
    assert df.limit(0).withColumn("text", extract(df.html, TREE)).count() == 0


def test_query_takes_the_whole_article(spark):
    """By brute force: these pages hold their article in one element and cut it by p and h1."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = op5_html_extraction(spark, SF_SMALL).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        body = re.search("<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
