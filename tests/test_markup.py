"""The tokenizer against pages whose elements are known."""

import pytest

from reqlake.sources import markup, pages

LONG = "words that are enough to be taken for a description of a course, certainly"


@pytest.mark.parametrize(
    "html, expected",
    [
        (None, []),
        ("plain text, no tags & no < elements", []),
        ("<a href='/x?a=1&amp;b=2'>A &lt;b&gt; &eacute;</a>", [("a", "/x?a=1&b=2", "A <b> é")]),
        ("<A HREF=/bare>bare</A><a name=n>no link</a><a href>empty</a>", [("a", "/bare", "bare"), ("a", None, "no link"), ("a", "", "empty")]),
        ("<!-- <a href='/hidden'>x</a> --><h1>One <i>two</i><br>three</h1>", [("h1", None, "One two three")]),
        ("<script>'<a href=\"/no\">'</script><style>p{}</style><noscript><p>no</noscript><p>yes", [("p", None, "yes")]),
        ("<p>first<p>second</p>outside<p>third<div>not it</div>", [("p", None, "first"), ("p", None, "second"), ("p", None, "third")]),
        ("<h1>open <p>text <b>bold<p>next", [("h1", None, "open"), ("p", None, "text bold"), ("b", None, "bold"), ("p", None, "next")]),
        ("<article><p><b>cut off<br></article>after<footer>foot", [("p", None, "cut off"), ("b", None, "cut off")]),
        ("<p>a > b, 1 < 2</p><![if x]><p title='>'>quoted</p>", [("p", None, "a > b, 1 < 2"), ("p", None, "quoted")]),
        ("<p>\u00a0kept\u00a0</p><p> \n a \t b </p></p></h1>", [("p", None, "\u00a0kept\u00a0"), ("p", None, "a b")]),
    ],
)
def test_elements(html, expected):
    assert [(e["tag"], e["href"], e["text"]) for e in markup.read_elements(html)] == expected


def test_starts_and_ends_tell_what_follows():
    nav, h1, link, after = markup.read_elements("<p>nav</p><h1>t <a href=/x>x</a></h1><p>after")
    assert nav["end"] <= h1["start"] < link["start"] < link["end"] < h1["end"] <= after["start"]


def test_pages_of_real_markup(spark):
    rows = [
        (1, "https://h/one", f"<!-- <h1>not</h1> --><p>{LONG} nav</p><h1 class='t'>Caf&eacute; &amp; more</h1><p>short<p>{LONG}&hellip;</p><a href='/a'>1</a><a href=\"/b\">2</a><a href=/a>3</a>"),
        (2, "https://h/two?q=1", "<p>no heading"), (3, "https://h/three", None), (3, "https://h/three", None),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS elements", "2 AS pos", "3 AS link")
    assert sorted(map(tuple, pages.links(table).collect())) == [(1, 0, "/a"), (1, 1, "/b")]
    assert sorted(map(tuple, pages.headings(table).collect())) == [(1, "Café & more", True), (2, "two", False), (3, "three", False), (3, "three", False)]
    assert {tuple(r) for r in pages.first_paragraphs(table).collect()} == {(1, f"{LONG}…"), (2, None), (3, None)}
    assert pages.links(table.limit(0)).count() == 0
