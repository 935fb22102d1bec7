"""HTML read by a tokenizer: the elements of every page that catalogue pages are read from, as one array column.

Spark cuts the pages into Arrow batches; the helper below reads one page at a time.  Picking links, headings and paragraphs
out of the array is left to column expressions (``pages``), so a page stays one row and nothing is shuffled.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEPT = ("a", "b", "h1", "p")
HIDDEN = ("script", "style", "noscript", "template")
#: Starts of these, and ends of all but p, end a paragraph, a heading, a bold text or a link that was left open.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SPACE = re.compile(r"[ \t\n\r\f\v]+")
ELEMENTS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class _Reader(HTMLParser):
    """Collects KEPT elements in order of their starts; text is gathered once for a page and cut by offsets."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.found, self.open, self.hidden, self.at = [], [], [], [], 0

    def parse_marked_section(self, i, report=1):  # read like a comment, as browsers do
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        self.at += 1
        self.pieces.append(" ")
        if tag in HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in BLOCKS:
            self._close(lambda e: True)
        if tag in KEPT:
            self._close(lambda e: e["tag"] == tag)
            href = next((v or "" for k, v in attrs if k == "href"), None)
            self.found.append({"tag": tag, "href": href, "start": self.at, "from": len(self.pieces)})
            self.open.append(self.found[-1])

    def handle_startendtag(self, tag, attrs):  # a slash does not close an element in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.at += 1
        self.pieces.append(" ")
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        elif not self.hidden:
            self._close(lambda e: e["tag"] == tag or (tag in BLOCKS and tag != "p"))

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)

    def _close(self, which):
        for e in self.open:
            if which(e):
                e.update(end=self.at, to=len(self.pieces))
        self.open = [e for e in self.open if "to" not in e]

    def elements(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self.at += 1
        self._close(lambda e: True)
        return [{k: e[k] for k in ("tag", "href", "start", "end")} | {"text": SPACE.sub(" ", "".join(self.pieces[e["from"] : e["to"]])).strip(" ")} for e in self.found]


def read_elements(html: str | None) -> list[dict]:
    return _Reader().elements(html or "")


def with_elements(pages: DataFrame, *keys: str) -> DataFrame:
    """The key columns of ``pages`` and `elements`: (tag, href, text, start, end) of every a, b, h1 and p, by start.

    Start and end count tags, so of two elements the one with the smaller end is over before the other starts.  Character
    references are resolved in texts and links; comments and hidden elements are passed over; tags are spaces in a text and
    white space collapses.  An element left open ends where a block starts or ends, at another of its kind or at the page's end.
    A null or empty page has no elements; repeated rows get equal ones.
    """
    rows = pages.select(*keys, "html")

    def run(batches):
        import pyarrow as pa  # on the executors only: the module itself loads without it

        element = pa.struct([("tag", pa.string()), ("href", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            elements = pa.array([read_elements(h.as_py()) for h in batch.column(len(keys))], pa.list_(element))
            yield pa.record_batch([*batch.columns[: len(keys)], elements], [*keys, "elements"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keys)], T.StructField("elements", ELEMENTS)]))
