"""Pages as an interval-encoded table of nodes: the one place where HTML is parsed.

``end_id`` is the last descendant's number, so *descendant of* is ``node_id`` between two numbers of
one page, and sums over a subtree are differences of running sums. ``path`` lists a node's ancestors
from the root, so joins of nodes with what stands above them are by equality, after an explode.
``outer_start`` and ``outer_end`` are places in the page's HTML; ``html_len`` is the length between
them with white-space runs as one character. Text in scripts and styles has the tag ``#data``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "page_id long, node_id int, end_id int, parent_id int, depth int, sib_idx int, n_children int, tag string, text string, attrs map<string,string>, "
    "path array<int>, outer_start int, outer_end int, html_len int"
)

#: Fixed values of HTML: elements without content, and what a start tag closes by itself.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


class _Tree(HTMLParser):
    """Rows of one page in document order; end tags that are implied are filled in."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html = html
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: list[int] = []

    def add(self, tag: str, text: str | None, attrs: dict) -> int:
        parent = self.open[-1] if self.open else -1
        index = 0
        if parent >= 0:
            index = self.children[parent]
            self.children[parent] += 1
        here = self.text_ends()
        self.rows.append([len(self.rows), len(self.rows), parent, len(self.open), index, 0, tag, text, attrs, list(self.open), here, -1, 0])
        self.children.append(0)
        return len(self.rows) - 1

    def place(self) -> int:
        line, column = self.getpos()
        return min(self.lines[line - 1] + column, len(self.html))

    def text_ends(self) -> int:
        """The place of the markup at hand, where a text before it ends."""
        here = self.place()
        if self.rows and self.rows[-1][11] < 0 and self.rows[-1][6][0] == "#":
            self.rows[-1][11] = here
        return here

    def close(self, depth: int, end: int | None = None) -> None:  # type: ignore[override]
        """Ends the open elements from a depth on: the outermost at end, what it closes by itself here."""
        here = self.place()
        for k, at in enumerate(self.open[depth:]):
            self.rows[at][1] = len(self.rows) - 1
            self.rows[at][11] = end if end is not None and k == 0 else here
        del self.open[depth:]

    def implied(self, tag: str) -> None:
        names = [self.rows[i][6] for i in self.open]
        if tag in _CLOSES:
            for k in range(len(names) - 1, -1, -1):
                if names[k] in _SCOPE[tag]:
                    break
                if names[k] in _CLOSES[tag]:
                    self.close(k)
                    break
        elif tag in _BLOCKS and "p" in names:
            self.close(len(names) - 1 - names[::-1].index("p"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.implied(tag)
        at = self.add(tag, None, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(at)
        else:
            self.rows[at][11] = self.place() + len(self.get_starttag_text() or "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.implied(tag)
        at = self.add(tag, None, {k: v or "" for k, v in attrs})
        self.rows[at][11] = self.place() + len(self.get_starttag_text() or "")

    def handle_endtag(self, tag: str) -> None:
        self.text_ends()
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][6] == tag:
                here = self.place()
                found = self.html.find(">", here)
                self.close(k, found + 1 if found >= 0 else len(self.html))
                break

    def handle_data(self, data: str) -> None:
        inside = self.rows[self.open[-1]][6] if self.open else ""
        self.add("#data" if inside in ("script", "style") else "#text", data, {})

    def handle_comment(self, data: str) -> None:
        self.add("#comment", data, {})

    def finish(self) -> list[list]:
        HTMLParser.close(self)
        for at in self.open:
            self.rows[at][1], self.rows[at][11] = len(self.rows) - 1, len(self.html)
        # Characters that count: all but white space after white space.
        space = np.array([c.isspace() for c in self.html], bool)
        counted = np.concatenate([[0], np.cumsum(~(space & np.append(False, space[:-1])))]).tolist()
        ends = [row[10] for row in self.rows[1:]] + [len(self.html)]
        for row, n, end in zip(self.rows, self.children, ends):
            row[5] = n
            if row[11] < 0:
                row[11] = end
            a, b = row[10], row[11]
            row[12] = max(counted[b] - counted[a] - (1 if b > a + 1 and self.html[b - 1].isspace() else 0), 0)
        return self.rows


def page_rows(html: str | None) -> list[list]:
    """(node_id, end_id, parent_id, depth, sib_idx, n_children, tag, text, attrs, path, outer_start, outer_end, html_len) of a page."""
    tree = _Tree(html or "")
    tree.feed(html or "")
    return tree.finish()


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The nodes of pages. A null or empty page has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "node_id", "end_id", "parent_id", "depth", "sib_idx", "n_children", "tag", "text", "attrs", "path", "outer_start", "outer_end", "html_len"]
        for batch in batches:
            for begin in range(0, len(batch), 64):  # a few pages at a time: their nodes are many
                part = batch.iloc[begin : begin + 64]
                rows = [[p, *row] for p, h in zip(part.iloc[:, 0], part.iloc[:, 1]) for row in page_rows(h)]
                yield pd.DataFrame(rows, columns=columns)

    return pages.select(key, html).mapInPandas(run, NODES)


def fragments(df: DataFrame, key: str, html: str) -> DataFrame:
    """The nodes of HTML fragments below and with their first element, renumbered from it; a fragment without elements has none."""
    nodes = parse_pages(df, key, html)
    first = nodes.where("depth = 0 and substr(tag, 1, 1) <> '#'").groupBy("page_id").agg(F.min_by(F.struct(F.col("node_id").alias("a"), F.col("end_id").alias("z")), "node_id").alias("f"))
    inside = nodes.join(first, "page_id").where("node_id between f.a and f.z")
    return inside.select(
        "page_id",
        *[(F.col(c) - F.col("f.a")).alias(c) for c in ("node_id", "end_id")],
        F.greatest(F.col("parent_id") - F.col("f.a"), F.lit(-1)).alias("parent_id"),
        "depth",
        F.when(F.col("depth") == 0, 0).otherwise(F.col("sib_idx")).alias("sib_idx"),
        *["n_children", "tag", "text", "attrs"],
        F.transform("path", lambda x: x - F.col("f.a")).alias("path"),
        *["outer_start", "outer_end", "html_len"],
    )
