"""Article extraction and Markdown from HTML: one Arrow pass with the standard library's parser.

Specification: script, style, noscript, template, nav, header, footer, aside, form and comments go; the
root is the first ``article``, else ``main``, else ``body``, else all.  Headings become ``#`` lines,
list items ``-`` or numbers, ``pre`` a fenced block, ``code``, bold, italic, links and image texts their
marks.  The title is the ``title`` element's text, else the first ``h1``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import sliced

# Elements by role.
DROPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "svg", "iframe", "button"}
BLOCKS = {"p", "div", "section", "article", "main", "body", "ul", "ol", "table", "tr", "blockquote", "figure", "figcaption", "dl", "dt", "dd", "hr"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
ROOTS = ("article", "main", "body")


class _Article(HTMLParser):
    """Collects Markdown for each candidate root at once; dropped elements are skipped with all they hold."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.spans: dict[str, list[int]] = {}
        self.open: list[str] = []
        self.skip = 0
        self.title: list[str] = []
        self.in_title = False
        self.heading: list[str] | None = None
        self.first_h1: str | None = None
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.site = ""
        self.description = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name == "og:site_name":
                self.site = a.get("content") or ""
            elif name in ("description", "og:description") and not self.description:
                self.description = a.get("content") or ""
            return
        if tag == "title" and not self.skip and not self.title:
            self.in_title = True
            return
        if tag not in VOID:
            if tag in DROPPED:
                self.skip += 1
            self.open.append(tag)
        if self.skip:
            return
        if tag in ROOTS and tag not in self.spans:
            self.spans[tag] = [len(self.out), -1]
        if tag == "p" and "p" in self.open[:-1] and self.open[-2:-1] == ["p"]:
            self.open.pop(-2)  # an unclosed paragraph ends where the next begins
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            self.heading = [] if tag == "h1" and self.first_h1 is None else self.heading
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(a.get("alt") or "")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
            return
        if tag in VOID or tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self._close(top)
            if top == tag:
                break

    def _close(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip -= 1
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            if tag == "h1" and self.heading is not None and self.first_h1 is None:
                self.first_h1, self.heading = " ".join("".join(self.heading).split()), None
            self.out.append("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        if tag in self.spans and self.spans[tag][1] < 0:
            self.spans[tag][1] = len(self.out)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
            return
        if self.skip:
            return
        text = data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data)
        if self.heading is not None:
            self.heading.append(text)
        self.out.append(text)


def collapse(markdown: str) -> str:
    return re.sub("\n{3,}", "\n\n", markdown).strip()


def extract(html: str | None) -> tuple[str, str, str, str, str]:
    """(title, markdown, text, excerpt, site); blanks for blank input."""
    if not html or not html.strip():
        return "", "", "", "", ""
    parser = _Article()
    parser.feed(html)
    parser.close()
    while parser.open:
        parser._close(parser.open.pop())
    a, b = next((parser.spans[r] for r in ROOTS if r in parser.spans), (0, len(parser.out)))
    body = "".join(parser.out[a : b if b >= 0 else len(parser.out)])
    lines = re.split(r"(```\n.*?\n```)", body, flags=re.S)
    markdown = collapse("".join(x if x.startswith("```") else re.sub(r"[ \t]*\n[ \t]*(?=\n|[^ \t-])", "\n", x) for x in lines))
    text = " ".join(re.sub(r"\]\([^)]*\)|[#*`\[\]|]", " ", markdown).split())
    title = " ".join("".join(parser.title).split()) or parser.first_h1 or ""
    excerpt = parser.description or next((" ".join(p.split())[:200] for p in markdown.split("\n\n") if p and not p.startswith("#")), "")
    return title, markdown, text, excerpt, parser.site


def extract_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, markdown, text, excerpt and site, in one pass over the HTML, which is dropped."""
    rest = [c for c in pages.columns if c != html]
    fields = ["title", "markdown", "text", "excerpt", "site"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html) + "".join(f", {f} string" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return article_batches(batches, html, rest, fields)

    return pages.mapInArrow(run, schema)


def article_batches(batches: Iterator[pa.RecordBatch], html: str, rest: list[str], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with what ``extract`` finds, in runs of about a MiB of HTML."""
    for batch in batches:
        for part in sliced(batch, html):
            got = zip(*map(extract, part.column(html).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(x, pa.string()) for x in got)], names=[*rest, *fields])
