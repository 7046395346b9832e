"""Main content, titles and links of HTML pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import by_pieces

#: Elements without content, content elements and id/class markers, block elements, void elements.
SKIPPED = {"script", "style", "noscript", "nav", "footer", "header", "aside", "button", "form", "svg", "img", "figure"}
ROOTS = {"article", "main"}
MARKERS = ("content", "main", "article", "post", "entry", "body")
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "hr", "dl", "dt", "dd"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Reads a page once: text under each candidate root, title, first heading and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.skip = self.pre = 0
        self.root: int | None = None
        self.done = False
        self.text: list[str] = []
        self.all: list[str] = []
        self.title: list[str] = []
        self.heading: list[str] = []
        self.headed = False
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in given:
            self.links.append(given["href"])
        if tag in BLOCKS:
            self._put("\n")
        if tag in VOID:
            return
        self.stack.append(tag)
        self.skip += tag in SKIPPED
        self.pre += tag == "pre"
        named = f"{given.get('id', '')} {given.get('class', '')}".lower()
        if self.root is None and not self.done and not self.skip and tag not in ("html", "head", "title") and (tag in ROOTS or any(m in named for m in MARKERS)):
            self.root = len(self.stack)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            closed = self.stack.pop()
            self.skip -= closed in SKIPPED
            self.pre -= closed == "pre"
            if closed in BLOCKS:
                self._put("\n")
            if closed == "h1" and self.root is not None:
                self.headed = True
            if self.root is not None and len(self.stack) < self.root:
                self.root, self.done = None, True
            if closed == tag:
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title":
            self.title.append(data)
        elif not self.skip and "head" not in self.stack:
            self._put(data if self.pre else re.sub(r"\s+", " ", data))
            if "h1" in self.stack and not self.headed and (self.root is not None or self.done is False):
                self.heading.append(data)

    def _put(self, data: str) -> None:
        if not self.skip:
            self.all.append(data)
            if self.root is not None:
                self.text.append(data)


def extract_html(html: str) -> tuple[str, str]:
    """Title and text. The text is that of the first article, main, or element marked as content, else of the
    whole page: white space runs become one blank outside pre, blocks begin a line. The title is the page's
    own, else its first h1."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = [re.sub(r" {2,}", " ", x).strip() for x in "".join(reader.text or reader.all).split("\n")]
    title = " ".join("".join(reader.title).split()) or " ".join("".join(reader.heading).split())
    return title, "\n".join(x for x in lines if x)


def resolve_url(base: str, href: str) -> str:
    """The absolute http(s) address without query and fragment; empty for others and for bare fragments."""
    href = href.strip()
    if not href or href.startswith("#"):
        return ""
    try:
        at = urlsplit(urldefrag(urljoin(base, href)).url)
    except ValueError:
        return ""
    return urlunsplit((at.scheme, at.netloc, at.path, "", "")) if at.scheme in ("http", "https") and at.netloc else ""


def same_origin(url: str, base: str) -> bool:
    one, two = urlsplit(url), urlsplit(base)
    return one.netloc == two.netloc and one.path.startswith(two.path)


def page_links(html: str, url: str, base: str | None = None) -> list[str]:
    """Distinct resolved links in order; of the base's origin only, if one is given."""
    reader = _Reader()
    reader.feed(html)
    found = dict.fromkeys(u for u in (resolve_url(url, h) for h in reader.links) if u)
    return [u for u in found if base is None or same_origin(u, base)]


# Types as objects: a worker that imports this module has no session to parse a type with.
@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def main_content(pages: pa.Array) -> pa.Array:
    names = ("title", "text")
    return by_pieces(lambda h: dict(zip(names, extract_html(h) if h else ("", ""), strict=True)), pa.struct([(n, pa.string()) for n in names]), pages)


def links(html: Column, url: Column, base: str | None = None) -> Column:
    @F.arrow_udf("array<string>")
    def found(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return by_pieces(lambda h, u: page_links(h or "", u or "", base), pa.list_(pa.string()), pages, urls)

    return found(html, url)


@F.pandas_udf(T.StringType())
def resolved(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([resolve_url(b or "", h or "") for b, h in zip(bases, hrefs, strict=True)])
