"""Documents from web pages: sitemaps, crawls over a table of links, page loading.

Fetching is a function of the caller's (a url gives status, content type and body), called by the tasks of a data source;
offline runs give a table of pages instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.html import extract_html, links, main_content, same_origin
from ..tables import cut

#: Limits of a crawl.
MAX_PAGES, PAGE_BYTES, SITEMAP_BYTES = 500, 10 << 20, 5 << 20
Fetch = Callable[[str], tuple[int, str, bytes]]


def sitemap_candidates(root: str) -> list[str]:
    at = urlsplit(root)
    return [f"{at.scheme}://{at.netloc}{path}" for path in ("/sitemap.xml", "/sitemap_index.xml")] + [root.rstrip("/") + "/sitemap.xml"]


def parse_sitemap(xml: str, base: str) -> tuple[list[str], list[str]]:
    """Page addresses of the base's origin, and addresses of further sitemaps."""
    try:
        tree = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return [], []
    locs = [(node.text or "").strip() for node in tree.iter() if node.tag.rsplit("}", 1)[-1] == "loc"]
    if tree.tag.rsplit("}", 1)[-1] == "sitemapindex":
        return [], locs
    return [u for u in locs if same_origin(u, base)], []


def discover_sitemap(fetch: Fetch, root: str) -> list[str]:
    """Addresses of the first sitemap that has any."""
    for first in dict.fromkeys(sitemap_candidates(root)):
        found: dict[str, None] = {}
        queue, seen = [first], set()
        while queue:
            url = queue.pop(0)
            if url in seen:
                continue
            seen.add(url)
            status, _, body = fetch(url)
            if status == 200 and len(body) <= SITEMAP_BYTES:
                pages, more = parse_sitemap(body.decode("utf-8", "replace"), root)
                found |= dict.fromkeys(pages)
                queue += more
        if found:
            return list(found)
    return []


def link_table(pages: DataFrame, url: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """source, target, pos: distinct links of each page in order."""
    return pages.select(F.col(url).alias("source"), F.posexplode(links(F.col(html), F.col(url), base)).alias("pos", "target"))


def crawl(link_rows: DataFrame, root: str, max_pages: int = MAX_PAGES, max_depth: int = 0) -> DataFrame:
    """url, depth: breadth first over a table of links from the root. Pages at max_depth are not expanded (0: no
    bound); at most max_pages (0: 500) are kept, nearest first, then by address."""
    spark = link_rows.sparkSession
    bound = max_pages or MAX_PAGES
    frontier = spark.createDataFrame([(root, 0)], "url string, depth int")
    seen, depth, count = frontier, 0, 1
    while count < bound and (not max_depth or depth < max_depth):
        depth += 1
        fresh = link_rows.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(depth)), "frontier")
        more = frontier.count()
        if not more:
            break
        seen = cut(seen.unionByName(frontier), "seen")
        count += more
    return seen.orderBy("depth", "url").limit(bound)


def page_documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """path, title, doc_type, content, file_hash of each page with any text; a page without a title is called by
    the path of its address, else by its host."""
    rows = pages.select(F.col(url).alias("path"), main_content(F.coalesce(F.col(html), F.lit(""))).alias("m"))
    place = F.coalesce(F.nullif(F.regexp_replace(F.try_parse_url("path", F.lit("PATH")), "^/$", ""), F.lit("")), F.try_parse_url("path", F.lit("HOST")))
    return rows.where(F.trim("m.text") != "").select("path", F.coalesce(F.nullif(F.col("m.title"), F.lit("")), place).alias("title"), F.lit("web").alias("doc_type"), F.col("m.text").alias("content"), F.sha2("m.text", 256).alias("file_hash"))


PAGE = "url string, depth int, status int, kind string, body binary"


class _Reader(DataSourceReader):
    """A partition for each `size` addresses; each is fetched by one task, with the caller's function."""

    def __init__(self, urls: list[tuple[str, int]], fetch: Fetch, size: int):
        self.urls, self.fetch, self.size = urls, fetch, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url, depth in partition.value:
            try:
                status, kind, body = self.fetch(url)
            except OSError:  # no answer
                status, kind, body = 0, "", b""
            yield url, depth, status, kind, body[:PAGE_BYTES]


def page_source(urls: list[tuple[str, int]], fetch: Fetch, size: int = 4) -> type[DataSource]:
    """A data source `pages` that reads the addresses (url, depth) through `fetch`; to be registered with a session."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pages"

        def schema(self) -> str:
            return PAGE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(urls, fetch, size)

    return Pages


def fetched(spark: SparkSession, urls: list[tuple[str, int]], fetch: Fetch) -> DataFrame:
    """Pages of the addresses, fetched once each and written: links and texts come from the same answers."""
    spark.dataSource.register(page_source(urls, fetch))
    return cut(spark.read.format("pages").load(), "pages")


def crawl_site(spark: SparkSession, root: str, fetch: Fetch, max_pages: int = MAX_PAGES, max_depth: int = 0, skip_sitemap: bool = False) -> DataFrame:
    """Pages of a site (url, depth, status, kind, body): those of its sitemap, else breadth first along its own links
    from the root, level by level. At most max_pages (0: 500) are fetched; those at max_depth (0: no bound) are not
    expanded. Each level's new addresses, a bounded list, are what the next one's reader is given."""
    bound = max_pages or MAX_PAGES
    listed = [] if skip_sitemap else discover_sitemap(fetch, root)
    if listed:
        return fetched(spark, [(u, 0) for u in listed[:bound]], fetch)
    seen, level, depth, found = {root}, [root], 0, []
    while level:
        pages = fetched(spark, [(u, depth) for u in level], fetch)
        found.append(pages)
        depth += 1
        if len(seen) >= bound or (max_depth and depth > max_depth):
            break
        html = pages.where("status = 200 AND kind LIKE 'text/html%'").select("url", F.decode("body", "UTF-8").alias("html"))
        known = spark.createDataFrame([(u,) for u in sorted(seen)], "target string")
        fresh = link_table(html, base=root).select("target").distinct().join(F.broadcast(known), "target", "left_anti")  # bounded by max_pages
        level = [r["target"] for r in fresh.orderBy("target").limit(bound - len(seen)).collect()]
        seen |= set(level)
    return reduce(DataFrame.unionByName, found)


def site_documents(pages: DataFrame) -> DataFrame:
    """path, title, doc_type, content, file_hash and mtime (null) of pages that answered 200 with HTML or plain text that is
    not blank. The hash is the content's, so a page whose markup alone has changed is unchanged."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, kind, body in zip(part["url"], part["kind"], part["body"], strict=True):
                text = bytes(body).decode("utf-8", "replace")
                title, content = extract_html(text) if kind.startswith("text/html") else ("", text)
                if content.strip():
                    rows.append((url, title or urlsplit(url).path.strip("/") or urlsplit(url).netloc, content))
            yield pd.DataFrame(rows, columns=["path", "title", "content"])

    wanted = pages.where("status = 200 AND (kind LIKE 'text/html%' OR kind LIKE 'text/plain%')").select("url", "kind", "body")
    rows = wanted.mapInPandas(read, "path string, title string, content string")
    return rows.select("path", "title", F.lit("web").alias("doc_type"), "content", F.sha2("content", 256).alias("file_hash"), F.lit(None).cast("long").alias("mtime"))
