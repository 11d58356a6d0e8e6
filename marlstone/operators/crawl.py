"""Crawl operators over stored pages: metadata, links, classification, text, sitemaps, team members."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import normalize_url, strip
from ..sources.shared import written

# File types by extension and by content type.
TYPE_OF_EXTENSION = {"pdf": "PDF", "docx": "DOCX", "md": "MD", "markdown": "MD", "html": "HTML", "htm": "HTML"}
TYPE_OF_CONTENT = {"application/pdf": "PDF", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX", "text/markdown": "MD", "text/html": "HTML"}

# Classes of elements that hold a team member's name, and a role.
NAME_CLASSES = {"member-name", "member_name", "team-member-name", "team_member_name"}
ROLE_CLASSES = {
    "member-designation", "member_title", "member-role", "member_role", "team-member-role", "team_member_role", "designation", "position", "role",
}
#: Parts in which a crawl's frontier is put in order, and pages whose texts a worker holds at one time.
SALTS, PAGES = 16, 64
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _literal_map(m: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in m.items() for x in kv))


def file_type(url: Column, content_type: Column | None = None) -> Column:
    """By the path's extension, else by the content type, else PDF."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    by_content = F.lit(None).cast("string") if content_type is None else F.try_element_at(_literal_map(TYPE_OF_CONTENT), F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))))
    return F.coalesce(F.try_element_at(_literal_map(TYPE_OF_EXTENSION), extension), by_content, F.lit("PDF"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, url): the title, or the url where there is none."""
    title = strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", F.when(title == "", F.col("url")).otherwise(title).alias("title"), "url")


def hrefs(html: Column) -> Column:
    """Link targets in order, without mailto, tel and javascript."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike(r"(?i)^\s*(mailto:|tel:|javascript:)"))


@F.udtf(returnType="place int, href string")
class LinkRows:
    """A page's link targets as rows, in order, by the rule of hrefs(), for a lateral join."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str]]:
        targets = (m[1] for m in re.finditer(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"']", html or ""))
        yield from enumerate(t for t in targets if not re.match(r"(?i)\s*(mailto:|tel:|javascript:)", t))


def allowed(host: Column, domains: list[str]) -> Column:
    """Is a host one of the domains or below one?"""
    host = F.lower(host)
    return F.exists(F.array(*(F.lit(d.lower()) for d in domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, internal): absolute normalised links of each page; internal if the host is the page's own."""

    @F.pandas_udf(StringType())
    def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
        def join(b: str, x: str) -> str | None:
            try:
                return urljoin(b, x)
            except ValueError:
                return None

        return pd.Series([join(b, x) for b, x in zip(base, link, strict=True)])

    rows = pages.select("page_id", "url", F.explode(hrefs(F.col("html"))).alias("href"))
    rows = rows.withColumn("link", normalize_url(F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).otherwise(absolute("url", "href"))))
    host = lambda c: F.lower(F.try_parse_url(F.col(c), F.lit("HOST")))
    return rows.select("page_id", "link", (host("link") == host("url")).alias("internal"))


def sitemap_urls(robots: Column) -> Column:
    """The first sitemap line of a robots.txt that names anything; null if there is none. Lines end as Python's do."""
    lines = F.transform(F.split(robots, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), strip)
    named = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("sitemap:")), lambda x: strip(F.substring(x, 9, 1 << 30)))
    return F.get(F.filter(named, lambda x: x != ""), F.lit(0))


def _locations(xml: str) -> list[str] | None:
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    if local(root) != "urlset":
        return None
    out = []
    for url in (e for e in root if local(e) == "url"):
        first = next((e for e in url if local(e) == "loc"), None)
        plain = url.find("loc")
        found = next((e.text for e in (first, plain) if e is not None and e.text), "")
        if found.strip():
            out.append(found.strip())
    return out


@F.pandas_udf(ArrayType(StringType()))
def sitemap_locations(xml: pd.Series) -> pd.Series:
    """The locations of a flat sitemap: of each url right under a urlset its first loc, without white space around it.
    Null for an index, another root, and what is no XML; an empty list for a sitemap without a location.
    """
    return xml.map(_locations, na_action="ignore")


def discover(roots: DataFrame, documents: DataFrame, links: DataFrame, most_pages: int) -> DataFrame:
    """(root, url, source): the pages of each root (root, a normalised url), over stored responses (url, status, body) and
    the links of stored pages (url, link).

    The root's host is asked for robots.txt, and the sitemap that it names is read; its locations are the root's pages
    (source SITEMAP). Where one of these is missing, was answered with 400 or more, or is no flat sitemap, the root is
    crawled breadth first (BFS_FALLBACK), most_pages of each root at most. Null roots are none.
    """
    answers = documents.where("status < 400 AND url IS NOT NULL").groupBy("url").agg(F.max("body").alias("body"))
    asked = roots.where("root IS NOT NULL").select("root").distinct().withColumn("url", F.concat(F.regexp_extract("root", "^([^:/?#]+://[^/?#]*)", 1), F.lit("/robots.txt")))
    named = asked.join(answers, "url").select("root", sitemap_urls(F.col("body")).alias("url")).where("url IS NOT NULL")
    read = written(named.join(answers, "url").select("root", sitemap_locations("body").alias("found")).where("found IS NOT NULL"))
    listed = read.select("root", F.explode("found").alias("url"), F.lit("SITEMAP").alias("source"))
    left = asked.select("root").join(read, "root", "left_anti")
    crawled = crawl_each(left.select("root", F.col("root").alias("url")), links, most_pages)
    return listed.unionByName(crawled.select("root", "url", F.lit("BFS_FALLBACK").alias("source")))


class _Page(HTMLParser):
    """Text as Markdown-like lines, and (name, role) pairs: whole text of elements with a class of NAME_CLASSES, and of the
    next ones with a class of ROLE_CLASSES.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.line, self.skip, self.name, self.team = [], "", 0, None, []
        self.open: list[tuple[str, str | None, list[str]]] = []  # tag, name or role, text so far

    def _end_line(self) -> None:
        if self.line.strip():
            self.lines.append(" ".join(self.line.split()))
        self.line = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = set((dict(attrs).get("class") or "").split())
        if tag not in VOID:
            self.open.append((tag, "name" if classes & NAME_CLASSES else "role" if classes & ROLE_CLASSES else None, []))
        if tag in ("title", "script", "style", "nav", "footer", "header"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._end_line()
            self.line = "#" * int(tag[1]) + " "
        elif tag == "li":
            self._end_line()
            self.line = "- "
        elif tag in ("p", "div", "br", "tr", "table", "section", "article"):
            self._end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in (t for t, *_ in self.open):  # elements left open inside end here too
            while self.open:
                inner, kind, parts = self.open.pop()
                self._pair(kind, " ".join("".join(parts).split()))
                if inner == tag:
                    break
        if tag in ("title", "script", "style", "nav", "footer", "header"):
            self.skip = max(self.skip - 1, 0)
        elif tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._end_line()

    def _pair(self, kind: str | None, text: str) -> None:
        if kind == "name" and text:
            self.name = text
        elif kind == "role" and text and self.name:
            self.team.append((self.name, text))
            self.name = None

    def handle_data(self, data: str) -> None:
        for _, kind, parts in self.open:
            if kind:
                parts.append(data)
        if not self.skip:
            self.line += data


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, markdown, team): main text, and team members as `name: role`. An approximation by the standard parser:
    headings, list items and paragraphs become lines; scripts, styles and page furniture go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part, out = batch.slice(at, PAGES), []
                for html in part.column(1).to_pylist():
                    p = _Page()
                    p.feed(html or "")
                    p.close()
                    p._end_line()
                    out.append(("\n".join(p.lines), [f"{n}: {r}" for n, r in p.team]))
                made = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *made], names=["page_id", "markdown", "team"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, markdown string, team array<string>")


def crawl(roots: DataFrame, links: DataFrame, most_pages: int) -> DataFrame:
    """(url, step): as crawl_each(), of one crawl from all roots (url) together."""
    return crawl_each(roots.select(F.lit("").alias("root"), "url"), links, most_pages).select("url", "step")


def crawl_each(roots: DataFrame, links: DataFrame, most_pages: int) -> DataFrame:
    """(root, url, step): pages that breadth-first crawls over stored links (url, link) fetch, one crawl for each root, which
    begins at its urls (root, url), in the step it does. Each step takes a crawl's frontier in order of urls until it has
    visited most_pages; what has no page counts as visited but is not returned. All crawls take a step together, and no
    url comes to the driver. A row with a null link says that a page is there. A frontier's first urls are found in SALTS parts, then among those.
    """
    known = written(links.select("url", "link").distinct())
    frontier, visited, step = roots.select("root", "url").distinct(), None, 0
    while True:
        batch = frontier if visited is None else frontier.join(visited.select("root", "url"), ["root", "url"], "left_anti")
        spent = F.lit(0) if visited is None else F.coalesce("spent", F.lit(0))
        if visited is not None:
            batch = batch.join(visited.groupBy("root").agg(F.count(F.lit(1)).alias("spent")), "root", "left")
        batch = batch.withColumns({"left": F.lit(most_pages) - spent, "salt": F.pmod(F.xxhash64("url"), F.lit(SALTS))})
        for by in (["root", "salt"], ["root"]):
            batch = batch.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("url"))).where("n <= left")
        batch = written(batch.select("root", "url", F.lit(step).alias("step")))
        if not batch.head(1):
            break
        visited, step = batch if visited is None else written(visited.unionByName(batch)), step + 1
        frontier = known.where("link IS NOT NULL").join(batch.select("root", "url"), "url").select("root", F.col("link").alias("url")).distinct()
    pages = known.select("url").distinct()
    return batch if visited is None else visited.join(pages, "url", "left_semi").select("root", "url", "step")
