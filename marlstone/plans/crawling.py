"""Queries of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl as C
from ..sources import tables as T
from .base import query


@query("src13_page_metadata", "SELECT page_id, url, CASE WHEN t = '' THEN url ELSE t END AS title FROM (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_metadata(T.read(spark, sf_dir, "pages")).select("page_id", "url", "title")


HREFS = """SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: NOT regexp_matches(x, '(?i)^\\s*(mailto:|tel:|javascript:)'))) AS href FROM pages"""


@query("src15_pf23_hrefs", f"SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_distinct, min(href) AS least FROM ({HREFS}) GROUP BY page_id")
def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "pages").select("page_id", F.explode(C.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("n_distinct"), F.min("href").alias("least"))


@query("udf4_link_rows", f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, h[i] AS href FROM (SELECT page_id, list(href) AS h, unnest(range(1, len(list(href)) + 1)) AS i FROM ({HREFS}) GROUP BY page_id)")
def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by a table function, joined laterally."""
    pages = T.read(spark, sf_dir, "pages")
    return pages.lateralJoin(C.LinkRows(F.col("html").outer())).select("page_id", "place", "href")


@query("src16_link_classes", f"SELECT page_id, count(*) FILTER (WHERE NOT regexp_matches(href, '(?i)^https?://') OR lower(regexp_extract(href, '(?i)^https?://([^/?#:]*)', 1)) = lower(regexp_extract(url, '(?i)^https?://([^/?#:]*)', 1))) AS internal, count(*) AS links FROM ({HREFS}) GROUP BY page_id")
def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.links(T.read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count_if("internal").alias("internal"), F.count(F.lit(1)).alias("links"))


@query("sc6_normalized_urls", "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(url, '(\\?[^#]*)', 1) AS url FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages)")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import normalize_url

    return T.read(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("pf22_allowed_domains", "SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org' AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h FROM pages)")
def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return T.read(spark, sf_dir, "pages").select("page_id", C.allowed(host, ["example.com", "example.org"]).alias("allowed"))


@query("sc7_src11_file_types", "SELECT page_id, CASE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'DOCX' WHEN 'md' THEN 'MD' WHEN 'markdown' THEN 'MD' WHEN 'html' THEN 'HTML' WHEN 'htm' THEN 'HTML' ELSE 'PDF' END AS file_type FROM pages")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").select("page_id", C.file_type(F.col("url")).alias("file_type"))


@query("src12_src14_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_text(T.read(spark, sf_dir, "pages"))


@query("src5_so11_frontier_step", f"SELECT DISTINCT href FROM ({HREFS}) WHERE href NOT IN (SELECT href FROM (" + HREFS.replace("FROM pages", "FROM pages WHERE page_id % 3 = 0") + ")) ORDER BY href LIMIT 100")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.read(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(C.hrefs(F.col("html"))).alias("href"))
    visited = links.where("page_id % 3 = 0").select("href").distinct()
    return links.select("href").distinct().join(visited, "href", "left_anti").orderBy("href").limit(100)
