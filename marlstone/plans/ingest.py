"""Queries of ingestion: chunks by category, batches of windows, answers, facts, upserts, sitemaps, crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, crawl, extraction, stages
from ..sources import tables as T
from .base import query
from .crawling import HREFS

#: Texts with headings: a document's lines, of which each fifth is made one, and the kind of each document.
TYPED = r"""typed AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'PDF' ELSE 'MD' END AS kind, regexp_replace(text, '([.!?]) (\w)', '\1' || chr(10) || '# \2') AS text FROM documents)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "CSV").when(F.col("doc_id") % 3 == 1, "PDF").otherwise("MD")
    # DuckDB replaces the first place only
    first = F.concat(F.regexp_extract("text", r"(?s)^(.*?[.!?]) \w", 1), F.lit("\n# "), F.expr(r"substring(text, length(regexp_extract(text, '(?s)^(.*?[.!?]) [a-zA-Z0-9_]', 1)) + 2)"))
    return T.read(spark, sf_dir, "documents").select("doc_id", kind.alias("source_type"), F.when(F.col("text").rlike(r"(?s)[.!?] \w"), first).otherwise(F.col("text")).alias("text"))


@query("nl1_nl2_nl4_chunk_document", f"""WITH {TYPED},
lines AS (SELECT doc_id, kind, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM typed WHERE text <> ''),
numbered AS (SELECT *, count(*) FILTER (WHERE kind <> 'CSV' AND line LIKE '#%' AND i > 0) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
parts AS (SELECT doc_id, kind, g, string_agg(line || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END, '' ORDER BY i) AS part FROM numbered GROUP BY ALL),
tokens AS (SELECT *, list_filter(regexp_split_to_array(part, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM parts WHERE part <> ''),
starts AS (SELECT *, unnest(range(0, greatest(len(w), 1), 425)) AS s FROM tokens WHERE len(w) > 0),
kept AS (SELECT * FROM starts WHERE s = 0 OR s + 75 < len(w))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, s) - 1 AS INTEGER) AS chunk_index, CAST(len(w[s + 1:s + 500]) AS INTEGER) AS token_count,
       CASE WHEN kind <> 'CSV' AND part LIKE '#%' THEN trim(regexp_extract(part, '^#+[\\x20\\x09]*([^\\n]*)', 1)) END AS heading,
       md5(CASE WHEN len(w) <= 500 THEN part ELSE array_to_string(w[s + 1:s + 500], ' ') END) AS chunk_md5 FROM kept""")
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk_document(_typed(spark, sf_dir), ["PDF", "MD"], ["CSV"])
    return made.select("doc_id", "chunk_index", "token_count", "heading", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("nl2_marked_sections", """
WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN doc_id % 7 > 0 THEN doc_id % 2 * 37 END AS first, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id END AS title FROM documents WHERE text <> ''),
m AS (SELECT *, unnest(range(0, greatest(n + 100 - first, 0), 400)) + first AS p FROM d WHERE first IS NOT NULL),
marks AS (SELECT *, (p - first) // 400 AS i, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM m),
s AS (SELECT doc_id, title, p AS start, least(coalesce(next, n), n) AS stop, 'H' || i AS heading, CAST(1 + i % 3 AS INTEGER) AS heading_level, text FROM marks
  UNION ALL SELECT doc_id, title, 0, least(coalesce(nullif(first, 0), n), n), NULL, NULL, text FROM d WHERE first IS NULL OR first > 0),
parts AS (SELECT *, substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS part FROM s WHERE stop > start),
tokens AS (SELECT *, list_filter(regexp_split_to_array(part, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM parts),
windows AS (SELECT *, unnest(range(0, greatest(len(w), 1), 40)) AS k FROM tokens WHERE len(w) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, k) - 1 AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", heading, heading_level, title,
       md5(CASE WHEN len(w) <= 50 THEN part ELSE array_to_string(w[k + 1:k + 50], ' ') END) AS chunk_md5 FROM windows WHERE k = 0 OR k + 10 < len(w)""")
def marked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with markers of three levels, some with a preamble, some without markers, the last marker behind the end."""
    docs = T.read(spark, sf_dir, "documents")
    first = F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 2 * 37)
    places = F.when(F.length("text") + 100 > first, F.sequence(first, F.length("text") + 99, F.lit(400).cast("long")))
    marks = F.transform(places, lambda p, i: F.struct(p.alias("position"), (1 + i % 3).alias("level"), F.concat(F.lit("H"), i.cast("string")).alias("heading_text")))
    typed = docs.select("doc_id", "text", marks.alias("structure"), F.lit("PDF").alias("source_type"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("title"))
    made = chunking.chunk_marked(typed, size=50, overlap=10)
    return made.select("doc_id", "chunk_index", "start", "end", "heading", "heading_level", "title", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("er2_attribute_upserts", "WITH r AS (SELECT o_orderstatus AS namespace, lower(left(o_orderpriority, 3)) || o_custkey % 50 AS name, CASE o_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'boolean' END AS value_type, o_orderkey % 2 = 0 AS multivalue, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000000 ELSE 0 END AS seq FROM orders) SELECT namespace, name, arg_max(value_type, seq) AS value_type, arg_min(multivalue, seq) AS multivalue FROM r GROUP BY ALL")
def attribute_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("number", "string", "boolean"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    name = F.concat(F.lower(F.substring("o_orderpriority", 1, 3)), (F.col("o_custkey") % 50).cast("string"))
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("namespace"), name.alias("name"), kind.alias("value_type"), (F.col("o_orderkey") % 2 == 0).alias("multivalue"), F.col("o_orderkey").alias("seq"))
    return extraction.upsert_attributes(o.where("seq % 5 <> 0"), o.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1_000_000_000_000))


@query("udf3_page_ranges", "SELECT doc_id, CAST(1 AS INTEGER) AS page_start, CAST((greatest(length(text) - 1, 0)) // 3000 + 1 AS INTEGER) AS page_end, count(*) AS chunks FROM (SELECT doc_id, text, w, unnest(range(0, greatest(len(w), 1), 425)) AS s FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0) WHERE s = 0 OR s + 75 < len(w) GROUP BY ALL")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("CSV").alias("source_type"))
    made = chunking.chunk_document(docs, [], ["CSV"], page_chars=3000)
    return made.groupBy("doc_id", F.col("pages")["page_start"].alias("page_start"), F.col("pages")["page_end"].alias("page_end")).agg(F.count(F.lit(1)).alias("chunks"))


WINDOWS = "w AS (SELECT conv_id, turn, turn // 3 AS batch, CAST(turn % 3 AS INTEGER) AS slot, coalesce(length(text), 0) AS len, role FROM conversations)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("len"), "role")
    return extraction.batches(rows, "conv_id", "turn")


@query("nl17_nl18_split_on_reject", f"""WITH {WINDOWS},
b AS (SELECT conv_id, batch, count(*) AS n, sum(len) > 1200 OR bool_or(len % 7 = 0) AS no,
             coalesce(sum(len) FILTER (WHERE slot > 0), 0) > 1200 OR coalesce(bool_or(len % 7 = 0) FILTER (WHERE slot > 0), FALSE) AS no_right FROM w GROUP BY ALL)
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch, slot, no AND (len > 1200 OR len % 7 = 0) AND (n < 3 OR slot = 0 OR no_right) AS lost FROM w JOIN b USING (conv_id, batch)""")
def split_on_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request is turned down if its texts have over 1,200 characters, or one of them a length that seven divides."""
    too_much = lambda: (F.sum("len") > 1200) | F.max(F.col("len") % 7 == 0)
    return extraction.split_on_reject(_windows(spark, sf_dir), too_much, "conv_id").select("conv_id", "turn", "batch", "slot", "lost")


@query("jn22_answers_to_windows", f"""WITH {WINDOWS},
a AS (SELECT conv_id, batch, CASE WHEN conv_id % 3 = 1 THEN 2 - slot ELSE slot END AS slot, role FROM w WHERE NOT (conv_id % 3 = 2 AND turn % 4 = 3))
SELECT w.conv_id, w.turn, coalesce(a.role, '') AS output FROM w LEFT JOIN a ON w.conv_id = a.conv_id AND w.batch = a.batch AND w.slot = a.slot""")
def answers_to_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every third conversation have no ids, of the next ones ids in reverse, of the others some are missing."""
    windows = _windows(spark, sf_dir)
    kind = F.col("conv_id") % 3
    given = windows.where(~((kind == 2) & (F.col("turn") % 4 == 3)))
    ids = F.when(kind == 0, -1).when(kind == 1, 2 - F.col("slot")).otherwise(F.col("slot"))
    answers = given.select("conv_id", "batch", F.col("slot").alias("position"), ids.alias("window_id"), F.array("role").alias("output"))
    return extraction.match_answers(windows, answers, "conv_id").select("conv_id", "turn", F.array_join("output", ",").alias("output"))


@query("nl19_facts_of_answers", """
SELECT p_partkey, 'part' AS entity_type, p_name AS entity_name, 'general' AS namespace, 'size' AS attribute, CAST(p_size AS VARCHAR) AS value, 'number' AS value_type FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, 'supplier', p_name, 'general', 'brand', p_brand, 'string' FROM part WHERE p_partkey % 10 <> 0""")
def facts_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit('{"entity_type":" Item","entity_name":"'), F.col("p_name"), F.lit('","attribute_name":" size ","value":'), F.col("p_size").cast("string"), F.lit(',"value_type":"int"}'))
    two = F.concat(F.lit('{"entity_type":"supplier","entity_name":"'), F.col("p_name"), F.lit('","attribute_name":"brand","value":"'), F.col("p_brand"), F.lit('","value_type":"string"}'))
    answer = F.when(F.col("p_partkey") % 10 == 0, "no json").otherwise(F.concat(F.lit('{"attributes":['), one, F.lit(","), two, F.lit("]}")))
    facts = extraction.facts_of(answer, F.create_map(F.lit("item"), F.lit("part")))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.explode(facts).alias("f")).select("p_partkey", "f.entity_type", "f.entity_name", "f.namespace", "f.attribute", "f.value", "f.value_type")


@query("sc44_tool_call_fold", """
WITH c AS (SELECT l_orderkey, l_linenumber AS i, l_linenumber % 4 AS tool, 'part:' || l_partkey AS subject, 'part:' || l_partkey || '=supplier:' || l_suppkey AS line FROM lineitem)
SELECT l_orderkey, arg_max(subject, (i, line)) FILTER (WHERE tool = 1) AS entity, coalesce(string_agg(line, ';' ORDER BY i, line) FILTER (WHERE tool = 2), '') AS facts,
       coalesce(string_agg(line, ';' ORDER BY i, line) FILTER (WHERE tool = 3), '') AS relations FROM c GROUP BY ALL""")
def tool_call_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("no_such_tool", "resolve_entity", "record_attribute", "record_relation"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    call = F.struct(names.alias("tool"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("subject"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("value"))
    calls = T.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws("=", call["subject"], call["value"]).alias("line"), call.alias("c")))).alias("listed"))
    calls = calls.withColumn("calls", F.transform("listed", lambda x: x["c"]))
    folded = calls.select("l_orderkey", extraction.fold_tool_calls(F.col("calls")).alias("f"))
    return folded.select("l_orderkey", "f.entity", F.array_join("f.facts", ";").alias("facts"), F.array_join("f.relations", ";").alias("relations"))


@query("src21_replaced_chunks", T.sql("""SELECT version_id, 0 AS chunk_index, checksum, CAST(version_id AS VARCHAR) AS embedding FROM version WHERE version_id % 3 <> 0 AND version_id % 4 <> 0
UNION ALL SELECT n.version_id, 0, n.checksum, CAST(k.version_id AS VARCHAR) FROM version n LEFT JOIN (SELECT checksum, min(version_id) AS version_id FROM version WHERE version_id % 3 <> 0 GROUP BY ALL) k ON n.checksum = k.checksum WHERE n.version_id % 4 = 0""", "version"))
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.lit(0).alias("chunk_index"), F.sha2("text", 256).alias("checksum"))
    existing = v.where("version_id % 3 <> 0").withColumn("embedding", F.col("version_id").cast("string"))
    return extraction.replace_chunks(existing, v.where("version_id % 4 = 0").withColumn("embedding", F.lit(None).cast("string")))


@query("src22_er4_value_upserts", """
WITH r AS (SELECT 'customer:' || o_custkey AS entity_id, o_orderstatus AS attribute, lower(left(o_orderpriority, 1)) AS value_norm, o_orderpriority AS value, o_orderkey % 2 = 0 AS searchable, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000000 ELSE 0 END AS seq FROM orders)
SELECT entity_id, attribute, value_norm, arg_min(value, seq) AS value, arg_max(searchable, seq) AS searchable FROM r GROUP BY ALL""")
def value_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity_id"), F.col("o_orderstatus").alias("attribute"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("value_norm"), F.col("o_orderpriority").alias("value"), (F.col("o_orderkey") % 2 == 0).alias("searchable"), F.col("o_orderkey").alias("seq"))
    new = o.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1_000_000_000_000)
    return extraction.upsert_values(o.where("seq % 5 <> 0"), new)


#: Stored responses of each host: robots.txt (a fourth is not there), a sitemap in nine spellings, and the pages.
HOSTED = """hosted AS (SELECT *, 'https://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site FROM pages),
host AS (SELECT site, min(page_id) AS k, arg_min(url, page_id) AS root FROM hosted GROUP BY site)"""
_STARTS = ['<?xml version="1.0" encoding="UTF-8"?>\n<?xml-stylesheet type="text/xsl" href="s.xsl"?>\n', "<!-- made by hand -->", "", "\n"]


def _hosted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    site = F.concat(F.lit("https://"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)))
    pages = T.read(spark, sf_dir, "pages").withColumn("site", site)
    return pages, pages.groupBy("site").agg(F.min("page_id").alias("k"), F.min_by("url", "page_id").alias("root"), F.array_sort(F.collect_list("url")).alias("urls"))


@query("src3_src6_src7_sitemaps", f"""WITH RECURSIVE {HOSTED}, listed AS (SELECT site FROM host WHERE k % 4 <> 3 AND k % 9 NOT IN (5, 6, 7, 8)),
link AS (SELECT DISTINCT url, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href END AS link FROM ({HREFS})),
crawled(root, url) AS (SELECT root, root FROM host WHERE site NOT IN (SELECT site FROM listed) UNION SELECT root, l.link FROM crawled c JOIN link l ON c.url = l.url JOIN pages p ON p.url = l.link)
SELECT root, url, 'SITEMAP' AS source FROM host JOIN hosted USING (site) WHERE site IN (SELECT site FROM listed)
UNION ALL SELECT root, url, 'BFS_FALLBACK' FROM crawled""")
def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's pages by robots.txt and sitemap; hosts without a usable one are crawled."""
    pages, hosts = _hosted(spark, sf_dir)
    kind = F.col("k") % 9
    robots = F.concat(F.lit("User-agent: *\r\nSitemap: \r\nDisallow: /x\r\n SiteMap:\t"), F.col("site"), F.lit("/map.xml \r\nSitemap: other\r\n"))
    answered = hosts.select(F.concat(F.regexp_extract("root", "^[a-z]+://[^/?#]*", 0), F.lit("/robots.txt")).alias("url"), F.when(F.col("k") % 4 == 3, 404).otherwise(200).alias("status"), robots.alias("body"))
    spelt = lambda u: F.when(kind == 2, F.concat(F.lit("<![CDATA["), u, F.lit("]]>"))).otherwise(F.replace(u, F.lit("&"), F.lit("&amp;")))
    image = F.lit("<image:image><image:loc>https://x/i.png</image:loc></image:image>")
    url = F.transform("urls", lambda u: F.concat(F.lit("<url>"), F.when(kind == 1, image).otherwise(""), F.lit("<loc>\n  "), spelt(u), F.lit("\n</loc></url>")))
    start = F.element_at(F.array(*map(F.lit, _STARTS)), (kind % 4 + 1).cast("int"))
    whole = F.concat(start, F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="i">'), F.array_join(url, ""), F.lit("</urlset>"))
    whole = F.when(kind == 3, F.regexp_replace(whole, "^\n", "")).otherwise(whole)
    body = F.when(kind == 5, F.replace(whole, F.lit("urlset"), F.lit("sitemapindex"))).when(kind == 6, F.substring(whole, 1, 120)).when(kind == 7, "no xml at all").when(kind == 8, "<html><body>gone</body></html>").otherwise(whole)
    maps = hosts.select(F.concat("site", F.lit("/map.xml")).alias("url"), F.lit(200).alias("status"), body.alias("body"))
    stored = pages.select("url", F.lit(200).alias("status"), F.col("html").alias("body"))
    links = crawl.links(pages).where("internal").join(pages.select("page_id", "url"), "page_id").select("url", "link")
    return crawl.discover(hosts.select("root"), answered.unionByName(maps).unionByName(stored), _with_pages(pages, links), most_pages=1_000_000)


def _with_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """links, and a row for each page, so that one without a link is a page too."""
    return links.unionByName(pages.select("url", F.lit(None).cast("string").alias("link")))


#: One site of all pages: a page stands under the first word of its title, and menus link to such words.
PLACED = """placed AS (SELECT page_id, html, 'https://site.example/' || regexp_extract(html, '(?is)<title[^>]*>\\s*([A-Za-z]+)', 1) AS url FROM pages WHERE regexp_matches(html, '(?is)<title[^>]*>\\s*[A-Za-z]'))"""


@query("src4_bfs_crawl", f"""
WITH RECURSIVE {PLACED}, link AS (SELECT DISTINCT url, 'https://site.example' || rtrim(href, '/') AS link FROM ({HREFS.replace('FROM pages', 'FROM placed')}) WHERE regexp_matches(href, '^/[^/?#]')),
found(url, step) AS (SELECT * FROM (SELECT url, 0 FROM placed WHERE page_id % 100 = 0) UNION SELECT l.link, step + 1 FROM found f JOIN link l ON f.url = l.url WHERE step < 15)
SELECT url, CAST(min(step) AS INTEGER) AS step FROM found WHERE url IN (SELECT url FROM placed) GROUP BY url""")
def bfs_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of that site by the links of its pages' html, from each hundredth page."""
    word = F.regexp_extract("html", r"(?is)<title[^>]*>\s*([A-Za-z]+)", 1)
    pages = T.read(spark, sf_dir, "pages").where(word != "").select("page_id", F.concat(F.lit("https://site.example/"), word).alias("url"), "html")
    links = crawl.links(pages).where("internal").join(pages.select("page_id", "url"), "page_id").select("url", "link")
    return crawl.crawl(pages.where("page_id % 100 = 0").select("url"), _with_pages(pages, links), most_pages=1_000_000)


@query("udf6_stages", "SELECT event_id, CASE WHEN value IS NULL OR value < 5 THEN 'fetch' WHEN event_type = 'error' THEN 'extract' END AS failed_at, CASE WHEN value >= 5 THEN value * 2 END AS size, CASE WHEN value >= 5 AND event_type <> 'error' THEN upper(event_type) END AS facts FROM events")
def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stages.run_stages(T.read(spark, sf_dir, "events").select("event_id", "event_type", "value"), [("fetch", F.col("value") >= 5, {"size": F.col("value") * 2}), ("extract", F.col("event_type") != "error", {"facts": F.upper("event_type")})])
    return made.select("event_id", "failed_at", "size", "facts")
