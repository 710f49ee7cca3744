"""Paged documents, running numbers, reuse by hash, options and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave import functions as fn
from folioweave.catalog.common import (
    SQL_PAGED, paged, sql_has_text, sql_noise, sql_unescape, sql_words, table,
)
from folioweave.catalog.scalars import SQL_SCANNED
from folioweave.operators import metrics, outcome, paged as pg, reuse
from folioweave.operators.markup import extract_links, outline

DOC_COUNT = 7  # link documents: a few large ones, so that running numbers cross blocks


# ---------------------------------------------------------------- inputs


def assets(s, d):
    """Page links as numbered assets: page_id % 7 is the document, page_id the page."""
    return extract_links(table(s, d, "pages")).select(
        (F.col("page_id") % DOC_COUNT).alias("doc_id"), F.col("page_id").alias("page_number"), F.col("link_index").alias("pos"))


SQL_ASSETS = rf"""l AS (SELECT page_id, regexp_extract_all({sql_noise('html')}, '(?i)<a[\s>]') AS a FROM pages),
assets AS (SELECT page_id % {DOC_COUNT} AS doc_id, page_id AS page_number, unnest(range(len(a))) AS pos FROM l)"""


def meta(s, d):
    """Page metadata with events standing in for images and tables of pages."""
    e = table(s, d, "events")
    child = e.select((F.col("user_id") % 100).alias("doc_id"), (F.col("event_id") % 8 + 1).alias("page_number"), "event_type")
    return pg.page_meta(paged(s, d), child.where("event_type = 'click'"), child.where("event_type = 'error'"))


SQL_META = f"""{SQL_PAGED},
child AS (SELECT user_id % 100 AS doc_id, event_id % 8 + 1 AS page_number, event_type FROM events),
cnt AS (SELECT doc_id, page_number, count(*) FILTER (event_type = 'click') AS i, count(*) FILTER (event_type = 'error') AS t FROM child GROUP BY ALL),
meta AS (SELECT p.doc_id, p.page_number, CAST({sql_words('text')} AS BIGINT) AS word_count, {sql_has_text('text')} AS has_text,
  coalesce(i, 0) AS image_count, coalesce(i, 0) > 0 AS has_images, coalesce(t, 0) AS table_count, coalesce(t, 0) > 0 AS has_tables
  FROM paged p LEFT JOIN cnt c ON c.doc_id = p.doc_id AND c.page_number = p.page_number)"""


def perf(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), "ts")


NOW = "2024-01-20 00:00:00"


def stored(s, d):
    """Results of every even document; converted_at spread over two days."""
    docs = table(s, d, "documents").where("doc_id % 2 = 0")
    ts = F.lit("2024-01-19 23:00:00").cast("timestamp_ntz") - F.expr("make_dt_interval(0, int(doc_id % 48))")
    keyed = docs.select(fn.content_hash("text").alias("content_hash"), F.lit("c1").alias("config_hash"),
                        ts.alias("converted_at"), "doc_id", fn.word_count("text").alias("words"))
    return reuse.latest_result(keyed, ["content_hash", "config_hash"], "converted_at", "doc_id").withColumnRenamed("doc_id", "source_doc")


SQL_STORED = f"""k AS (SELECT sha256(text) AS content_hash, TIMESTAMP '2024-01-19 23:00:00' - to_hours(CAST(doc_id % 48 AS INTEGER)) AS converted_at, doc_id,
  CAST({sql_words('text')} AS BIGINT) AS words FROM documents WHERE doc_id % 2 = 0),
stored AS (SELECT content_hash, converted_at, doc_id AS source_doc, words FROM k
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY converted_at DESC, doc_id DESC) = 1),
live AS (SELECT * FROM stored WHERE converted_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)"""


def wanted(s, d):
    return table(s, d, "documents").select("doc_id", fn.content_hash("text").alias("content_hash"), F.lit("c1").alias("config_hash"))


# ---------------------------------------------------------------- queries


def corpus_info(s, d):
    sizes = paged(s, d).groupBy("doc_id").agg((F.sum(F.octet_length("text")) * 100).alias("size_bytes"))
    return pg.corpus_info(meta(s, d), sizes)


SQL_INFO = f"""WITH {SQL_META}, z AS (SELECT doc_id, sum(octet_length(encode(text))) * 100 AS b FROM paged GROUP BY doc_id)
SELECT m.doc_id, round(any_value(z.b) / 1048576.0::DOUBLE, 2) AS size_mb, count(*) AS pages, CAST(sum(image_count) AS BIGINT) AS images, CAST(sum(table_count) AS BIGINT) AS tables,
  CASE WHEN bool_or(has_text) THEN 'Yes' ELSE 'No (Scanned)' END AS text_layer,
  CASE WHEN NOT bool_or(has_text) THEN 'This PDF appears to be scanned. Use --ocr flag for conversion.' END AS recommendation
FROM meta m JOIN z ON z.doc_id = m.doc_id GROUP BY m.doc_id"""


def convert_once(s, d):
    work = lambda df: df.select("content_hash", fn.word_count("text").alias("words"), fn.preview("text", 30).alias("head"))
    return reuse.convert_once(table(s, d, "documents").select("doc_id", "text"), "text", work).select("doc_id", "words", "head")


def resolve_options(s, d):
    c = table(s, d, "customer")
    opts = c.where("c_custkey % 3 > 0").select(
        F.col("c_custkey").alias("doc_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "embed").when(F.col("c_mktsegment") == "MACHINERY", "separate").alias("image_mode"),
        F.when(F.col("c_acctbal") > 5000, F.lit(50)).alias("xlsx_max_sheet_width"))
    return reuse.resolve_options(c.select(F.col("c_custkey").alias("doc_id")), opts,
                                 {"image_mode": "link", "xlsx_max_sheet_width": 100, "table_format": "github"})


def attach_assets(s, d):
    """Links and headings as the two kinds of children."""
    links = extract_links(table(s, d, "pages")).select(F.col("page_id").alias("doc_id"))
    heads = outline(table(s, d, "pages")).select(F.col("page_id").alias("doc_id"))
    res = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return outcome.attach_assets(res, links, heads)


SQL_ATTACH = rf"""WITH l AS (SELECT page_id, len(regexp_extract_all({sql_noise('html')}, '(?i)<a[\s>]')) AS n, len(regexp_extract_all({sql_noise('html')}, '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]\s*>')) AS m FROM pages)
SELECT p.page_id AS doc_id, url, CAST(n AS BIGINT) AS total_images, CAST(m AS BIGINT) AS total_tables
FROM pages p JOIN l ON l.page_id = p.page_id"""


def corpus_totals(s, d):
    docs = table(s, d, "documents").select(fn.word_count("text").alias("total_words"), (F.col("doc_id") % 3).alias("total_images"))
    return metrics.corpus_totals(docs)


def latest_result(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return reuse.latest_result(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def expire(s, d):
    e = table(s, d, "events").select(F.col("ts").alias("converted_at"))
    return reuse.expire_results(e, NOW, 240)


def paginate(s, d):
    links = extract_links(table(s, d, "pages")).select(
        (F.col("page_id") % DOC_COUNT).alias("doc_id"), (F.col("page_id") * 1000 + F.col("link_index")).alias("asset_no"))
    return pg.paginate(links, "doc_id", "asset_no")


def gallery_slice(s, d):
    links = extract_links(table(s, d, "pages")).select("page_id", "link_index", "text")
    return pg.gallery_slice(links, ["page_id", "link_index"], 3)


SQL_GALLERY = rf"""WITH p AS (SELECT page_id, regexp_extract_all({sql_noise('html')}, '(?is)<a\s[^>]*>(.*?)</a>', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS link_index FROM p)
SELECT page_id, CAST(link_index AS BIGINT) AS link_index, {sql_unescape('text')} AS text FROM u ORDER BY page_id, link_index LIMIT 12 OFFSET 36"""

_PIECE = """concat_ws(chr(10) || chr(10), '<!-- Page ' || page_number || ' -->', text, CASE WHEN page_number < last THEN '***' END)"""

def rounded(df, *cols):
    """Means end in exact halves at times, which engines round differently; a nudge settles them."""
    return df.select(*[F.round(F.col(c) + F.lit(1e-9), 4).alias(c) if c in cols else F.col(c) for c in df.columns])


NUDGE = "1e-9::DOUBLE"
R_STATS = f"count(*) AS count, round(sum(value) + {NUDGE}, 4) AS total, round(avg(value) + {NUDGE}, 4) AS avg, min(value) AS min, max(value) AS max"

QUERIES = {
    "nonblank_parts": (lambda s, d: pg.nonblank_parts(paged(s, d)), f"WITH {SQL_PAGED} SELECT * FROM paged WHERE {sql_has_text('text')}"),
    "page_meta": (lambda s, d: meta(s, d), f"WITH {SQL_META} SELECT * FROM meta"),
    "doc_rollup": (lambda s, d: pg.doc_rollup(meta(s, d)), f"""WITH {SQL_META} SELECT doc_id, count(*) AS page_count, CAST(sum(word_count) AS BIGINT) AS total_words,
        CAST(sum(image_count) AS BIGINT) AS total_images, CAST(sum(table_count) AS BIGINT) AS total_tables FROM meta GROUP BY doc_id"""),
    "corpus_info": (corpus_info, SQL_INFO),
    "is_scanned_avg": (lambda s, d: pg.is_scanned_avg(paged(s, d)), f"WITH {SQL_PAGED}, {SQL_SCANNED} SELECT doc_id, scanned FROM scanned"),
    "is_scanned_any": (lambda s, d: pg.is_scanned_any(paged(s, d)), f"WITH {SQL_PAGED} SELECT doc_id, NOT bool_or({sql_has_text('text')}) AS scanned FROM paged WHERE page_number <= 3 GROUP BY doc_id"),
    "assemble_pages": (lambda s, d: pg.assemble_pages(paged(s, d), markers=True, breaks=True, marker="***"),
        f"""WITH {SQL_PAGED}, n AS (SELECT *, max(page_number) OVER (PARTITION BY doc_id) AS last FROM paged)
        SELECT doc_id, CAST((page_number - 1) // 4096 AS BIGINT) AS part, string_agg({_PIECE}, chr(10) || chr(10) ORDER BY page_number) AS markdown
        FROM n WHERE {sql_has_text('text')} GROUP BY ALL"""),
    "image_index": (lambda s, d: pg.image_index(assets(s, d)), f"""WITH {SQL_ASSETS} SELECT doc_id, page_number, pos, row_number() OVER w - 1 AS image_index,
        'Image ' || (row_number() OVER w) || ' from page ' || page_number AS alt_text FROM assets WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, pos)"""),
    "table_index": (lambda s, d: pg.table_index(assets(s, d).where("pos % 3 = 0")),
        f"WITH {SQL_ASSETS} SELECT doc_id, page_number, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pos) - 1 AS table_index FROM assets WHERE pos % 3 = 0"),
    "first_pages": (lambda s, d: pg.first_pages(paged(s, d)), f"WITH {SQL_PAGED} SELECT * FROM paged WHERE page_number <= 3"),
    "paginate": (paginate, f"""WITH {SQL_ASSETS} SELECT doc_id, page_number * 1000 + pos AS asset_no,
        (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pos) - 1) // 12 AS gallery_page,
        CAST(ceil(count(*) OVER (PARTITION BY doc_id) / 12.0) AS BIGINT) AS gallery_pages FROM assets"""),
    "gallery_slice": (gallery_slice, SQL_GALLERY),
    "page_breaks": (lambda s, d: pg.page_breaks(paged(s, d)).select("doc_id", "page_number", "break_after"),
        f"WITH {SQL_PAGED} SELECT doc_id, page_number, CASE WHEN lead(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) IS NOT NULL THEN '---' END AS break_after FROM paged"),
    "cache_hits": (lambda s, d: reuse.cache_hits(wanted(s, d), stored(s, d), NOW).select("doc_id", "source_doc", "words"),
        f"WITH {SQL_STORED} SELECT d.doc_id, source_doc, words FROM documents d JOIN live ON content_hash = sha256(d.text)"),
    "cache_misses": (lambda s, d: reuse.cache_misses(wanted(s, d), stored(s, d), NOW).select("doc_id", "content_hash"),
        f"WITH {SQL_STORED} SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT content_hash FROM live)"),
    "convert_once": (convert_once, f"""SELECT doc_id, CAST({sql_words('text')} AS BIGINT) AS words,
        CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '...' ELSE text END AS head FROM documents"""),
    "resolve_options": (resolve_options, """SELECT c_custkey AS doc_id,
        CASE WHEN c_custkey % 3 > 0 AND c_mktsegment = 'BUILDING' THEN 'embed' WHEN c_custkey % 3 > 0 AND c_mktsegment = 'MACHINERY' THEN 'separate' ELSE 'link' END AS image_mode,
        CASE WHEN c_custkey % 3 > 0 AND c_acctbal > 5000 THEN 50 ELSE 100 END AS xlsx_max_sheet_width, 'github' AS table_format FROM customer"""),
    "attach_assets": (attach_assets, SQL_ATTACH),
    "corpus_totals": (corpus_totals, f"SELECT count(*) AS files, CAST(sum({sql_words('text')}) AS BIGINT) AS words, CAST(sum(doc_id % 3) AS BIGINT) AS images FROM documents"),
    "perf_stats": (lambda s, d: rounded(metrics.perf_stats(perf(s, d), "click"), "total", "avg"),
        f"SELECT 'click' AS operation, {R_STATS} FROM events WHERE event_type = 'click'"),
    "perf_stats_all": (lambda s, d: rounded(metrics.perf_stats_all(perf(s, d)), "total", "avg"),
        f"SELECT event_type AS operation, {R_STATS} FROM events GROUP BY event_type"),
    "cache_stats": (lambda s, d: rounded(reuse.cache_stats(table(s, d, "documents"), "text"), "total_size_mb"),
        f"SELECT count(*) AS num_entries, round(sum(octet_length(encode(text))) / 1048576.0::DOUBLE + {NUDGE}, 4) AS total_size_mb, 24::BIGINT AS max_age_hours FROM documents"),
    "latest_result": (latest_result, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "expire_results": (expire, f"""SELECT count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 240 HOUR) AS expired,
        count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR) AS kept FROM events"""),
}
