"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave import functions as fn
from folioweave.catalog.common import (
    SQL_PAGED, WS, paged, sql_noise, sql_strip, sql_tidy, sql_unescape, sql_words, table,
)
from folioweave.operators.markup import extract_links, tokenize_html
from folioweave.operators.paged import is_scanned_avg

docs = lambda s, d: table(s, d, "documents")

IMAGE_MODE = {"AUTOMOBILE": "embed", "BUILDING": "separate"}


def _mode(c):
    return F.when(c == "AUTOMOBILE", "embed").when(c == "BUILDING", "separate").otherwise("link")


SQL_MODE = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'embed' WHEN 'BUILDING' THEN 'separate' ELSE 'link' END"
MARKED = "\n# Head\n```py\ncode\n```\n\n\n\n- item\n"


def config_hash(s, d):
    return table(s, d, "customer").select("c_custkey", fn.config_hash(
        table_format=F.lit("github"), image_mode=_mode(F.col("c_mktsegment"))).alias("config_hash"))


def tidy_markdown(s, d):
    return docs(s, d).select("doc_id", fn.tidy_markdown(F.replace("text", F.lit(". "), F.lit(MARKED))).alias("md"))


def pad_row(s, d):
    row = F.array(F.col("s_name"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))
    return table(s, d, "supplier").select(
        "s_suppkey", F.array_join(fn.pad_row(row, (F.col("s_suppkey") % 6 + 1)), "|").alias("cells"))


def cell_text(s, d):
    v = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("n"), v.alias("b"))
    return c.select("c_custkey", fn.cell_text("n").alias("name_text"), fn.cell_text("b", True).alias("bal_text"))


def resolve_url(s, d):
    links = extract_links(table(s, d, "pages")).select("page_id", "link_index", F.regexp_replace("href_raw", "[?#./%]", "").alias("w"))
    w = F.concat(F.lit("w"), F.col("w"))
    forms = [w, F.concat(F.lit("/"), w), F.concat(F.lit("../"), w), F.concat(F.lit("?q="), w), F.concat(F.lit("#"), w),
             F.concat(F.lit("//cdn.example.com/"), w), F.concat(F.lit("https://x.example.com/a/../"), w),
             F.concat(F.lit("./a/./b/../"), w, F.lit("?k=1#z"))]
    ref = None
    for i, f in enumerate(forms):
        hit = F.col("link_index") % 8 == i
        ref = F.when(hit, f) if ref is None else ref.when(hit, f)
    base = F.lit("http://h.example.com/d1/d2/page.html?old=1#top")
    rows = links.select("page_id", "link_index", base.alias("base"), ref.alias("ref"))
    return rows.select("page_id", "link_index", fn.resolve_url("base", "ref").alias("resolved"))


SQL_RESOLVE = rf"""
WITH p AS (SELECT page_id, {sql_noise('html')} AS h FROM pages),
a AS (SELECT page_id, regexp_extract_all(h, '(?is)<a\s[^>]*href="([^"]*)"', 1) AS l FROM p),
u AS (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS i FROM a),
w AS (SELECT page_id, i, 'w' || regexp_replace({sql_unescape('href')}, '[?#./%]', '', 'g') AS w FROM u)
SELECT page_id, CAST(i AS BIGINT) AS link_index, CASE i % 8
  WHEN 0 THEN 'http://h.example.com/d1/d2/' || w WHEN 1 THEN 'http://h.example.com/' || w
  WHEN 2 THEN 'http://h.example.com/d1/' || w WHEN 3 THEN 'http://h.example.com/d1/d2/page.html?q=' || w
  WHEN 4 THEN 'http://h.example.com/d1/d2/page.html?old=1#' || w WHEN 5 THEN 'http://cdn.example.com/' || w
  WHEN 6 THEN 'https://x.example.com/a/../' || w ELSE 'http://h.example.com/d1/d2/a/' || w || '?k=1#z' END AS resolved
FROM w"""


def parse_data_uri(s, d):
    plain = F.concat(F.lit("data:text/plain,"), F.replace("p_name", F.lit(" "), F.lit("%20")))
    uri = F.when(F.col("p_partkey") % 2 == 0, fn.to_data_uri(F.lit("png"), F.encode("p_name", "UTF-8"))).otherwise(plain)
    rows = table(s, d, "part").select("p_partkey", uri.alias("uri"))
    got = fn.parse_data_uri("uri")
    return rows.select("p_partkey", got["mime"].alias("mime"), got["is_base64"].alias("is_base64"),
                       got["bytes"].cast("string").alias("body"))


def image_dims(s, d):
    w, h = F.col("p_size") + 1, F.col("p_partkey") % 60000 + 1
    hex4 = lambda c: F.lpad(F.hex(c), 8, "0")
    le2 = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex4(w), hex4(h), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), le2(w), le2(h), F.lit("F00000"))
    n = F.col("p_partkey") % 3
    b = F.unhex(F.when(n == 0, png).when(n == 1, gif).otherwise(F.lit("FFD8FFE000104A464946")))
    rows = table(s, d, "part").select("p_partkey", b.alias("b")).select("p_partkey", fn.image_dims("b").alias("x"))
    return rows.select("p_partkey", "x.format", F.col("x.width").cast("bigint").alias("width"), F.col("x.height").cast("bigint").alias("height"))


def pdf_date(s, d):
    n, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (F.when(n == 0, F.concat(F.lit("D:"), F.date_format(t, "yyyyMMdd"), F.lit("132559+02'00'")))
            .when(n == 1, F.date_format(t, "yyyyMMdd")).when(n == 2, F.concat(F.lit("D:"), F.date_format(t, "yyyy")))
            .when(n == 3, F.lit("D:20241399")).otherwise(F.date_format(t, "yyyy-MM-dd")))
    rows = table(s, d, "orders").select("o_orderkey", text.alias("raw"))
    return rows.select("o_orderkey", fn.pdf_date("raw").cast("string").alias("stamp"))


def estimate_seconds(s, d):
    n = F.col("doc_id") % 6
    ext = (F.when(n == 0, ".pdf").when(n == 1, ".docx").when(n == 2, ".wav").when(n == 3, ".PNG").when(n == 4, ".csv").otherwise(".xlsx"))
    rows = docs(s, d).select("doc_id", ext.alias("ext"), (F.col("n_chars") * 5000).alias("size"),
                             F.when(n < 3, F.col("n_chars") % 40).alias("pages"))
    return rows.select(
        "doc_id", F.round(fn.estimate_seconds("ext", "size"), 6).alias("by_extension"),
        F.round(fn.estimate_seconds("ext", "size", rule="any_document"), 6).alias("any_document"),
        F.round(fn.estimate_seconds("ext", "size", "pages", "text_pages"), 6).alias("text_pages"),
        F.round(fn.estimate_seconds("ext", "size", "pages", "ocr_pages"), 6).alias("ocr_pages"))


SQL_ESTIMATE = """
WITH r AS (SELECT doc_id, doc_id % 6 AS n, n_chars * 5000 / 1048576.0::DOUBLE AS mb, CASE WHEN doc_id % 6 < 3 THEN n_chars % 40 END AS pages FROM documents)
SELECT doc_id, round(CASE n WHEN 0 THEN greatest(1.0, mb * 0.5::DOUBLE) WHEN 1 THEN greatest(1.0, mb * 0.3::DOUBLE) WHEN 5 THEN greatest(1.0, mb * 0.3::DOUBLE)
  WHEN 2 THEN greatest(5.0, mb * 2) WHEN 3 THEN greatest(2.0, mb) ELSE greatest(1.0, mb * 0.5::DOUBLE) END, 6) AS by_extension,
  round(greatest(1.0, mb), 6) AS any_document, round(coalesce(pages * 0.1::DOUBLE, 10.0), 6) AS text_pages,
  round(coalesce(pages * 3.0::DOUBLE, 30.0), 6) AS ocr_pages FROM r"""


def summary_text(s, d):
    warn = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("w1"), F.lit("w2"))).otherwise(F.array().cast("array<string>"))
    err = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("e1"))).otherwise(F.array().cast("array<string>"))
    rows = docs(s, d).select(
        "doc_id", F.concat(F.col("source"), F.lit(".pdf")).alias("name"), (F.col("doc_id") % 9).alias("pages"),
        (F.col("n_chars") * 37).alias("words"), (F.col("doc_id") % 4).alias("images"), (F.col("doc_id") % 2).alias("tables"),
        (F.col("n_chars") / F.lit(1000.0)).alias("seconds"), F.lit("fast").alias("strategy"), warn.alias("w"), err.alias("e"))
    return rows.select("doc_id", fn.summary_text("name", "pages", "words", "images", "tables", "seconds", "strategy", "w", "e").alias("summary"))


SQL_SUMMARY = """
SELECT doc_id, '✓ Converted: ' || source || '.pdf' || chr(10) || '  Pages: ' || (doc_id % 9) || chr(10) || '  Words: ' || format('{:,}', n_chars * 37)
  || chr(10) || '  Images: ' || (doc_id % 4) || chr(10) || '  Tables: ' || (doc_id % 2) || chr(10) || '  Time: ' || format('{:.2f}', n_chars / 1000.0::DOUBLE) || 's'
  || chr(10) || '  Strategy: fast' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  ⚠ Warnings: 2' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '  ✗ Errors: 1' ELSE '' END AS summary FROM documents"""


def quality_warnings(s, d):
    roll = paged(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(fn.word_count("text")).alias("words"))
    return roll.select("doc_id", F.array_join(fn.quality_warnings("words", "pages", F.col("doc_id") % 4), " / ").alias("warnings"))


SQL_QUALITY = f"""
WITH {SQL_PAGED}, r AS (SELECT doc_id, count(*) AS pages, sum({sql_words('text')}) AS words FROM paged GROUP BY doc_id)
SELECT doc_id, concat_ws(' / ', CASE WHEN words < 10 AND pages > 1 THEN 'Very little text extracted - document may be scanned or contain mostly images' END,
  CASE WHEN doc_id % 4 > 0 THEN 'Conversion completed with ' || (doc_id % 4) || ' errors' END) AS warnings FROM r"""


def size_mb(s, d):
    return docs(s, d).select("doc_id", fn.size_mb(F.col("n_chars") * 1000).alias("size_mb"),
                             fn.or_na(F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).alias("lang"))


def docx_pages(s, d):
    n = tokenize_html(table(s, d, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("page_id", fn.docx_pages("n").alias("pages"))


SQL_TOKEN_RE = "</?[A-Za-z!?][^>]*>|[^<]+|<"
SQL_DOCX_PAGES = f"""SELECT page_id, CAST(greatest(1, len(regexp_extract_all({sql_noise('html')}, '{SQL_TOKEN_RE}')) // 25) AS BIGINT) AS pages FROM pages"""


def pick_strategy(s, d):
    scanned = is_scanned_avg(paged(s, d))
    kind = F.when(F.col("doc_id") % 5 == 0, "html").otherwise("pdf")
    wish = F.when(F.col("doc_id") % 7 == 0, "accurate").otherwise("auto")
    rows = scanned.select("doc_id", kind.alias("kind"), wish.alias("wish"), "scanned")
    return rows.select("doc_id", fn.pick_strategy("kind", "wish", "scanned", True).alias("with_ocr"),
                       fn.pick_strategy("kind", "wish", "scanned", False).alias("without_ocr"))


SQL_STRIPPED = f"length({sql_strip('text')})"
SQL_SCANNED = f"""scanned AS (SELECT doc_id, avg({SQL_STRIPPED}) < 50 AS scanned FROM paged WHERE page_number <= 3 GROUP BY doc_id)"""
SQL_PICK = f"""WITH {SQL_PAGED}, {SQL_SCANNED}
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'accurate' WHEN doc_id % 5 <> 0 AND scanned THEN 'ocr' ELSE 'fast' END AS with_ocr,
  CASE WHEN doc_id % 7 = 0 THEN 'accurate' ELSE 'fast' END AS without_ocr FROM scanned"""


def decode_text(s, d):
    latin = F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(latin, "ISO-8859-1"))
    return docs(s, d).select("doc_id", raw.alias("b")).select("doc_id", fn.decode_text("b").alias("text"))


QUERIES = {
    "word_count": (lambda s, d: docs(s, d).select("doc_id", fn.word_count("text").alias("n_words")),
                   f"SELECT doc_id, CAST({sql_words('text')} AS BIGINT) AS n_words FROM documents"),
    "approx_words": (lambda s, d: docs(s, d).select("doc_id", fn.approx_words("text").alias("n_words")),
                     "SELECT doc_id, CAST(length(text) // 5 AS BIGINT) AS n_words FROM documents"),
    "content_hash": (lambda s, d: docs(s, d).select("doc_id", fn.content_hash("text").alias("content_hash")),
                     "SELECT doc_id, sha256(text) AS content_hash FROM documents"),
    "config_hash": (config_hash, f"""SELECT c_custkey, substring(sha256('{{"image_mode":"' || {SQL_MODE} || '","table_format":"github"}}'), 1, 16) AS config_hash FROM customer"""),
    "cache_key": (lambda s, d: docs(s, d).select("doc_id", fn.cache_key(fn.content_hash("text"), F.col("lang")).alias("cache_key")),
                  "SELECT doc_id, sha256(text) || '_' || lang AS cache_key FROM documents"),
    "tidy_markdown": (tidy_markdown, "SELECT doc_id, " + sql_tidy(
        "replace(text, '. ', '" + MARKED.replace("\n", "' || chr(10) || '") + "')") + " AS md FROM documents"),
    "escape_cell": (lambda s, d: docs(s, d).select("doc_id", fn.escape_cell("text").alias("cell")),
                    rf"SELECT doc_id, trim(regexp_replace(replace(text, '|', '\|'), '{WS}+', ' ', 'g')) AS cell FROM documents"),
    "pad_row": (pad_row, """SELECT s_suppkey, array_to_string(list_resize([s_name, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)], s_suppkey % 6 + 1, ''), '|') AS cells FROM supplier"""),
    "cell_text": (cell_text, """SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE '' END AS name_text,
        CASE WHEN c_custkey % 5 IN (0, 1) THEN '' ELSE coalesce(CAST(c_acctbal AS VARCHAR), '') END AS bal_text FROM customer"""),
    "resolve_url": (resolve_url, SQL_RESOLVE),
    "parse_data_uri": (parse_data_uri, """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'image/png' ELSE 'text/plain' END AS mime,
        p_partkey % 2 = 0 AS is_base64, p_name AS body FROM part"""),
    "to_data_uri": (lambda s, d: table(s, d, "part").select("p_partkey", fn.to_data_uri(F.lit("png"), F.encode("p_name", "UTF-8")).alias("uri")),
                    "SELECT p_partkey, 'data:image/png;base64,' || to_base64(encode(p_name)) AS uri FROM part"),
    "image_name": (lambda s, d: table(s, d, "pages").select("page_id", fn.image_name("url", "page_id").alias("name")),
                   r"""SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), ''), 'image_' || page_id) AS name FROM pages"""),
    "image_dims": (image_dims, """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' ELSE 'unknown' END AS format,
        CAST(CASE WHEN p_partkey % 3 < 2 THEN p_size + 1 ELSE 0 END AS BIGINT) AS width,
        CAST(CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 60000 + 1 ELSE 0 END AS BIGINT) AS height FROM part"""),
    "pdf_date": (pdf_date, """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 13:25:59'
        WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN 2 THEN strftime(o_orderdate, '%Y') || '-01-01 00:00:00' END AS stamp FROM orders"""),
    "estimate_seconds": (estimate_seconds, SQL_ESTIMATE),
    "summary_text": (summary_text, SQL_SUMMARY),
    "quality_warnings": (quality_warnings, SQL_QUALITY),
    "size_mb": (size_mb, "SELECT doc_id, round(n_chars * 1000 / 1048576.0::DOUBLE, 2) AS size_mb, CASE WHEN doc_id % 3 > 0 AND lang <> '' THEN lang ELSE 'N/A' END AS lang FROM documents"),
    "docx_pages": (docx_pages, SQL_DOCX_PAGES),
    "pick_strategy": (pick_strategy, SQL_PICK),
    "html_unescape": (lambda s, d: table(s, d, "pages").select("page_id", fn.html_unescape("html").alias("html")),
                      f"SELECT page_id, {sql_unescape('html')} AS html FROM pages"),
    "preview": (lambda s, d: docs(s, d).select("doc_id", fn.preview("text").alias("preview")),
                "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents"),
    "decode_text": (decode_text, r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{0}-\x{ff}]', '?', 'g') END AS text FROM documents"),
}
