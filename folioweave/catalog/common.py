"""Inputs shared by several registered queries, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The blanks of str.split(), in RE2 notation.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NON_WS}+'))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_has_text(x: str) -> str:
    return f"regexp_matches({x}, '{NON_WS}')"


def sql_unescape(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"),
                       ("middot", "·"), ("apos", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def sql_noise(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)', '', 'g')"
    return rf"regexp_replace({x}, '(?s)<!--.*?(?:-->|\z)', '', 'g')"


def sql_tidy(x: str) -> str:
    x = rf"regexp_replace({x}, '\n(#{{1,6}} [^\n]+)\n', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '```([0-9A-Za-z_]*)\n', chr(10) || '```\1' || chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n```\n', chr(10) || '```' || chr(10) || chr(10), 'g')"
    return rf"regexp_replace({sql_strip(x)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


# ---------------------------------------------------------------- paged documents


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents; every third one has blank pages only."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"),
        F.when(F.col("conv_id") % 3 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("text"))


SQL_PAGED = """paged AS (SELECT conv_id AS doc_id, turn + 1 AS page_number,
  CASE WHEN conv_id % 3 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM conversations)"""


# ---------------------------------------------------------------- mixed files

PAGE_EXT = [".html", ".htm", ".pdf", ".PNG", ""]
DOC_EXT = [".txt", ".json", ".csv", ".png", ".xml", ""]


def _pick(index, values: list[str]):
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v))
    return out


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files: path, mime, content; names and contents disagree at times."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    a = pages.select(
        F.concat(F.lit("site/p.1/"), F.col("page_id").cast("string"), _pick(F.col("page_id") % 5, PAGE_EXT)).alias("path"),
        F.when(F.col("page_id") % 7 == 0, F.lit("text/html")).alias("mime"), F.col("html").alias("content"))
    n = F.col("doc_id") % 4
    prefix = F.when(n == 0, F.lit('{"a": ')).when(n == 1, F.lit("%PDF-1.7\n")).otherwise(F.lit(""))
    b = docs.select(
        F.concat(F.lit("site/d/"), F.col("doc_id").cast("string"), _pick(F.col("doc_id") % 6, DOC_EXT)).alias("path"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("application/json")).alias("mime"),
        F.concat(prefix, F.col("text")).alias("content"))
    return a.unionByName(b)


def _sql_pick(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


SQL_MIXED = f"""mixed AS (
  SELECT 'site/p.1/' || page_id || {_sql_pick('page_id % 5', PAGE_EXT)} AS path,
         CASE WHEN page_id % 7 = 0 THEN 'text/html' END AS mime, html AS content FROM pages
  UNION ALL
  SELECT 'site/d/' || doc_id || {_sql_pick('doc_id % 6', DOC_EXT)},
         CASE WHEN doc_id % 11 = 0 THEN 'application/json' END,
         CASE doc_id % 4 WHEN 0 THEN '{{"a": ' WHEN 1 THEN '%PDF-1.7' || chr(10) ELSE '' END || text FROM documents)"""
SQL_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+?(\.[^./]+)$', 1))"


def sql_map(x: str, mapping: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


# ---------------------------------------------------------------- HTML made from rows


def row_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup pages with a captioned table, an image of each kind and code, one per supplier."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("string").alias("bal"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"),
                   F.lpad(F.hex(F.col("s_suppkey") + 1), 8, "0"), F.lpad(F.hex(F.lit(20)), 8, "0"), F.lit("0802"))
    html = F.concat(
        F.lit("<html><head><title>T</title></head><body><p>Supplier</p>\n<table><caption>Row | one</caption><thead><tr><th>Key</th><th>Name</th></tr></thead>"),
        F.lit("<tbody><tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td><b>"), F.col("s_name"),
        F.lit("</b> | x</td></tr>\n<tr><td>"), F.col("bal"), F.lit("</td></tr></tbody></table>"),
        F.lit("<table><tr><td>a</td><td>"), F.col("s_nationkey").cast("string"), F.lit("</td></tr><tr><td></td><td>z</td></tr></table>"),
        F.lit('<img src="data:image/png;base64,'), F.base64(F.unhex(png)), F.lit('" alt="Chart">'),
        F.lit('<img alt=ext src="https://img.example.com/'), F.col("s_suppkey").cast("string"), F.lit('.png">'),
        F.lit("<img src='pics/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".gif'></body></html>"))
    return sup.select(F.col("s_suppkey").alias("page_id"),
                      F.concat(F.lit("file:///corpus/dir/"), F.col("s_suppkey").cast("string"), F.lit(".html")).alias("url"),
                      html.alias("html"))
