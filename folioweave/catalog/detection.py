"""Detection, routing and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave import rules
from folioweave.catalog.common import SQL_EXT, SQL_MIXED, mixed, sql_map, table
from folioweave.operators import detect, metrics, routing

HTML_EXT = [".html", ".htm"]


def typed(s, d):
    return detect.detect_type(mixed(s, d), mime="mime")


def _magic_sql(column: str, names: bool) -> str:
    """First matching signature; only the textual ones can occur in the text tables."""
    lead = rf"lower(regexp_replace(substring({column}, 1, 512), '^[\s]+', ''))"
    picks = []
    for name, kind, sig in rules.SIGNATURES:
        out = name if names else kind
        if name == "html":
            picks.append(f"WHEN starts_with({lead}, '{sig.decode().lower()}') THEN '{out}'")
        elif all(32 <= b < 127 for b in sig):
            picks.append(f"WHEN starts_with({column}, '{sig.decode()}') THEN '{out}'")
    return "CASE " + " ".join(picks) + " END"


SQL_OK = rf"""CASE by_ext WHEN 'pdf' THEN starts_with(content, '%PDF-') WHEN 'json' THEN starts_with(content, '{{') OR starts_with(content, '[')
  WHEN 'xml' THEN starts_with(content, '<')
  WHEN 'html' THEN regexp_matches(substring(content, 1, 512), '(?i)^[\s]*(<!doctype|<html)') ELSE true END"""
SQL_SNIFF = "regexp_matches(lower(substring(content, 1, 1024)), '<!doctype|<html|<head|<body|<div')"
SQL_TYPED = f"""{SQL_MIXED},
e AS (SELECT *, {SQL_EXT} AS ext FROM mixed),
b AS (SELECT *, {sql_map('ext', rules.EXTENSION_TYPES)} AS by_ext, {sql_map('mime', rules.MIME_TYPES)} AS by_mime,
      {_magic_sql('content', False)} AS by_magic, {SQL_SNIFF} AS sniff FROM e),
typed AS (SELECT path, content,
  CASE WHEN by_ext IS NOT NULL AND {SQL_OK} THEN by_ext WHEN by_mime IS NOT NULL THEN by_mime WHEN by_magic IS NOT NULL THEN by_magic WHEN sniff THEN 'html' END AS file_type,
  CASE WHEN by_ext IS NOT NULL AND {SQL_OK} THEN 'extension' WHEN by_mime IS NOT NULL THEN 'mime' WHEN by_magic IS NOT NULL THEN 'magic' WHEN sniff THEN 'content' ELSE 'unsupported' END AS detected_by
  FROM b)"""
SQL_ERROR = "CASE WHEN file_type IS NULL THEN 'Could not determine file type for: ' || path END"


def with_ext(s, d):
    return mixed(s, d).withColumn("ext", detect.file_ext("path"))


def validate_ext(s, d):
    return detect.validate_ext(with_ext(s, d), "ext", "HTML Converter", HTML_EXT).select("path", "ext", "ext_ok", "ext_error")


def magic_ok(s, d):
    return detect.type_by_ext(with_ext(s, d)).select("path", detect.magic_ok("content", "file_type").alias("magic_ok"))


# ---------------------------------------------------------------- routes from data


def event_routes(s, d):
    """Routes found in the event log: type by user, strategy by event kind; small by its vocabulary."""
    e = table(s, d, "events")
    kind = F.concat(F.lit("t"), (F.col("user_id") % 17).cast("string"))
    strategy = (F.when(F.col("event_type") == "click", "fast").when(F.col("event_type") == "view", "auto")
                .when(F.col("event_type") == "error", "ocr").when(F.col("user_id") % 17 == 3, "accurate").otherwise("default"))
    return e.where((F.col("user_id") % 17 != 5) | (F.col("event_type") != "click")).select(
        kind.alias("file_type"), strategy.alias("strategy")).distinct().withColumn(
        "converter", F.concat(F.col("file_type"), F.lit("-"), F.col("strategy")))


SQL_ROUTES = """routes AS (SELECT DISTINCT 't' || (user_id % 17) AS file_type,
  CASE event_type WHEN 'click' THEN 'fast' WHEN 'view' THEN 'auto' WHEN 'error' THEN 'ocr' ELSE CASE WHEN user_id % 17 = 3 THEN 'accurate' ELSE 'default' END END AS strategy
  FROM events WHERE user_id % 17 <> 5 OR event_type <> 'click')"""


def route(s, d):
    n = F.col("doc_id")
    pick = F.when(n % 3 == 0, "fast").when(n % 3 == 1, "accurate").otherwise("markitdown")
    df = table(s, d, "documents").select("doc_id", F.concat(F.lit("t"), (n % 19).cast("string")).alias("file_type"), pick.alias("strategy"))
    return routing.route(df, event_routes(s, d)).select("doc_id", "converter", "route_error")


SQL_ROUTE = f"""WITH {SQL_ROUTES},
known AS (SELECT file_type, string_agg(strategy, ', ' ORDER BY strategy) AS known FROM routes GROUP BY file_type),
df AS (SELECT doc_id, 't' || (doc_id % 19) AS file_type, CASE doc_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'accurate' ELSE 'markitdown' END AS strategy FROM documents),
j AS (SELECT df.*, CASE WHEN r.strategy IS NOT NULL THEN df.file_type || '-' || df.strategy WHEN q.strategy IS NOT NULL THEN df.file_type || '-default' END AS converter, known
  FROM df LEFT JOIN routes r ON r.file_type = df.file_type AND r.strategy = df.strategy
  LEFT JOIN routes q ON q.file_type = df.file_type AND q.strategy = 'default' LEFT JOIN known k ON k.file_type = df.file_type)
SELECT doc_id, converter, CASE WHEN converter IS NULL THEN 'No converter available for ' || upper(file_type) || ' with strategy ''' || strategy ||
  '''. Available strategies for ' || upper(file_type) || ': [' || coalesce(known, '') || ']' END AS route_error FROM j"""


def strategies_per_type(s, d):
    return routing.strategies_per_type(event_routes(s, d)).select("file_type", F.array_join("strategies", ",").alias("strategies"))


def formats_common(s, d):
    """Extensions of the files at hand that every entry point accepts."""
    seen = with_ext(s, d).where("ext <> ''").select("ext").distinct()
    general = seen.where(F.col("ext").isin(list(rules.ROUTABLE_EXTENSION_TYPES)))
    upload = seen.where(F.col("ext").isin(rules.UPLOAD_EXTENSIONS))
    return routing.formats_common(general, upload)


def format_gaps(s, d):
    """Types detected among the files at hand that no route takes."""
    wide = typed(s, d).unionByName(mixed(s, d).select("path", "mime", "content", F.lit("tiff").alias("file_type"),
                                                      F.lit("magic").alias("detected_by"), F.lit(None).cast("string").alias("error")))
    return routing.format_gaps(detect.only_supported(wide), routing.built_in_routes(s).where("file_type <> 'json'"))


def union_results(s, d):
    a = table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("html").alias("converter"), "url")
    b = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("converter"), "n_chars")
    return routing.union_results(a, b)


QUERIES = {
    "file_ext": (lambda s, d: with_ext(s, d).select("path", "ext"), f"WITH {SQL_MIXED} SELECT path, {SQL_EXT} AS ext FROM mixed"),
    "type_by_ext": (lambda s, d: detect.type_by_ext(with_ext(s, d)).select("path", "file_type"),
                    f"WITH {SQL_MIXED} SELECT path, {sql_map(SQL_EXT, rules.EXTENSION_TYPES)} AS file_type FROM mixed"),
    "magic_ok": (magic_ok, f"WITH {SQL_MIXED}, e AS (SELECT *, {sql_map(SQL_EXT, rules.EXTENSION_TYPES)} AS by_ext FROM mixed) "
                 f"SELECT path, CASE WHEN by_ext = 'png' THEN false ELSE {SQL_OK} END AS magic_ok FROM e"),
    "type_by_magic": (lambda s, d: detect.type_by_magic(mixed(s, d)).select("path", "signature", "magic_type"),
                      f"WITH {SQL_MIXED} SELECT path, {_magic_sql('content', True)} AS signature, {_magic_sql('content', False)} AS magic_type FROM mixed"),
    "sniff_html": (lambda s, d: mixed(s, d).select("path", detect.sniff_html("content").alias("is_html")),
                   f"WITH {SQL_MIXED} SELECT path, {SQL_SNIFF} AS is_html FROM mixed"),
    "type_by_mime": (lambda s, d: detect.type_by_mime(mixed(s, d)).select("path", "file_type"),
                     f"WITH {SQL_MIXED} SELECT path, {sql_map('mime', rules.MIME_TYPES)} AS file_type FROM mixed"),
    "detect_type": (lambda s, d: typed(s, d).select("path", "file_type", "detected_by", "error"),
                    f"WITH {SQL_TYPED} SELECT path, file_type, detected_by, {SQL_ERROR} AS error FROM typed"),
    "only_supported": (lambda s, d: detect.only_supported(typed(s, d)).select("path", "file_type"),
                       f"WITH {SQL_TYPED} SELECT path, file_type FROM typed WHERE file_type IS NOT NULL"),
    "validate_ext": (validate_ext, f"""WITH {SQL_MIXED}, e AS (SELECT path, {SQL_EXT} AS ext FROM mixed)
        SELECT path, ext, ext IN ('.html', '.htm') AS ext_ok, CASE WHEN ext NOT IN ('.html', '.htm') THEN 'File extension ''' || ext ||
        ''' not supported by HTML Converter. Supported extensions: .html, .htm' END AS ext_error FROM e"""),
    "batch_report": (lambda s, d: metrics.batch_report(typed(s, d)),
                     f"WITH {SQL_TYPED} SELECT count(*) AS total, count(file_type) AS successful, count(*) - count(file_type) AS failed FROM typed"),
    "distinct_types": (lambda s, d: detect.distinct_types(typed(s, d)).orderBy("file_type"),
                       f"WITH {SQL_TYPED} SELECT DISTINCT file_type FROM typed WHERE file_type IS NOT NULL"),
    "route": (route, SQL_ROUTE),
    "capability_matrix": (lambda s, d: routing.capability_matrix(event_routes(s, d), ["auto", "fast", "accurate", "ocr", "default"]),
                          f"WITH {SQL_ROUTES} SELECT file_type, bool_or(strategy = 'auto') AS auto, bool_or(strategy = 'fast') AS fast, bool_or(strategy = 'accurate') AS accurate, bool_or(strategy = 'ocr') AS ocr, bool_or(strategy = 'default') AS \"default\" FROM routes GROUP BY file_type"),
    "strategies_per_type": (strategies_per_type, f"WITH {SQL_ROUTES} SELECT file_type, string_agg(strategy, ',' ORDER BY strategy) AS strategies FROM routes GROUP BY file_type"),
    "formats_common": (formats_common, f"WITH {SQL_MIXED}, e AS (SELECT DISTINCT {SQL_EXT} AS ext FROM mixed) SELECT ext FROM e WHERE ext IN ('.pdf', '.html', '.htm', '.docx', '.xlsx')"),
    "format_gaps": (format_gaps, f"WITH {SQL_TYPED}, t AS (SELECT DISTINCT file_type FROM typed UNION SELECT 'tiff') SELECT file_type FROM t WHERE file_type IN ('json', 'tiff', 'doc', 'xls', 'ppt')"),
    "union_results": (union_results, "SELECT page_id AS id, 'html' AS converter, url, NULL::BIGINT AS n_chars FROM pages UNION ALL SELECT doc_id, 'text', NULL, n_chars FROM documents"),
}
