"""Fallbacks, errors, warnings, data formats, sinks and user converters."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave import functions as fn
from folioweave.catalog.common import sql_words, table
from folioweave.catalog.detection import SQL_ERROR, SQL_TYPED, typed
from folioweave.catalog.markup import SQL_META
from folioweave.operators import outcome
from folioweave.operators.markup import html_metadata
from folioweave.plans.converters import ConverterRegistry
from folioweave.session import shared_dir
from folioweave.sources import files
from folioweave.sources.markup_data import scan_json, scan_xml

docs = lambda s, d: table(s, d, "documents")


def first_success(s, d):
    a = F.when(F.col("n_chars") % 2 == 0, fn.preview("text", 20))
    b = F.when(F.col("n_chars") % 3 == 0, F.upper(fn.preview("text", 10)))
    r = docs(s, d).select("doc_id", outcome.first_success([("first", a), ("second", b)]).alias("r"))
    return r.select("doc_id", "r.value", "r.converter", "r.error")


SQL_FIRST = """SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN CASE WHEN length(text) > 20 THEN substring(text, 1, 20) || '...' ELSE text END
    WHEN n_chars % 3 = 0 THEN upper(CASE WHEN length(text) > 10 THEN substring(text, 1, 10) || '...' ELSE text END) END AS value,
  CASE WHEN n_chars % 2 = 0 THEN 'first' WHEN n_chars % 3 = 0 THEN 'second' END AS converter,
  CASE WHEN n_chars % 2 > 0 AND n_chars % 3 > 0 THEN 'all converters failed: first, second' END AS error FROM documents"""


def guard(s, d):
    t = typed(s, d).drop("error")
    g = outcome.guard(t, "file_type", F.concat(F.lit("Could not determine file type for: "), F.col("path")))
    return g.select("path", "status", "error")


def merge_warnings(s, d):
    a = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("short"), F.col("lang")))
    b = F.when(F.col("doc_id") % 3 == 0, F.array(F.col("source")))
    return docs(s, d).select("doc_id", F.array_join(outcome.merge_warnings(a, b), ",").alias("warnings"))


def enrich(s, d):
    res = table(s, d, "pages").select("page_id", F.array(F.lit("w")).alias("warnings"))
    meta = html_metadata(table(s, d, "pages").where("page_id % 4 > 0"))
    return outcome.enrich(res, meta, "page_id", ["title", "author"]).select("page_id", "title", "author", F.array_join("warnings", ",").alias("warnings"))


SQL_ENRICH = f"""WITH m AS ({SQL_META}) SELECT page_id, CASE WHEN page_id % 4 > 0 THEN title END AS title, author,
  CASE WHEN page_id % 4 > 0 THEN 'w' ELSE 'w,Rich metadata extraction failed: no metadata' END AS warnings FROM m"""


def json_rows(s, d):
    """Event properties as JSON documents, some nested, some broken."""
    e = table(s, d, "events")
    nested = F.concat(F.lit('{"items": ["a", {"deep": '), F.col("props"), F.lit("}], \"name\": \"n"), F.col("user_id").cast("string"), F.lit('"}'))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.col("props"), F.lit("}"))).when(F.col("event_id") % 3 == 0, nested).otherwise(F.col("props"))
    return scan_json(e.select("event_id", text.alias("doc")), "event_id", "doc")


SQL_JSON = """WITH e AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, '' AS path, NULL AS value, 'invalid JSON' AS error FROM e WHERE event_id % 10 = 0
UNION ALL SELECT event_id, 'k', k, NULL FROM e WHERE event_id % 10 > 0 AND event_id % 3 > 0
UNION ALL SELECT event_id, unnest(['items[0]', 'items[1].deep.k', 'name']), unnest(['a', k, 'n' || user_id]), NULL FROM e WHERE event_id % 10 > 0 AND event_id % 3 = 0"""


def xml_rows(s, d):
    """Customers as small XML documents, some of them broken."""
    close = F.when(F.col("c_custkey") % 7 == 0, F.lit("</wrong>")).otherwise(F.lit("</x:root>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><x:root xmlns:x="urn:x"><x:item id="1">'), F.col("c_name"), F.lit("</x:item><skip>no</skip>\n<x:item>"),
                   F.col("c_mktsegment"), F.lit(" &amp; <b>co</b></x:item>"), close)
    return scan_xml(table(s, d, "customer").select("c_custkey", xml.alias("xml")), "c_custkey", "xml", "item")


SQL_XML = """SELECT c_custkey, NULL::BIGINT AS node_no, NULL AS text, 'invalid XML' AS error FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, unnest([0, 1, 2]), unnest([c_name, c_mktsegment || ' & ', 'co']), NULL FROM customer WHERE c_custkey % 7 > 0"""


# ---------------------------------------------------------------- sinks, read back


def write_markdown(s, d):
    out = shared_dir(s, "markdown")
    r = docs(s, d).select("doc_id", F.concat(F.lit("in/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
                          F.col("lang").alias("file_type"), fn.tidy_markdown("text").alias("markdown"))
    files.write_markdown(r, out)
    return s.read.parquet(out).select("doc_id", "output_path", F.col("file_type").cast("string").alias("file_type"), fn.word_count("markdown").alias("words"))


SQL_WRITE_MD = f"SELECT doc_id, 'in/' || lang || '/' || doc_id || '.md' AS output_path, lang AS file_type, CAST({sql_words('text')} AS BIGINT) AS words FROM documents"


def write_images(s, d):
    out = shared_dir(s, "images")
    img = table(s, d, "part").select(
        F.concat(F.lit("doc"), (F.col("p_partkey") % 20).cast("string")).alias("stem"), (F.col("p_partkey") % 5 + 1).alias("page_number"),
        F.floor(F.col("p_partkey") / 20).alias("image_index"), F.lit("png").alias("format"), F.encode("p_name", "UTF-8").alias("bytes"))
    files.write_images(img, out)
    return s.read.parquet(out).select("file_name", F.col("bytes").cast("string").alias("body"))


SQL_WRITE_IMG = "SELECT 'doc' || (p_partkey % 20) || '_images/image_' || (p_partkey % 5 + 1) || '_' || (p_partkey // 20) || '.png' AS file_name, p_name AS body FROM part"


def record_metrics(s, d):
    out = shared_dir(s, "metrics")
    e = table(s, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), "ts",
                                     F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attrs"), "event_id")
    for half in (0, 1):
        files.record_metrics(e.where(F.col("event_id") % 2 == half), out)
    back = s.read.parquet(out)
    return back.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("attrs")["user"]).alias("users"),
                                         F.round(F.sum("duration"), 4).alias("total"))


def export_json(s, d):
    conv = table(s, d, "conversations")
    res = conv.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("text").alias("markdown"), F.count(F.lit(1)).alias("page_count"))
    img = conv.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("image_index"), F.length("text").alias("size_bytes"))
    tab = conv.where("turn % 3 = 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("table_index"), F.col("role").alias("caption"))
    j = files.export_json(res, img, tab)
    get = lambda p: F.get_json_object("json", p)
    return j.select("doc_id", "part", get("$.markdown").alias("markdown"), get("$.metadata.page_count").cast("bigint").alias("page_count"),
                    get("$.images[*].size_bytes").alias("sizes"), get("$.tables[0].caption").alias("caption"))


SQL_EXPORT = """WITH i AS (SELECT conv_id, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS s, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, arg_min(role, turn) AS caption FROM conversations WHERE turn % 3 = 0 GROUP BY conv_id)
SELECT c.conv_id AS doc_id, 0::BIGINT AS part, max(text) AS markdown, count(*) AS page_count,
  any_value(CASE WHEN n = 1 THEN s WHEN n > 1 THEN '[' || s || ']' END) AS sizes, any_value(caption) AS caption
FROM conversations c LEFT JOIN i ON i.conv_id = c.conv_id LEFT JOIN t ON t.conv_id = c.conv_id GROUP BY c.conv_id"""


# ---------------------------------------------------------------- user converters


def _lines_converter(batches):
    """A toy converter: the first line as a heading; empty content is an error."""
    import pyarrow as pa

    for b in batches:
        text = [bytes(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        md = ["# " + t.split("\n", 1)[0] if t.strip() else None for t in text]
        err = [None if m is not None else "empty" for m in md]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(md, pa.string()), pa.array(err, pa.string())], names=["path", "markdown", "error"])


def registry() -> ConverterRegistry:
    reg = ConverterRegistry()
    reg.register_converter("json", "fast", "First Line", _lines_converter, (".json",))
    reg.register_converter("csv", "default", "First Line CSV", _lines_converter, (".csv",))
    reg.register_converter("xml", "fast", "Switched Off", _lines_converter, (".xml",), available=False)
    return reg


def register_converter(s, d):
    known = typed(s, d).where("file_type in ('json', 'csv', 'xml')")
    todo = known.select("path", F.encode("content", "UTF-8").alias("content"), "file_type", F.lit("fast").alias("strategy"))
    return registry().convert(todo).select("path", "converter", F.md5("markdown").alias("markdown_md5"), "error")


SQL_CONVERT = f"""WITH {SQL_TYPED} SELECT path, CASE file_type WHEN 'json' THEN 'First Line' WHEN 'csv' THEN 'First Line CSV' END AS converter,
  CASE WHEN file_type <> 'xml' THEN md5('# ' || split_part(content, chr(10), 1)) END AS markdown_md5,
  CASE WHEN file_type = 'xml' THEN 'No converter available for XML with strategy ''fast''. Available strategies for XML: []' END AS error
FROM typed WHERE file_type IN ('json', 'csv', 'xml')"""

QUERIES = {
    "first_success": (first_success, SQL_FIRST),
    "guard": (guard, f"WITH {SQL_TYPED} SELECT path, CASE WHEN file_type IS NULL THEN 'error' ELSE 'ok' END AS status, {SQL_ERROR} AS error FROM typed"),
    "merge_warnings": (merge_warnings, """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'short,' || lang END, CASE WHEN doc_id % 3 = 0 THEN source END) AS warnings FROM documents"""),
    "enrich": (enrich, SQL_ENRICH),
    "scan_json": (json_rows, SQL_JSON),
    "scan_xml": (xml_rows, SQL_XML),
    "write_markdown": (write_markdown, SQL_WRITE_MD),
    "write_images": (write_images, SQL_WRITE_IMG),
    "record_metrics": (record_metrics, "SELECT event_type AS operation, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type"),
    "export_json": (export_json, SQL_EXPORT),
    "register_converter": (register_converter, SQL_CONVERT),
}
