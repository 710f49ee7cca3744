"""Packages: ZIP containers written from customer rows inside Spark, then scanned."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import functions as F

from folioweave.catalog.common import table
from folioweave.plans.batch import convert_corpus
from folioweave.sources import packages as pk
from folioweave.sources.files import scan_corpus

PER_FILE = 40  # customers per package: a file has a fixed size, their number grows with the table
KINDS = ["xlsx", "docx", "epub", "zip"]
PNG = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000007000000090802000000")
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
CORE = ('<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc" xmlns:dcterms="urn:t"><dc:title>{title}</dc:title><dc:creator>author {n}</dc:creator>'
        '<dc:subject>s{n}</dc:subject><dcterms:created>2024-01-0{day}T10:00:00Z</dcterms:created></cp:coreProperties>')


def _zip(members: dict[str, bytes | str]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buf.getvalue()


def _workbook(rows: list[tuple], n: int) -> dict[str, str]:
    """Two sheets: names by shared string, segments inline; the second one has keys only."""
    shared = "".join(f"<si><t>{escape(r[1])}</t></si>" for r in rows)
    cells = "".join(
        f'<row r="{i + 2}"><c r="A{i + 2}"><v>{r[0]}</v></c><c r="B{i + 2}" t="s"><v>{i}</v></c>'
        f'<c r="D{i + 2}" t="inlineStr"><is><t>{escape(r[2])}</t></is></c></row>' for i, r in enumerate(rows))
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c></row>'
    keys = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{r[0]}</v></c></row>' for i, r in enumerate(rows))
    return {
        "[Content_Types].xml": "<Types>spreadsheetml</Types>",
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Data {n}" sheetId="1" r:id="rId7"/><sheet name="Keys" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="urn:rel"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/><Relationship Id="rId8" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{shared}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{head}{cells}</sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{keys}</sheetData></worksheet>',
        "docProps/core.xml": CORE.format(title="" if n % 8 == 4 else f"Book {n}", n=n, day=n % 9 + 1),
    }


def _par(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def _nested(n: int) -> str:
    """A tracked change, a text box with its older version, a note, a table within a cell, a style by its name."""
    box = f"<w:txbxContent>{_par(f'boxed {n}')}</w:txbxContent>"
    inner = f"<w:tbl><w:tr><w:tc>{_par('in')}</w:tc><w:tc>{_par('ner')}</w:tc></w:tr></w:tbl>"
    return (
        '<w:p><w:r><w:t xml:space="preserve">before </w:t></w:r><w:ins><w:r><w:t xml:space="preserve">new </w:t></w:r></w:ins>'
        f"<w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:r><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback>"
        '</mc:AlternateContent></w:r><w:r><w:t>tail</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{_par("Wide")}</w:tc></w:tr><w:tr><w:tc>{_par(f"c{n}")}</w:tc>'
        f"<w:tc>{_par('out')}{inner}<w:p/></w:tc></w:tr></w:tbl>"
        '<w:p><w:pPr><w:pStyle w:val="Kop3"/></w:pPr><w:sdt><w:sdtContent><w:r><w:t>Last</w:t></w:r></w:sdtContent></w:sdt></w:p>')


def _document(rows: list[tuple], n: int, nested: bool = False) -> dict[str, bytes | str]:
    paras = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part {n}</w:t></w:r></w:p>' + "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(r[1])} </w:t></w:r><w:r><w:t>{escape(r[2])}</w:t></w:r></w:p>' for r in rows)
    space = f'xmlns:w="{WORD}" xmlns:mc="urn:mc"'
    more = {} if not nested else {
        "word/footnotes.xml": f'<w:footnotes {space}><w:footnote w:type="separator" w:id="0">{_par("-")}</w:footnote><w:footnote w:id="2">{_par(f"foot {n}")}</w:footnote></w:footnotes>',
        "word/styles.xml": f'<w:styles {space}><w:style w:type="paragraph" w:styleId="Kop3"><w:name w:val="heading 3"/></w:style></w:styles>'}
    return more | {"word/document.xml": f'<w:document {space}><w:body>{paras}{_nested(n) if nested else ""}</w:body></w:document>',
                   "word/media/image1.png": PNG, "docProps/core.xml": CORE.format(title=f"Doc {n}", n=n, day=n % 9 + 1)}


def _package(pdf: pd.DataFrame) -> pd.DataFrame:
    n = int(pdf["file_no"].iloc[0])
    rows = sorted(zip(pdf["c_custkey"], pdf["c_name"], pdf["c_mktsegment"]))
    kind = KINDS[n % 4]
    if kind == "xlsx":
        body = _zip(_workbook(rows, n))
    elif kind == "docx":
        body = _zip(_document(rows, n, nested=True))
    elif kind == "epub":
        body = _zip({"mimetype": "application/epub+zip", "OEBPS/a.xhtml": "<p>x</p>"})
    else:
        body = _zip({f"row{k}.txt": f"{a}|{b}" for k, (a, b, _) in enumerate(rows)})
    # every ninth package is cut short
    return pd.DataFrame({"path": [f"in/pack_{n}.{kind}"], "content": [body[:20] if n % 9 == 8 else body]})


def corpus(s, d):
    c = table(s, d, "customer").select(F.floor(F.col("c_custkey") / PER_FILE).cast("bigint").alias("file_no"), "c_custkey", "c_name", "c_mktsegment")
    return c.groupBy("file_no").applyInPandas(_package, "path string, content binary")


SQL_FILES = f"""f AS (SELECT c_custkey // {PER_FILE} AS n, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_custkey // {PER_FILE} ORDER BY c_custkey) AS i FROM customer),
g AS (SELECT *, 'in/pack_' || n || CASE n % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN '.epub' ELSE '.zip' END AS path, n % 9 = 8 AS broken FROM f)"""


def explode_archive(s, d):
    """Members of all packages; sizes and bodies of those whose text SQL can write down."""
    m = pk.explode_archive(corpus(s, d))
    plain = F.col("member").rlike(r"^(row[0-9]+\.txt|mimetype|OEBPS/a\.xhtml|\[Content_Types\]\.xml)$")
    return m.select("path", "member", F.when(plain, F.col("size")).alias("size"), F.when(plain, F.col("content").cast("string")).alias("body"),
                    F.col("error").isNotNull().alias("failed"))


SQL_EXPLODE = f"""WITH {SQL_FILES}
SELECT path, 'row' || (i - 1) || '.txt' AS member, CAST(length(c_custkey || '|' || c_name) AS BIGINT) AS size, c_custkey || '|' || c_name AS body, false AS failed FROM g WHERE n % 4 = 3 AND NOT broken
UNION ALL SELECT DISTINCT path, 'mimetype', 20, 'application/epub+zip', false FROM g WHERE n % 4 = 2 AND NOT broken
UNION ALL SELECT DISTINCT path, 'OEBPS/a.xhtml', 8, '<p>x</p>', false FROM g WHERE n % 4 = 2 AND NOT broken
UNION ALL SELECT path, member, CASE WHEN member[1] = '[' THEN 28 END, CASE WHEN member[1] = '[' THEN '<Types>spreadsheetml</Types>' END, false
  FROM (SELECT DISTINCT path FROM g WHERE n % 4 = 0 AND NOT broken), (SELECT unnest(['[Content_Types].xml', 'xl/workbook.xml', 'xl/_rels/workbook.xml.rels', 'xl/sharedStrings.xml', 'xl/worksheets/sheet1.xml', 'xl/worksheets/sheet2.xml', 'docProps/core.xml']) AS member)
UNION ALL SELECT path, member, NULL, NULL, false FROM (SELECT DISTINCT path FROM g WHERE n % 4 = 1 AND NOT broken), (SELECT unnest(['word/document.xml', 'word/footnotes.xml', 'word/styles.xml', 'word/media/image1.png', 'docProps/core.xml']) AS member)
UNION ALL SELECT DISTINCT path, NULL, NULL::BIGINT, NULL, true FROM g WHERE broken"""


def scan_xlsx_cells(s, d):
    m = pk.explode_archive(corpus(s, d).where("path like '%.xlsx'"), r"^xl/.*\.(xml|rels)$")
    return pk.scan_xlsx_cells(m).select("doc_id", "sheet", "sheet_index", "row_index", "col_index", "text", "is_header")


SQL_XLSX = f"""WITH {SQL_FILES}, x AS (SELECT * FROM g WHERE n % 4 = 0 AND NOT broken)
SELECT path AS doc_id, 'Data ' || n AS sheet, 0::BIGINT AS sheet_index, i AS row_index, unnest([0, 1, 3])::BIGINT AS col_index, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) AS text, false AS is_header FROM x
UNION ALL SELECT path, 'Data ' || n, 0, 0, unnest([0, 1]), unnest(['key', 'name']), true FROM (SELECT DISTINCT path, n FROM x)
UNION ALL SELECT path, 'Keys', 1, i - 1, 0, CAST(c_custkey AS VARCHAR), i = 1 FROM x"""


def resolve_shared_strings(s, d):
    """Cells that point at shared strings, straight from the parts."""
    m = pk.explode_archive(corpus(s, d).where("path like '%.xlsx'"), r"^xl/sharedStrings\.xml$")
    c = table(s, d, "customer").select(
        F.concat(F.lit("in/pack_"), F.floor(F.col("c_custkey") / PER_FILE).cast("string"), F.lit(".xlsx")).alias("path"),
        F.lit("s").alias("cell_type"), (F.col("c_custkey") % PER_FILE).cast("string").alias("raw"), "c_custkey")
    return pk.resolve_shared_strings(c, pk.shared_strings(m)).select("c_custkey", "text")


SQL_STRINGS = f"""WITH {SQL_FILES}, st AS (SELECT n, i - 1 AS idx, c_name FROM g WHERE n % 4 = 0 AND NOT broken)
SELECT c_custkey, coalesce(st.c_name, '') AS text FROM customer c LEFT JOIN st ON st.n = c.c_custkey // {PER_FILE} AND st.idx = c.c_custkey % {PER_FILE}"""


def scan_docx_blocks(s, d):
    return pk.scan_docx_blocks(pk.explode_archive(corpus(s, d).where("path like '%.docx'"), pk.DOCX_PARTS))


SQL_DOCX = f"""WITH {SQL_FILES}, x AS (SELECT * FROM g WHERE n % 4 = 1 AND NOT broken)
SELECT path AS doc_id, i AS block_no, NULL AS style, NULL::INTEGER AS level, c_name || ' ' || c_mktsegment AS text FROM x
UNION ALL SELECT DISTINCT path, 0, 'Heading2', 2, 'Part ' || n FROM x
UNION ALL SELECT path, k + unnest([1, 2, 3, 4, 5]), unnest([NULL, NULL, 'Table', 'Kop3', 'Footnote']), unnest([NULL, NULL, NULL, 3, NULL]),
  unnest(['before new tail[^2]', 'boxed ' || n, '| Wide |  |' || chr(10) || '| --- | --- |' || chr(10) || '| c' || n || ' | out in ner |', 'Last', '[^2]: foot ' || n])
  FROM (SELECT path, n, count(*) AS k FROM x GROUP BY ALL)"""


def docx_media(s, d):
    m = pk.docx_media(pk.explode_archive(corpus(s, d).where("path like '%.docx'"), "^word/media/"))
    return m.select("doc_id", "name", "format", "width", "height", "size_bytes")


def package_metadata(s, d):
    only = r"^(docProps/core\.xml|xl/workbook\.xml|word/document\.xml)$"
    m = pk.package_metadata(pk.explode_archive(corpus(s, d), only))
    return m.select("path", "title", "author", "subject", "keywords", F.date_format("created", "yyyy-MM-dd").alias("created"), "page_count")


SQL_PROPS = f"""WITH {SQL_FILES}, k AS (SELECT path, n, count(*) AS rows FROM g WHERE n % 4 < 2 AND NOT broken GROUP BY ALL)
SELECT path, CASE WHEN n % 4 = 1 THEN 'Doc ' || n WHEN n % 8 = 4 THEN 'pack_' || n ELSE 'Book ' || n END AS title, 'author ' || n AS author, 's' || n AS subject, NULL::VARCHAR AS keywords,
  '2024-01-0' || (n % 9 + 1) AS created, CASE WHEN n % 4 = 0 THEN 2 ELSE greatest(1, (rows + 3) // 25) END::BIGINT AS page_count FROM k"""


def scan_files(s, d):
    """The given Parquet files as a corpus: names and sizes without reading them."""
    f = scan_corpus(s, d, "*.parquet")
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


def convert_packages(s, d):
    """The batch job over packages, markup and one CSV or unknown file per customer; Markdown of the CSV files."""
    p = table(s, d, "pages").select(F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    u = table(s, d, "customer").select(
        F.concat(F.lit("in/c"), F.col("c_custkey").cast("string"), F.when(F.col("c_mktsegment") == "BUILDING", ".bin").otherwise(".csv")).alias("path"),
        F.encode(F.concat(F.lit("name,segment\n"), F.col("c_name"), F.lit(","), F.col("c_mktsegment"), F.lit("\n")), "UTF-8").alias("content"))
    files = corpus(s, d).unionByName(p).unionByName(u)
    r = convert_corpus(files)
    return r.select("path", "part", "file_type", F.col("error").isNotNull().alias("failed"),
                    F.when(F.col("file_type").isin("csv", "docx"), F.col("markdown")).alias("markdown"))


# cut-short packages keep the type their extension names, except that they cannot be read
SQL_BATCH = f"""WITH {SQL_FILES}, k AS (SELECT path, n, broken, string_agg(c_name || ' ' || c_mktsegment, chr(10) || chr(10) ORDER BY i) AS body FROM g GROUP BY ALL)
SELECT path, 0::BIGINT AS part, CASE n % 4 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' ELSE 'zip' END AS file_type, broken OR n % 4 >= 2 AS failed,
  CASE WHEN n % 4 = 1 AND NOT broken THEN concat_ws(chr(10) || chr(10), '## Part ' || n, body, 'before new tail[^2]', 'boxed ' || n,
    '| Wide |  |' || chr(10) || '| --- | --- |' || chr(10) || '| c' || n || ' | out in ner |', '### Last', '[^2]: foot ' || n) END AS markdown FROM k
UNION ALL SELECT 'in/' || page_id || '.html', 0, 'html', false, NULL FROM pages
UNION ALL SELECT 'in/c' || c_custkey || '.csv', 0, 'csv', false, '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'in/c' || c_custkey || '.bin', 0, 'unknown', true, NULL FROM customer WHERE c_mktsegment = 'BUILDING'"""

QUERIES = {
    "scan_corpus": (scan_files, None),
    "explode_archive": (explode_archive, SQL_EXPLODE),
    "package_subtype": (lambda s, d: pk.package_subtype(pk.explode_archive(corpus(s, d))), f"""WITH {SQL_FILES}
        SELECT DISTINCT path, CASE n % 4 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' ELSE 'zip' END AS package_type FROM g WHERE NOT broken"""),
    "scan_xlsx_cells": (scan_xlsx_cells, SQL_XLSX),
    "resolve_shared_strings": (resolve_shared_strings, SQL_STRINGS),
    "scan_docx_blocks": (scan_docx_blocks, SQL_DOCX),
    "docx_media": (docx_media, f"""WITH {SQL_FILES} SELECT DISTINCT path AS doc_id, 'image1.png' AS name, 'png' AS format, 7 AS width, 9 AS height, 29::BIGINT AS size_bytes FROM g WHERE n % 4 = 1 AND NOT broken"""),
    "package_metadata": (package_metadata, SQL_PROPS),
    "convert_corpus": (convert_packages, SQL_BATCH),
}
