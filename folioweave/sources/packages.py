"""ZIP-based packages: archives, workbooks, word-processor files.

Opening the container is the one step that needs Python; it runs as an Arrow
batch function over the corpus. Everything after it - XML parts, shared strings,
sheet names, properties - is parsed and joined by Spark.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import docx_pages, image_dims
from folioweave.sources.word import DOCX_PARTS, scan_docx_blocks  # noqa: F401  part of this module's interface

MEMBER_SCHEMA = "path string, member_no bigint, member string, size bigint, content binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("member_no", pa.int64()), ("member", pa.string()),
                    ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_FLUSH_BYTES = 16 << 20
_MEMBER_LIMIT = (1 << 31) - (1 << 20)
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}


def _members(path: str, data: bytes, wanted: re.Pattern | None, read: re.Pattern | None) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for no, info in enumerate(z.infolist()):
                if info.is_dir() or (wanted and not wanted.search(info.filename)):
                    continue
                if read and not read.search(info.filename):
                    yield path, no, info.filename, info.file_size, None, None
                    continue
                if info.file_size > _MEMBER_LIMIT:
                    yield path, no, info.filename, info.file_size, None, "member too large"
                    continue
                try:
                    yield path, no, info.filename, info.file_size, z.read(info), None
                except Exception as e:  # a damaged member must not take the archive down
                    yield path, no, info.filename, info.file_size, None, f"unreadable member: {e}"
    except Exception as e:
        yield path, None, None, None, None, f"not a ZIP archive: {e}"


def explode_archive(corpus: DataFrame, only: str | None = None, read: str | None = None) -> DataFrame:
    """One row per member of each archive (path, content).

    `only` is a pattern on member names that drops the others; `read` keeps all
    members but decompresses the matching ones alone. Where several jobs read the
    members, write this table once and pass it around.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(only) if only else None
        opened = re.compile(read) if read else None
        rows, held = [], 0
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _members(path, data.as_py() or b"", wanted, opened):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held >= _FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return corpus.select("path", "content").mapInArrow(run, MEMBER_SCHEMA)


def package_subtype(members: DataFrame) -> DataFrame:
    """(path, package_type): docx, xlsx, pptx, epub or zip."""
    has = lambda part: F.bool_or(F.contains("member", F.lit(part)))
    types = F.when(F.col("member") == "[Content_Types].xml", F.col("content").cast("string"))
    says = lambda word: F.coalesce(F.bool_or(F.contains(types, F.lit(word))), F.lit(False))
    epub = (F.col("member") == "mimetype") & (F.trim(F.col("content").cast("string")) == "application/epub+zip")
    flags = members.where(F.col("member").isNotNull()).groupBy("path").agg(
        has("word/").alias("w"), has("xl/").alias("x"), has("ppt/").alias("p"),
        F.coalesce(F.bool_or(epub), F.lit(False)).alias("e"),
        says("wordprocessingml").alias("cw"), says("spreadsheetml").alias("cx"), says("presentationml").alias("cp"))
    kind = (
        F.when(F.col("w"), "docx").when(F.col("x"), "xlsx").when(F.col("p"), "pptx").when(F.col("e"), "epub")
        .when(F.col("cw"), "docx").when(F.col("cx"), "xlsx").when(F.col("cp"), "pptx").otherwise("zip"))
    return flags.select("path", kind.alias("package_type"))


_LISTED = pa.schema([("path", pa.string()), ("content", pa.binary()), ("names", pa.list_(pa.string())),
                     ("mimetype", pa.string()), ("types", pa.string())])


def _listing(data: bytes) -> tuple[list[str] | None, str | None, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            read = lambda n: z.read(n).decode("utf-8", "replace") if n in names else None
            return names, read("mimetype"), read("[Content_Types].xml")
    except Exception:
        return None, None, None


def with_package_type(archives: DataFrame) -> DataFrame:
    """(path, content, package_type) without a shuffle: members are listed next to their file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_listing(b.as_py() or b"") for b in batch.column(1)]
            extra = [pa.array(c, t) for c, t in zip(zip(*found), _LISTED.types[2:])] if found else [
                pa.array([], t) for t in _LISTED.types[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *extra], schema=_LISTED)

    listed = archives.select("path", "content").mapInArrow(
        run, "path string, content binary, names array<string>, mimetype string, types string")
    has = lambda part: F.exists("names", lambda n: F.contains(n, F.lit(part)))
    says = lambda word: F.contains("types", F.lit(word))
    kind = (
        F.when(has("word/"), "docx").when(has("xl/"), "xlsx").when(has("ppt/"), "pptx")
        .when(F.trim("mimetype") == "application/epub+zip", "epub")
        .when(says("wordprocessingml"), "docx").when(says("spreadsheetml"), "xlsx").when(says("presentationml"), "pptx")
        .otherwise("zip"))
    return listed.select("path", "content", kind.alias("package_type"))


# ---------------------------------------------------------------- workbooks


def _part(members: DataFrame, pattern: str, schema: str) -> DataFrame:
    """XML members matching a name pattern, parsed."""
    return members.where(F.col("member").rlike(pattern)).select(
        "path", "member", F.from_xml(F.col("content").cast("string"), schema, _XML).alias("x"))


def workbook_sheets(members: DataFrame) -> DataFrame:
    """(path, sheet_index, sheet, member): the sheets in workbook order."""
    names = _part(members, r"^xl/workbook\.xml$", "sheets struct<sheet: array<struct<_name:string,_id:string>>>")
    names = names.select("path", F.posexplode("x.sheets.sheet").alias("i", "s")).select(
        "path", F.col("i").cast("bigint").alias("sheet_index"), F.col("s._name").alias("sheet"), F.col("s._id").alias("rid"))
    rels = _part(members, r"^xl/_rels/workbook\.xml\.rels$", "Relationship array<struct<_Id:string,_Target:string>>")
    rels = rels.select("path", F.explode("x.Relationship").alias("r")).select(
        "path", F.col("r._Id").alias("rid"),
        F.concat(F.lit("xl/"), F.regexp_replace("r._Target", "^(/xl/|\\./)", "")).alias("member"))
    return names.join(rels, ["path", "rid"]).drop("rid")


def shared_strings(members: DataFrame) -> DataFrame:
    """(path, idx, text); rich text runs are joined."""
    part = _part(members, r"^xl/sharedStrings\.xml$", "si array<struct<t:string, r:array<struct<t:string>>>>")
    runs = F.array_join(F.transform("s.r", lambda r: F.coalesce(r["t"], F.lit(""))), "")
    return part.select("path", F.posexplode("x.si").alias("idx", "s")).select(
        "path", F.col("idx").cast("bigint").alias("idx"), F.coalesce("s.t", runs, F.lit("")).alias("text"))


def resolve_shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Replace shared-string numbers (cell_type 's') by their text."""
    idx = F.when(F.col("cell_type") == "s", F.col("raw").try_cast("bigint"))
    out = cells.withColumn("idx", idx).join(strings, ["path", "idx"], "left")
    return out.withColumn("text", F.coalesce("text", F.when(F.col("cell_type") == "s", F.lit("")).otherwise(F.col("raw")), F.lit("")))


def _column_number(ref):
    """0-based column of a cell reference such as AB12."""
    letters = F.split(F.regexp_extract(ref, "^([A-Z]+)", 1), "")
    letters = F.filter(letters, lambda c: c != "")
    return (F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1).cast("bigint")


def _date_styles(members: DataFrame) -> DataFrame:
    """(path, is_date): for each cell style whether its number format is a date or a time."""
    part = _part(members, r"^xl/styles\.xml$", (
        "numFmts struct<numFmt: array<struct<_numFmtId:int,_formatCode:string>>>, cellXfs struct<xf: array<struct<_numFmtId:int>>>"))
    own = F.coalesce("x.numFmts.numFmt", F.array().cast("array<struct<_numFmtId:int,_formatCode:string>>"))
    letters = lambda f: F.regexp_replace(f["_formatCode"], r'"[^"]*+"|\[[^\]]*+\]|\\.', "")
    custom = F.transform(F.filter(own, lambda f: letters(f).rlike("(?i)[ymdhs]")), lambda f: f["_numFmtId"])
    fixed = lambda n: n.between(14, 22) | n.between(45, 47)  # noqa: E731  numbers of the format's own date formats
    return part.select("path", F.transform("x.cellXfs.xf", lambda s: F.coalesce(
        fixed(s["_numFmtId"]) | F.array_contains(custom, s["_numFmtId"]), F.lit(False))).alias("is_date"))


def _shown(raw: Column, kind: Column, style: Column) -> Column:
    """Booleans as True and False, dates as dates; other values as stored."""
    serial = raw.try_cast("double")
    seconds = F.round((serial - 25569) * 86400).cast("bigint")  # days since 1899-12-30
    stamp = F.timestamp_seconds(seconds).cast("timestamp")
    text = F.when(seconds % 86400 == 0, F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    dated = F.coalesce(F.get(F.col("is_date"), style), F.lit(False)) & F.coalesce(kind, F.lit("n")).isin("n") & serial.between(0, 2958465)
    return F.when((kind == "b") & raw.isin("0", "1"), F.when(raw == "1", "True").otherwise("False")).when(dated, text).otherwise(raw)


def broken_sheets(members: DataFrame) -> DataFrame:
    """(path, member): sheets that cannot be read as XML, or whose member could not be opened."""
    sheet = F.col("member").rlike(r"^xl/worksheets/[^/]+\.xml$")
    body = F.from_xml(F.col("content").cast("string"), "_bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return members.where(sheet).where(F.col("content").isNull() | body.isNull() | body["_bad"].isNotNull()).select("path", "member")


def scan_xlsx_cells(members: DataFrame, sheets: list[str] | None = None) -> DataFrame:
    """cells with sheet names; only `sheets` when given.

    Numbers appear as stored, booleans as True and False, dates by their cell style.
    """
    listed = workbook_sheets(members)
    if sheets is not None:
        listed = listed.where(F.col("sheet").isin(sheets))
    schema = ("sheetData struct<row: array<struct<_r:bigint, c: array<struct<_r:string,_t:string,_s:int,v:string,"
              "is:struct<t:string,r:array<struct<t:string>>>>>>>>")
    part = _part(members, r"^xl/worksheets/[^/]+\.xml$", schema)
    rows = part.select("path", "member", F.posexplode("x.sheetData.row").alias("i", "row"))
    raw = rows.select("path", "member", F.coalesce(F.col("row._r") - 1, F.col("i")).alias("row_index"),
                      F.posexplode("row.c").alias("j", "c"))
    raw = raw.select(
        "path", "member", "row_index", F.coalesce(_column_number("c._r"), F.col("j").cast("bigint")).alias("col_index"),
        F.col("c._t").alias("cell_type"), F.col("c._s").alias("style"), F.coalesce("c.v", "c.is.t", F.array_join(
            F.transform("c.is.r", lambda r: F.coalesce(r["t"], F.lit(""))), "")).alias("raw"))
    raw = raw.join(_date_styles(members), "path", "left")
    raw = raw.withColumn("raw", _shown(F.col("raw"), F.col("cell_type"), F.col("style"))).drop("is_date", "style")
    text = resolve_shared_strings(raw, shared_strings(members))
    return text.join(listed, ["path", "member"]).select(
        F.col("path").alias("doc_id"), F.col("sheet_index").alias("table_index"), "row_index", "col_index", "text",
        (F.col("row_index") == 0).alias("is_header"), "sheet", "sheet_index")


# ---------------------------------------------------------------- word-processor files

_WORD = ("body struct<p: array<struct<pPr: struct<pStyle: struct<_val:string>>, "
         "r: array<struct<t: array<string>>>>>, tbl: array<string>>")


def docx_media(members: DataFrame) -> DataFrame:
    """Embedded pictures with format and size."""
    dims = image_dims("content")
    return members.where(F.col("member").rlike("^word/media/")).select(
        F.col("path").alias("doc_id"), F.regexp_extract("member", "([^/]+)$", 1).alias("name"),
        dims["format"].alias("format"), dims["width"].alias("width"), dims["height"].alias("height"),
        F.col("size").alias("size_bytes"), F.col("content").alias("bytes"))


def package_metadata(members: DataFrame) -> DataFrame:
    """Core properties and page count per package; the title falls back to the file stem."""
    core = F.from_xml(
        F.when(F.col("member") == "docProps/core.xml", F.col("content").cast("string")),
        "title string, creator string, subject string, keywords string, created string, modified string", _XML)
    sheets = F.from_xml(
        F.when(F.col("member") == "xl/workbook.xml", F.col("content").cast("string")),
        "sheets struct<sheet: array<struct<_name:string>>>", _XML)
    word = F.from_xml(
        F.when(F.col("member") == "word/document.xml", F.col("content").cast("string")), _WORD, _XML)
    wanted = members.where(F.col("member").isin("docProps/core.xml", "xl/workbook.xml", "word/document.xml"))
    facts = wanted.select("path", core.alias("c"), F.size(sheets["sheets"]["sheet"]).alias("n_sheets"),
                          F.size(word["body"]["p"]).alias("n_par"))
    one = facts.groupBy("path").agg(
        *[F.max(F.nullif(F.trim(F.col("c")[n]), F.lit(""))).alias(n)
          for n in ("title", "creator", "subject", "keywords", "created", "modified")],
        F.max("n_sheets").alias("n_sheets"), F.max("n_par").alias("n_par"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    pages = F.coalesce(F.when(F.col("n_sheets") > 0, F.col("n_sheets").cast("bigint")),
                       docx_pages(F.greatest(F.coalesce("n_par", F.lit(0)), F.lit(0))))
    return one.select(
        "path", F.coalesce("title", stem).alias("title"), F.col("creator").alias("author"), "subject", "keywords",
        F.try_to_timestamp("created").alias("created"), F.try_to_timestamp("modified").alias("modified"),
        pages.alias("page_count"))
