"""The batch job: a folder of mixed files to one result table.

detect -> write by type -> convert per type -> union. Each converter reads only
the files of its type; a file that fails becomes an error row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions import decode_text, tidy_markdown, word_count
from folioweave.operators.detect import detect_type
from folioweave.operators.routing import union_results
from folioweave.operators.tables import render_table, table_or_note, workbook_markdown
from folioweave.options import Options
from folioweave.plans.pages import pages_to_results
from folioweave.sources.files import csv_cells
from folioweave.session import shared_dir
from folioweave.sources.packages import (
    DOCX_PARTS, broken_sheets, explode_archive, scan_docx_blocks, scan_xlsx_cells, with_package_type, workbook_sheets,
)

BLOCKS_PER_PART = 4096


def docx_markdown(members: DataFrame) -> DataFrame:
    """(doc_id, part, markdown) of word-processor files: headings by level, text by paragraph."""
    blocks = scan_docx_blocks(members).where(F.trim("text") != "")
    line = F.concat(F.coalesce(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" ")), F.lit("")), F.col("text"))
    part = F.floor(F.col("block_no") / BLOCKS_PER_PART).cast("bigint").alias("part")
    lines = blocks.select("doc_id", part, F.struct("block_no", line.alias("p")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "\n\n")
    return lines.groupBy("doc_id", "part").agg(tidy_markdown(joined).alias("markdown"))


def xlsx_markdown(members: DataFrame, options: Options) -> DataFrame:
    """(doc_id, part, markdown) of workbooks: every sheet, wide ones cut with a note, empty and broken ones with a line."""
    wanted = [s.strip() for s in options.xlsx_sheets.split(",")] if options.xlsx_sheets else None
    listed = workbook_sheets(members)
    if wanted is not None:
        listed = listed.where(F.col("sheet").isin(wanted))
    bad = broken_sheets(members).withColumn("bad", F.lit(True))
    listed = listed.join(bad, ["path", "member"], "left").select(
        F.col("path").alias("doc_id"), F.col("sheet_index").alias("table_index"), "sheet", "bad")
    rendered = table_or_note(scan_xlsx_cells(members, wanted), options.xlsx_max_sheet_width, options.table_format, listed)
    sheets = rendered.join(listed, ["doc_id", "table_index"]).withColumn(
        "markdown", F.when(F.col("bad"), F.lit(rules.BROKEN_SHEET)).otherwise(F.col("markdown")))
    return workbook_markdown(sheets.select(
        "doc_id", F.regexp_extract("doc_id", "([^/]+)$", 1).alias("name"),
        F.col("table_index").alias("sheet_index"), "sheet", "part", "markdown"), options.xlsx_mode)


def type_corpus(corpus: DataFrame, options: Options, folder: str) -> DataFrame:
    """Detect types once and write the files by type, so that each converter reads only its own."""
    packed = F.coalesce(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), F.lit(False))
    files = corpus.select("path", "content")
    files = with_package_type(files.where(packed)).unionByName(files.where(~packed), allowMissingColumns=True)
    typed = detect_type(files, package_type="package_type", text_passthrough=options.text_passthrough)
    typed = typed.withColumn("file_type", F.coalesce("file_type", F.lit("unknown")))
    typed.select("path", "content", "error", "file_type").write.partitionBy("file_type").parquet(folder)
    return corpus.sparkSession.read.parquet(folder)


def convert_corpus(corpus: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, part, file_type, markdown, total_words, error) for files (path, content)."""
    opts = options or Options()
    typed = type_corpus(corpus, opts, shared_dir(corpus.sparkSession, "typed"))
    of = lambda kind: typed.where(F.col("file_type") == kind)
    parts = []

    text = decode_text("content")
    html = of("html").select(F.col("path").alias("page_id"), F.col("path").alias("url"), text.alias("html"))
    md = pages_to_results(html, opts).select(
        F.col("doc_id").alias("path"), F.lit(0).cast("bigint").alias("part"), "markdown")
    parts.append(md.withColumn("file_type", F.lit("html")))

    cells = csv_cells(of("csv").select(F.col("path").alias("doc_id"), text.alias("content")))
    parts.append(_named(render_table(cells, opts.table_format), "csv"))
    parts.append(_named(docx_markdown(explode_archive(of("docx"), DOCX_PARTS)), "docx"))
    parts.append(_named(xlsx_markdown(explode_archive(of("xlsx"), r"^xl/.*\.(xml|rels)$"), opts), "xlsx"))
    for kind in ("json", "xml", "text"):
        fence = text if kind == "text" else F.concat(F.lit(f"```{kind}\n"), text, F.lit("\n```"))
        parts.append(of(kind).select("path", F.lit(0).cast("bigint").alias("part"), fence.alias("markdown"),
                                     F.lit(kind).alias("file_type")))

    done = union_results(*parts).withColumn("total_words", word_count("markdown"))
    status = typed.select("path", F.col("file_type").alias("_type"), F.col("error").alias("_error"))
    joined = status.join(done, "path", "left")
    missing = F.when(F.col("markdown").isNull(), F.coalesce(
        "_error", F.concat(F.lit("Failed to read "), F.upper("_type"))))
    return joined.select(
        "path", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"), F.col("_type").cast("string").alias("file_type"),
        "markdown", F.coalesce("total_words", F.lit(0).cast("bigint")).alias("total_words"), missing.alias("error"))


def _named(rendered: DataFrame, kind: str) -> DataFrame:
    return rendered.select(F.col("doc_id").alias("path"), "part", "markdown", F.lit(kind).alias("file_type"))
