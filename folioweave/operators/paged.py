"""Paged documents: rows are (doc_id, page_number from 1, text).

A document may hold any number of pages. Everything that needs order within a
document works on blocks of pages; assembled Markdown comes in parts of at most
`pages_per_part` pages, one part for ordinary documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions import has_text, stripped_length, word_count
from folioweave.operators.grouping import block_of, running_number, with_group_stats

PAGES_PER_PART = 4096
PAGES_PER_BLOCK = 256


def nonblank_parts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(has_text(text))


def page_meta(pages: DataFrame, images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Per page: word, image and table counts and the three `has_` flags."""
    key = ["doc_id", "page_number"]
    out = pages.select(*key, word_count("text").alias("word_count"), has_text("text").alias("has_text"))
    for child, n, flag in ((images, "image_count", "has_images"), (tables, "table_count", "has_tables")):
        if child is None:
            out = out.withColumn(n, F.lit(0).cast("bigint"))
        else:
            counts = child.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
            out = out.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("bigint")))
        out = out.withColumn(flag, F.col(n) > 0)
    return out


def doc_rollup(meta: DataFrame) -> DataFrame:
    return meta.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("word_count").alias("total_words"),
        F.sum("image_count").alias("total_images"),
        F.sum("table_count").alias("total_tables"),
    )


def corpus_info(meta: DataFrame, doc_sizes: DataFrame) -> DataFrame:
    """Per document: size, totals, text layer and the advice that follows from it.

    doc_sizes: (doc_id, size_bytes), one row per document.
    """
    per_doc = meta.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("image_count").alias("images"),
        F.sum("table_count").alias("tables"), F.bool_or("has_text").alias("_text"),
    )
    return per_doc.join(doc_sizes, "doc_id", "left").select(
        "doc_id", F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("size_mb"), "pages", "images", "tables",
        F.when(F.col("_text"), F.lit("Yes")).otherwise(F.lit("No (Scanned)")).alias("text_layer"),
        F.when(~F.col("_text"), F.lit(rules.MSG_SCANNED_HINT)).alias("recommendation"),
    )


def first_pages(pages: DataFrame, n: int = rules.SCAN_PAGES) -> DataFrame:
    """The first n pages of each document.

    The rank filter is pushed below the shuffle, so at most n rows per document
    leave any task, however long the document is.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number")
    return pages.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def is_scanned_avg(pages: DataFrame, limit: int = rules.SCAN_MEAN_CHARS) -> DataFrame:
    """Scanned when the mean stripped length of the first pages is under the limit."""
    short = pages.select("doc_id", "page_number", stripped_length("text").alias("_len"))
    return first_pages(short).groupBy("doc_id").agg((F.avg(F.coalesce("_len", F.lit(0))) < limit).alias("scanned"))


def is_scanned_any(pages: DataFrame) -> DataFrame:
    """Scanned when none of the first pages has any text."""
    short = pages.select("doc_id", "page_number", has_text("text").alias("_text"))
    return first_pages(short).groupBy("doc_id").agg((~F.bool_or("_text")).alias("scanned"))


def page_breaks(pages: DataFrame, marker: str = rules.PAGE_BREAK) -> DataFrame:
    """Adds break_after: the marker on every page but the document's last."""
    out = with_group_stats(pages, ["doc_id"], block_of("page_number"), {"_last": (F.max, F.col("page_number"))})
    return out.withColumn("break_after", F.when(F.col("page_number") < F.col("_last"), F.lit(marker))).drop("_last")


def image_index(images: DataFrame) -> DataFrame:
    """Running image number over the pages of a document, and its alt text."""
    out = running_number(images, ["doc_id"], ["page_number", "pos"], [block_of("page_number", PAGES_PER_BLOCK)],
                         "image_index")
    return out.withColumn("alt_text", F.concat(
        F.lit("Image "), (F.col("image_index") + 1).cast("string"),
        F.lit(" from page "), F.col("page_number").cast("string")))


def table_index(tables: DataFrame) -> DataFrame:
    """Running table number over the pages of a document."""
    return running_number(tables, ["doc_id"], ["page_number", "pos"], [block_of("page_number", PAGES_PER_BLOCK)],
                          "table_index")


def assemble_pages(
    pages: DataFrame, markers: bool = True, breaks: bool = False, marker: str = rules.PAGE_BREAK,
    pages_per_part: int = PAGES_PER_PART,
) -> DataFrame:
    """(doc_id, part, markdown): non-blank page texts in order, joined by blank lines.

    `markers` puts `<!-- Page n -->` before each page, `breaks` puts `marker` after
    each page but the last. Parts of a document, joined by a blank line, are the whole.
    """
    part = F.floor((F.col("page_number") - 1) / pages_per_part).cast("bigint").alias("part")
    cols = ["doc_id", "page_number", "text"]
    rows = pages.select(*cols)
    if breaks:
        rows = page_breaks(rows, marker)
    else:
        rows = rows.withColumn("break_after", F.lit(None).cast("string"))
    number = F.col("page_number").cast("string")
    head = F.concat(F.lit("<!-- Page "), number, F.lit(" -->")) if markers else F.lit(None).cast("string")
    piece = F.concat_ws("\n\n", head, F.col("text"), F.col("break_after"))
    kept = rows.where(has_text("text")).select("doc_id", part, F.struct("page_number", piece.alias("p")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "\n\n")
    return kept.groupBy("doc_id", "part").agg(joined.alias("markdown"))


def paginate(df: DataFrame, key: str, order: str, per_page: int = rules.GALLERY_PAGE) -> DataFrame:
    """Adds gallery page number (from 0) and the number of gallery pages per document."""
    out = running_number(df, [key], [order], [block_of(order)], "_n", total="_total")
    return (
        out.withColumn("gallery_page", F.floor(F.col("_n") / per_page).cast("bigint"))
        .withColumn("gallery_pages", F.ceil(F.col("_total") / per_page).cast("bigint"))
        .drop("_n", "_total")
    )


def gallery_slice(df: DataFrame, order: list[str], page: int, per_page: int = rules.GALLERY_PAGE) -> DataFrame:
    """One page of the whole gallery; runs as a top-k, not as a full sort."""
    return df.orderBy(*order).offset(page * per_page).limit(per_page)
