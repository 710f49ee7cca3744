"""The page job: markup corpus to result rows in one plan with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions import quality_warnings, word_count
from folioweave.operators.markup import _noise_free, markdown_of, page_facts
from folioweave.options import Options


def pages_to_results(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """Result row per page: metadata, counts, Markdown and quality warnings.

    Everything read off the page itself is computed before the shuffle and
    carried along; only nesting-dependent work happens behind it.
    """
    opts = options or Options()
    zero = F.lit(0)

    def occurrences(pattern: str) -> Column:
        return F.coalesce(F.regexp_count("_h", F.lit(pattern)), zero).cast("bigint")

    ready = page_facts(_noise_free(pages, opts.html_base_url)).select(
        "*",
        F.greatest(F.lit(1), occurrences(rf"(?i)<(?:{'|'.join(rules.SECTION_TAGS)})(?=[\s>])")).alias("page_count"),
        occurrences(r"(?i)<a(?=[\s>])").alias("total_links"),
        (occurrences(r"(?i)<img\b") if opts.extract_images else zero.cast("bigint")).alias("total_images"),
        (occurrences(r"(?i)<table(?=[\s>])") if opts.extract_tables else zero.cast("bigint")).alias("total_tables"),
    )
    facts = ["url", "title", "author", "subject", "page_count", "total_links", "total_images", "total_tables"]
    out = markdown_of(ready, facts, opts.image_mode).withColumn("total_words", word_count("markdown"))
    none = F.array().cast("array<string>")
    warnings = quality_warnings("total_words", "page_count", F.lit(0)) if opts.validate_output else none
    return out.select(F.col("page_id").alias("doc_id"), *facts, "total_words", "markdown", warnings.alias("warnings"))
