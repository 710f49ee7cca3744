"""Report, estimate and decision expressions over document metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions.text import _col


def preview(t, n: int = rules.PREVIEW_CHARS) -> Column:
    v = _col(t)
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n), F.lit("..."))).otherwise(v)


def size_mb(n) -> Column:
    return F.round(_col(n) / F.lit(1048576.0), 2)


def or_na(x) -> Column:
    v = _col(x).cast("string")
    return F.when(v.isNull() | (v == ""), F.lit("N/A")).otherwise(v)


def docx_pages(n) -> Column:
    return F.greatest(F.lit(1), F.floor(_col(n) / rules.PARAGRAPHS_PER_PAGE)).cast("bigint")


def estimate_seconds(ext, size_bytes, pages=None, rule: str = "by_extension") -> Column:
    """Expected seconds for one document.

    `rule`: by_extension | any_document | text_pages | ocr_pages. The page rules use
    `pages` and fall back to a flat figure where it is null.
    """
    if rule in ("text_pages", "ocr_pages"):
        per_page, flat = rules.COST_PER_PAGE[rule.split("_")[0]]
        return F.coalesce(_col(pages) * F.lit(per_page), F.lit(flat))
    mb = _col(size_bytes) / F.lit(1048576.0)

    def cost(floor: float, rate: float) -> Column:
        return F.greatest(F.lit(floor), mb * F.lit(rate))

    if rule == "any_document":
        return cost(*rules.COST_ANY_DOCUMENT)
    if rule != "by_extension":
        raise ValueError(f"unknown cost rule {rule!r}")
    out = None
    for exts, floor, rate in rules.COST_RULES:
        hit = F.lower(_col(ext)).isin(exts)
        out = F.when(hit, cost(floor, rate)) if out is None else out.when(hit, cost(floor, rate))
    return out.otherwise(cost(*rules.COST_DEFAULT))


def summary_text(name, pages, words, images, tables, seconds, strategy, warnings, errors) -> Column:
    """The summary block; warning and error lines only when there are any."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {label}: "), value.cast("string"))

    def counted(label: str, items) -> Column:
        n = F.size(_col(items))
        return F.when(n > 0, line(label, n))

    # format_number rounds ties to even on the exact value, as printf does
    secs = F.concat(F.replace(F.format_number(_col(seconds), 2), F.lit(","), F.lit("")), F.lit("s"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("✓ Converted: "), _col(name)),
        line("Pages", _col(pages)),
        line("Words", F.format_number(_col(words), 0)),
        line("Images", _col(images)),
        line("Tables", _col(tables)),
        line("Time", secs),
        line("Strategy", _col(strategy)),
        counted("⚠ Warnings", warnings),
        counted("✗ Errors", errors),
    )


def quality_warnings(words, pages, n_errors) -> Column:
    """array<string> of quality notes; empty when all is well."""
    notes = F.array(
        F.when((_col(words) < rules.FEW_WORDS) & (_col(pages) > 1), F.lit(rules.MSG_LITTLE_TEXT)),
        F.when(
            _col(n_errors) > 0,
            F.concat(F.lit("Conversion completed with "), _col(n_errors).cast("string"), F.lit(" errors")),
        ),
    )
    return F.filter(notes, lambda x: x.isNotNull())


def pick_strategy(file_type, strategy, scanned, has_ocr: bool) -> Column:
    """`auto` becomes ocr for scanned PDFs where OCR exists, else fast."""
    auto = F.when(
        (_col(file_type) == "pdf") & F.coalesce(_col(scanned), F.lit(False)) & F.lit(has_ocr), F.lit("ocr")
    ).otherwise(F.lit("fast"))
    return F.when(_col(strategy) == "auto", auto).otherwise(_col(strategy))
