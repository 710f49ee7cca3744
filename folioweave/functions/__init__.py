"""Column expressions; all of them stay on the JVM side."""

from folioweave.functions.assets import image_dims, image_name, parse_data_uri, to_data_uri
from folioweave.functions.display import (
    docx_pages, estimate_seconds, or_na, pick_strategy, preview, quality_warnings, size_mb,
    summary_text,
)
from folioweave.functions.hashing import cache_key, config_hash, content_hash
from folioweave.functions.text import (
    approx_words, cell_text, decode_text, escape_cell, has_text, html_unescape, pad_row,
    pdf_date, squeeze, strip, stripped_length, tidy_markdown, word_count,
)
from folioweave.functions.urls import resolve_url

__all__ = [
    "approx_words", "cache_key", "cell_text", "config_hash", "content_hash", "decode_text",
    "docx_pages", "escape_cell", "estimate_seconds", "has_text", "html_unescape", "image_dims",
    "image_name", "or_na", "pad_row", "parse_data_uri", "pdf_date", "pick_strategy", "preview",
    "quality_warnings", "resolve_url", "size_mb", "squeeze", "strip", "stripped_length",
    "summary_text", "tidy_markdown", "to_data_uri", "word_count",
]
