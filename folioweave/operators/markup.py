"""Markup jobs: pages (page_id, url, html) to tokens, links, images, cells, Markdown.

Two kinds of operator live here. Facts that one regular expression can see
(title, links, images, headings, visible text) are projections: no shuffle at
all. What depends on nesting (lists, tables, sections, Markdown) works on the
token table: the pages are hash-partitioned by page_id once, before they are
blown up into tokens, and all windows and the final aggregate reuse that
partitioning. A page is one input row, so a group of tokens is never larger
than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions import (
    html_unescape, image_dims, image_name, parse_data_uri, resolve_url, squeeze, strip,
    tidy_markdown, to_data_uri,
)
from folioweave.functions.text import WS, _col

# The rest of a tag: a quoted value after an equals sign may hold `>`.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
_TAG = rf"</?[A-Za-z!?]{_ATTRS}>"
_INLINE_TAGS = (
    "a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var"
)


# ---------------------------------------------------------------- expressions


def drop_noise(html) -> Column:
    """Markup without script and style elements and comments; an unclosed one runs to the end."""
    h = F.regexp_replace(_col(html), rf"(?is)<script\b{_ATTRS}>.*?(?:</script\s*>|\z)", "")
    h = F.regexp_replace(h, rf"(?is)<style\b{_ATTRS}>.*?(?:</style\s*>|\z)", "")
    return F.regexp_replace(h, r"(?s)<!--.*?(?:-->|\z)", "")


def raw_attribute(tag, name: str) -> Column:
    """Value of an attribute as written, '' when absent."""
    value = F.regexp_extract(
        _col(tag), rf"""(?is)(?:^|[\s"']){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def has_attribute(tag, name: str) -> Column:
    return _col(tag).rlike(rf"""(?is)(?:^|[\s"']){name}\s*=\s*(?:"|'|[^\s"'>])""")


def attribute(tag, name: str) -> Column:
    """Unescaped value of an attribute in tag text, null when absent."""
    return F.when(has_attribute(tag, name), html_unescape(raw_attribute(tag, name)))


def _markup_to_words(html: Column) -> Column:
    """Noise-free markup with the head dropped and tags taken out; still escaped."""
    h = F.regexp_replace(html, rf"(?is)<head\b{_ATTRS}>.*?</head\s*>", " ")
    h = F.regexp_replace(h, rf"(?i)</?(?:{_INLINE_TAGS})(?=[\s/>]){_ATTRS}>", "")
    return F.regexp_replace(h, _TAG, " ")


def _inner_text(markup: Column) -> Column:
    return squeeze(html_unescape(F.regexp_replace(markup, _TAG, "")))


def _first_meta(metas: Column, name: str) -> Column:
    return F.get(F.filter(metas, lambda m: m.rlike(rf"""(?i)[\s"']name\s*=\s*["']?{name}(?:["'\s/>])""")), 0)


def with_base(pages: DataFrame, html: str, configured: str | None = None) -> DataFrame:
    """Adds base: configured, else `<base href>`, else the page's own address."""
    if configured is not None:
        return pages.withColumn("base", F.lit(configured))
    tagged = pages.withColumn("_base_tag", F.regexp_extract(html, rf"(?i)<base\s{_ATTRS}>", 0))
    return tagged.withColumn("base", F.when(F.col("_base_tag") == "", F.col("url")).otherwise(
        F.coalesce(attribute("_base_tag", "href"), F.col("url")))).drop("_base_tag")


# ---------------------------------------------------------------- map-side operators


def strip_noise(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", drop_noise("html"))


def html_metadata(pages: DataFrame) -> DataFrame:
    """title (else the first h1), author, subject per page."""
    facts = page_facts(pages.select("page_id", drop_noise("html").alias("_h")))
    return facts.select("page_id", "title", "author", "subject")


def page_facts(pages: DataFrame) -> DataFrame:
    """Adds title, author and subject read from `_h`, the noise-free markup."""
    title = F.regexp_extract("_h", rf"(?is)<title{_ATTRS}>(.*?)</title", 1)
    heading = F.regexp_extract("_h", rf"(?is)<h1(?=[\s>]){_ATTRS}>(.*?)</h1", 1)
    metas = F.regexp_extract_all("_h", F.lit(rf"(?i)<meta\s{_ATTRS}>"), F.lit(0))
    blank = F.lit("")
    # each pass over the page is made once and referred to by name afterwards
    return (
        pages.withColumns({"_title": title, "_metas": metas})
        .withColumns({
            "_title": strip(html_unescape("_title")),
            "_author": _first_meta(F.col("_metas"), "author"), "_about": _first_meta(F.col("_metas"), "description"),
        })
        .withColumns({
            "_heading": F.when(F.col("_title") == "", heading),
            "author": attribute("_author", "content"), "subject": attribute("_about", "content"),
        })
        .withColumn("title", F.coalesce(F.nullif("_title", blank), F.nullif(_inner_text(F.col("_heading")), blank)))
        .drop("_title", "_heading", "_metas", "_author", "_about")
    )


def base_url(pages: DataFrame, configured: str | None = None) -> DataFrame:
    return with_base(pages, "html", configured).select("page_id", F.col("base").alias("base_url"))


def _noise_free(pages: DataFrame, configured: str | None = None) -> DataFrame:
    """(page_id, url, base, _h) with script, style and comments gone."""
    return with_base(pages.select("page_id", "url", drop_noise("html").alias("_h")), "_h", configured)


def extract_links(pages: DataFrame, configured: str | None = None) -> DataFrame:
    """One row per anchor: link_index, href as written, href resolved, text."""
    pieces = _noise_free(pages, configured).select("page_id", "base", F.split("_h", r"(?i)<a(?=[\s>])").alias("ps"))
    anchors = F.slice("ps", F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0)))
    out = pieces.select("page_id", "base", F.posexplode(anchors).alias("link_index", "piece"))
    # step by step, so that each value is computed once and then referred to
    out = out.select(
        "page_id", "link_index", "base",
        F.regexp_extract("piece", rf"(?s)^({_ATTRS})", 1).alias("attrs"),
        F.regexp_replace(F.regexp_extract("piece", rf"(?is)^{_ATTRS}>(.*?)(?:</a\s*>|\z)", 1), _TAG, "").alias("inner"))
    out = out.withColumns({
        "href": F.when(has_attribute("attrs", "href"), raw_attribute("attrs", "href")),
        "text": squeeze(html_unescape("inner"))})
    out = out.withColumn("href_raw", html_unescape("href"))
    return out.select(
        "page_id", F.col("link_index").cast("bigint").alias("link_index"), "href_raw",
        resolve_url("base", "href_raw").alias("href_resolved"), "text")


def extract_images(pages: DataFrame, configured: str | None = None) -> DataFrame:
    """One row per image element with a source: kind external, data or local.

    Data URIs are decoded here; external ones stay addresses; local ones get
    their bytes from `resolve_local_images`.
    """
    tags = F.regexp_extract_all("_h", F.lit(rf"(?i)<img\b{_ATTRS}>"), F.lit(0))
    out = _noise_free(pages, configured).select("page_id", "base", F.posexplode(tags).alias("n", "tag"))
    out = out.select("page_id", F.col("n").cast("bigint").alias("image_index"), "base",
                     attribute("tag", "src").alias("src"),
                     F.coalesce(attribute("tag", "alt"), F.lit("")).alias("alt_text"))
    out = out.where(F.col("src").isNotNull())
    data = F.col("src").startswith("data:")
    full = F.when(data, F.col("src")).otherwise(resolve_url("base", "src"))
    out = out.withColumn("src", full).withColumn("bytes", parse_data_uri("src")["bytes"])
    kind = F.when(data, F.lit("data")).when(F.col("src").rlike("^https?://"), F.lit("external")).otherwise(F.lit("local"))
    return _describe(out.withColumn("kind", kind)).drop("base")


def _describe(images: DataFrame) -> DataFrame:
    dims = image_dims("bytes")
    known = F.col("bytes").isNotNull()
    name = F.when(F.col("kind") == "external", F.concat(F.lit("external_image_"), F.col("image_index").cast("string")))
    name = name.when(F.col("kind") == "data", F.concat(F.lit("image_"), F.col("image_index").cast("string")))
    return (
        images.withColumn("name", name.otherwise(image_name("src", "image_index")))
        .withColumn("original_url", F.when(F.col("kind") == "external", F.col("src")))
        .withColumn("format", F.when(known, dims["format"]).when(F.col("kind") == "external", F.lit("url"))
                    .otherwise(F.lit("unknown")))
        .withColumn("width", F.when(known, dims["width"]).otherwise(0))
        .withColumn("height", F.when(known, dims["height"]).otherwise(0))
        .withColumn("size_bytes", F.coalesce(F.length("bytes"), F.lit(0)).cast("bigint"))
    )


def resolve_local_images(images: DataFrame, corpus: DataFrame) -> DataFrame:
    """Bytes of local images by joining their address with corpus (path, content)."""
    found = corpus.select(F.col("path").alias("src"), F.col("content").alias("_content"))
    out = images.join(found, "src", "left").withColumn("bytes", F.coalesce("bytes", "_content")).drop("_content")
    return _describe(out).select(*images.columns)


def apply_image_mode(images: DataFrame, mode: str, folder: str = "images") -> DataFrame:
    """Adds md_src: what Markdown points at; null means the image leaves the text."""
    if mode not in rules.IMAGE_MODES:
        raise ValueError(f"image mode must be one of {rules.IMAGE_MODES}")
    own = {
        "embed": F.when(F.col("bytes").isNotNull(), to_data_uri("format", "bytes")).otherwise(F.col("src")),
        "link": F.concat(F.lit(folder + "/"), F.col("name")),
        "separate": F.lit(None).cast("string"),
    }[mode]
    return images.withColumn("md_src", F.when(F.col("kind") == "external", F.col("src")).otherwise(own))


def html_to_text(pages: DataFrame) -> DataFrame:
    """Text a reader sees: head dropped, inline tags vanish, other tags separate words."""
    words = pages.select("page_id", _markup_to_words(drop_noise("html")).alias("_w"))
    return words.select("page_id", squeeze(html_unescape("_w")).alias("text"))


def outline(pages: DataFrame) -> DataFrame:
    """Headings in order, with their level."""
    found = F.regexp_extract_all(
        drop_noise("html"), F.lit(rf"(?is)<h[1-6](?=[\s>]){_ATTRS}>.*?</h[1-6]\s*>"), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("heading_no", "h")).select(
        "page_id", F.col("heading_no").cast("bigint").alias("heading_no"),
        F.substring("h", 3, 1).cast("int").alias("level"), _inner_text(F.col("h")).alias("text"))


# ---------------------------------------------------------------- tokens


def token_texts(html) -> Column:
    """Array of token texts; joined they are the input again."""
    return F.regexp_extract_all(_col(html), F.lit(_TAG + "|[^<]+|<"), F.lit(0))


def _classified(raw: DataFrame) -> DataFrame:
    tag = F.lower(F.regexp_extract("raw", r"(?s)^</?([A-Za-z!?][A-Za-z0-9:\-]*).*>$", 1))
    kind = (
        F.when(F.col("tag") == "", F.lit("text"))
        .when(F.col("raw").startswith("</"), F.lit("close"))
        .when(F.col("tag").isin(rules.VOID_TAGS) | F.col("raw").endswith("/>") | F.col("tag").rlike("^[!?]"),
              F.lit("void"))
        .otherwise(F.lit("open"))
    )
    return raw.withColumn("tag", tag).withColumn("kind", kind)


def tokenize_html(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """tokens (page_id, pos, kind, tag, raw) of noise-free markup.

    `clustered` partitions the pages by page_id first, for jobs whose windows
    would otherwise shuffle the (larger) token table.
    """
    src = pages.select("page_id", "html")
    src = src.repartition("page_id") if clustered else src
    raw = src.select("page_id", F.posexplode(token_texts(drop_noise("html"))).alias("pos", "raw"))
    return _classified(raw).select("page_id", "pos", "kind", "tag", "raw")


def _delta(tags: list[str]) -> Column:
    hit = F.col("tag").isin(tags)
    return F.when(hit & (F.col("kind") == "open"), 1).when(hit & (F.col("kind") == "close"), -1).otherwise(0)


def _opens(tags: list[str]) -> Column:
    return F.col("tag").isin(tags) & (F.col("kind") == "open")


def _doc():
    return Window.partitionBy("page_id").orderBy("pos")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def nesting_depth(tokens: DataFrame) -> DataFrame:
    """Adds list depth, table depth and the number of tables opened so far."""
    return tokens.select(
        "*",
        F.sum(_delta(["ul", "ol"])).over(_so_far()).alias("ul_depth"),
        F.sum(_delta(["table"])).over(_so_far()).alias("table_depth"),
        F.sum(_opens(["table"]).cast("int")).over(_so_far()).alias("table_no"),
    )


def section_count(tokens: DataFrame) -> DataFrame:
    """Sections and articles per page, at least 1."""
    return tokens.groupBy("page_id").agg(
        F.greatest(F.lit(1), F.count_if(_opens(rules.SECTION_TAGS))).cast("bigint").alias("page_count"))


def semantic_sections(tokens: DataFrame) -> DataFrame:
    """(page_id, section_no, tag, text); text belongs to the innermost section around it."""
    tags = rules.SEMANTIC_TAGS
    out = tokens.select(
        "page_id", "pos", "kind", "tag", "raw",
        F.sum(_delta(tags)).over(_so_far()).alias("_depth"),
        F.sum(_opens(tags).cast("int")).over(_so_far()).alias("_seq"))
    level = Window.partitionBy("page_id", "_depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(_opens(tags), F.struct("_seq", "tag"))
    out = out.withColumn("_sec", F.last(opened, ignorenulls=True).over(level))
    out = out.where((F.col("_depth") > 0) & F.col("_sec").isNotNull())
    inline = F.col("tag").isin(_INLINE_TAGS.split("|"))
    piece = F.when(F.col("kind") == "text", F.col("raw")).when(inline, F.lit("")).otherwise(F.lit(" "))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda s: s["p"]), "")
    return out.groupBy("page_id", F.col("_sec._seq").cast("bigint").alias("section_no"), F.col("_sec.tag").alias("tag")).agg(
        squeeze(html_unescape(joined)).alias("text"))


def _located(tokens: DataFrame) -> DataFrame:
    """Tokens inside tables with the table (also nested ones), row and cell they belong to."""
    out = tokens.select(
        "page_id", "pos", "kind", "tag", "raw",
        F.sum(_delta(["table"])).over(_so_far()).alias("_depth"),
        F.sum(_opens(["table"]).cast("int")).over(_so_far()).alias("_seq"))
    level = Window.partitionBy("page_id", "_depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_table", F.last(F.when(_opens(["table"]), F.col("_seq")), ignorenulls=True).over(level))
    out = out.where((F.col("_depth") > 0) & F.col("_table").isNotNull())
    within = Window.partitionBy("page_id", "_table").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cell_edge = F.col("tag").isin("td", "th", "tr")
    state = F.when(cell_edge, F.when(_opens(["td", "th"]), F.col("tag")).otherwise(F.lit("")))
    out = out.select(
        "*",
        (F.sum(_opens(["tr"]).cast("int")).over(within) - 1).alias("_row"),
        F.last(state, ignorenulls=True).over(within).alias("_cell"),
        (F.sum(_delta(["thead"])).over(within) > 0).alias("_thead"),
        (F.sum(_delta(["caption"])).over(within) > 0).alias("_caption"))
    in_row = Window.partitionBy("page_id", "_table", "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("_col", F.sum(_opens(["td", "th"]).cast("int")).over(in_row) - 1)


def _joined_text() -> Column:
    inline = F.col("tag").isin(_INLINE_TAGS.split("|"))
    piece = F.when(F.col("kind") == "text", F.col("raw")).when(inline, F.lit("")).otherwise(F.lit(" "))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("p"))))
    return squeeze(html_unescape(F.array_join(F.transform(ordered, lambda s: s["p"]), "")))


def extract_html_tables(tokens: DataFrame) -> DataFrame:
    """cells (doc_id, table_index, row_index, col_index, text, is_header) of all tables."""
    inside = _located(tokens).where((F.col("_cell") != "") & (F.col("_row") >= 0) & (F.col("_col") >= 0))
    header = (F.col("_cell") == "th") | F.col("_thead")
    return inside.groupBy(
        F.col("page_id").alias("doc_id"), (F.col("_table") - 1).cast("bigint").alias("table_index"),
        F.col("_row").cast("bigint").alias("row_index"), F.col("_col").cast("bigint").alias("col_index"),
    ).agg(_joined_text().alias("text"), F.bool_or(header).alias("is_header"))


def table_captions(tokens: DataFrame) -> DataFrame:
    inside = _located(tokens).where(F.col("_caption"))
    return inside.groupBy(
        F.col("page_id").alias("doc_id"), (F.col("_table") - 1).cast("bigint").alias("table_index"),
    ).agg(_joined_text().alias("caption"))


# ---------------------------------------------------------------- Markdown


def _sum_gt0(tags: list[str]) -> Column:
    return F.sum(_delta(tags)).over(_so_far()) > 0


def html_to_markdown(pages: DataFrame, configured: str | None = None, image_mode: str = "link") -> DataFrame:
    """(page_id, markdown) of pages (page_id, url, html)."""
    return markdown_of(_noise_free(pages, configured), [], image_mode)


def markdown_of(pages: DataFrame, carry: list[str], image_mode: str = "link") -> DataFrame:
    """(page_id, markdown, *carry) of pages (page_id, base, _h, *carry).

    One shuffle, of the pages by page_id, after script, style and comments are gone.
    `carry` columns travel on one extra token per page, so they need no join back.

    Inline markers appear only when open and close stand in the same block;
    an unclosed `<b>` loses its marker, never its text.
    """
    src = pages.select("page_id", "base", F.struct(F.lit(1).alias("_one"), *carry).alias("page"),
                       F.coalesce("_h", F.lit("")).alias("_h")).repartition("page_id")
    src = src.select("page_id", "base", "page", F.concat(F.array(F.lit("")), token_texts("_h")).alias("ts"))
    toks = src.select("page_id", "base", "page", F.posexplode("ts").alias("pos", "raw"))
    toks = toks.withColumn("page", F.when(F.col("pos") == 0, F.col("page")))
    toks = _classified(toks)
    is_a, is_img = F.col("tag") == "a", F.col("tag") == "img"
    toks = toks.withColumn("ref", F.when(is_a & has_attribute("raw", "href"), raw_attribute("raw", "href"))
                           .when(is_img & has_attribute("raw", "src"), raw_attribute("raw", "src")))
    toks = toks.withColumns({"ref": html_unescape("ref"), "alt": F.when(is_img, html_unescape(raw_attribute("raw", "alt")))})
    toks = toks.withColumn("target", F.when(F.col("ref").startswith("data:"), F.col("ref")).when(
        F.col("ref").isNotNull(), resolve_url("base", "ref")))
    toks = toks.withColumn("body", F.when(F.col("kind") == "text", html_unescape("raw"))).drop("raw", "ref", "base")
    toks = toks.withColumn("words", F.regexp_replace(F.regexp_replace("body", f"{WS}+", " "), r"([*_])", r"\\$1"))

    marker = F.when(F.col("tag") == "a", F.lit("a"))
    for tag, mark in rules.EMPHASIS.items():
        marker = marker.when(F.col("tag") == tag, F.lit(mark))
    toks = toks.withColumn("is_block", F.col("tag").isin(rules.BLOCK_TAGS)).withColumn("marker", marker)
    toks = toks.withColumn("blank", (F.col("kind") == "text") & (F.trim("words") == ""))
    block, blank = F.col("is_block"), F.col("blank")
    at_li = _opens(["li"])
    toks = toks.select(
        "*",
        F.sum(_delta(["blockquote"])).over(_so_far()).alias("quotes"),
        # what stands before and after, blank text aside
        F.coalesce(F.when(F.lag(blank).over(_doc()), F.lag(at_li, 2).over(_doc())).otherwise(F.lag(at_li).over(_doc())),
                   F.lit(False)).alias("after_li"),
        F.coalesce(F.when(F.lead(blank).over(_doc()), F.lead(block, 2).over(_doc())).otherwise(F.lead(block).over(_doc())),
                   F.lit(True)).alias("before_block"),
        _sum_gt0(["head", "title"]).alias("in_head"),
        _sum_gt0(["pre"]).alias("in_pre"),
        F.sum(_delta(["ul", "ol"])).over(_so_far()).alias("depth"),
        F.sum(_delta(["table"])).over(_so_far()).alias("tdepth"),
        F.sum(block.cast("int")).over(_so_far()).alias("seg"),
        F.coalesce(F.lag(block).over(_doc()), F.lit(True)).alias("prev_block"),
        F.coalesce(F.lead(block).over(_doc()), F.lit(True)).alias("next_block"),
        (F.sum((F.col("tag") == "img").cast("int")).over(_so_far()) - 1).alias("img_no"),
    )
    outer = F.col("tdepth") == 1
    toks = toks.withColumn("row_seq", F.sum((_opens(["tr"]) & outer).cast("int")).over(_so_far()))
    toks = toks.withColumn("rows_before", F.coalesce(
        F.last(F.when(_opens(["table"]) & outer, F.col("row_seq")), ignorenulls=True).over(_so_far()), F.lit(0)))
    in_row = (F.col("tdepth") >= 1) & (F.col("row_seq") > F.col("rows_before"))

    # cells and header cells of the row so far: running totals less their value at the row's start
    toks = toks.withColumn("cell_open", _opens(["td", "th"]) & in_row & outer)
    toks = toks.withColumns({
        "cells": F.sum(F.col("cell_open").cast("int")).over(_so_far()),
        "heads": F.sum((F.col("cell_open") & (F.col("tag") == "th")).cast("int")).over(_so_far())})
    row_start = F.last(F.when(_opens(["tr"]) & outer, F.struct("cells", "heads")), ignorenulls=True).over(_so_far())
    toks = toks.withColumn("_row", row_start).withColumns({
        "cell_no": F.col("cells") - F.coalesce(F.col("_row.cells"), F.lit(0)),
        "row_th": F.col("heads") > F.coalesce(F.col("_row.heads"), F.lit(0))}).drop("cells", "heads", "_row")

    # marker pairing inside a block, item numbers inside a list: the two that need an order of their own
    pair = Window.partitionBy("page_id", "seg", "marker").orderBy("pos")
    level = Window.partitionBy("page_id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    new_list = F.when(_opens(["ul", "ol"]), F.struct("pos", "tag"))
    items = F.sum(_opens(["li"]).cast("int")).over(level)
    toks = toks.select(
        "*",
        F.lead("kind").over(pair).alias("pair_next"), F.lag("kind").over(pair).alias("pair_prev"),
        F.lag("target").over(pair).alias("pair_target"),
    )
    toks = toks.select(
        "*", F.last(new_list, ignorenulls=True).over(level)["tag"].alias("list_tag"), items.alias("level_items"))
    toks = toks.withColumn("item_no", F.col("level_items") - F.last(
        F.when(_opens(["ul", "ol"]), F.col("level_items")), ignorenulls=True).over(level))

    kind, tag = F.col("kind"), F.col("tag")
    is_open, is_close = kind == "open", kind == "close"
    empty, para = F.lit(""), F.lit("\n\n")
    quoted = F.concat(para, F.repeat(F.lit("> "), F.greatest("quotes", F.lit(0)).cast("int")))
    below = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.col("depth").cast("int")))  # a further block of a list item
    matched = F.coalesce(
        F.when(is_open, F.col("pair_next") == "close").when(is_close, F.col("pair_prev") == "open"), F.lit(False))
    target = F.when(is_close, F.col("pair_target")).otherwise(F.col("target"))
    in_pre, row_open = F.col("in_pre"), F.col("cell_no") > 0

    # trimming by '' trims nothing: each choice is an argument, not a second copy of the text
    words = F.replace("words", F.lit("|"), F.when(in_row, F.lit("\\|")).otherwise(F.lit("|")))
    words = F.ltrim(words, F.when(F.col("prev_block"), F.lit(" ")).otherwise(empty))
    words = F.rtrim(words, F.when(F.col("next_block"), F.lit(" ")).otherwise(empty))
    item = F.when(F.col("list_tag") == "ol", F.concat(F.col("item_no").cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    indent = F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0)).cast("int"))
    header = F.col("row_th") & (F.col("row_seq") == F.col("rows_before") + 1)
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("cell_no").cast("int")))
    row_end = F.concat(F.lit(" |"), F.when(header, rule).otherwise(empty))
    image = F.concat(F.lit("!["), F.col("alt"), F.lit("]("), _image_target(image_mode), F.lit(")"))

    out = (
        F.when(F.col("in_head") | tag.isin("head", "title"), empty)
        .when((kind == "text") & in_pre, F.col("body"))
        .when(kind == "text", words)
        .when(in_pre & (tag != "pre"), F.when(tag == "br", F.lit("\n")).otherwise(empty))
        .when(tag == "pre", F.when(is_open, F.lit("\n\n```\n")).otherwise(F.lit("\n```\n\n")))
        .when((tag == "table") & (F.col("tdepth") == F.when(is_open, 1).otherwise(0)), para)
        .when((tag == "tr") & outer & is_open, F.lit("\n"))
        .when((tag == "tr") & outer & is_close & row_open, row_end)
        .when(F.col("cell_open"), F.when(F.col("cell_no") == 1, F.lit("| ")).otherwise(F.lit(" | ")))
        .when((F.col("tdepth") > 0) & block & (tag != "caption"), F.when(
            row_open & ~tag.isin("tr", "thead", "tbody", "tfoot") & ~(outer & tag.isin("td", "th")), F.lit(" "),
        ).otherwise(empty))
        .when(tag.isin(rules.HEADING_TAGS) & is_open,
              F.concat(quoted, F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" ")))
        .when(tag.isin("ul", "ol"), F.when(
            (is_open & (F.col("depth") <= 1)) | (is_close & (F.col("depth") <= 0)), para).otherwise(empty))
        .when(tag == "li", F.when(is_open, F.concat(F.lit("\n"), indent, item)).otherwise(empty))
        .when(tag == "br", F.lit("  \n"))
        .when(tag == "hr", F.lit("\n\n---\n\n"))
        .when((tag == "blockquote") & is_open, F.when(F.col("before_block"), empty).otherwise(quoted))
        .when(tag == "img", F.coalesce(image, empty))
        .when(tag == "a", F.when(~matched | target.isNull(), empty).when(is_open, F.lit("[")).otherwise(
            F.concat(F.lit("]("), target, F.lit(")"))))
        .when(F.col("marker").isNotNull(), F.when(matched, F.col("marker")).otherwise(empty))
        .when(block & (F.col("depth") <= 0), F.when(is_open, quoted).otherwise(para))
        .when(block & is_open & ~F.col("after_li"), below)
        .when(block & is_close & ~F.col("before_block"), below)
        .otherwise(empty)
    )
    pieces = toks.select("page_id", "pos", "page", out.alias("p")).where((F.col("p") != "") | (F.col("pos") == 0))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "p")))
    return pieces.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["p"]), "").alias("_md"),
        F.first("page", ignorenulls=True).alias("_page"),
    ).select("page_id", tidy_markdown("_md").alias("markdown"), *[F.col("_page")[n].alias(n) for n in carry])


def _image_target(mode: str) -> Column:
    """What an image in Markdown points at, by mode; external images stay addresses."""
    full = F.col("target")
    external = full.rlike("^https?://")
    if mode == "separate":
        return F.when(external, full)
    if mode == "link":
        number = F.col("img_no")
        own = F.when(full.startswith("data:"), F.concat(F.lit("image_"), number.cast("string"))).otherwise(
            image_name(full, number))
        return F.when(external, full).otherwise(F.concat(F.lit("images/"), own))
    return full
