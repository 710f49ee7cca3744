"""Word-processor documents: paragraphs and tables of nested markup, by running depths.

Text boxes put paragraphs into runs of paragraphs, cells hold tables, tracked changes
and content controls stand anywhere. So the markup is cut into tokens, one row each;
running counts say how deep in paragraphs, runs and tables a token lies, and a token
belongs to what was opened last at its own depth. Files are partitioned once, by path;
all windows and aggregates reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import html_unescape

DOCX_PARTS = r"^word/(document|footnotes|endnotes|styles)\.xml$"  # members that `scan_docx_blocks` reads

TASKS_PER_SHUFFLE = 4  # tokens take many times the room of their markup

_TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
_LEFT_OUT = ("Fallback", "del", "moveFrom")  # second versions of drawings, and what tracked changes took away
_OFF = ("0", "false", "none", "off")
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def _attribute(name: str) -> Column:
    return F.regexp_extract("raw", rf"""[\s:]{name}\s*+=\s*+["']([^"']*+)""", 1)


def _tokens(members: DataFrame) -> DataFrame:
    """(path, part, pos, raw, kind, name) of the text parts; `part` 0 is the document, 1 its footnotes, 2 its endnotes."""
    part = F.when(F.col("member") == "word/document.xml", 0).when(F.col("member") == "word/footnotes.xml", 1).when(
        F.col("member") == "word/endnotes.xml", 2)
    texts = members.select("path", part.alias("part"), F.col("content").cast("string").alias("xml")).where("part is not null")
    # a fixed number: by the size of packed markup too few tasks would be left for the tokens and their windows
    texts = texts.repartition(TASKS_PER_SHUFFLE * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    raw = texts.select("path", "part", F.posexplode(F.regexp_extract_all("xml", F.lit(_TOKEN), F.lit(0))).alias("pos", "raw"))
    kind = (F.when(~F.col("raw").startswith("<") | F.col("raw").startswith("<!"), "text").when(F.col("raw").startswith("</"), "close")
            .when(F.col("raw").endswith("/>"), "void").otherwise("open"))
    name = F.regexp_extract("raw", r"^</?+(?:[\w.\-]++:)?+([\w.\-]++)", 1)
    return raw.select("*", kind.alias("kind"), name.alias("name"))


def _placed(tokens: DataFrame) -> DataFrame:
    """Tokens with the paragraph and the run they belong to, and the cell of the outermost table around them."""
    file = Window.partitionBy("path", "part").orderBy("pos")
    so_far = file.rowsBetween(Window.unboundedPreceding, 0)
    name, kind = F.col("name"), F.col("kind")

    def depth(*names: str) -> Column:
        hit = name.isin(*names)
        return F.sum(F.when(hit & (kind == "open"), 1).when(hit & (kind == "close"), -1).otherwise(0)).over(so_far)

    def opened(tag: str) -> Column:
        return (name == tag) & (kind == "open")

    def last(what: Column, window=so_far) -> Column:
        return F.last(what, ignorenulls=True).over(window)

    out = tokens.select(
        "*", depth("p").alias("in_p"), depth("r").alias("in_r"), depth("tbl").alias("in_tbl"), depth("pPr").alias("in_ppr"),
        depth("rPr").alias("in_rpr"), depth(*_LEFT_OUT).alias("left_out"),
        (F.lag("name").over(file).isin("t") & (F.lag("kind").over(file) == "open")).alias("after_t"))
    top = F.col("in_tbl") == 1
    note = name.isin("footnote", "endnote") & (kind == "open")
    out = out.select(
        "*", last(F.when(opened("tbl") & top, F.col("pos"))).alias("table_pos"),
        F.sum((opened("tr") & top).cast("int")).over(so_far).alias("row"), F.sum((opened("tc") & top).cast("int")).over(so_far).alias("cell"),
        last(F.when(opened("tc") & top, 1).when((name == "gridSpan") & top, F.greatest(F.lit(1), F.coalesce(
            _attribute("val").try_cast("int"), F.lit(1))))).alias("span"),
        last(F.when(note, F.struct("pos", _attribute("id").alias("id"), _attribute("type").alias("type")))).alias("note"))
    out = out.withColumn("row_cell", last(F.when(opened("tr") & top, F.col("cell"))))

    def innermost(tag: str, level: str) -> Column:
        at = Window.partitionBy("path", "part", level).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return F.when(F.col(level) > 0, last(F.when(opened(tag), F.col("pos")), at))

    paragraph = F.when((name == "p") & (kind == "void"), F.col("pos")).otherwise(innermost("p", "in_p"))
    return out.withColumn("p", paragraph).withColumn("r", innermost("r", "in_r")).where("p is not null and left_out = 0")


def _marked(text: Column, mark: str, on: Column) -> Column:
    return F.when(on & text.rlike(r"\S"), F.regexp_replace(text, r"(?s)^(\s*+)(.*?)(\s*)$", f"$1{mark}$2{mark}$3")).otherwise(text)


def _joined(items: str, field: str, between: str) -> Column:
    """A field of sorted structs as one text."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s[field]), between)


def _paragraphs(placed: DataFrame) -> DataFrame:
    """(path, part, p, text, style, item, indent, place): paragraphs with their runs in order, bold and italic ones marked."""
    name, kind = F.col("name"), F.col("kind")
    in_run, own = (F.col("in_r") > 0) & (F.col("in_ppr") == 0), F.col("in_ppr") == 1  # older properties lie deeper
    element = in_run & (kind != "close")
    piece = (
        F.when((kind == "text") & F.col("after_t"), F.col("raw")).when(element & (name == "tab"), "\t")
        .when(element & name.isin("br", "cr"), "\n").when(element & (name == "noBreakHyphen"), "-")
        .when(element & (name == "footnoteReference"), F.concat(F.lit("[^"), _attribute("id"), F.lit("]")))
        .when(element & (name == "endnoteReference"), F.concat(F.lit("[^e"), _attribute("id"), F.lit("]"))))
    on = in_run & (F.col("in_rpr") == 1) & (kind != "close") & ~_attribute("val").isin(*_OFF)
    begin = (name == "p") & kind.isin("open", "void")
    place = F.when(begin, F.struct((F.col("in_tbl") > 0).alias("table"), "table_pos", "row", (F.col("cell") - F.col("row_cell") - 1).alias("col"),
                                   "span", "note"))
    runs = placed.select("path", "part", "p", "r", "pos", piece.alias("piece"), (on & (name == "b")).alias("b"), (on & (name == "i")).alias("i"),
                         F.when(own & (name == "pStyle"), _attribute("val")).alias("style"), (own & (name == "numPr")).alias("item"),
                         F.when(own & (name == "ilvl"), _attribute("val").try_cast("int")).alias("indent"), place.alias("place"))
    runs = runs.groupBy("path", "part", "p", "r").agg(
        F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))).alias("pieces"), F.min("pos").alias("pos"), F.bool_or("b").alias("b"),
        F.bool_or("i").alias("i"), F.max("style").alias("style"), F.bool_or("item").alias("item"), F.max("indent").alias("indent"),
        F.max("place").alias("place"))
    text = _marked(_marked(_joined("pieces", "piece", ""), "*", F.col("i")), "**", F.col("b"))
    out = runs.withColumn("text", text).groupBy("path", "part", "p").agg(
        F.collect_list(F.struct("pos", "text")).alias("runs"), F.max("style").alias("style"), F.bool_or("item").alias("item"),
        F.coalesce(F.max("indent"), F.lit(0)).alias("indent"), F.max("place").alias("place"))
    # marks of neighbouring runs meet
    return out.withColumn("text", html_unescape(F.replace(_joined("runs", "text", ""), F.lit("****"), F.lit(""))))


def _styles(members: DataFrame) -> DataFrame:
    """(path, names): style numbers with the names users see."""
    part = members.where(F.col("member") == "word/styles.xml").select(
        "path", F.from_xml(F.col("content").cast("string"), "style array<struct<_styleId:string, name:struct<_val:string>>>", _XML).alias("x"))
    return part.groupBy("path").agg(F.first("x.style").alias("names"))


def _table_lines(rows: Column) -> Column:
    """Sorted rows of cells as a Markdown table, the first one as its header; all rows as wide as the widest."""
    empty = lambda n: F.array_repeat(F.lit(""), F.greatest(n, F.lit(0)).cast("int"))
    cells = F.transform(rows, lambda r: F.aggregate(
        r["cells"], F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<string>").alias("out")),
        lambda done, c: F.struct((c["col"] + 1).cast("bigint").alias("next"), F.concat(
            done["out"], empty(c["col"] - done["next"]), F.array(c["text"]), empty(c["span"] - 1)).alias("out")), lambda done: done["out"]))
    width = F.array_max(F.transform(cells, F.size))
    lines = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, empty(width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")


def scan_docx_blocks(members: DataFrame) -> DataFrame:
    """(doc_id, block_no, style, level, text): paragraphs, tables and notes in order; level is null outside headings.

    All text counts: runs, links, insertions, content controls, and the paragraphs of
    text boxes, each a block after the paragraph that holds the box. A table is one block
    of style `Table`; a cell has the text of all its paragraphs, those of tables within
    it too, and takes as many columns as it spans. Notes come last, as blocks of style
    `Footnote` or `Endnote` that begin with the mark that stands where they are
    referred to. List items begin with a dash, indented by level. A heading's level
    follows from its style's name. Deletions and the old places of moved text are left
    out. A group never holds more than one file's part.
    """
    paragraphs = _paragraphs(_placed(_tokens(members)))
    table = F.coalesce(F.col("place.table"), F.lit(False)) & (F.col("part") == 0)
    dash = F.when(F.col("item") & ~table, F.concat(F.repeat(F.lit("  "), F.col("indent")), F.lit("- "))).otherwise(F.lit(""))
    block = F.when(table, F.col("place.table_pos")).when(F.col("part") > 0, F.col("place.note.pos")).otherwise(F.col("p"))
    out = paragraphs.where("part = 0 or place.note.type = ''").select(
        "path", "part", block.alias("block"), table.alias("table"), F.when(table, F.col("place.row")).otherwise(0).alias("row"),
        F.when(table, F.col("place.col")).otherwise(0).cast("bigint").alias("col"), "p", F.concat(dash, "text").alias("text"),
        F.coalesce("place.span", F.lit(1)).alias("span"), "style", F.col("place.note.id").alias("note"))
    in_cell = F.trim(F.replace(F.regexp_replace(_joined("all", "text", " "), r"\s++", " "), F.lit("|"), F.lit("\\|")))
    text = F.when(F.col("table"), in_cell).otherwise(_joined("all", "text", " "))
    cells = out.groupBy("path", "part", "block", "row", "col").agg(
        F.collect_list(F.struct("p", "text")).alias("all"), F.max("table").alias("table"), F.max("span").alias("span"), F.max("style").alias("style"),
        F.max("note").alias("note")).withColumn("text", text)
    rows = cells.groupBy("path", "part", "block", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "span", "text"))).alias("cells"), F.max("table").alias("table"), F.max("style").alias("style"),
        F.max("note").alias("note"))
    blocks = rows.groupBy("path", "part", "block").agg(
        F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.max("table").alias("table"), F.max("style").alias("style"), F.max("note").alias("note"))
    mark = F.when(F.col("part") > 0, F.concat(F.when(F.col("part") == 1, "[^").otherwise("[^e"), F.col("note"), F.lit("]: "))).otherwise(F.lit(""))
    whole = F.when(F.col("table"), _table_lines(F.col("rows"))).otherwise(F.concat(mark, F.col("rows")[0]["cells"][0]["text"]))
    kind = F.when(F.col("table"), "Table").when(F.col("part") == 1, "Footnote").when(F.col("part") == 2, "Endnote")
    named = blocks.join(_styles(members), "path", "left")
    name = F.coalesce(F.get(F.filter("names", lambda s: s["_styleId"] == F.col("style")), F.lit(0))["name"]["_val"], F.col("style"))
    heading = F.regexp_extract(name, "(?i)^heading ?([1-6])$", 1).try_cast("int")
    number = F.row_number().over(Window.partitionBy("path").orderBy("part", "block")) - 1
    return named.select(
        F.col("path").alias("doc_id"), number.cast("bigint").alias("block_no"), F.coalesce(kind, "style").alias("style"),
        F.when(kind.isNull(), heading).alias("level"), whole.alias("text"))
