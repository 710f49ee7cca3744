"""Tables inside documents.

Two shapes of the same thing:
  cells (doc_id, table_index, row_index, col_index, text, is_header)
  rows  (doc_id, table_index, row_index, is_header, values array<string>)

A rendered table comes in parts of at most ROWS_PER_PART rows; the parts of a
table joined by a newline are the whole table. Ordinary tables have one part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions import cell_text, escape_cell, pad_row, squeeze
from folioweave.operators.grouping import block_of, running_number, with_group_stats

TABLE = ["doc_id", "table_index"]
ROWS_PER_PART = 4096
PIECES_PER_PART = 1024


# ---------------------------------------------------------------- building


def to_rows(df: DataFrame, doc: str, order: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Any DataFrame as one table per `doc` value: a header row, then rows by `order`.

    The first order column is an integer; it also cuts large tables into blocks.
    Further ones break its ties.
    """
    order = [order] if isinstance(order, str) else list(order)
    names = [f"_o{i}" for i in range(len(order))]
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    body = F.array(*[cell_text(c, c in floating) for c in columns])
    numbered = running_number(
        df.select(F.col(doc).alias("doc_id"), *[F.col(o).alias(n) for o, n in zip(order, names)], body.alias("values")),
        ["doc_id"], names, [block_of(names[0])], "_n",
    )
    row = F.struct((F.col("_n") + 1).alias("row_index"), F.lit(False).alias("is_header"), F.col("values"))
    head = F.struct(F.lit(0).cast("bigint").alias("row_index"), F.lit(True).alias("is_header"),
                    F.array(*[F.lit(c) for c in columns]).alias("values"))
    # the first row brings the header along, so no second pass over the input
    return (
        numbered.select("doc_id", F.explode(F.when(F.col("_n") == 0, F.array(head, row)).otherwise(F.array(row))).alias("r"))
        .select("doc_id", F.lit(0).cast("bigint").alias("table_index"), "r.*")
    )


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.select(*TABLE, "row_index", "is_header", F.posexplode("values").alias("col_index", "text")).select(
        *TABLE, "row_index", F.col("col_index").cast("bigint").alias("col_index"), "text", "is_header")


def rows_of(cells: DataFrame) -> DataFrame:
    """Cells back to rows, each text at its column and '' in gaps; one group is one row, so its size is the table's width."""
    grouped = cells.groupBy(*TABLE, "row_index").agg(
        F.max("is_header").alias("is_header"), F.array_sort(F.collect_list(F.struct("col_index", "text"))).alias("_cells"))
    first = F.filter("_cells", lambda c, i: (i == 0) | (F.get("_cells", i - 1)["col_index"] != c["col_index"]))
    width = F.element_at("_cells", -1)["col_index"].cast("int") + 1
    at = F.map_from_entries(first)
    spread = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at(at, i.cast("bigint")), F.lit("")))
    dense = F.transform("_cells", lambda c: c["text"])
    return grouped.withColumn("values", F.when(F.size("_cells") == width, dense).otherwise(spread)).drop("_cells")


def to_cells(df: DataFrame, doc: str, order: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    return cells_of(to_rows(df, doc, order, columns))


def _as_rows(table: DataFrame) -> DataFrame:
    return table if "values" in table.columns else rows_of(table)


# ---------------------------------------------------------------- filters and facts


def select_sheets(cells: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Keep the named sheets; a string is a comma list with blanks around names allowed."""
    wanted = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    return cells.where(F.col("sheet").isin(wanted))


def cap_columns(cells: DataFrame, n: int = rules.SHEET_COLUMNS) -> DataFrame:
    """Keep the first n columns; `note` says so on every cell of a table that was wider."""
    out = with_group_stats(cells, TABLE, block_of("row_index"), {"_wide": (F.max, F.col("col_index"))})
    width = F.col("_wide") + 1
    note = F.concat(F.lit("*Table too wide ("), width.cast("string"),
                    F.lit(f" columns), showing first {n} columns*"))
    return out.where(F.col("col_index") < n).withColumn("note", F.when(width > n, note)).drop("_wide")


def drop_tiny_tables(cells: DataFrame) -> DataFrame:
    """Drop tables of fewer than two rows."""
    out = with_group_stats(cells, TABLE, block_of("row_index"),
                           {"_lo": (F.min, F.col("row_index")), "_hi": (F.max, F.col("row_index"))})
    return out.where(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi")


def header_row(cells: DataFrame) -> DataFrame:
    """Adds in_header: the first row of a table that has header cells anywhere."""
    out = with_group_stats(cells, TABLE, block_of("row_index"),
                           {"_first": (F.min, F.col("row_index")), "_any": (F.max, F.col("is_header"))})
    return out.withColumn("in_header", F.col("_any") & (F.col("row_index") == F.col("_first"))).drop("_first", "_any")


def table_dims(cells: DataFrame) -> DataFrame:
    """Rows, columns and header texts of each table."""
    heads = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("is_header"), F.struct("row_index", "col_index", "text")))),
        lambda s: s["text"])
    return cells.groupBy(*TABLE).agg(
        (F.max("row_index") + 1).alias("row_count"), (F.max("col_index") + 1).alias("col_count"),
        heads.alias("headers"))


def empty_table_note(tables: DataFrame, rendered: DataFrame) -> DataFrame:
    """The rendered tables, and a placeholder for each listed one that has no cells.

    Only the keys of first parts are looked up, one row per table, so a table of
    many parts is never on either side of the join.
    """
    return _with_notes(tables, rendered, rendered.where(F.col("part") == 0).select(*TABLE))


def _with_notes(tables: DataFrame, rendered: DataFrame, present: DataFrame) -> DataFrame:
    notes = tables.select(*TABLE).join(present, TABLE, "left_anti").select(
        *TABLE, F.lit(0).cast("bigint").alias("part"), F.lit(rules.EMPTY_SHEET).alias("markdown"))
    return rendered.select(*TABLE, "part", "markdown").unionByName(notes)


# ---------------------------------------------------------------- rendering


def _collect_parts(lines: DataFrame) -> DataFrame:
    """Lines of a part to its text; the lines already lie by (table, part)."""
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy(*TABLE, "part").agg(joined.alias("markdown"))


def _with_edges(rows: DataFrame) -> DataFrame:
    """Adds part, the table's first and last row number, and its width (header first)."""
    size = F.size("values")
    out = with_group_stats(rows, TABLE, block_of("row_index", ROWS_PER_PART), {
        "_first": (F.min, F.col("row_index")),
        "_last": (F.max, F.col("row_index")),
        "_head": (F.max, F.when(F.col("is_header"), size)),
        "_wide": (F.max, size),
    }, keep="part")
    return out.withColumn("_width", F.coalesce("_head", "_wide")).drop("_head")


def _github_lines(rows: DataFrame) -> DataFrame:
    cells = pad_row(F.transform("values", escape_cell), F.col("_width"))
    line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_width")), " | "), F.lit(" |"))
    return rows.withColumn("line", F.when(F.col("is_header"), F.concat_ws("\n", line, rule)).otherwise(line))


def _markup_text(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _html_lines(rows: DataFrame) -> DataFrame:
    cells = pad_row(F.transform("values", _markup_text), F.col("_width"))

    def tr(tag: str) -> Column:
        inner = F.array_join(
            F.transform(cells, lambda c: F.concat(F.lit(f"      <{tag}>"), c, F.lit(f"</{tag}>"))), "\n")
        return F.concat_ws("\n", F.lit("    <tr>"), inner, F.lit("    </tr>"))

    first, last = F.col("row_index") == F.col("_first"), F.col("row_index") == F.col("_last")
    head = F.concat_ws("\n", F.lit("  <thead>"), tr("th"), F.lit("  </thead>"), F.lit("  <tbody>"))
    body = F.concat_ws("\n", F.when(first, F.lit("  <tbody>")), tr("td"))
    return rows.withColumn("line", F.concat_ws(
        "\n",
        F.when(first, F.lit("<table>")),
        F.when(F.col("is_header"), head).otherwise(body),
        F.when(last, F.lit("  </tbody>\n</table>")),
    ))


def _with_specs(rows: DataFrame) -> DataFrame:
    """As `_with_edges`, plus `_specs`: (width, numeric) of every column of the table.

    One pass over the cells feeds both, and the result meets the rows by (table,
    part). Widths count code points; header cells ask for two more, as plain-text
    table printers do. East Asian double width is not considered.
    """
    tagged = rows.withColumn("part", block_of("row_index", ROWS_PER_PART))
    text, head = F.col("text"), F.col("is_header")
    number = text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") | (text == "")
    cells = tagged.select(*TABLE, "part", "row_index", "is_header", F.posexplode("values").alias("col_index", "text"))
    narrow = cells.groupBy(*TABLE, "part", "col_index").agg(
        F.max(F.when(head, F.length(text) + 2).otherwise(F.length(text))).alias("w"),
        F.coalesce(F.min(F.when(~head, number)), F.lit(True)).alias("num"),
        F.max((~head).cast("int")).alias("body"),
        F.max(head).alias("head"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi"))
    col, whole = Window.partitionBy(*TABLE, "col_index"), Window.partitionBy(*TABLE)
    known = narrow.select(
        *TABLE, "part", "col_index", F.max("w").over(col).alias("w"),
        (F.min("num").over(col) & (F.max("body").over(col) > 0)).alias("num"),
        F.min("lo").over(whole).alias("_first"), F.max("hi").over(whole).alias("_last"),
        (F.max("col_index").over(whole) + 1).alias("_wide"),
        (F.max(F.when(F.col("head"), F.col("col_index"))).over(whole) + 1).alias("_head"))
    # the set has one entry per column of the table, whichever parts it occurs in
    known = known.withColumn("_cols", F.collect_set(F.struct("col_index", "w", "num")).over(whole))
    facts = known.groupBy(*TABLE, "part").agg(*[F.first(c).alias(c) for c in ("_first", "_last", "_wide", "_head", "_cols")])
    facts = facts.withColumn("_width", F.coalesce("_head", "_wide")).withColumn(
        "_specs", F.slice(F.array_sort("_cols"), F.lit(1), F.col("_width"))).drop("_head", "_cols")
    return tagged.join(facts, [*TABLE, "part"])


def _boxed_lines(rows: DataFrame) -> DataFrame:
    """Padded lines of the grid and pipe formats, both as columns."""
    def cell(c: Column, s: Column) -> Column:
        return F.when(s["num"], F.lpad(c, s["w"], " ")).otherwise(F.rpad(c, s["w"], " "))

    padded = rows.withColumn("values", pad_row("values", F.col("_width")))
    return padded.withColumn("line", F.concat(
        F.lit("| "), F.array_join(F.zip_with("values", "_specs", cell), " | "), F.lit(" |")))


def _pipe_lines(rows: DataFrame) -> DataFrame:
    marks = F.transform("_specs", lambda s: F.when(
        s["num"], F.concat(F.repeat(F.lit("-"), s["w"] + 1), F.lit(":"))
    ).otherwise(F.concat(F.lit(":"), F.repeat(F.lit("-"), s["w"] + 1))))
    rule = F.concat(F.lit("|"), F.array_join(marks, "|"), F.lit("|"))
    return _boxed_lines(rows).withColumn("line", F.concat_ws("\n", "line", F.when(F.col("is_header"), rule)))


def _grid_lines(rows: DataFrame) -> DataFrame:
    def border(dash: str) -> Column:
        bars = F.transform("_specs", lambda s: F.repeat(F.lit(dash), s["w"] + 2))
        return F.concat(F.lit("+"), F.array_join(bars, "+"), F.lit("+"))

    return _boxed_lines(rows).withColumn("line", F.concat_ws(
        "\n",
        F.when(F.col("row_index") == F.col("_first"), border("-")),
        "line",
        F.when(F.col("is_header"), border("=")).otherwise(border("-")),
    ))


def render_table(table: DataFrame, fmt: str = "github") -> DataFrame:
    """(doc_id, table_index, part, markdown) from cells or rows."""
    if fmt not in rules.TABLE_FORMATS:
        raise ValueError(f"table format must be one of {rules.TABLE_FORMATS}")
    return _collect_parts(_lines(_prepared(_as_rows(table), fmt), fmt))


def _prepared(rows: DataFrame, fmt: str) -> DataFrame:
    """Rows with what their format needs to know about the whole table."""
    if fmt in ("pipe", "grid"):
        return _with_specs(rows.withColumn("values", F.transform("values", escape_cell if fmt == "pipe" else squeeze)))
    return _with_edges(rows)


def _lines(rows: DataFrame, fmt: str) -> DataFrame:
    return {"github": _github_lines, "html": _html_lines, "pipe": _pipe_lines, "grid": _grid_lines}[fmt](rows)


def table_or_note(table: DataFrame, n: int = rules.SHEET_COLUMNS, fmt: str = "github",
                  tables: DataFrame | None = None) -> DataFrame:
    """Rendered tables with the too-wide note, and the placeholder for empty ones."""
    rows = _prepared(_as_rows(table), fmt)
    note = F.when((F.col("_wide") > n) & (F.col("row_index") == F.col("_first")), F.concat(
        F.lit("*Table too wide ("), F.col("_wide").cast("string"), F.lit(f" columns), showing first {n} columns*\n")))
    capped = rows.withColumns({"values": F.slice("values", 1, n), "_width": F.least("_width", F.lit(n)), "_note": note})
    if "_specs" in capped.columns:
        capped = capped.withColumn("_specs", F.slice("_specs", 1, n))
    rendered = _collect_parts(_lines(capped, fmt).withColumn("line", F.concat_ws("\n", "_note", "line")))
    if tables is None:
        return rendered
    # the tables that have cells are known from the input; nothing is rendered twice
    return _with_notes(tables, rendered, table.select(*TABLE).distinct())


# ---------------------------------------------------------------- workbooks and appendices


def workbook_markdown(sheets: DataFrame, mode: str = "combined") -> DataFrame:
    """(doc_id, part, markdown) from (doc_id, name, sheet_index, sheet, part, markdown).

    Parts of a workbook, joined without separator, are the whole document.
    """
    if mode not in rules.WORKBOOK_MODES:
        raise ValueError(f"workbook mode must be one of {rules.WORKBOOK_MODES}")
    # one narrow table of (sheet, block of parts) tells all: last part of the sheet,
    # sheets of the workbook, and how many pieces come before the block
    cut = ["doc_id", "sheet_index", "_block"]
    tagged = sheets.withColumn("_block", block_of("part"))
    sheet, book = Window.partitionBy("doc_id", "sheet_index"), Window.partitionBy("doc_id")
    before = book.orderBy("sheet_index", "_block").rowsBetween(Window.unboundedPreceding, -1)
    facts = tagged.groupBy(*cut).agg(
        F.max("part").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == 0).alias("s")
    ).select(*cut, F.max("hi").over(sheet).alias("_last"), F.sum("s").over(book).alias("_sheets"),
             F.min("sheet_index").over(book).alias("_first"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*cut).orderBy("part"))
    out = tagged.withColumn("_local", local).join(facts, cut).withColumn("_n", F.col("_start") + F.col("_local") - 1)
    starts, ends = F.col("part") == 0, F.col("part") == F.col("_last")
    opens = starts & (F.col("sheet_index") == F.col("_first"))
    none = F.lit("")
    if mode == "combined":
        head = F.concat(
            F.when(opens, F.concat(
                F.lit("# Excel Workbook: "), F.col("name"), F.lit("\n*Contains "),
                F.col("_sheets").cast("string"), F.lit(" sheet(s)*\n\n"))).otherwise(none),
            F.when(starts, F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n"))).otherwise(none))
        tail = "\n\n\n---\n\n"
    else:
        lead = F.when(opens | F.lit(mode == "selected"), none).otherwise(F.lit("\n\n"))
        head = F.when(starts, F.concat(lead, F.lit("# "), F.col("sheet"), F.lit("\n\n"))).otherwise(none)
        tail = "\n\n\n\n" if mode == "selected" else "\n\n"
    piece = F.concat(head, F.col("markdown"), F.when(ends, F.lit(tail)).otherwise(F.lit("\n")))
    numbered = out.select("doc_id", "_n", piece.alias("piece"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "piece"))), lambda s: s["piece"]), "")
    return numbered.groupBy("doc_id", block_of("_n", PIECES_PER_PART).alias("part")).agg(joined.alias("markdown"))


def images_section(images: DataFrame, mode: str = "link") -> DataFrame:
    """(doc_id, part, markdown): the appendix of embedded or linked images.

    images: (doc_id, image_index, alt_text, format, bytes, path).
    """
    if mode not in rules.IMAGE_MODES:
        raise ValueError(f"image mode must be one of {rules.IMAGE_MODES}")
    target = {
        "embed": F.concat(F.lit("data:image/"), F.col("format"), F.lit(";base64,"), F.base64("bytes")),
        "link": F.col("path"),
        "separate": F.lit(None).cast("string"),
    }[mode]
    lines = images.select("doc_id", "image_index", F.concat(
        F.lit("!["), F.col("alt_text"), F.lit("]("), target, F.lit(")\n\n")).alias("line"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("image_index", "line"))),
                    lambda s: F.coalesce(s["line"], F.lit(""))), "")
    part = block_of("image_index", PIECES_PER_PART).alias("part")
    head = F.when(F.col("part") == 0, F.lit("## Images and Charts\n\n")).otherwise(F.lit(""))
    return lines.groupBy("doc_id", part).agg(joined.alias("_md")).select(
        "doc_id", "part", F.concat(head, F.col("_md")).alias("markdown"))


# ---------------------------------------------------------------- Markdown tables

_PIPE_LINE = r"^\|[^\n]+\|$"
_RULE_LINE = r"^\|[-:\s|]*-[-:\s|]*\|$"


def find_md_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, table_index, markdown, row_count, data_row_count, col_count).

    Only lines that look like table lines leave the map side; a run of adjacent
    ones is a table when a rule line stands between its first and last line.
    """
    lines = (
        docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("no", "line"))
        .where(F.col("line").rlike(_PIPE_LINE))
        .withColumn("is_rule", F.col("line").rlike(_RULE_LINE))
    )
    island = F.col("no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))
    blocks = lines.withColumn("island", island).groupBy("doc_id", "island").agg(
        F.array_sort(F.collect_list(F.struct("no", "line", "is_rule"))).alias("ls"))
    inner = F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 2, F.lit(0)))
    found = blocks.where(F.exists(inner, lambda s: s["is_rule"]))
    flags = F.transform("ls", lambda s: s["is_rule"].cast("int"))
    rule_at = F.array_position(flags, 1)
    content = F.filter("ls", lambda s: ~s["is_rule"])
    body = F.filter(F.slice("ls", rule_at.cast("int"), F.size("ls")), lambda s: ~s["is_rule"])
    first = F.col("ls")[0]["line"]
    facts = found.select(
        "doc_id", F.col("ls")[0]["no"].alias("_no"),
        F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("markdown"),
        F.size(content).cast("bigint").alias("row_count"),
        F.size(body).cast("bigint").alias("data_row_count"),
        (F.size(F.split(first, r"\|")) - 2).cast("bigint").alias("col_count"),
    )
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("_no")) - 1).cast("bigint")
    return facts.withColumn("table_index", number).drop("_no")


def md_table_cells(blocks: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Cells of Markdown tables (doc_id, table_index, markdown); no shuffle."""
    lines = F.split(markdown, "\n")
    numbered = F.filter(lines, lambda s: ~s.rlike(_RULE_LINE))
    # known before the explode: after it, every line would carry its whole table and cut it again
    tables = blocks.select(*TABLE, numbered.alias("_lines"), F.element_at(lines, 2).rlike(_RULE_LINE).alias("_has_head"))
    rows = tables.select(*TABLE, F.posexplode("_lines").alias("row_index", "line"), "_has_head")
    bare = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    pieces = F.split(F.replace(bare, F.lit("\\|"), F.lit("\u0001")), r"\|")
    texts = F.transform(pieces, lambda c: F.replace(F.trim(c), F.lit("\u0001"), F.lit("|")))
    return rows.select(
        *TABLE, F.col("row_index").cast("bigint").alias("row_index"),
        (F.col("_has_head") & (F.col("row_index") == 0)).alias("is_header"),
        F.posexplode(texts).alias("col_index", "text"),
    ).select(*TABLE, "row_index", F.col("col_index").cast("bigint").alias("col_index"), "text", "is_header")
