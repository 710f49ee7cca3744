"""Table jobs over customers, suppliers and line items as tables inside documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.catalog.common import table
from folioweave.operators import tables as tb
from folioweave.session import shared_dir
from folioweave.sources import files

COLS = ["c_custkey", "c_name", "c_mktsegment"]
LINE = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipmode_no", "l_quantity"]


def rows(s, d):
    """Customers as one table per nation."""
    return tb.to_rows(table(s, d, "customer"), "c_nationkey", "c_custkey", COLS)


def cells(s, d):
    return tb.cells_of(rows(s, d))


SQL_ROWS = """body AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_index, false AS is_header,
  [CAST(c_custkey AS VARCHAR), c_name, c_mktsegment] AS vals FROM customer),
rows_ AS (SELECT * FROM body UNION ALL SELECT DISTINCT doc_id, 0::BIGINT, true, ['c_custkey', 'c_name', 'c_mktsegment'] FROM body)"""
SQL_CELLS = f"""{SQL_ROWS}, cells AS (SELECT doc_id, 0::BIGINT AS table_index, row_index, CAST(i AS BIGINT) AS col_index, vals[i + 1] AS text, is_header
  FROM rows_, (SELECT unnest(range(3)) AS i))"""


def line_rows(s, d):
    """Line items as three tables, one per return flag; the tables are large."""
    li = table(s, d, "lineitem").select(
        "*", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("no"), (F.col("l_suppkey") % 7).alias("l_shipmode_no"))
    doc = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return tb.to_rows(li.withColumn("doc", doc), "doc", ["no", "l_partkey", "l_linestatus", "l_shipmode_no", "l_quantity"], LINE)


SQL_LINES = """li AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS doc_id, l_orderkey * 8 + l_linenumber AS no,
  [CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag, l_linestatus, CAST(l_suppkey % 7 AS VARCHAR), CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR)] AS vals,
  l_partkey, l_linestatus, l_suppkey % 7 AS sm, l_quantity FROM lineitem),
lb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, l_partkey, l_linestatus, sm, l_quantity) AS row_index, false AS is_header, vals FROM li),
lrows AS (SELECT * FROM lb UNION ALL SELECT DISTINCT doc_id, 0::BIGINT, true, ['l_orderkey', 'l_partkey', 'l_linenumber', 'l_returnflag', 'l_linestatus', 'l_shipmode_no', 'l_quantity'] FROM lb)"""


def cap_columns(s, d):
    return tb.cap_columns(tb.cells_of(line_rows(s, d)), 4).select("doc_id", "row_index", "col_index", "text", "note")


SQL_CAP = f"""WITH {SQL_LINES} SELECT doc_id, row_index, CAST(i AS BIGINT) AS col_index, vals[i + 1] AS text,
  '*Table too wide (7 columns), showing first 4 columns*' AS note FROM lrows, (SELECT unnest(range(4)) AS i)"""


def tiny_source(s, d):
    """Tables by account balance bucket; some have a single row."""
    c = table(s, d, "customer").select(
        F.floor(F.col("c_acctbal") / 5).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("table_index"),
        F.col("c_custkey").alias("row_index"), F.lit(0).cast("bigint").alias("col_index"), F.col("c_name").alias("text"),
        F.lit(False).alias("is_header"))
    return c


def empty_table_note(s, d):
    listed = table(s, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(0).cast("bigint").alias("table_index"))
    some = table(s, d, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("doc_id"), F.lit(0).cast("bigint").alias("table_index"), F.lit(0).cast("bigint").alias("part"),
        F.col("s_name").alias("markdown"))
    return tb.empty_table_note(listed, some)


def select_sheets(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("sheet"))
    return tb.select_sheets(c, " ASIA , EUROPE,NOWHERE")


def header_row(s, d):
    base = cells(s, d).withColumn("is_header", F.col("is_header") & (F.col("doc_id") % 2 == 0))
    return tb.header_row(base).select("doc_id", "row_index", "col_index", "in_header")


def table_dims(s, d):
    return tb.table_dims(cells(s, d)).select("doc_id", "row_count", "col_count", F.array_join("headers", "|").alias("headers"))


GH_LINE = "'| ' || array_to_string(vals, ' | ') || ' |'"
SQL_GITHUB = f"""WITH {SQL_ROWS} SELECT doc_id, 0::BIGINT AS table_index, row_index // 4096 AS part,
  string_agg({GH_LINE} || CASE WHEN is_header THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row_index) AS markdown FROM rows_ GROUP BY ALL"""

# pipe and grid: column 0 is numeric (right), the others left
SQL_BOX = f"""{SQL_ROWS}, w AS (SELECT doc_id, greatest(max(CASE WHEN is_header THEN 0 ELSE length(vals[1]) END), 11) AS w1,
  greatest(max(CASE WHEN is_header THEN 0 ELSE length(vals[2]) END), 8) AS w2, greatest(max(CASE WHEN is_header THEN 0 ELSE length(vals[3]) END), 14) AS w3,
  max(row_index) AS last FROM rows_ GROUP BY doc_id),
bx AS (SELECT r.*, w1, w2, w3, last, '| ' || lpad(vals[1], CAST(w1 AS INTEGER), ' ') || ' | ' || rpad(vals[2], CAST(w2 AS INTEGER), ' ') || ' | ' || rpad(vals[3], CAST(w3 AS INTEGER), ' ') || ' |' AS line,
  '+' || repeat('-', w1 + 2) || '+' || repeat('-', w2 + 2) || '+' || repeat('-', w3 + 2) || '+' AS bar,
  '+' || repeat('=', w1 + 2) || '+' || repeat('=', w2 + 2) || '+' || repeat('=', w3 + 2) || '+' AS bold FROM rows_ r JOIN w ON w.doc_id = r.doc_id)"""
SQL_PIPE = f"""WITH {SQL_BOX} SELECT doc_id, 0::BIGINT AS table_index, row_index // 4096 AS part, string_agg(line || CASE WHEN is_header THEN
  chr(10) || '|' || repeat('-', w1 + 1) || ':|:' || repeat('-', w2 + 1) || '|:' || repeat('-', w3 + 1) || '|' ELSE '' END, chr(10) ORDER BY row_index) AS markdown FROM bx GROUP BY ALL"""
SQL_GRID = f"""WITH {SQL_BOX} SELECT doc_id, 0::BIGINT AS table_index, row_index // 4096 AS part, string_agg(CASE WHEN is_header THEN bar || chr(10) || line || chr(10) || bold
  ELSE line || chr(10) || bar END, chr(10) ORDER BY row_index) AS markdown FROM bx GROUP BY ALL"""


def _tr(tag: str) -> str:
    c = " || chr(10) || ".join(f"'      <{tag}>' || vals[{i}] || '</{tag}>'" for i in (1, 2, 3))
    return f"'    <tr>' || chr(10) || {c} || chr(10) || '    </tr>'"


SQL_HTML = f"""WITH {SQL_ROWS}, l AS (SELECT *, max(row_index) OVER (PARTITION BY doc_id) AS last FROM rows_)
SELECT doc_id, 0::BIGINT AS table_index, row_index // 4096 AS part, string_agg(CASE WHEN is_header THEN '<table>' || chr(10) || '  <thead>' || chr(10) || {_tr('th')} || chr(10) || '  </thead>' || chr(10) || '  <tbody>'
  ELSE {_tr('td')} END || CASE WHEN row_index = last THEN chr(10) || '  </tbody>' || chr(10) || '</table>' ELSE '' END, chr(10) ORDER BY row_index) AS markdown FROM l GROUP BY ALL"""


def md_docs(s, d):
    """Rendered tables between paragraphs: documents with Markdown tables in them."""
    parts = tb.render_table(rows(s, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "markdown"))).alias("p"))
    t = parts.select("doc_id", F.array_join("p.markdown", "\n").alias("markdown"))
    return t.select("doc_id", F.concat(F.lit("Intro\n\n"), F.col("markdown"), F.lit("\n\ntext | no table\n\n| a | b |\n| :--- | ---: |\n| x\\|y |  |\n\n|lonely|\n")).alias("text"))


SQL_FIND = f"""WITH {SQL_ROWS}, t AS (SELECT doc_id, string_agg({GH_LINE} || CASE WHEN is_header THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row_index) AS markdown,
  count(*) AS n FROM rows_ GROUP BY doc_id)
SELECT doc_id, 0::BIGINT AS table_index, markdown, n AS row_count, n - 1 AS data_row_count, 3::BIGINT AS col_count FROM t
UNION ALL SELECT doc_id, 1::BIGINT, '| a | b |' || chr(10) || '| :--- | ---: |' || chr(10) || '| x\\|y |  |', 2::BIGINT, 1::BIGINT, 2::BIGINT FROM t"""


def md_table_cells(s, d):
    """Cells -> Markdown -> cells gives the table back."""
    found = tb.find_md_tables(md_docs(s, d)).where("table_index = 0")
    return tb.md_table_cells(found)


def table_or_note(s, d):
    zero = F.lit(0).cast("bigint").alias("table_index")
    listed = s.range(3).select(F.col("id").cast("int").alias("doc_id"), zero).unionByName(
        table(s, d, "supplier").select((F.col("s_suppkey") + 1000).alias("doc_id"), F.lit(0).cast("bigint").alias("table_index")))
    return tb.table_or_note(line_rows(s, d), 4, tables=listed)


SQL_NOTE = f"""WITH {SQL_LINES}, t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, row_index // 4096 AS part,
  string_agg('| ' || array_to_string(vals[1:4], ' | ') || ' |' || CASE WHEN is_header THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row_index) AS md FROM lrows GROUP BY ALL)
SELECT doc_id, 0::BIGINT AS table_index, part, CASE WHEN part = 0 THEN '*Table too wide (7 columns), showing first 4 columns*' || chr(10) || chr(10) ELSE '' END || md AS markdown FROM t
UNION ALL SELECT s_suppkey + 1000, 0::BIGINT, 0::BIGINT, '*Empty sheet*' FROM supplier"""


def sheet_md(s, d):
    """One sheet per nation, one workbook per region; a sheet body per customer block."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    body = c.select(
        F.col("n_regionkey").cast("bigint").alias("doc_id"), F.col("n_nationkey").cast("bigint").alias("sheet_index"), F.col("n_name").alias("sheet"),
        F.floor(F.col("c_custkey") / 500).cast("bigint").alias("part"), F.col("c_acctbal"))
    return body.groupBy("doc_id", "sheet_index", "sheet", "part").agg(F.count(F.lit(1)).cast("string").alias("markdown")).withColumn(
        "name", F.concat(F.lit("wb"), F.col("doc_id").cast("string"), F.lit(".xlsx")))


def workbook_markdown(s, d):
    out = [tb.workbook_markdown(sheet_md(s, d), m).select("doc_id", "part", F.lit(m).alias("mode"), "markdown") for m in ("combined", "separate", "selected")]
    return out[0].unionByName(out[1]).unionByName(out[2])


SQL_WB = """WITH b AS (SELECT n_regionkey AS doc_id, n_nationkey AS si, n_name AS sheet, c_custkey // 500 AS part, CAST(count(*) AS VARCHAR) AS md
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
e AS (SELECT *, max(part) OVER (PARTITION BY doc_id, si) AS last, min(si) OVER (PARTITION BY doc_id) AS first FROM b),
n AS (SELECT doc_id, count(*) FILTER (part = 0) AS sheets FROM b GROUP BY doc_id),
p AS (SELECT e.*, sheets,
  CASE WHEN part = 0 AND si = first THEN '# Excel Workbook: wb' || e.doc_id || '.xlsx' || chr(10) || '*Contains ' || sheets || ' sheet(s)*' || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN part = 0 THEN '## Sheet: ' || sheet || chr(10) ELSE '' END || md || CASE WHEN part = last THEN repeat(chr(10), 3) || '---' || chr(10) || chr(10) ELSE chr(10) END AS combined,
  CASE WHEN part = 0 THEN CASE WHEN si = first THEN '' ELSE chr(10) || chr(10) END || '# ' || sheet || chr(10) || chr(10) ELSE '' END || md || CASE WHEN part = last THEN repeat(chr(10), 2) ELSE chr(10) END AS separate,
  CASE WHEN part = 0 THEN '# ' || sheet || chr(10) || chr(10) ELSE '' END || md || CASE WHEN part = last THEN repeat(chr(10), 4) ELSE chr(10) END AS selected
  FROM e JOIN n ON n.doc_id = e.doc_id),
u AS (UNPIVOT p ON combined, separate, selected INTO NAME mode VALUE piece),
r AS (SELECT doc_id, mode, piece, si, part, row_number() OVER (PARTITION BY doc_id, mode ORDER BY si, part) - 1 AS n FROM u)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n // 1024 AS part, mode, string_agg(piece, '' ORDER BY n) AS markdown FROM r GROUP BY doc_id, mode, n // 1024"""


def images(s, d):
    """Parts as images of twenty documents."""
    return table(s, d, "part").select(
        (F.col("p_partkey") % 20).alias("doc_id"), F.floor(F.col("p_partkey") / 20).cast("bigint").alias("image_index"),
        F.col("p_name").alias("alt_text"), F.lit("png").alias("format"), F.encode("p_name", "UTF-8").alias("bytes"),
        F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"))


def images_section(s, d):
    out = [tb.images_section(images(s, d), m).select("doc_id", "part", F.lit(m).alias("mode"), "markdown") for m in ("embed", "link", "separate")]
    return out[0].unionByName(out[1]).unionByName(out[2])


SQL_IMAGES = """WITH i AS (SELECT p_partkey % 20 AS doc_id, p_partkey // 20 AS idx, '![' || p_name || '](data:image/png;base64,' || to_base64(encode(p_name)) || ')' || chr(10) || chr(10) AS embed,
  '![' || p_name || '](images/' || p_partkey || '.png)' || chr(10) || chr(10) AS link, '' AS separate FROM part),
u AS (UNPIVOT i ON embed, link, separate INTO NAME mode VALUE line)
SELECT doc_id, idx // 1024 AS part, mode, CASE WHEN idx // 1024 = 0 THEN '## Images and Charts' || chr(10) || chr(10) ELSE '' END || string_agg(line, '' ORDER BY idx) AS markdown
FROM u GROUP BY doc_id, mode, idx // 1024"""


def scan_csv_cells(s, d):
    """Customers written as CSV files, a hundred per file, every third file with line breaks in its fields, and scanned."""
    out = shared_dir(s, "csv")
    c = table(s, d, "customer").select(F.floor(F.col("c_custkey") / 100).cast("bigint").alias("file_no"), "c_custkey", "c_name", "c_mktsegment")
    between = F.when(F.col("file_no") % 3 == 2, F.lit(',\n\n ""')).otherwise(F.lit(', ""'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), between, F.col("c_mktsegment"), F.lit('"""'))
    lines = c.select("file_no", F.col("c_custkey").alias("k"), line.alias("value")).unionByName(
        c.select("file_no").distinct().select("file_no", F.lit(-1).cast("bigint").alias("k"), F.lit("key,name").alias("value")))
    lines.repartition("file_no").sortWithinPartitions("file_no", "k").select("file_no", "value").write.partitionBy("file_no").text(out)
    cells = files.scan_csv_cells(s, out, "*.txt")
    return cells.select(F.regexp_extract("doc_id", "file_no=([0-9]+)", 1).cast("bigint").alias("doc_id"), "row_index", "col_index", "text", "is_header")


SQL_CSV = """WITH r AS (SELECT c_custkey // 100 AS doc_id, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS row_index, c_custkey,
  c_name || CASE c_custkey // 100 % 3 WHEN 2 THEN ',' || chr(10) || chr(10) || ' "' ELSE ', "' END || c_mktsegment || '"' AS n FROM customer)
SELECT doc_id, row_index, 0::BIGINT AS col_index, CAST(c_custkey AS VARCHAR) AS text, false AS is_header FROM r UNION ALL SELECT doc_id, row_index, 1, n, false FROM r
UNION ALL SELECT DISTINCT doc_id, 0, 0, 'key', true FROM r UNION ALL SELECT DISTINCT doc_id, 0, 1, 'name', true FROM r"""

QUERIES = {
    "to_cells": (lambda s, d: tb.to_cells(table(s, d, "customer"), "c_nationkey", "c_custkey", COLS), f"WITH {SQL_CELLS} SELECT * FROM cells"),
    "select_sheets": (select_sheets, "SELECT c_custkey, r_name AS sheet FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')"),
    "cap_columns": (cap_columns, SQL_CAP),
    "drop_tiny_tables": (lambda s, d: tb.drop_tiny_tables(tiny_source(s, d)).select("doc_id", "row_index", "text"),
        "SELECT CAST(floor(c_acctbal / 5) AS BIGINT) AS doc_id, c_custkey AS row_index, c_name AS text FROM customer QUALIFY count(*) OVER (PARTITION BY floor(c_acctbal / 5)) >= 2"),
    "empty_table_note": (empty_table_note, "SELECT s_suppkey AS doc_id, 0::BIGINT AS table_index, 0::BIGINT AS part, CASE WHEN s_acctbal > 0 THEN s_name ELSE '*Empty sheet*' END AS markdown FROM supplier"),
    "header_row": (header_row, f"WITH {SQL_CELLS} SELECT doc_id, row_index, col_index, row_index = 0 AND doc_id % 2 = 0 AS in_header FROM cells"),
    "table_dims": (table_dims, "SELECT c_nationkey AS doc_id, count(*) + 1 AS row_count, 3::BIGINT AS col_count, 'c_custkey|c_name|c_mktsegment' AS headers FROM customer GROUP BY c_nationkey"),
    "render_github": (lambda s, d: tb.render_table(rows(s, d), "github"), SQL_GITHUB),
    "render_pipe": (lambda s, d: tb.render_table(rows(s, d), "pipe"), SQL_PIPE),
    "render_grid": (lambda s, d: tb.render_table(rows(s, d), "grid"), SQL_GRID),
    "render_html": (lambda s, d: tb.render_table(cells(s, d), "html"), SQL_HTML),
    "find_md_tables": (lambda s, d: tb.find_md_tables(md_docs(s, d)), SQL_FIND),
    "md_table_cells": (md_table_cells, f"WITH {SQL_CELLS} SELECT * FROM cells"),
    "table_or_note": (table_or_note, SQL_NOTE),
    "workbook_markdown": (workbook_markdown, SQL_WB),
    "images_section": (images_section, SQL_IMAGES),
    "scan_csv_cells": (scan_csv_cells, SQL_CSV),
}
