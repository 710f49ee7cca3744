"""Table jobs: round trips, formats, wide and empty sheets, parts of large tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave.operators import tables as tb
from folioweave.sources.delimited import csv_cells, csv_records, scan_csv_cells

RUNS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
WORD = st.text(alphabet="ab|\\ é.-1", max_size=6).map(lambda t: " ".join(t.replace("\\", "").split()))


def people(spark):
    return spark.createDataFrame([(1, 1, "Alice", 30, "New York"), (1, 2, "Bob", 25, None), (2, 1, "Zoë", 7, "Köln|West")],
                                 "doc int, no int, Name string, Age int, City string")


def rendered(spark, fmt):
    rows = tb.to_rows(people(spark), "doc", "no", ["Name", "Age", "City"])
    return {r.doc_id: r.markdown for r in tb.render_table(rows, fmt).collect()}


def test_github(spark):
    md = rendered(spark, "github")
    assert md[1] == "| Name | Age | City |\n| --- | --- | --- |\n| Alice | 30 | New York |\n| Bob | 25 |  |"
    assert md[2].endswith("| Zoë | 7 | Köln\\|West |")


def test_pipe_aligns_numbers_right(spark):
    assert rendered(spark, "pipe")[1] == ("| Name   |   Age | City     |\n|:-------|------:|:---------|\n"
                                          "| Alice  |    30 | New York |\n| Bob    |    25 |          |")


def test_grid(spark):
    assert rendered(spark, "grid")[1] == (
        "+--------+-------+----------+\n| Name   |   Age | City     |\n+========+=======+==========+\n"
        "| Alice  |    30 | New York |\n+--------+-------+----------+\n| Bob    |    25 |          |\n+--------+-------+----------+")


def test_html(spark):
    md = rendered(spark, "html")[2]
    assert md.startswith("<table>\n  <thead>\n    <tr>\n      <th>Name</th>") and md.endswith("</tr>\n  </tbody>\n</table>")


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        tb.render_table(tb.to_rows(people(spark), "doc", "no", ["Name"]), "latex")


@RUNS
@given(st.lists(st.tuples(WORD, WORD, WORD), min_size=1, max_size=12))
def test_markdown_round_trip(spark, data):
    data = [("h" + a, "k" + b, c) for a, b, c in data]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(data)], "doc int, no int, a string, b string, c string")
    rows = tb.to_rows(df, "doc", "no", ["a", "b", "c"])
    md = tb.render_table(rows).select("doc_id", "markdown")
    found = tb.find_md_tables(md, "markdown")
    back = {(r.row_index, r.col_index): r.text for r in tb.md_table_cells(found).collect()}
    want = {(0, i): n for i, n in enumerate("abc")}
    want |= {(i + 1, j): v for i, r in enumerate(data) for j, v in enumerate(r)}
    assert back == want


def test_large_table_comes_in_parts_that_join_to_the_whole(spark, monkeypatch):
    df = spark.range(1000).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("no"), F.col("id").cast("string").alias("v"))
    rows = tb.to_rows(df, "doc", "no", ["v"])
    whole = tb.render_table(rows, "html").collect()
    monkeypatch.setattr(tb, "ROWS_PER_PART", 64)
    for fmt, one in (("html", whole[0].markdown), ("grid", None), ("github", None)):
        parts = tb.render_table(rows, fmt).orderBy("part").collect()
        assert len(parts) == 16
        joined = "\n".join(p.markdown for p in parts)
        assert joined.count("\n") > 1000 and (one is None or joined == one)


def test_wide_sheet(spark):
    df = spark.range(1).select(F.lit(1).alias("doc"), F.lit(1).alias("no"), *[F.lit(i).alias(f"Col{i}") for i in range(150)])
    md = tb.table_or_note(tb.to_cells(df, "doc", "no", [f"Col{i}" for i in range(150)]), 100).first().markdown
    assert md.startswith("*Table too wide (150 columns), showing first 100 columns*\n\n| Col0 |") and "Col99" in md and "Col100" not in md


def test_md_tables(spark):
    text = ("p\n| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n\n| x | y |\n| :-- | --: |\n| 1 | 2 |\n|  | 4 |\n| only | line |x\n|---|\n")
    rows = tb.find_md_tables(spark.createDataFrame([(5, text)], "doc_id int, text string")).orderBy("table_index").collect()
    assert [(r.table_index, r.col_count, r.row_count, r.data_row_count) for r in rows] == [(0, 3, 2, 1), (1, 2, 3, 2)]


def test_csv_quotes(spark):
    text = 'a,b,c\r\n1,"x, ""y""",\n"multi\nline",2,3\n,,\n'
    got = {}
    for r in csv_cells(spark.createDataFrame([("f", text)], "doc_id string, content string")).collect():
        got.setdefault(r.row_index, {})[r.col_index] = r.text
    assert [list(dict(sorted(v.items())).values()) for _, v in sorted(got.items())] == [
        ["a", "b", "c"], ["1", 'x, "y"', ""], ["multi\nline", "2", "3"], ["", "", ""]]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_csv_files_in_splits(spark, tmp_path, split):
    """Files cut anywhere give the cells of the whole text, whatever their quotes do."""
    rng = random.Random(split)
    texts = ["", "\n\n", "a,b\n1,2", 'a,"b\nc"\n"d\n\n""e"",",f\r\n\r\ng\r\n', 'open,"never\nclosed,x\n\n"",y\nlast', 'x"y"z,"q"w"e\nr,"', "é,ü\n", 'h\n"a\n\nb",c\n"u\nv\n']
    for _ in range(25):
        texts.append("".join(rng.choice(['"', '""', ",", "\n", "\n\n", "\r\n", "ab", "c", ' "']) for _ in range(rng.randint(1, 60))))
    (tmp_path / "in").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / "in" / f"{i}.csv").write_bytes(t.encode("latin-1") if i == 6 else t.encode())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, content string")
    want = sorted((r.doc_id, r.row_index, r.col_index, r.text, r.is_header) for r in csv_cells(docs).collect())
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = scan_csv_cells(spark, str(tmp_path / "in")).withColumn("n", F.regexp_extract("doc_id", "([0-9]+)[.]csv$", 1).cast("int"))
        assert sorted((r.n, r.row_index, r.col_index, r.text, r.is_header) for r in got.collect()) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_large_csv_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f'{i},"two{chr(10) if i % 5 == 0 else " "}lines"\n' for i in range(20_000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        records = csv_records(spark, str(tmp_path))
        assert records.agg(F.count("*"), F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first()[:] == (20_000, 0, 19_999, 20_000)
        assert records.where("row_index = 15005").first().rec == '15005,"two\nlines"'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize("mode, want", [
    ("combined", "# Excel Workbook: w.xlsx\n*Contains 2 sheet(s)*\n\n## Sheet: One\nA\n\n\n---\n\n## Sheet: Two\nB\n\n\n---\n\n"),
    ("separate", "# One\n\nA\n\n\n\n# Two\n\nB\n\n"),
    ("selected", "# One\n\nA\n\n\n\n# Two\n\nB\n\n\n\n"),
])
def test_workbook_modes(spark, mode, want):
    df = spark.createDataFrame([(1, "w.xlsx", 1, "Two", 0, "B"), (1, "w.xlsx", 0, "One", 0, "A")],
                               "doc_id int, name string, sheet_index bigint, sheet string, part bigint, markdown string")
    assert tb.workbook_markdown(df, mode).first().markdown == want


def test_column_widths_hold_across_parts(spark, monkeypatch):
    """A part whose rows lack a column is still padded to the width other parts give it."""
    monkeypatch.setattr(tb, "ROWS_PER_PART", 4)
    cells = [(1, 0, r, 0, str(r), False) for r in range(12)] + [(1, 0, 9, 1, "a long one", False)]
    df = spark.createDataFrame(cells, "doc_id int, table_index bigint, row_index bigint, col_index bigint, text string, is_header boolean")
    lines = "\n".join(r.markdown for r in tb.render_table(df, "pipe").orderBy("part").collect()).split("\n")
    assert len(lines) == 12 and len({len(x) for x in lines}) == 1 and lines[9] == "|  9 | a long one |"


def test_md_table_cells_do_not_carry_the_table(spark):
    """What holds for the whole table is found before its lines are rows: no line is joined with the text, or cuts it again."""
    md = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(3000))
    blocks = spark.createDataFrame([(1, 0, md), (1, 1, "| a |\n| b |"), (2, 0, None)], "doc_id long, table_index long, markdown string").repartition(2)
    cells = tb.md_table_cells(blocks)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(split(") <= 1 and plan.index("element_at(split(") > plan.rindex("Generate posexplode"), plan
    got = cells.groupBy("doc_id", "table_index").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_header").alias("h")).collect()
    assert sorted((r.doc_id, r.table_index, r.n, r.h) for r in got) == [(1, 0, 6002, 2), (1, 1, 2, 0)]
