"""Packages, batch conversion, data formats, errors and streams."""

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioweave.catalog import packages as made
from folioweave.operators import outcome
from folioweave.options import Options
from folioweave.plans.batch import convert_corpus
from folioweave.plans.pages import pages_to_results
from folioweave.session import shared_dir
from folioweave.sources import files, packages as pk
from folioweave.sources.markup_data import deep_json, scan_json, scan_xml
from folioweave.streaming import jobs

ROWS = [(1, "Ann & Co", "ONE"), (2, "Bob", "TWO")]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<!doctype html><h1>Hi</h1><p>there</p>")
    (tmp_path / "sub" / "b.htm").write_text("<html><p>deep</p></html>")
    (tmp_path / "book.xlsx").write_bytes(made._zip(made._workbook(ROWS, 1)))
    (tmp_path / "doc.docx").write_bytes(made._zip(made._document(ROWS, 2)))
    (tmp_path / "renamed.bin").write_bytes(made._zip(made._document(ROWS, 3)))
    (tmp_path / "data.csv").write_text("k,v\n1,x\n")
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 cut short")
    (tmp_path / "note.txt").write_text("plain words")
    (tmp_path / "data.json").write_text('{"a": 1}')
    return str(tmp_path)


def test_scan_corpus(spark, folder):
    names = lambda df: sorted(os.path.basename(r.path) for r in df.select("path").collect())
    assert names(files.scan_corpus(spark, folder, "*.{html,htm}")) == ["a.html"]
    assert names(files.scan_corpus(spark, folder, "*.{html,htm}", recursive=True)) == ["a.html", "b.htm"]


def test_batch(spark, folder):
    corpus = files.scan_corpus(spark, folder, "*", recursive=True).select("path", "content")
    got = {os.path.basename(r.path): r for r in convert_corpus(corpus).collect()}
    assert got["a.html"].markdown == "# Hi\n\nthere" and got["b.htm"].markdown == "deep"
    assert got["doc.docx"].markdown == "## Part 2\n\nAnn & Co ONE\n\nBob TWO"
    assert got["renamed.bin"].file_type == "docx" and got["renamed.bin"].markdown.startswith("## Part 3")
    assert "## Sheet: Data 1" in got["book.xlsx"].markdown and "| 1 | Ann & Co |" in got["book.xlsx"].markdown
    assert got["data.csv"].markdown == "| k | v |\n| --- | --- |\n| 1 | x |"
    assert got["data.json"].markdown == '```json\n{"a": 1}\n```'
    assert got["bad.xlsx"].error == "Failed to read XLSX" and got["bad.xlsx"].markdown is None
    assert got["note.txt"].file_type == "unknown" and got["note.txt"].error.startswith("Could not determine file type")
    again = convert_corpus(corpus.where("path like '%note.txt'"), Options(text_passthrough=True)).first()
    assert again.markdown == "plain words" and again.error is None


def test_whole_documents(spark):
    """Text anywhere in a Word file; sheets with gaps, without cells, and unreadable ones."""
    w = f'xmlns:w="{made.WORD}"'
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    body = (
        '<w:p w:rsid="1"/><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Tides &amp; moons</w:t></w:r></w:p>'
        '<w:p><w:r><w:t xml:space="preserve">See </w:t></w:r><w:hyperlink><w:r><w:t>the log</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>, now</w:t></w:r></w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
        f"<w:sdt><w:sdtContent>{p('controlled')}</w:sdtContent></w:sdt>"
        f"<w:tbl><w:tr><w:tc>{p('Boat')}</w:tc><w:tc>{p('a|b')}{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('Tern')}</w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>loud</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve"> too</w:t></w:r><w:r><w:br/><w:t>next</w:t></w:r></w:p>')
    docx = made._zip({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    df = spark.createDataFrame([("d.docx", bytearray(docx))], "path string, content binary")
    got = [(r.level, r.text) for r in pk.scan_docx_blocks(pk.explode_archive(df)).orderBy("block_no").collect()]
    assert got == [(None, ""), (1, "Tides & moons"), (None, "See the log, now"), (None, "controlled"),
                   (None, "| Boat | a\\|b c |\n| --- | --- |\n| Tern |  |"), (None, "  - **loud** **too**\nnext")]
    cell = lambda ref, x, more="": f'<c r="{ref}"{more}>{x}</c>'
    sheet = "".join([
        f'<row r="1">{cell("A1", "<is><r><t>Bo</t></r><r><t>at</t></r></is>", " t=" + chr(34) + "inlineStr" + chr(34))}{cell("D1", "<v>7</v>")}</row>',
        f'<row r="2">{cell("A2", "<v>45296</v>", " s=" + chr(34) + "1" + chr(34))}{cell("B2", "<v>1</v>", " t=" + chr(34) + "b" + chr(34))}{cell("C2", "<v>45296.5</v>", " s=" + chr(34) + "2" + chr(34))}</row>'])
    parts = made._workbook(ROWS, 1) | {
        "xl/workbook.xml": f'<workbook xmlns="{made.MAIN}" xmlns:r="{made.REL}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(("Gaps", "None", "Torn"), 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="urn:rel">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{made.MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{made.MAIN}"><sheetData>{sheet}</sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet xmlns="{made.MAIN}"><sheetData/></worksheet>', "xl/worksheets/s3.xml": "<worksheet><sheetData><row"}
    df = spark.createDataFrame([("in/b.xlsx", bytearray(made._zip(parts)))], "path string, content binary")
    md = convert_corpus(df).first().markdown
    assert "*Contains 3 sheet(s)*" in md and "## Sheet: None\n*Empty sheet*" in md and "## Sheet: Torn\n*Sheet could not be read*" in md
    assert "| Boat |  |  | 7 |" in md and "| 2024-01-05 | True | 2024-01-05 12:00:00 |" in md


def test_nested_word_markup(spark):
    """Depths of paragraphs, runs and tables; what tracked changes took away; properties of older versions; notes; rows of all widths."""
    p, t = made._par, lambda *rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    bold = "<w:r><w:rPr><w:b/>{}</w:rPr><w:t>{}</w:t></w:r>"
    box = f"<w:r><w:pict><w:txbxContent>{p('one')}<w:p><w:pPr><w:rPr><w:b/></w:rPr></w:pPr>{bold.format('', 'two')}</w:p></w:txbxContent></w:pict></w:r>"
    body = (
        f"<w:p><w:r><w:t>a</w:t></w:r>{box}<w:r><w:t>z</w:t></w:r></w:p>"
        f"{t([p('h')], [p('x') + t([t([p('deep')]) + p('|')], [p('er')]) + p('y'), p('n'), ''], [''])}"
        f"<w:p><w:pPr><w:pStyle w:val='Old' /><w:pPrChange><w:pPr><w:pStyle w:val='Zzz'/><w:numPr/></w:pPr></w:pPrChange></w:pPr>"
        f"{bold.format('<w:rPrChange><w:rPr><w:i/></w:rPr></w:rPrChange>', 'b')}<w:r><w:rPr><w:b w:val='0'/></w:rPr><w:t> c</w:t></w:r></w:p>"
        f"<w:moveFrom>{p('gone')}</w:moveFrom><w:p title='a > b'><w:r><w:t>x</w:t><w:tab/><w:t>&lt;y&gt;</w:t><w:noBreakHyphen/><w:instrText>no</w:instrText></w:r><w:r><w:endnoteReference w:id='7'/></w:r></w:p>"
        f"<!-- {p('comment')} -->{p('last')}")
    parts = {"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>",
             "word/endnotes.xml": f"<w:endnotes><w:endnote w:id='7'>{p('first')}{p('second')}</w:endnote></w:endnotes>", "word/footnotes.xml": "<w:footnotes"}
    df = spark.createDataFrame([("d.docx", bytearray(made._zip(parts))), ("e.docx", bytearray(made._zip({"word/document.xml": ""}))), ("f.docx", bytearray(b"x"))],
                               "path string, content binary")
    got = [(r.block_no, r.style, r.text) for r in pk.scan_docx_blocks(pk.explode_archive(df)).orderBy("block_no").collect()]
    assert got == [
        (0, None, "az"), (1, None, "one"), (2, None, "**two**"), (3, "Table", "| h |  |\n| --- | --- |\n| x deep \\| er y | n |"),
        (4, "Old", "**b** c"), (5, None, "x\t<y>-[^e7]"), (6, None, "last"), (7, "Endnote", "[^e7]: first second")]
    rows = [[p(f"r{i}")] for i in range(3000)]
    many = spark.createDataFrame([("m.docx", bytearray(made._zip({"word/document.xml": t(*rows)})))], "path string, content binary")
    assert pk.scan_docx_blocks(pk.explode_archive(many)).first().text.count("\n") == 3000


def test_archive_members(spark):
    df = spark.createDataFrame([("a.zip", bytearray(made._zip({"x.txt": "one", "d/y.xml": "<a/>"}))), ("b.zip", bytearray(b"nope"))], "path string, content binary")
    rows = {(r.path, r.member): r for r in pk.explode_archive(df).collect()}
    assert bytes(rows[("a.zip", "x.txt")].content) == b"one" and rows[("b.zip", None)].error.startswith("not a ZIP archive")
    only = pk.explode_archive(df.where("path = 'a.zip'"), r"\.xml$").collect()
    assert [r.member for r in only] == ["d/y.xml"]
    read = {r.member: r.content for r in pk.explode_archive(df.where("path = 'a.zip'"), read=r"\.xml$").collect()}
    assert read["x.txt"] is None and bytes(read["d/y.xml"]) == b"<a/>"


def test_damaged_member_is_a_row(spark):
    body = bytearray(made._zip({"x.txt": "word " * 200, "ok.txt": "fine"}))
    body[45] ^= 0xFF
    rows = {r.member: r for r in pk.explode_archive(spark.createDataFrame([("a.zip", body)], "path string, content binary")).collect()}
    assert rows["x.txt"].error and bytes(rows["ok.txt"].content) == b"fine"


def test_selected_sheets(spark):
    df = spark.createDataFrame([("w.xlsx", bytearray(made._zip(made._workbook(ROWS, 1))))], "path string, content binary")
    cells = pk.scan_xlsx_cells(pk.explode_archive(df), ["Keys"])
    assert {r.sheet for r in cells.collect()} == {"Keys"}


def test_content_types_tell_packages_apart(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("[Content_Types].xml", "... presentationml ...")
    df = spark.createDataFrame([("p", bytearray(buf.getvalue()))], "path string, content binary")
    assert pk.package_subtype(pk.explode_archive(df)).first().package_type == "pptx"
    assert pk.with_package_type(df).first().package_type == "pptx"


def test_both_ways_of_typing_packages_agree(spark):
    corpus = made.corpus(spark, "/root/testdata/sf0.001")
    a = {r.path: r.package_type for r in pk.package_subtype(pk.explode_archive(corpus)).collect()}
    b = {r.path: r.package_type for r in pk.with_package_type(corpus).collect()}
    assert all(b[k] == v for k, v in a.items()) and set(b) >= set(a) and "Exchange" not in (
        pk.with_package_type(spark.createDataFrame([("p", bytearray(b""))], "path string, content binary"))
        ._jdf.queryExecution().executedPlan().toString())


def test_json_and_xml(spark):
    df = spark.createDataFrame([(1, '{"name": "n", "value": 3, "items": ["a", "b"], "none": null}'), (2, "not { json }"), (3, "7"), (4, '{"a":1}}')], "id int, s string")
    rows = {(r.id, r.path): (r.value, r.error) for r in scan_json(df, "id", "s").collect()}
    assert rows[(1, "items[1]")] == ("b", None) and rows[(1, "value")] == ("3", None) and rows[(3, "")] == ("7", None)
    assert rows[(2, "")][1] == rows[(4, "")][1] == "invalid JSON"
    deep = "[" * 9 + "1" + "]" * 9
    assert scan_json(spark.createDataFrame([(1, deep)], "id int, s string"), "id", "s").first()[1:3] == ("[0]" * 9, "1")
    x = spark.createDataFrame([(1, "<r><i a='1'>text</i><i/></r>"), (2, "<r><i>x</r>"), (3, "<r/>")], "id int, x string")
    got = scan_xml(x, "id", "x").orderBy("id").collect()
    assert [(r.id, r.text, r.error) for r in got] == [(1, "text", None), (2, None, "invalid XML")]


def _flat(v, path=""):
    """Leaves of a parsed document with their paths."""
    if isinstance(v, dict) and v:
        return [x for k, w in v.items() for x in _flat(w, f"{path}.{k}" if path else k)]
    if isinstance(v, list) and v:
        return [x for i, w in enumerate(v) for x in _flat(w, f"{path}[{i}]")]
    return [(path, "{}" if v == {} else "[]" if v == [] else None if v is None else v if isinstance(v, str) else json.dumps(v))]


def test_json_of_any_depth(spark):
    rng = random.Random(1)

    def made_up(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            return rng.choice([1, -20, True, None, "x", "a[b]", '"q" \\ é\n', "", {}, []])
        some = [made_up(depth - 1) for _ in range(rng.randint(0, 3))]
        return some if kind < 0.6 else {rng.choice("abcd") + str(i): v for i, v in enumerate(some)}

    whole = [made_up(rng.randint(0, 9)) for _ in range(60)]
    texts = {i: json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(whole)}
    want = sorted((i, p, v, None) for i, w in enumerate(whole) for p, v in _flat(w))
    df = spark.createDataFrame(list(texts.items()), "id int, s string")
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted(map(tuple, scan_json(df, "id", "s").collect()), key=key) == sorted(want, key=key)
    direct = deep_json(df.selectExpr("id as key", "'' as path", "s as text"))
    assert sorted(map(tuple, direct.collect()), key=key) == sorted(want, key=key)


def test_json_validity(spark):
    """Texts changed at random: valid where the standard parser says so, by either way."""
    rng = random.Random(2)
    seeds = ['{"a": [1, {"b": "x"}, []], "c": -1.5e3}', '[[1, 2], {"k": {"l": null}}, "s"]', '{"x": {"y": [true, false]}}']
    texts = []
    for _ in range(300):
        t = list(rng.choice(seeds))
        for _ in range(rng.randint(1, 2)):
            t[rng.randrange(len(t))] = rng.choice(["", "[", "]", "{", "}", ",", ":", '"', "1", "0", " ", "e", "-", ".", "\\"])
        texts.append("".join(t))

    def valid(t):
        def once(pairs):
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError
            return dict(pairs)

        try:
            json.loads(t, object_pairs_hook=once, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    want = {i for i, t in enumerate(texts) if not valid(t)}
    assert 50 < len(want) < 290
    direct = deep_json(df.selectExpr("id as key", "'' as path", "s as text"))
    assert {r["key"] for r in direct.where("error is not null").collect()} == want
    assert {r["id"] for r in scan_json(df, "id", "s").where("error is not null").collect()} == want


def test_json_plan_does_not_depend_on_the_documents(spark):
    small = spark.createDataFrame([(1, "[1]")], "id int, s string")
    deep = spark.createDataFrame([(1, "[" * 5000 + "]" * 5000), (2, "[" * 60), (3, "[" * 3000), (4, '{"a":' * 1200 + "1" + "}" * 1200)], "id int, s string")
    lines = [len(scan_json(df, "id", "s")._jdf.queryExecution().optimizedPlan().toString().split("\n")) for df in (small, deep)]
    assert lines[0] == lines[1]
    got = {r["id"]: r for r in scan_json(deep, "id", "s").collect()}
    assert got[1]["path"] == "[0]" * 4999 and got[1]["value"] == "[]" and got[2]["error"] == got[3]["error"] == "invalid JSON"
    assert got[4]["path"] == ".".join(["a"] * 1200) and got[4]["value"] == "1"


def test_fail_fast(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert {r.id: r.status for r in outcome.guard(df, "v", F.lit("bad")).collect()} == {1: "ok", 2: "error"}
    with pytest.raises(PySparkException):
        outcome.guard(df, "v", F.lit("bad row"), fail_fast=True).collect()


def test_first_success(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, None, None)], "id int, a string, b string")
    got = {r.id: r.r for r in df.select("id", outcome.first_success([("A", F.col("a")), ("B", F.col("b"))]).alias("r")).collect()}
    assert (got[1].value, got[1].converter) == ("a", "A") and (got[2].value, got[2].converter) == ("b", "B")
    assert got[3].value is None and got[3].error == "all converters failed: A, B"


def test_export_files(spark, tmp_path):
    df = spark.createDataFrame([("x/a.md", "# A"), ("b.md", "# B")], "name string, body string")
    files.export_files(df, str(tmp_path), "name", "body")
    assert (tmp_path / "x" / "a.md").read_text() == "# A" and (tmp_path / "b.md").read_text() == "# B"
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


def test_json_export_splits_children_of_a_large_document(spark, monkeypatch):
    monkeypatch.setattr(files, "CHILDREN_PER_PART", 10)
    res = spark.createDataFrame([(1, "md", 3), (2, "other", 1)], "doc_id int, markdown string, page_count int")
    img = spark.range(25).select(F.lit(1).alias("doc_id"), F.col("id").alias("image_index"))
    tab = spark.createDataFrame([(2, 0)], "doc_id int, table_index bigint")
    out = files.export_json(res, img, tab)
    n = F.size(F.from_json("json", "images array<struct<image_index:bigint>>")["images"])
    assert sorted((r.doc_id, r.part, r.n) for r in out.select("doc_id", "part", n.alias("n")).collect()) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]


# ---------------------------------------------------------------- streams


def test_stream_converts_each_page_once_and_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    src, out = str(tmp_path / "in"), shared_dir(spark, "once")
    calls = []

    def convert(df):
        calls.append(df.count())
        return pages_to_results(df).select("doc_id", "markdown")

    def run():
        stream = jobs.stream_pages(spark, src).withColumn("doc_id", F.col("page_id"))
        jobs.convert_stream(stream, f"{out}/r", f"{out}/c", lambda d: convert(d)).awaitTermination()

    pages.where("page_id < 20").write.parquet(src)
    run()
    pages.where("page_id >= 10 and page_id < 30").write.mode("append").parquet(src)  # ten old ones again
    run()
    got = jobs.read_results(spark, f"{out}/r")
    want = pages_to_results(pages.where("page_id < 30")).select("doc_id", "markdown")
    assert calls == [20, 10] and got.count() == 30
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_terminal_state_wins(spark):
    ev = spark.createDataFrame([(1, "pending", 0.0, "m", 1), (1, "completed", 1.0, "done", 2), (1, "processing", 0.5, "late", 3), (2, "pending", 0.0, "m", 1)],
                               "job_id int, status string, progress double, message string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.job_id: r.status for r in jobs.job_status(ev).collect()} == {1: "completed", 2: "pending"}


def _feed(spark, tmp_path, name, batches, schema):
    src = str(tmp_path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(src)
        yield src


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    day = 86400
    batches = [[("op", 1.0, 10), ("op", 2.0, day + 7200)], [("op", 100.0, 20), ("op", 4.0, 3 * day)], [("op", 1.0, 9 * day)]]
    out = shared_dir(spark, "late")
    for src in _feed(spark, tmp_path, "late", batches, "operation string, duration double, t int"):
        s = spark.readStream.schema("operation string, duration double, t int, ts timestamp").parquet(src)
        jobs.run_available(jobs.perf_window(s, "1 day", "1 hour"), f"{out}/r", f"{out}/c")
    got = {r.window_start.strftime("%d"): (r["count"], r.total) for r in spark.read.parquet(f"{out}/r").collect()}
    assert got["01"] == (1, 1.0) and got["02"] == (1, 2.0) and got["04"] == (1, 4.0)


def test_dedup_ttl_forgets_after_the_ttl(spark, tmp_path):
    hour = 3600
    batches = [[("k", 5 * hour)], [("k", 6 * hour)], [("z", 80 * hour)], [("k", 81 * hour)]]
    out = shared_dir(spark, "ttl")
    for src in _feed(spark, tmp_path, "ttl", batches, "key string, t int"):
        s = spark.readStream.schema("key string, t int, ts timestamp").parquet(src)
        jobs.run_available(jobs.dedup_ttl(s, ["key"], "ts", "24 hours"), f"{out}/r", f"{out}/c")
    assert sorted((r.key, r.t) for r in spark.read.parquet(f"{out}/r").collect()) == [("k", 5 * hour), ("k", 81 * hour), ("z", 80 * hour)]


def test_job_machine_rejects_and_forgets(spark, tmp_path):
    """Events of several micro-batches: backward, late and ended ones are reported, and state goes in the end."""
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [
        [(1, "processing", day(1, 5)), (1, "pending", day(1, 4)), (2, "processing", day(1, 5)), (3, "odd", day(1))],
        [(1, "pending", day(1, 6)), (1, "processing", day(1, 1)), (1, "completed", day(1, 7)), (2, "failed", day(1, 6))],
        [(1, "processing", day(1, 8)), (9, "pending", day(9))], [(8, "pending", day(10))], [(2, "pending", day(10)), (1, "pending", day(10))]]
    schema = "job_id long, status string, progress double, message string, ts timestamp"
    for rows in batches:
        spark.createDataFrame([(j, st, 0.5, "m", t) for j, st, t in rows], "job_id long, status string, progress double, message string, t string").selectExpr(
            "job_id", "status", "progress", "message", "cast(t as timestamp) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = jobs.job_transitions(stream, 2 * 24 * 3600 * 1000).writeStream.outputMode("update").foreachBatch(
        lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = [(r.job_id, r.status, str(r.ts)[8:13], r.rejected) for r in spark.read.parquet(out).orderBy("batch", "job_id", "ts").collect()]
    assert got == [
        (1, "pending", "01 04", None), (1, "processing", "01 05", None), (2, "processing", "01 05", None), (3, "odd", "01 00", "unknown"),
        (1, "processing", "01 01", "late"), (1, "pending", "01 06", "backward"), (1, "completed", "01 07", None), (2, "failed", "01 06", None),
        (1, "processing", "01 08", "ended"), (9, "pending", "09 00", None), (8, "pending", "10 00", None), (1, "pending", "10 00", None), (2, "pending", "10 00", None)]


def test_contents_are_converted_once(spark, tmp_path):
    """Changed content of a known id is converted, known content of a new id is not, a second run adds what is new."""
    root, ran = str(tmp_path / "r"), []

    def convert(df):
        ran.extend(r["content"] for r in df.select("content").collect())
        return df.select("content_hash", F.upper("content").alias("text"))

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("doc_id long, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        for q in jobs.convert_contents(stream, root, convert):
            assert q.awaitTermination(120)
        return {r.doc_id: r.text for r in jobs.current_results(spark, root).collect()}

    arrive([(1, "a"), (2, "a"), (3, "b"), (4, None)])
    arrive([(5, "a"), (3, "c"), (6, "c")])
    assert run() == {1: "A", 2: "A", 3: "C", 5: "A", 6: "C"} and sorted(ran) == ["a", "b", "c"]
    arrive([(3, "b"), (7, "d")])
    assert run() == {1: "A", 2: "A", 3: "B", 5: "A", 6: "C", 7: "D"} and sorted(ran) == ["a", "b", "c", "d"]


def test_expiry_leaves_kept_days_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(96).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) as converted_at")
    jobs.write_dated(rows, path)
    files_of = lambda: {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files_of()
    for _ in range(2):  # again changes nothing
        jobs.expire_dated(spark, path, "2024-01-04 12:00:00", 36)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(48, 96))
    jobs.expire_dated(spark, path, "2024-01-04 12:30:00", 24)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(61, 96))
    after = files_of()
    assert {f for f in before if "01-04" in f} <= after and not any("01-01" in f or "01-02" in f for f in after)


def test_rows_counted_while_they_are_written(spark, tmp_path):
    out = str(tmp_path)
    assert files.write_observed(spark.range(37).toDF("id"), f"{out}/a", f"{out}/m", "write", {"kind": "x"})["rows"] == "37"
    files.write_observed(spark.range(0).toDF("id"), f"{out}/b", f"{out}/m", "write")
    assert sorted(r.attrs["rows"] for r in spark.read.parquet(f"{out}/m").collect()) == ["0", "37"]
