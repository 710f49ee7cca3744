"""Markup fixtures: structure, malformed input, tables, images, links."""

import base64

import pytest

from folioweave.operators import markup as mk
from folioweave.operators.tables import header_row, render_table, table_dims
from folioweave.options import Options
from folioweave.plans.pages import pages_to_results

PNG = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000064000000640802000000")

SAMPLE = """<!DOCTYPE html>
<html><head><title>Harbour Log</title><meta name="author" content="A. Writer">
<meta content="About &amp; more" name="description"><style>p {}</style><script>var x = "</p><h1>no</h1>";</script></head>
<body><!-- hidden <h1>no</h1> --><h1>Tides of March</h1>
<p>A <strong>bold</strong> and <em>slanted</em> word, snake_case * star.</p>
<h2>Low water</h2><ul><li>Ebb<ul><li>early</li><li>late</li></ul></li><li>Flood</li></ul>
<ol><li>first</li><li>second<ol><li>inner</li></ol></li><li>third</li></ol>
<pre><code>def moor():
    return "a*b"</code></pre>
<table><caption>Boats at the quay</caption><thead><tr><th>Boat</th><th>Berth</th><th>Port</th></tr></thead>
<tbody><tr><td>Petrel</td><td>30</td><td>a | b</td></tr><tr><td>Gannet</td><td>25</td></tr></tbody></table>
<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>
<p>Go <a href="https://quay.example/abs">there</a> or <a href='page.html'>here</a> or <a href=/root>root</a>.</p>
</body></html>"""


def pages(spark, *htmls, url="http://host.example/dir/p.html"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def markdown(spark, html, **kw):
    return mk.html_to_markdown(pages(spark, html), **kw).first().markdown


@pytest.fixture(scope="module")
def sample(spark):
    return pages_to_results(pages(spark, SAMPLE)).first()


def test_sample_metadata(sample):
    assert (sample.title, sample.author, sample.subject) == ("Harbour Log", "A. Writer", "About & more")
    assert (sample.page_count, sample.total_links, sample.total_images, sample.total_tables) == (1, 3, 0, 2)


def test_sample_markdown(sample):
    md = sample.markdown
    assert md.startswith("# Tides of March\n\nA **bold** and *slanted* word, snake\\_case \\* star.\n\n## Low water\n\n")
    assert "- Ebb\n  - early\n  - late\n- Flood" in md
    assert "1. first\n2. second\n  1. inner\n3. third" in md
    assert '```\n\ndef moor():\n    return "a*b"\n\n```' in md
    assert "| Boat | Berth | Port |\n| --- | --- | --- |\n| Petrel | 30 | a \\| b |\n| Gannet | 25 |" in md
    assert "[there](https://quay.example/abs) or [here](http://host.example/dir/page.html) or [root](http://host.example/root)." in md
    assert "hidden" not in md and "var x" not in md and "Harbour Log" not in md and "\n\n\n" not in md


def test_malformed_keeps_text(spark):
    md = markdown(spark, "<html><body><p>one<div>two <strong>three<p>four</div> a < b && c")
    assert md == "one\n\ntwo three\n\nfour\n\na < b && c"


@pytest.mark.parametrize("html", ["", None, "<html><body></body></html>", "<!-- open"])
def test_empty(spark, html):
    row = pages_to_results(pages(spark, html)).first()
    assert row.markdown == "" and row.total_words == 0


def test_unclosed_script_runs_to_the_end(spark):
    assert markdown(spark, "<p>a</p><script>if (x < 1) { ") == "a"


def test_unicode_is_kept(spark):
    assert markdown(spark, "<p>你好世界 مرحبا بالعالم 🎉</p>") == "你好世界 مرحبا بالعالم 🎉"


def test_title_falls_back_to_heading(spark):
    assert mk.html_metadata(pages(spark, "<h1>The <b>one</b></h1><p>x")).first().title == "The one"


@pytest.mark.parametrize("page,want", [
    ("<ul><li><p>One</p><p>Two</p></li><li>\n<div>a</div>b</li></ul>", "- One\n  Two\n- a\n  b"),
    ("<blockquote><p>one</p><p>two</p></blockquote><p>out</p>", "> one\n\n> two\n\nout"),
    ("<blockquote>bare</blockquote>x", "> bare\n\nx"),
    ('<p>Go <a title="a > b" href="/x">there</a> <b class=\'1 > 0\'>loud</b></p>', "Go [there](http://host.example/x) **loud**"),
    ("<p>&check; &copy &#150; &notit; &amp;lt;</p>", "✓ © – ¬it; &lt;"),
])
def test_blocks_quotes_and_references(spark, page, want):
    assert markdown(spark, page) == want


def test_base_url(spark):
    page = "<html><head><base href='https://b.example/x/'></head><a href='page.html'>p</a></html>"
    assert mk.extract_links(pages(spark, page)).first().href_resolved == "https://b.example/x/page.html"
    assert mk.extract_links(pages(spark, page), "https://quay.example/log/").first().href_resolved == "https://quay.example/log/page.html"


def test_unclosed_anchor_does_not_swallow_the_next(spark):
    rows = mk.extract_links(pages(spark, "<a href=a>one <a href=b>two</a> rest")).orderBy("link_index").collect()
    assert [(r.href_raw, r.text) for r in rows] == [("a", "one"), ("b", "two")]


def test_tables(spark):
    toks = mk.tokenize_html(pages(spark, SAMPLE), clustered=True)
    cells = mk.extract_html_tables(toks)
    assert mk.table_captions(toks).collect() == [(0, 0, "Boats at the quay")]
    dims = {r.table_index: r for r in table_dims(cells).collect()}
    assert (dims[0].row_count, dims[0].col_count, dims[0].headers) == (3, 3, ["Boat", "Berth", "Port"])
    assert (dims[1].row_count, dims[1].col_count, dims[1].headers) == (2, 2, [])
    md = {r.table_index: r.markdown for r in render_table(cells.select("*")).collect()}
    assert md[0] == "| Boat | Berth | Port |\n| --- | --- | --- |\n| Petrel | 30 | a \\| b |\n| Gannet | 25 |  |"
    assert md[1] == "| 1 | 2 |\n| 3 | 4 |"
    heads = header_row(cells).where("in_header").groupBy("table_index").count().collect()
    assert heads == [(0, 3)]


def test_nested_table_cells_belong_to_the_inner_table(spark):
    toks = mk.tokenize_html(pages(spark, "<table><tr><td>a<table><tr><td>in</td></tr></table>b</td><td>c</td></tr></table>"))
    got = {(r.table_index, r.col_index): r.text for r in mk.extract_html_tables(toks).collect()}
    assert got == {(0, 0): "a b", (0, 1): "c", (1, 0): "in"} or got == {(0, 0): "ab", (0, 1): "c", (1, 0): "in"}


def test_images(spark):
    html = ("<img src='pics/a.gif' alt='Local image'><img src='data:image/png;base64,%s' alt=Data><img src='https://e.example/t.png'><img alt='none'>"
            % base64.b64encode(PNG).decode())
    img = mk.extract_images(pages(spark, html, url="file:///c/d/p.html"))
    rows = {r.kind: r for r in img.collect()}
    assert set(rows) == {"local", "data", "external"}
    assert (rows["data"].format, rows["data"].width, rows["data"].height, rows["data"].size_bytes) == ("png", 100, 100, len(PNG))
    assert rows["external"].original_url == "https://e.example/t.png" and rows["local"].alt_text == "Local image"

    corpus = spark.createDataFrame([("file:///c/d/pics/a.gif", bytearray(b"GIF89a\x05\x00\x06\x00xx"))], "path string, content binary")
    local = {r.kind: r for r in mk.resolve_local_images(img, corpus).collect()}["local"]
    assert (local.format, local.width, local.height, local.name) == ("gif", 5, 6, "a.gif")

    def target(mode, kind):
        return {r.kind: r.md_src for r in mk.apply_image_mode(img, mode).collect()}[kind]

    assert target("embed", "data").startswith("data:image/png;base64,") and target("link", "data") == "images/image_1"
    assert target("separate", "data") is None and target("separate", "external") == "https://e.example/t.png"
    with pytest.raises(ValueError):
        mk.apply_image_mode(img, "nope")


@pytest.mark.parametrize("mode, text", [("embed", "![x](data:image/png;base64,aGk=)"), ("link", "![x](images/image_0)"), ("separate", "")])
def test_image_modes_in_markdown(spark, mode, text):
    assert markdown(spark, "<p><img src='data:image/png;base64,aGk=' alt='x'></p>", image_mode=mode) == text


def test_sections(spark):
    toks = mk.tokenize_html(pages(spark, "<article>A <b>x</b><aside>note</aside> end</article><p>out</p>"))
    got = sorted((r.tag, r.text) for r in mk.semantic_sections(toks).collect())
    assert got == [("article", "A x end"), ("aside", "note")]


def test_options_are_checked_and_immutable():
    with pytest.raises(ValueError):
        Options(strategy="best")
    a = Options()
    b = a.with_(image_mode="embed")
    assert a.image_mode == "link" and a.config_hash() != b.config_hash()
    assert a.with_(enable_cache=False).config_hash() == a.config_hash()


def test_page_job_shuffles_once(spark):
    df = pages_to_results(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_text_scan_reads_two_columns(spark):
    plan = mk.html_to_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "Exchange" not in plan
