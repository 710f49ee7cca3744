"""Column functions against Python and hand-made values."""

import base64
import datetime
from html import unescape
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave import functions as fn
from folioweave.operators.markup import token_texts

RUNS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=60)


def values(spark, items, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


@RUNS
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_word_count_and_strip_equal_python(spark, items):
    assert values(spark, items, fn.word_count) == [len(t.split()) for t in items]
    assert values(spark, items, fn.strip) == [t.strip() for t in items]


@RUNS
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_tokens_joined_are_the_input(spark, items):
    marked = [t.replace("a", "<b>").replace("e", "</p x='1'>").replace("o", "<") for t in items]
    assert values(spark, marked, lambda v: F.array_join(token_texts(v), "")) == marked


@RUNS
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20))
def test_data_uri_round_trip(spark, items):
    back = values(spark, items, lambda v: fn.parse_data_uri(fn.to_data_uri(F.lit("png"), v))["bytes"], "binary")
    assert [bytes(b) for b in back] == items


@RUNS
@given(st.lists(st.lists(st.sampled_from(["text\n", "\n", "```py\n", "```\n", "- a\n"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_tidy_has_no_triple_newline_and_is_idempotent(spark, items):
    # fences at line starts, as Markdown has them
    once = values(spark, items, fn.tidy_markdown)
    assert all("\n\n\n" not in t and t == t.strip() for t in once)
    assert values(spark, once, fn.tidy_markdown) == once


def test_tidy_headings(spark):
    assert values(spark, ["a\n\n\n\n# H\nb\n\n\n- x\n"], fn.tidy_markdown) == ["a\n\n# H\n\nb\n\n- x"]


def test_resolve_url_equals_urljoin(spark):
    base = "http://a.example/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "//h.example/x", "?y", "g?y", "#s", "g#s", "", "..", "../", "../g", "../..", "../../g",
            "../../../g", "/./g", "/../g", "g.", "./g/.", "g/../h", "mailto:x@y", "https://z.example/a/../b", "a//b", "g?", "g#"]
    assert values(spark, refs, lambda r: fn.resolve_url(F.lit(base), r)) == [urljoin(base, r) for r in refs]
    for other in ("https://example.com/docs/", "file:///corpus/a/b/c/page.html", "http://h.example"):
        # above the root of a file address the RFC and urljoin part ways; ours follows the RFC
        some = [r for r in refs if not (other.startswith("file:") and r == "/../g")]
        assert values(spark, some, lambda r: fn.resolve_url(F.lit(other), r)) == [urljoin(other, r) for r in some]
    assert values(spark, ["/../g"], lambda r: fn.resolve_url(F.lit("file:///a/b"), r)) == ["file:///g"]


def test_html_unescape_equals_python(spark):
    items = ["a &amp; b", "&amp;lt;", "&lt;x&gt;", "&eacute;&copy;", "&#233;&#xE9;&#x1F389;", "&unknown; &", "no entity", "&#0;"]
    assert values(spark, items, fn.html_unescape) == [unescape(t) for t in items]


def test_decode_text_falls_back_to_latin1(spark):
    assert values(spark, ["café".encode(), "café".encode("latin-1")], fn.decode_text, "binary") == ["café", "café"]


def test_pdf_date(spark):
    items = ["D:20240131123059+01'00'", "20240131", "D:2024", "20240231", "x", None, "D:20240101126160", "D:202401"]
    d = datetime.datetime
    assert values(spark, items, fn.pdf_date) == [
        d(2024, 1, 31, 12, 30, 59), d(2024, 1, 31), d(2024, 1, 1), None, None, None, None, d(2024, 1, 1)]


def test_estimates(spark):
    two_mb = 2 * 1024 * 1024
    row = spark.range(1).select(
        fn.estimate_seconds(F.lit(".xlsx"), F.lit(two_mb)).alias("a"), fn.estimate_seconds(F.lit(".mp3"), F.lit(two_mb)).alias("b"),
        fn.estimate_seconds(F.lit(".pdf"), F.lit(0), F.lit(10), "ocr_pages").alias("c"),
        fn.estimate_seconds(F.lit(".pdf"), F.lit(0), F.lit(None).cast("int"), "text_pages").alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (1.0, 5.0, 30.0, 10.0)
    with pytest.raises(ValueError):
        fn.estimate_seconds(F.lit(".pdf"), F.lit(1), rule="nope")


def test_image_dims(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000640000000A0802000000")
    bmp = b"BM" + bytes(16) + (300).to_bytes(4, "little") + (7).to_bytes(4, "little")
    got = values(spark, [png, bmp, b"\xff\xd8\xff", b""], fn.image_dims, "binary")
    assert [(g.format, g.width, g.height) for g in got] == [("png", 100, 10), ("bmp", 300, 7), ("unknown", 0, 0), ("unknown", 0, 0)]


def test_broken_base64_is_null_not_a_failure(spark):
    got = values(spark, ["data:image/png;base64,@@", "data:text/plain,a%20b+c", "plain"], fn.parse_data_uri)
    assert got[0].bytes is None and bytes(got[1].bytes) == b"a b+c" and got[2] is None
    assert base64.b64decode("aGk=") == b"hi"
