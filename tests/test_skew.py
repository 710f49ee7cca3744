"""Hot groups: block-wise operators against brute force, and the plans they run with."""

import random

from pyspark.sql import functions as F

from folioweave.operators import paged as pg
from folioweave.operators.grouping import block_of, running_number, with_group_stats
from folioweave.operators.reuse import convert_once


def skewed(n=600):
    """A third of the rows belong to document 0."""
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 40), i, rnd.random()) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def test_running_number_equals_brute_force(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "doc int, pos int, v double")
    got = {(r.doc, r.pos): r.n for r in running_number(df, ["doc"], ["pos"], [block_of("pos", 16)], "n").collect()}
    want, seen = {}, {}
    for doc, pos, _ in sorted(rows):
        want[(doc, pos)] = seen.get(doc, 0)
        seen[doc] = want[(doc, pos)] + 1
    assert got == want


def test_group_stats_equal_brute_force(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "doc int, pos int, v double")
    out = with_group_stats(df, ["doc"], block_of("pos", 16), {"lo": (F.min, F.col("pos")), "hi": (F.max, F.col("v")), "n": (F.sum, F.lit(1))})
    for r in out.collect():
        mine = [x for x in rows if x[0] == r.doc]
        assert (r.lo, r.hi, r.n) == (min(x[1] for x in mine), max(x[2] for x in mine), len(mine))


def test_no_window_spans_a_whole_group_of_rows(spark):
    df = spark.createDataFrame(skewed(), "doc int, pos int, v double")
    plan = running_number(df, ["doc"], ["pos"], [block_of("pos", 16)], "n")._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert over_rows and all("_b0" in line for line in over_rows)


def test_first_pages_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i, "x") for i in range(50)], "doc_id int, page_number int, text string")
    assert pg.first_pages(df).count() == 3
    plan = pg.first_pages(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_long_document_is_assembled_in_parts(spark):
    df = spark.createDataFrame([(1, i, f"t{i}" if i % 4 else " ") for i in range(1, 301)], "doc_id int, page_number int, text string")
    whole = pg.assemble_pages(df, markers=True, breaks=True).collect()
    parts = pg.assemble_pages(df, markers=True, breaks=True, pages_per_part=32).orderBy("part").collect()
    assert len(whole) == 1 and len(parts) == 10
    assert "\n\n".join(p.markdown for p in parts) == whole[0].markdown
    assert whole[0].markdown.startswith("<!-- Page 1 -->\n\nt1\n\n---\n\n<!-- Page 2 -->")


def test_last_page_has_no_break(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id int, page_number int, text string")
    got = {(r.doc_id, r.page_number): r.break_after for r in pg.page_breaks(df).collect()}
    assert got == {(1, 1): "---", (1, 2): None, (2, 1): None}


def test_copies_are_converted_once(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(300)]
    seen = spark.sparkContext.accumulator(0)

    def work(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf.assign(n=pdf["text"].str.len())[["content_hash", "n"]]

    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = convert_once(df, "text", lambda d: d.mapInPandas(work, "content_hash string, n bigint")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(t) for i, t in rows}
    assert seen.value == 201


def test_word_tokens_keep_their_tasks(spark):
    """Small packed markup is many tokens: its shuffle is not merged into a few tasks."""
    from folioweave.sources import word

    xml = "<w:document><w:body><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>"
    members = spark.createDataFrame([(f"f{i}.docx", "word/document.xml", xml.encode()) for i in range(400)], "path string, member string, content binary")
    placed = word._placed(word._tokens(members)).groupBy(F.spark_partition_id()).count()
    assert placed.count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
