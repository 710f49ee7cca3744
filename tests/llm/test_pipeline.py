"""The pipeline: every stage on its own input, and the whole on a small table with planted cases."""

import random
import re

import pytest

import corpus_pipeline as C
from folioweave.llm import decontam, mixing, passages, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "benchmark decontamination", "mixing to target weights"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = C.run(spark, SF)
    assert out.columns == [*docs.columns, "mix_domain", "mix_tokens", "mix_copies"]
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert ids and len(set(ids)) == len(ids)
    assert decontam.contaminated(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert passages.repeated_passages(out).count() == 0
    assert all(len(r["text"]) == r["n_chars"] for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_empty_and_odd_rows(spark, name):
    stage = dict(C.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, tokens int"
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, words(30), "en", "src1", 5, "s", 1) for i in range(6)] + [(None, words(20), None, None, None, None, None), (9, None, "en", "src0", 0, "s", 1),
                                                                         (10, "", "xx", "src0", 0, "s", 1), (0, "again " + words(9), "en", "src1", 5, "s", 1)]
    got = stage(spark, spark.createDataFrame(rows, schema), SF)
    assert got.columns[:7] == [c.split()[0] for c in schema.split(", ")]
    assert got.count() <= len(rows)


def test_planted_cases(spark):
    """Plain searches on the result of each middle stage."""
    rng = random.Random(2)
    words = lambda n: [("".join(rng.choice("abcdefgh") for _ in range(5))) for _ in range(n)]
    item = "Where did the seven grey ships sail on the first morning after the long storm of the north".split()
    base, part = words(200), words(60)
    texts = {1: base, 2: base, 3: words(40) + part, 4: part + words(40), 5: words(30) + item + words(30), 6: words(80)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    one = {r["doc_id"]: r["text"] for r in simhash.keep_one_each(docs).collect()}
    assert set(one) == {1, 3, 4, 5, 6}
    two = {r["doc_id"]: r["text"].split() for r in passages.cut_repeats(docs.where("doc_id != 2")).collect()}
    assert two == {1: texts[1], 3: texts[3], 4: texts[4][60:], 5: texts[5], 6: texts[6]}
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()} == {1, 2, 3, 4, 6}
    mix = mixing.mixed(docs, mixing.Mix(budget=10**6, epochs=2))
    assert {r["doc_id"]: r["mix_copies"] for r in mix.collect()} == {i: 2 for i in texts}


def test_library_does_not_import_this_folder():
    import pathlib

    root = pathlib.Path(C.__file__).parent / "folioweave"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"folioweave\.llm|corpus_pipeline", f.read_text()), f
