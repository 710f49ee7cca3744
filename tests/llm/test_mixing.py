"""Mixing: budgets and prefixes against a plain recursion over the tree, and the registered SQL."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from folioweave.llm import mixing as M
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string"


def fill(budget, kids):
    """{name: (weight, cap)} -> {name: share}: the shortage of each goes to the siblings that have more."""
    got, open_ = {}, {k: v for k, v in kids.items() if v[0] > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        short = {k: c for k, (w, c) in open_.items() if Fraction(budget * w, total) >= c}
        if not short:
            return got | {k: budget * w // total for k, (w, _) in open_.items()}
        first = min(short, key=lambda k: Fraction(short[k], open_[k][0]))
        got[first] = short[first]
        budget -= short[first]
        del open_[first]
    return got


def plain(rows, mix):
    leaves = defaultdict(list)
    for r in rows:
        n = len((r[1] or "").encode().split())
        if n:
            number = int((r[3] or "")[3:] or 0) % 3
            leaves[(("web", "books", "reference")[number], r[2] or M.NONE, r[3] or M.NONE)].append((r[0], n))
    w = lambda level, name: getattr(mix, level).get(name, mix.default)
    cap = {k: mix.epochs * sum(n for _, n in v) for k, v in leaves.items() if w("source", k[2])}
    by = lambda at: {k[:at] for k in cap}
    total = lambda p: sum(c for k, c in cap.items() if k[:len(p)] == p and w("lang", k[1]))
    budget = sum(n for v in leaves.values() for _, n in v) // 2 if mix.budget is None else mix.budget
    tops = {p: (w("domain", p[0]), total(p)) for p in by(1)}
    out = {}
    for d, b in fill(min(budget, sum(c for x, c in tops.values() if x)), tops).items():
        for ln, b2 in fill(b, {p: (w("lang", p[1]), total(p)) for p in by(2) if p[0] == d[0]}).items():
            for leaf, b3 in fill(b2, {k: (w("source", k[2]), c) for k, c in cap.items() if k[:2] == ln}).items():
                full, rest = divmod(b3, sum(n for _, n in leaves[leaf]))
                key = lambda i: hashlib.md5(f"{mix.seed}:{full}:{M.NONE if i is None else i}".encode()).hexdigest()
                keys = sorted((key(i), n) for i, n in leaves[leaf])
                for i, n in leaves[leaf]:
                    copies = full + (sum(m for k, m in keys if k <= key(i)) <= rest)
                    if copies:
                        out[(i, leaf)] = copies
    return out


@pytest.mark.parametrize("mix", [
    M.PRODUCTION, M.Mix(budget=900, epochs=2, domain={"web": 0}, lang={"en": 3}), M.Mix(budget=10**9, epochs=1), M.Mix(budget=0)])
def test_against_plain_recursion(spark, mix):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 1, 5, 40)))), rng.choice(("en", "en", "de", None)),
             rng.choice(("src0", "src0", "src1", "src2", "src4", None)), 0, "x") for i in range(300)]
    rows += [(1, "again here", "en", "src0", 0, "x"), (None, "no id", "en", "src1", 0, "x"), (None, None, None, None, None, None)]
    got = M.mixed(spark.createDataFrame(rows, SCHEMA), mix)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "mix_domain", "mix_tokens", "mix_copies"]
    have = {(r["doc_id"], (r["mix_domain"], r["lang"] or M.NONE, r["source"] or M.NONE)): r["mix_copies"] for r in got.collect()}
    assert have == plain(rows, mix)


def test_shortage_goes_to_siblings_first():
    assert fill(100, {"a": (1, 10), "b": (1, 1000), "c": (2, 1000)}) == {"a": 10, "b": 30, "c": 60}


def test_empty(spark):
    assert M.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = M.mixed(docs, M.PRODUCTION).selectExpr(
        "doc_id", "mix_domain AS domain", "lang", "source", "mix_tokens AS tokens", "mix_copies AS copies")
    assert compare(connect("/root/testdata/sf0.001"), got, M.mix_sql(M.PRODUCTION)) is None


def test_columns_named_like_those_added(spark):
    names = ["full", "_key", "_leaf", "_tokens", "_of", "_full", "_end", "leaf", "tokens", "of", "end", "key", "rest", "slice", "a.b"]
    plain = spark.createDataFrame([(i, f"word {i} and more", "en", f"src{i % 3}") for i in range(40)], "doc_id long, text string, lang string, source string")
    docs = plain.select("*", *[F.lit(777).alias(n) for n in names])
    mix = M.Mix(budget=60)
    got = M.mixed(docs, mix)
    assert got.columns == [*docs.columns, "mix_domain", "mix_tokens", "mix_copies"]
    rows = got.collect()
    assert rows and all(r[n] == 777 for r in rows for n in names)
    bare = {(r["doc_id"], r["mix_copies"]) for r in M.mixed(plain, mix).collect()}
    assert {(r["doc_id"], r["mix_copies"]) for r in rows} == bare
