"""Decontamination against a full edit-distance table."""

import random

import pytest

from folioweave.llm import decontam as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def distance(pattern, text):
    """Least edit distance to any passage, and its first end."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.choice("abc") for _ in range(rng.randint(1, 90))]
        t = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert D.myers(p, t) == distance(p, t)


def fixture(rng):
    items = [(i, " ".join(rng.choice(["red", "blue", "green", "oak", "elm", "fir", "sun"]) + str(rng.randint(0, 30)) for _ in range(n)))
             for i, n in enumerate((1, 2, 4, 5, 9, 20, 33, 50))]
    docs = []
    for d in range(80):
        body = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 40))]
        for _, t in rng.sample(items, 2):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 3))):
                at, what = rng.randrange(len(w)), rng.randint(0, 2)
                w[at:at + (what != 0)] = [] if what == 1 and len(w) > 1 else ["edit"]
            body += w + [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 9))]
        docs.append((d, ", ".join(body).upper()))
    return docs, items


def brute(docs, items):
    out = []
    for d, t in docs:
        w = D.words_of(t)
        for i, p in items:
            p = D.words_of(p)
            got, end = distance(p, w)
            if p and got <= int(D.BUDGET * len(p)):
                out.append((d, i, got, end))
    return sorted(out)


@pytest.mark.parametrize("most", [1000, 3])
def test_against_brute_force(spark, most):
    docs, items = fixture(random.Random(2))
    got = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), most=most)
    want = brute(docs, items)
    assert len(want) > 60 and sorted(tuple(r) for r in got.collect()) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "take THE red, pill now", 1), (None, "the red pill now", 2), (2, None, 3), (3, "", 4), (4, "red", 5),
                                  (1, "take THE red, pill now", 1)], DOCS + ", distance int")
    items = spark.createDataFrame([(7, "The red pill"), (7, "The red pill"), (8, None), (9, "..."), (None, "red")], ITEMS)
    assert sorted(str(tuple(r)) for r in D.contaminated(docs, items).collect()) == ["(1, 7, 0, 4)"] * 2 + ["(None, 7, 0, 3)"]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["distance"] for r in kept.collect()) == [3, 4, 5]
    none = spark.createDataFrame([], ITEMS)
    assert D.contaminated(docs, none).count() == 0 and D.drop_contaminated(docs, none).count() == 6
    assert D.contaminated(spark.createDataFrame([], DOCS), items).count() == 0
