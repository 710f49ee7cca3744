"""Snapshot collapse against a comparison of all conversations, and odd rows."""

import random

from folioweave.llm import chats as C

SCHEMA = "conv_id long, turn long, role string, text string, n_rows string, part string"


def plain(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((C.FIRST if t is None else t, r or "", x or ""))
    convs = {c: sorted(v) for c, v in convs.items()}

    def prefixes(v):
        turns = sorted({t for t, _, _ in v})
        return [tuple(x for x in v if x[0] <= t) for t in turns[:-1]]

    inner = {p for v in convs.values() for p in prefixes(v)}
    out, seen = {}, set()
    for c in sorted(convs):
        v = tuple(convs[c])
        if v not in inner and v not in seen:
            seen.add(v)
            out[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in convs[c])
    return out


def joined(df):
    parts = {}
    for r in df.collect():
        parts.setdefault(r["conv_id"], []).append((r["part"], r["text"]))
    return {c: "".join(t for _, t in sorted(v)) for c, v in parts.items()}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)  # running hashes over several blocks
    monkeypatch.setattr(C, "PART", 4)
    rng = random.Random(1)
    talks = [[(("user", "assistant")[t % 2], rng.choice("abc")) for t in range(rng.randint(1, 12))] for _ in range(12)]
    rows = []
    for c in range(120):
        talk = rng.choice(talks)
        rows += [(c, t, r, x, "n", "p") for t, (r, x) in enumerate(talk[:rng.randint(1, len(talk))])]
    rng.shuffle(rows)
    assert joined(C.rendered(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (2, 0, "user", "a", "", ""), (3, None, "user", "a", "", ""),
            (3, 5, None, None, "", ""), (4, 0, "user", None, "", ""), (4, 0, "system", "s", "", ""), (None, 0, "user", "lost", "", ""),
            (5, 0, "system", "s", "", ""), (5, 0, "user", "", "", ""), (5, 1, "user", "long " * 200_000, "", ""), (6, -7, "", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert joined(C.rendered(df)) == plain(rows)
    same = {r["conv_id"]: (r["n_rows"], r["n_same"]) for r in C.maximal_conversations(df).collect()}
    assert same[1] == (2, 1) and same[2] == (1, 1) and 4 not in same
    assert C.rendered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "user", "xa", "", ""), (2, 0, "userx", "a", "", ""), (2, 1, "user", "b", "", "")]
    assert set(joined(C.rendered(spark.createDataFrame(rows, SCHEMA)))) == {1, 2}


def test_no_python_in_the_plan(spark):
    plan = C.rendered(spark.createDataFrame([(1, 0, "user", "a", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
