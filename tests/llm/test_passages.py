"""Repeated passages: windows against their definition, planted passages against a plain search."""

import random

import numpy as np
import pytest

from folioweave.llm import passages as P

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def exact_repeats(texts, least=50):
    """doc -> word positions that lie in an exact passage of `least` words of a smaller doc."""
    seen, out = {}, {}
    for doc in sorted(texts):
        w = texts[doc].lower().split()
        grams = [tuple(w[i:i + least]) for i in range(len(w) - least + 1)]
        hit = {i + j for i, g in enumerate(grams) if g in seen for j in range(least)}
        if hit:
            out[doc] = hit
        for g in grams:
            seen.setdefault(g, doc)
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_windows_are_maximal_stretches():
    rng = np.random.default_rng(1)
    for n, width, top in ((1, 3, 9), (5, 3, 9), (60, 7, 1000), (200, 8, 4)):
        v = rng.integers(1, top, n).astype(np.uint64)
        at, nodes, first, last = P.compact_windows(v, width)
        assert at.tolist() == [i + int(np.argmin(v[i:i + width])) for i in range(n - width + 1)]
        assert nodes.tolist() == sorted(set(at.tolist()))
        for c, a, b in zip(nodes, first, last):
            a2 = max([i + 1 for i in range(c) if v[i] <= v[c]], default=0)
            b2 = min([i - 1 for i in range(c + 1, n) if v[i] < v[c]], default=n - 1)
            assert (a, b) == (a2, b2)


def test_signatures_do_not_depend_on_neighbours():
    rng = random.Random(2)
    cut = [P.shingles(" ".join(words(rng, n))) for n in (60, 300, 51)]
    which, key, place, body = P.signatures(cut, 46)
    for i, s in enumerate(cut):
        _, k, p, b = P.signatures([s], 46)
        assert set(zip(k, p, b)) == set(zip(key[which == i], place[which == i], body[which == i]))


def test_planted_passages(spark):
    rng = random.Random(5)
    shared = [words(rng, n) for n in (49, 50, 51, 70, 400)]
    texts = {}
    for d in range(60):
        body = words(rng, rng.randint(0, 120))
        for p in rng.sample(shared, rng.randint(0, 2)):
            body += p + words(rng, rng.randint(1, 80))
        texts[d] = " ".join(body)
    texts[60] = texts[3]
    got = covered(P.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA)).collect())
    want = exact_repeats(texts)
    assert set(got) == set(want)
    for d in want:
        assert want[d] <= got[d] and len(got[d] - want[d]) <= 12


def test_fragments_hide_no_passage(spark):
    """A fragment too short to count, in all texts, must not keep longer common passages apart."""
    rng = random.Random(6)
    common, tail = words(rng, 48), [words(rng, 30) for _ in range(4)]
    texts = {d: " ".join(words(rng, 40) + common + (tail[d % 4] if d >= 4 else words(rng, 30)) + words(rng, 20)) for d in range(24)}
    got = covered(P.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA)).collect())
    want = exact_repeats(texts)
    assert set(got) == set(want) == set(range(8, 24))
    assert all(want[d] <= got[d] for d in want)


def test_leads_across_partitions(spark):
    rng = random.Random(9)
    rows = [(5 if rng.random() < 0.4 else rng.randint(-60, 60), rng.randint(0, 300), rng.randint(0, 3) << 14 | 40, 7) for _ in range(3000)]
    rows += [(5, 1, 0, 7), (5, 1, 5 << 14 | 40, 7)]
    lead = {}
    for k, d, p, b in rows:
        lead[k] = min(lead.get(k, (d, p)), (d, p))
    want = sorted((d, lead[k][0], k, p, lead[k][1], p & 16383 == lead[k][1] & 16383) for k, d, p, b in rows if d != lead[k][0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = P._led(spark.createDataFrame(rows, "key long, doc long, place long, body long"), True)[0].select(
            "doc", "other", "key", "place", "place2", "equal").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(tuple(r) for r in got) == want


def test_edited_passage(spark):
    rng = random.Random(7)
    base = words(rng, 300)
    edited = list(base)
    for i in range(20, 300, 60):
        edited[i] = "changed"
    rows = [(1, " ".join(words(rng, 50) + base)), (2, " ".join(edited + words(rng, 50)))]
    got = covered(P.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(got[2] & set(range(300))) > 230 and not got[2] & set(range(306, 350))


def test_cut(spark):
    rng = random.Random(8)
    p = " ".join(words(rng, 60))
    rows = [(1, f"Start here {p} and on", 5, "x"), (2, f"Another\n{p}\nend", 5, None), (3, p, 5, "y"), (4, None, 5, "z"), (5, "", 5, "z"),
            (None, p, 5, "n"), (2, f"Another\n{p}\nend", 5, None), (6, "short", 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = P.cut_repeats(docs)
    assert got.columns == docs.columns
    have = sorted(((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert have == sorted([(-1, p, 5), (1, rows[0][1], 5), (2, "Another\nend", 11), (2, "Another\nend", 11), (4, None, 5), (5, "", 5), (6, "short", 5)], key=str)
    assert P.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text,spans,want", [("a b c d", [(1, 3)], "a d"), (" a\nb  c", [(0, 3)], ""), ("a b c d", [(0, 2), (1, 3)], "d"), ("é ü ö", [(1, 2)], "é ö")])
def test_without_words(text, spans, want):
    assert P.without_words(text, spans) == want


def most_alike(a, b, least):
    """The highest similarity of a stretch of at least `least` shingles of `a`, from a common one to a common one, and any of `b`, by trying all."""
    return max((len(x & y) / len(x | y) for i in range(len(a)) for k in range(i + least, len(a) + 1) if a[i] in b and a[k - 1] in b for x in [set(a[i:k])]
                for p in range(len(b)) for q in range(p + 1, len(b) + 1) for y in [set(b[p:q])]), default=0)


def test_similar_stretch_around_changes_in_the_middle():
    rng = random.Random(10)
    for n in (50, 60, 70, 80, 90):
        for changes in ((n // 2,), (n // 2, n // 2 + 2), (n // 3, 2 * n // 3), (n // 2 - 1, n // 2)):
            one = words(rng, n)
            other = [f"new{i}" if i in changes else w for i, w in enumerate(one)]
            a, b = (P.shingles(" ".join(t)) for t in (other, one))
            whole = len(set(a) & set(b)) / len(set(a) | set(b))
            got = P._alike(a, b, 46, 0.8)
            assert got == (0, n - 4) if whole >= 0.8 else got is None or got[1] - got[0] >= 46


def test_similar_stretch_against_all_stretches():
    rng = random.Random(11)
    seen = set()
    for _ in range(60):
        one = words(rng, 18)
        other = list(one)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(other))
            other[at:at + rng.randint(0, 1)] = words(rng, rng.randint(0, 2))
        other = words(rng, rng.randint(0, 3)) + other + words(rng, rng.randint(0, 3))
        a, b = (P.shingles(" ".join(t), 2) for t in (other, one))
        got = P._alike(a, b, 12, 0.8)
        assert (got is not None) == (most_alike(a.tolist(), b.tolist(), 12) >= 0.8)
        seen.add(got is not None)
    assert seen == {True, False}


def test_changed_word_in_the_middle_of_a_short_passage(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for d in range(40):
        n = rng.choice((60, 70, 80, 90))
        one = words(rng, n)
        other = [*one[:n // 2], "changed", *one[n // 2 + 1:]]
        rows += [(d, " ".join(words(rng, 30) + one + words(rng, 30))), (100 + d, " ".join(words(rng, 20) + other + words(rng, 20)))]
        want[100 + d] = set(range(20, 20 + n))
    got = covered(P.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert set(got) <= set(want) and len(got) >= 34  # candidates come from hashes
    assert all(len(want[d] & got[d]) >= 50 and len(got[d] - want[d]) <= 5 for d in got)


@pytest.mark.parametrize("first", ["same", "other"])
def test_fragment_twice_before_the_copy(spark, first):
    """The copied passage begins with a fragment that its document, or an earlier one with part of it, holds elsewhere too."""
    rng = random.Random(13)
    rows = []
    for d in range(30):
        before, fragment, after = words(rng, 45), words(rng, 44), words(rng, 6)
        front = before + fragment + words(rng, 30)
        middle = words(rng, 30) + (before if first == "other" else []) + fragment + after + words(rng, 30)
        copy = words(rng, 30) + fragment + after + words(rng, 30)
        texts = [front + middle, copy] if first == "same" else [front, middle, copy]
        rows += [(100 * k + d, " ".join(t)) for k, t in enumerate(texts)]
    got = covered(P.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
    want = exact_repeats(dict(rows))
    assert set(got) == set(want) and len(got) == (30 if first == "same" else 60)
    assert all(want[d] <= got[d] for d in want)


def test_short_passages_at_the_limit_meet():
    rng = np.random.default_rng(14)
    met = 0
    for _ in range(1000):
        one = rng.integers(0, 2**63, 46).astype(np.uint64)
        other = one.copy()
        other[rng.choice(46, 5, False)] = rng.integers(0, 2**63, 5).astype(np.uint64)  # 41 / 51 = 0.804
        met += bool(set(P.signatures([one], 46)[1].tolist()) & set(P.signatures([other], 46)[1].tolist()))
    assert met >= 970


def test_stretches_in_order_against_all_stretches():
    rng = random.Random(15)
    seen = set()
    for _ in range(80):
        one = words(rng, 18)
        other = list(one)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(other))
            other[at:at + rng.randint(0, 1)] = words(rng, rng.randint(0, 2))
        other = words(rng, rng.randint(0, 3)) + other + words(rng, rng.randint(0, 3))
        a, b = (P.shingles(" ".join(t), 2) for t in (other, one))
        if len(set(a) & set(b)) < 1:
            continue
        got, _ = P._similar_in_order(a, b, 12, 0.8)
        assert bool(got) == (most_alike(a.tolist(), b.tolist(), 12) >= 0.8)
        assert all(12 <= y - x <= 23 and a[x] in b and a[y - 1] in b for x, y in got)
        seen.add(bool(got))
    assert seen == {True, False}


def test_longest_rise():
    rng = random.Random(16)
    for _ in range(100):
        j = rng.sample(range(12), rng.randint(1, 8))
        got = [j[k] for k in P._longest_rise(np.array(j))]
        some = ([x for k, x in enumerate(j) if m >> k & 1] for m in range(1, 1 << len(j)))
        best = max(len(c) for c in some if c == sorted(c))
        assert len(got) == best and got == sorted(got)


def test_recall_of_similar_passages(spark):
    """Passages of 50 to 120 words with changed, lost and added words, against the similarity of the planted pair."""
    rng = random.Random(17)
    rows, want = [], {}
    for d in range(300):
        n = rng.choice((50, 60, 80, 120))
        one = words(rng, n)
        other = list(one)
        for _ in range(rng.randint(1, 1 + n // 60)):
            at = rng.randrange(len(other))
            other[at:at + rng.randint(0, 1)] = words(rng, rng.randint(0, 1))
        rows += [(d, " ".join(words(rng, 25) + one + words(rng, 25))), (1000 + d, " ".join(words(rng, 25) + other + words(rng, 25)))]
        a, b = (set(P.shingles(" ".join(t)).tolist()) for t in (one, other))
        if min(len(a), len(b)) >= 46 and len(a & b) / len(a | b) >= 0.8:
            want[1000 + d] = set(range(25, 25 + len(other)))
    got = covered(P.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
    hit = [len(got.get(d, set()) & w) >= 45 for d, w in want.items()]
    assert len(want) > 200 and sum(hit) >= 0.95 * len(hit)
    assert all(len(p - want.get(d, p)) <= 8 for d, p in got.items())


def test_repeated_ids_grow_in_proportion(spark):
    """Rows under one doc_id, equal or not, are checked once each."""
    rng = random.Random(18)
    part, own = words(rng, 60), words(rng, 60)
    first = " ".join(words(rng, 30) + part + words(rng, 30))
    second = [" ".join(words(rng, 20) + part + own), " ".join(own + words(rng, 90))]
    checked = []
    keep = P._checked
    sizes = {}
    for n in (10, 200):
        rows = [(1, first)] * n + [(2, second[i % 2]) for i in range(n)] + [(3, second[1])]

        def counted(units, *args):
            checked.append(units.count())
            return keep(units, *args)

        P._checked = counted
        try:
            got = covered(P.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
        finally:
            P._checked = keep
        assert set(range(20, 80)) <= got[2] and set(range(0, 150)) <= got[3]
        sizes[n] = sum(checked)
        checked.clear()
    assert sizes[200] == sizes[10]


def test_columns_named_like_those_added(spark):
    rng = random.Random(19)
    p = " ".join(words(rng, 60))
    docs = spark.createDataFrame([(1, p, "x", "y", "z"), (2, f"own {p}", "x", "y", "z")], "doc_id long, text string, cuts string, of_doc string, `a.b` string")
    got = P.cut_repeats(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, p, "x", "y", "z"), (2, "own", "x", "y", "z")]


def test_clipped_windows_are_those_of_the_tree():
    rng = np.random.default_rng(20)
    for n, width, top in ((3, 3, 9), (60, 7, 1000), (300, 8, 5), (500, 46, 1 << 40)):
        v = rng.integers(1, top, n).astype(np.uint64)
        at, nodes, first, last = P.compact_windows(v, width)
        at2, nodes2, first2, last2 = P.clipped_windows(v, width)
        assert at.tolist() == at2.tolist() and nodes.tolist() == nodes2.tolist()
        assert np.maximum(first, nodes - width + 1).tolist() == first2.tolist()
        assert np.minimum(last, nodes + width - 1).tolist() == last2.tolist()
    assert all(len(x) == 0 for x in P.clipped_windows(np.empty(0, np.uint64), 5))
