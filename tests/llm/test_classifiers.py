"""Quality and toxicity: held-out accuracy, gradients, and what odd inputs give."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import quality as Q
from folioweave.llm import queries
from folioweave.llm import toxicity as X

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, lang string, tox_score int, x string", "doc_id long, quality int, toxic int"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("name,column,folds,out,cut", [("op1_quality", "quality", 4, 2, 0.7), ("op8_toxicity", "toxic", 5, 0, 0.5)])
def test_held_out(spark, name, column, folds, out, cut):
    got = queries.QUERIES[name][0](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert ((got["score"] >= cut).astype(int) == got["predicted"]).all()
    assert (got["held_out"] == [fold(i, folds) == out for i in got["doc_id"]]).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    both = both[both["held_out"]]
    assert (both["predicted"] == both[column]).mean() >= 0.95
    assert auc(both["score"].to_numpy(), both[column].to_numpy()) >= (0.98 if name == "op1_quality" else 0.8)


def test_ranking_keeps_order_only():
    rng = np.random.default_rng(0)
    x = rng.random((400, len(Q._SHAPES))).astype(np.float32)
    y = (x[:, 0] + 0.3 * x[:, 3] < 0.6).astype(int)
    rank = Q.bradley_terry(x, y, 4000)
    assert auc(rank.strength(x), y) > 0.98
    s = rank.score(x)
    assert ((s >= Q.CUT) == (rank.strength(x) >= rank.threshold)).all()


def test_network_learns_stems_anywhere():
    rng = np.random.default_rng(1)
    plain = ["w" + "".join(rng.choice(list("abcdef"), 4)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 60))
        if i % 2:
            words[rng.integers(60)] = "vilex" + "".join(rng.choice(list("xyz"), 3))
        texts.append(" ".join(words))
        labels.append(i % 2)
    net = X.train(texts[:300], np.array(labels[:300], np.float32), steps=200)
    assert auc(X.Scorer(net)(texts[300:]), np.array(labels[300:])) > 0.97


def test_pooling_by_block_is_pooling_at_once():
    net, words = X.Network.fresh(3), X.Vocabulary()
    numbers = words.numbers(" ".join(f"t{i % 700}" for i in range(9000)))
    parts = net.responses(net.vectors(np.array(words.rows)))
    flat, starts = X._packed([numbers])
    whole, _ = net.pooled(parts, flat, starts)
    cut = np.concatenate([X.Scorer._best(flat, w, p, 1000) for w, p in zip(X.WIDTHS, parts)])
    assert np.allclose(whole[0], cut, atol=1e-5)


def test_edges(spark):
    rows = [(i, f"{'good' if i % 3 else 'b#d%%'} text number {i} " * (1 + i % 4), "en", 1, "x") for i in range(80)]
    rows += [(None, None, None, None, None), (90, "", "en", 1, "x"), (91, None, "xx", 1, "x"), (1, "other text", "en", 1, "x"), (92, "long " * 300_000, "en", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(80)] + [(None, 1, 1), (91, 1, 0), (5, None, None), (1, 1, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    ones = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    for lab in (labels, none, ones):
        got = Q.ranked(docs, lab).collect()
        assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got)
        kept = X.drop_toxic(docs, lab)
        assert kept.columns == docs.columns and kept.where("tox_score = 1 or tox_score is null").count() == kept.count()
    assert X.score(docs, X.fit(docs, none)).where("tox_reject").count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert Q.ranked(empty, labels).count() == 0 and X.drop_toxic(empty, labels).count() == 0


def test_long_text_ends_no_sample(spark, monkeypatch):
    """A labelled text beyond the character bound, first in the order of the sample, is passed over alone."""
    ids = [r["id"] for r in spark.range(80).orderBy(F.xxhash64("id", F.lit(7))).collect() if fold(r["id"], X.FOLDS) != X.HELD_OUT]
    monkeypatch.setattr(X, "SAMPLE_CHARS", 5000)
    rows = [(i, "word " * 2000 if i == ids[0] else f"{'vile' if i % 2 else 'kind'} text {i}", "en", 1, "x") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], LABELS)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["tox_reject"] for r in X.score(docs, X.fit(docs, labels)).collect()}
    assert sum(got[i] == bool(i % 2) for i in ids[1:]) >= 0.9 * len(ids[1:])


def test_thresholds_from_all_labelled_rows(spark):
    """A language with few rows in the fitting sample and many labelled ones has a threshold of its own; a rare one has none."""
    rows = [(i, f"{'vile' if i % 2 else 'kind'} text {i}", "es" if i % 8 < 2 else "xx" if i % 100 == 4 else "en", 1, "x") for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1200)], LABELS)
    model = X.fit(spark.createDataFrame(rows, DOCS), labels, sample=200)
    assert set(model.thresholds) == {"en", "es"}
    # all rows of both labels fitted or kept back: the fitted ones count where the others are too few
    assert set(X.fit(spark.createDataFrame(rows, DOCS), labels).thresholds) == {"en", "es"}


def naive_scores(net, texts):
    """The network as a loop over all positions of a text, one filter at a time."""
    out = []
    for text in texts:
        words = X._WORD.findall((text or "").lower())
        vectors = [sum(net.tables[t][r] for t, r in enumerate(X.word_rows(w))) for w in words] or [np.zeros(X.DIM, np.float32)]
        blank = [np.zeros(X.DIM, np.float32)] * (max(X.WIDTHS) - 1)
        line, z, k = [*blank, *vectors, *blank], net.base, 0
        for f in net.filters:
            for j in range(f.shape[2]):
                most = max(sum(float(line[p + i] @ f[i, :, j]) for i in range(len(f))) for p in range(len(line) - len(f) + 1))
                z += max(0.0, most + float(net.bias[k])) * float(net.out[k])
                k += 1
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


def test_scores_against_a_loop_over_positions():
    rng = np.random.default_rng(4)
    net = X.Network.fresh(5)
    net.bias[:] = rng.normal(size=len(net.bias))
    net.base = 0.3
    texts = ["", None, "one", "two words", " ".join(f"w{rng.integers(50)}" for _ in range(400)), "Ünï cödé, x_1 - y!"]
    got = X.Scorer(net)(texts)
    want = naive_scores(net, texts)
    # a window of blanks alone stands before and after a text of one word, and in a text of none
    assert np.allclose(got, want, atol=1e-5)


def test_one_pass_is_fit_and_score(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} text {i}", "en" if i % 3 else "fr", 1, "x") for i in range(600)] + [(3, "vile other", "en", 1, "x"), (None, None, None, 2, "y")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], LABELS)
    once = X.classified(docs, labels, ["doc_id", "x"])
    assert once.columns == ["doc_id", "x", "tox_score", "tox_reject"]
    twice = X.score(docs, X.fit(docs, labels)).select("doc_id", "x", "tox_score", "tox_reject")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    odd = docs.select("*", *[F.lit("mine").alias(c) for c in ("tox_raw", "tox_reject", "tox_lang", "tox_doc", "scored_text", "scored_lang", "raw", "a.b")])
    kept = X.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < 602 and kept.where("tox_raw = 'mine' and tox_reject = 'mine' and `a.b` = 'mine'").count() == kept.count()
