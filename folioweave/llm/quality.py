"""Quality: Bradley-Terry ranking from preference pairs over text features, cut at a quantile of the scores.

A document's strength is a linear function of its features. Of a labelled good and a
labelled bad document the first is preferred; the strengths are learned by logistic
loss on feature differences, so that only the order of documents matters. The score
on 0 to 1 puts the threshold, a quantile of the strengths of the labelled documents,
at 0.7.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import bound_batches, checkpointed, fold_of

FOLDS = 4
HELD_OUT = 2
SAMPLE = 20_000   # labelled rows whose features are fitted
PAIRS = 60_000    # preference pairs drawn from them
CUT = 0.7         # score of the threshold

_SHAPES = ("symbols", "digits", "upper", "blanks", "punctuation", "bangs", "bars", "mean_word", "long_words", "type_share",
           "top_share", "stutter", "pairs_seen", "lines_again", "short_lines", "words")
_SYMBOLS = re.compile(r"[#$%&*+/<=>@\\^_`{|}~\[\]]")


def features(text: str | None) -> np.ndarray:
    """Shares between 0 and 1 that do not depend on the language; all zero without a word."""
    out = np.zeros(len(_SHAPES), np.float32)
    words = (text or "").split()
    if not words:
        return out
    n, size, lines = len(words), len(text), [x for x in text.split("\n") if x.strip()]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = np.bincount(ids)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.bincount(codes[codes < 128], minlength=128)
    letters = max(1, int((lengths.sum())))
    out[:] = (
        len(_SYMBOLS.findall(text)) / size,
        ascii_[48:58].sum() / size,
        ascii_[65:91].sum() / letters,
        1 - letters / size,
        (ascii_[44] + ascii_[46] + ascii_[58] + ascii_[59]) / n,
        ascii_[33] / n,
        ascii_[124] / n,
        min(1.0, lengths.mean() / 20),
        (lengths > 20).mean(),
        len(numbers) / n,
        counts.max() / n,
        (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        min(1.0, np.log1p(n) / 12),
    )
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row, from its whole text; one pass."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tolist() for g in got], pa.list_(pa.float32()))], names=["doc_id", "x"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, x array<float>")


def expanded(x: np.ndarray) -> np.ndarray:
    """Each feature and whether it is well above or below usual: its square root and its square."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(x), x**2], axis=1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    spread: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (expanded(x) - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 in the order of the strengths; the threshold is at CUT."""
        z = (self.strength(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 5, rounds: int = 25, decay: float = 1e-4) -> Ranking:
    """Weights under which preferred documents win their pairs: mini-batch descent with momentum on the logistic loss."""
    wide = expanded(x)
    rank = Ranking(wide.mean(axis=0), wide.std(axis=0) + 1e-6, np.zeros(wide.shape[1]))
    z = (wide - rank.mean) / rank.scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return rank
    rng = np.random.default_rng(seed)
    one, other = rng.choice(good, pairs), rng.choice(bad, pairs)
    speed = np.zeros_like(rank.weights)
    for step in range(rounds):
        order = rng.permutation(pairs)
        for lo in range(0, pairs, 20_000):
            part = order[lo:lo + 20_000]
            diff = z[one[part]] - z[other[part]]
            miss = 1 / (1 + np.exp(np.clip(diff @ rank.weights, -500, 500)))  # chance that the other one wins
            speed = 0.9 * speed + (miss @ diff / len(part) - decay * rank.weights)
            rank.weights += 0.3 / (1 + step / 10) * speed
    return rank


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learn from labelled rows outside the held-out fold.

    `rows`: doc_id, x. The weights come from at most `sample` labelled rows in the
    order of a hash of the id; the quantile from all of them: it is the share of label
    0, so as many labelled documents fall below it as are labelled bad. With rows of one
    label only, all documents are equal and score as that label says.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "quality in (0, 1)").where(fold_of("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ready = checkpointed(rows.where("doc_id is not null").join(known, "doc_id"))
    got = ready.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("x", "quality").collect()
    if not got:
        return Ranking(np.zeros(len(_SHAPES) * 3), np.ones(len(_SHAPES) * 3), np.zeros(len(_SHAPES) * 3), threshold=1.0)
    x, y = np.array([r["x"] for r in got], np.float32), np.array([r["quality"] for r in got])
    rank = bradley_terry(x, y)
    if len(set(y)) < 2:
        rank.threshold = -1.0 if y[0] else 1.0
        return rank
    held = rows.sparkSession.sparkContext.broadcast(rank)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = held.value.strength(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(s), b.column(1)], names=["s", "quality"])

    s = ready.select("x", "quality").mapInArrow(strengths, "s double, quality int")
    share = ready.agg((1 - F.avg("quality")).alias("bad")).first()["bad"]
    # the cut lies halfway between the quantiles of what remains on either side
    low, high = s.agg(F.percentile_approx("s", [max(0.0, share * 0.98), min(1.0, share * 1.02)], 100_000)).first()[0]
    sides = s.groupBy("quality").agg(F.percentile_approx("s", 0.5, 10_000).alias("mid")).collect()
    mid = {r["quality"]: r["mid"] for r in sides}
    rank.threshold = (low + high) / 2
    rank.spread = max(abs(mid[1] - mid[0]) / 8, 1e-6)
    return rank


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(_SHAPES))


def ranked(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and quality_score of every row of `docs`; null and empty texts are scored like any other.

    The texts are read once; fitting and scoring use the features. Rows of one id are
    scored each by its own text, and labels that contradict each other count as 0.
    """
    rows = checkpointed(with_features(docs))
    rank = fit(rows, labels, sample)
    held = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(_matrix(b.column(1))))], names=["doc_id", "quality_score"])

    return rows.mapInArrow(run, "doc_id long, quality_score double")
