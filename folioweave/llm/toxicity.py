"""Toxicity: a convolutional text classifier with hashed word embeddings, in numpy.

A word's vector is the sum of three hashed embedding rows: of the word, of its first
four and of its first five characters, so that inflected forms share what they have in
common and two words meet only if all three rows do. Filters of one, two and three
words run over the whole text; the largest response of each filter, rectified, feeds a
logistic output. The filters are applied to the embedding rows of each distinct word
once, so a text costs a few gathers a word, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import bound_batches, checkpointed, fold_of, free_names, stored, text_slices

ROWS = 1 << 16          # embedding rows of each of the three tables
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12            # filters of each width
SAMPLE = 4000           # labelled rows that are fitted, half of each label where there are as many
SAMPLE_CHARS = 16_000_000  # characters of whole texts that are fitted
FOLDS = 5
HELD_OUT = 0
_CUTS = np.linspace(0.3, 0.7, 41)
LEAST_PER_LANG = 40     # labelled rows of each label that a language needs for a threshold of its own
_WORD = re.compile(r"\w+")
_CACHE = 200_000        # distinct words whose filter responses a task keeps


def word_rows(word: str) -> tuple[int, int, int]:
    """Rows of the three embedding tables."""
    return (crc32(word.encode("utf-8", "surrogatepass")) % ROWS, crc32(word[:4].encode("utf-8", "surrogatepass"), 1) % ROWS,
            crc32(word[:5].encode("utf-8", "surrogatepass"), 2) % ROWS)


class Vocabulary(dict):
    """Word -> number, in order of arrival; the rows of each number."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = [(0, 0, 0)]  # number 0 is the blank around a text

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.rows)
        self.rows.append(word_rows(word))
        return number

    def numbers(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


@dataclass
class Network:
    tables: np.ndarray    # 3 x ROWS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray      # of all filters
    out: np.ndarray
    base: float

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.05, (3, ROWS, DIM)).astype(np.float32),
            [rng.normal(0, 0.4 / w**0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(FILTERS * len(WIDTHS), np.float32),
            rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of numbered words; number 0 is zero."""
        v = self.tables[0][rows[:, 0]] + self.tables[1][rows[:, 1]] + self.tables[2][rows[:, 2]]
        v[0] = 0
        return v

    def responses(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Per width and offset: the part of a filter's response that a word gives at that offset."""
        return [[vectors @ f[j] for j in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def pooled(self, parts: list[list[np.ndarray]], flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text and the position it starts at.

        `flat` holds the texts one after the other, each with max(WIDTHS) blanks
        before it and at least one word (a blank if it has none).
        """
        top, at = [], []
        ends = np.append(starts[1:], len(flat))
        for w, part in zip(WIDTHS, parts):
            # a window may begin in the blanks before its text and end in those before the next one
            conv = part[0][flat]
            for j in range(1, w):
                conv[:-j] += part[j][flat[j:]]
            conv[len(flat) - w + 1:] = -1e9
            most = np.maximum.reduceat(conv, starts, axis=0)
            top.append(most)
            at.append((conv, ends))
        return np.concatenate(top, axis=1), at

    def score(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.bias, 0) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_PAD = max(WIDTHS) - 1


def _packed(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, blanks before each and after the last; their starts."""
    blank = np.zeros(_PAD, np.int32)
    parts, starts, at = [], [], 0
    for d in docs:
        starts.append(at)
        parts += [blank, d if len(d) else np.zeros(1, np.int32)]
        at += _PAD + max(1, len(d))
    return np.concatenate([*parts, blank]), np.array(starts)


def train(texts: list[str], labels: np.ndarray, seed: int = 7, steps: int = 500, batch: int = 32, rate: float = 0.02) -> Network:
    """Adagrad on the logistic loss; only the words that won a filter get a gradient.

    Whole rounds over the rows until `steps` batches are reached.
    """
    net, words = Network.fresh(seed), Vocabulary()
    docs = [words.numbers(t) for t in texts]
    rows = np.array(words.rows, np.int64)
    rng = np.random.default_rng(seed)
    memory = {"tables": np.full_like(net.tables, 1e-3), "filters": [np.full_like(f, 1e-3) for f in net.filters],
              "bias": np.full_like(net.bias, 1e-3), "out": np.full_like(net.out, 1e-3)}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)

    def move(value: np.ndarray, past: np.ndarray, gradient: np.ndarray) -> None:
        past += gradient**2
        value -= rate * gradient / np.sqrt(past)

    for _ in range(-(-steps * batch // len(docs))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            chosen = order[lo:lo + batch]
            flat, starts = _packed([docs[i] for i in chosen])
            seen, local = np.unique(flat, return_inverse=True)
            blank = int(np.searchsorted(seen, 0))  # 0 is always there
            vectors = net.tables[0][rows[seen, 0]] + net.tables[1][rows[seen, 1]] + net.tables[2][rows[seen, 2]]
            vectors[blank] = 0
            top, convs = net.pooled(net.responses(vectors), local, starts)
            hidden = np.maximum(top + net.bias, 0)
            error = (net.score(top) - labels[chosen]) * weight[chosen] / len(chosen)
            d_hidden = np.outer(error, net.out) * (hidden > 0)
            d_vectors = np.zeros_like(vectors)
            for k, w in enumerate(WIDTHS):
                conv, ends = convs[k]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(net.filters[k])
                where = np.stack([a + conv[a:b].argmax(axis=0) for a, b in zip(starts, ends)])  # texts x filters
                texts_at, live = np.nonzero(d_hidden[:, own])
                d, at = d_hidden[:, own][texts_at, live], where[texts_at, live]
                for j in range(w):
                    tokens = local[np.minimum(at + j, len(local) - 1)]
                    np.add.at(grad[j].T, live, d[:, None] * vectors[tokens])
                    np.add.at(d_vectors, tokens, d[:, None] * net.filters[k][j].T[live])
                move(net.filters[k], memory["filters"][k], grad)
            move(net.out, memory["out"], hidden.T @ error)
            net.base -= rate * float(error.sum()) * 5
            move(net.bias, memory["bias"], d_hidden.sum(axis=0))
            d_vectors[blank] = 0
            used = np.flatnonzero(np.abs(d_vectors).sum(axis=1))
            for t in range(3):
                at, back = np.unique(rows[seen[used], t], return_inverse=True)
                total = np.zeros((len(at), DIM), np.float32)
                np.add.at(total, back, d_vectors[used])
                memory["tables"][t][at] += total**2
                net.tables[t][at] -= rate * total / np.sqrt(memory["tables"][t][at])
    return net


class Scorer:
    """Scores of whole texts; keeps the filter responses of words it has seen."""

    def __init__(self, net: Network) -> None:
        self.net, self.words, self.parts, self.done = net, Vocabulary(), None, 0

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words.rows) > _CACHE:
            self.words, self.parts = Vocabulary(), None
        docs = [self.words.numbers(t) for t in texts]
        have = 0 if self.parts is None else len(self.parts[0][0])
        if have < len(self.words.rows):
            rows = np.array(self.words.rows[have:], np.int64)
            v = self.net.tables[0][rows[:, 0]] + self.net.tables[1][rows[:, 1]] + self.net.tables[2][rows[:, 2]]
            if not have:
                v[0] = 0
            new = self.net.responses(v)
            self.parts = new if not have else [
                [np.concatenate([a, b]) for a, b in zip(old, add)] for old, add in zip(self.parts, new)]
        out = np.empty(len(docs))
        for i, d in enumerate(docs):
            flat, _ = _packed([d])
            top = [self._best(flat, w, part) for w, part in zip(WIDTHS, self.parts)]
            out[i] = self.net.score(np.concatenate(top)[None, :])[0]
        return out

    @staticmethod
    def _best(flat: np.ndarray, width: int, part: list[np.ndarray], block: int = 4096) -> np.ndarray:
        """Largest response of one width in one text, block by block, so that a long text needs no more memory."""
        best = None
        for lo in range(0, len(flat) - width + 1, block):
            hi = min(lo + block, len(flat) - width + 1)
            conv = part[0].take(flat[lo:hi], axis=0)
            for j in range(1, width):
                conv += part[j].take(flat[lo + j:hi + j], axis=0)
            top = conv.max(axis=0)
            best = top if best is None else np.maximum(best, top)
        return best


def _threshold(counts: np.ndarray) -> float:
    """Middle of the cut range with the most right answers, within 0.3 to 0.7.

    `counts`: rows of each label (two lines) that reach 0, 1, .. all of the cuts.
    """
    right = counts[0].cumsum()[:-1] + counts[1][::-1].cumsum()[::-1][1:]
    return float(_CUTS[right == right.max()].mean())


@dataclass
class Model:
    net: Network
    cut: float                  # of the scores of the network; maps to a score of 0.5
    thresholds: dict[str, float]  # of the final score, by language


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled rows outside the held-out fold; of contradicting ones the toxic one holds."""
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "toxic in (0, 1)").where(fold_of("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[Network, list[int] | None]:
    """The network, and the ids whose texts it was fitted to (None: all of a sample too small to hold any back).

    The sample is at most `sample` labelled rows outside the held-out fold, in the order
    of a hash of the id, and at most SAMPLE_CHARS characters; whole texts, those that no
    longer fit are passed over. A fifth of it is not fitted. Of rows repeated under one
    id with different texts the one whose text has the smallest hash counts.
    """
    known = _known(labels)
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = [known.where(f"toxic = {v}").orderBy(order, "doc_id").limit(sample // 2) for v in (0, 1)]
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most `sample` ids are broadcast
    rows = have.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("r"))
    rows = checkpointed(rows.select("doc_id", "toxic", "r.text").withColumn("place", order))
    total, taken = 0, []
    for r in rows.select("place", "doc_id", F.length("text").alias("n")).orderBy("place", "doc_id").collect():
        if total + r["n"] <= SAMPLE_CHARS:
            total += r["n"]
            taken.append(r["doc_id"])
    got = rows.where(F.col("doc_id").isin(taken)).collect() if taken else []  # at most `sample` ids
    got.sort(key=lambda r: (r["place"], r["doc_id"]))
    y = np.array([r["toxic"] for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        net = Network.fresh(seed)
        net.out[:] = 0
        share = float(y.mean()) if len(y) else 0.0
        net.base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return net, []
    fit_on = np.flatnonzero(np.arange(len(got)) % 5 != 0)
    if len(set(y[fit_on])) < 2:
        return train([r["text"] for r in got], y, seed), None
    return train([got[i]["text"] for i in fit_on], y[fit_on], seed), [got[i]["doc_id"] for i in fit_on]


def calibrated(net: Network, fitted: list[int] | None, raw: DataFrame, labels: DataFrame) -> Model:
    """Cut and thresholds from all labelled rows outside the fold that were not fitted.

    `raw`: doc_id, lang, raw (the network's score) of all rows; only these narrow rows
    are joined with the labels. A language with too few rows of a label takes the fitted
    ones too. Without rows of both labels there is nothing to calibrate.
    """
    if not net.out.any():
        return Model(net, 0.5, {})
    scored = checkpointed(raw.groupBy("doc_id").agg(F.min(F.struct("raw", "lang")).alias("r")).select(
        "doc_id", "r.lang", "r.raw").join(_known(labels), "doc_id"))
    fresh = ~F.col("doc_id").isin(fitted) if fitted else F.lit(True)  # at most `sample` ids

    def counted(cut: float) -> dict[tuple[str | None, bool], np.ndarray]:
        """Per language and whether the rows are fresh: rows by label and number of cuts reached."""
        odds = F.col("raw") / (1 - F.col("raw")) * ((1 - cut) / cut)
        reached = sum(((odds / (1 + odds)) >= float(c)).cast("int") for c in _CUTS)
        out: dict[tuple[str | None, bool], np.ndarray] = {}
        for r in scored.groupBy("lang", fresh.alias("fresh"), "toxic", reached.alias("reached")).count().collect():
            out.setdefault((r["lang"], r["fresh"]), np.zeros((2, len(_CUTS) + 1), np.int64))[r["toxic"], r["reached"]] += r["count"]
        return out

    every = [c for (_, new), c in counted(0.5).items() if new]
    if not every:
        return Model(net, 0.5, {})
    cut = _threshold(sum(every))
    tables, own = counted(cut), {}
    for lang in sorted({lang for lang, _ in tables if lang}):
        some = [tables[lang, new] for new in (True, False) if (lang, new) in tables]
        for mine in ([tables[lang, True]] if (lang, True) in tables else []) + [sum(some)]:
            if mine.sum(axis=1).min() >= LEAST_PER_LANG:
                own[lang] = _threshold(mine)
                break
    return Model(net, cut, own)


def _with_raw(docs: DataFrame, net: Network, keep: list[str], name: str, lang: str) -> DataFrame:
    """The columns `keep` of `docs`, the score of the network, and the language; texts are scored whole, nothing is shuffled."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(net)  # ROWS * DIM * 3 floats, 12.6 MB, whatever the input
    plain = [f"c{i}" for i in range(len(keep))]  # names with dots cannot travel
    wanted = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, plain)], F.col("text").cast("string").alias("text"),
                         (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            texts, raw = b.column(len(keep)), np.empty(b.num_rows)
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                for x, y in text_slices(part):
                    raw[lo + x:lo + y] = scorer(part[x:y])
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(np.clip(raw, 1e-9, 1 - 1e-9)), b.column(len(keep) + 1)],
                                             names=[*plain, "raw", "lang"])

    schema = T.StructType([*[T.StructField(p, docs.schema[c].dataType) for c, p in zip(keep, plain)],
                           T.StructField("raw", T.DoubleType()), T.StructField("lang", T.StringType())])
    return wanted.mapInArrow(run, schema).toDF(*keep, name, lang)


def _judged(model: Model, raw: str, lang: str) -> tuple[Column, Column]:
    """Final score and rejection as column expressions over the network's score."""
    odds = (1 - F.col(raw)) / F.col(raw) * (model.cut / (1 - model.cut))
    score = 1 / (1 + odds)
    cut = F.lit(0.5)
    if model.thresholds:
        by = F.create_map(*[F.lit(v) for pair in model.thresholds.items() for v in pair])
        cut = F.coalesce(F.try_element_at(by, F.col(lang)), cut)
    return score, score >= cut


def classified(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, names: tuple[str, str] = ("tox_score", "tox_reject"),
               sample: int = SAMPLE) -> DataFrame:
    """The columns `keep` of `docs` (all) with a score and a rejection; every text is scored once.

    What the network says is written beside the kept columns; the thresholds and the
    results are taken from there. A null text counts as empty. A row is rejected at the
    threshold of its language, 0.5 where that is null or had too few labels. Kept columns
    of those names are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in names]
    raw, lang, doc = free_names([*keep, *names], "tox_raw", "tox_lang", "tox_doc")
    net, fitted = trained(docs, labels, sample)
    table = stored(_with_raw(docs.withColumn(doc, F.col("doc_id").cast("bigint")), net, [*keep, doc], raw, lang), "toxicity")
    model = calibrated(net, fitted, table.select(F.col(doc).alias("doc_id"), F.col(lang).alias("lang"), F.col(raw).alias("raw")), labels)
    score, reject = _judged(model, raw, lang)
    return table.select(*[F.col(f"`{c}`") for c in keep], score.alias(names[0]), reject.alias(names[1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """A model for other tables: trained on a bounded sample, calibrated on all labelled rows outside the held-out fold.

    Null labels and rows without a text take no part. Without rows of both labels every
    score is the share of label 1 (0 if there are none).
    """
    net, fitted = trained(docs, labels, sample, seed)
    narrow = stored(_with_raw(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), net, ["doc_id"], "raw", "lang"), "toxicity")
    return calibrated(net, fitted, narrow, labels)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("tox_score", "tox_reject")) -> DataFrame:
    """`docs` with a score (0 to 1) and a rejection added; one pass, nothing is shuffled. Columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in names]
    raw, lang = free_names([*keep, *names], "tox_raw", "tox_lang")
    found = _with_raw(docs, model.net, keep, raw, lang)
    score_, reject = _judged(model, raw, lang)
    return found.select(*[F.col(f"`{c}`") for c in keep], score_.alias(names[0]), reject.alias(names[1]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, all their columns, whatever these are called."""
    names = free_names(docs.columns, "tox_score", "tox_reject")
    return classified(docs, labels, names=tuple(names)).where(~F.col(names[1])).select(*[F.col(f"`{c}`") for c in docs.columns])
