"""Benchmark decontamination: pieces of the test items by the pigeonhole principle, Myers' bit-parallel distance.

Distances count words. An item of n words may differ in k = floor(budget * n) of them,
so of k + 1 disjoint pieces at least one stands in the text unchanged. Every text is
searched for all pieces at once (one rolling hash per piece length against a sorted
table), and only around a hit is the distance of the item to the best matching passage
computed, one machine operation per word of text for an item of any length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import bound_batches, text_slices

BUDGET = 0.2
BLOCK_CHARS = 8_000_000  # characters of test items that one pass over the documents looks for
BLOCK_ITEMS = 20_000     # and items
_WORD = re.compile(r"\w+")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; case and punctuation do not count."""
    return _WORD.findall((text or "").lower())


def hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n word hashes in a row."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + h[j:len(h) - n + 1 + j]
    return out ^ (out >> _U(29))


def myers(pattern: list, text: list) -> tuple[int, int]:
    """(distance, end): least edit distance of the pattern to any passage of the text, and where the first such ends."""
    m = len(pattern)
    where: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a passage may begin anywhere, so nothing enters below
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Pieces:
    """The test items of one pass: word hashes, budgets and a table of piece hashes for each piece length."""

    items: list[tuple[int, list[int], int]]  # item_id, word hashes, edits allowed
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted hashes, item number, offset

    @classmethod
    def of(cls, rows: list[tuple[int, str]], budget: float) -> Pieces:
        items, found = [], defaultdict(list)
        for item_id, text in rows:
            h = hashes(words_of(text))
            if not len(h):
                continue
            k = int(budget * len(h))
            cut = [i * len(h) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cut, cut[1:]):
                found[b - a].append((int(rolled(h[a:b], b - a)[0]), len(items), a))
            items.append((item_id, h.tolist(), k))
        tables = {}
        for n, pieces in found.items():
            pieces.sort()
            tables[n] = (np.array([p[0] for p in pieces], np.uint64), np.array([p[1] for p in pieces]), np.array([p[2] for p in pieces]))
        return cls(items, tables)

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item number, position at which the item would begin) for each exact piece in the text."""
        for n, (keys, item, offset) in self.tables.items():
            r = rolled(h, n)
            lo = np.searchsorted(keys, r)
            at = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == r)
            for p in at.tolist():
                i = int(lo[p])
                while i < len(keys) and keys[i] == r[p]:
                    yield int(item[i]), p - int(offset[i])
                    i += 1

    def matches(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item within its budget; the nearest, then first, passage."""
        spots = defaultdict(set)
        for i, at in self.hits(h):
            spots[i].add(at)
        out = []
        for i, begins in spots.items():
            item_id, pattern, k = self.items[i]
            best, reach = None, None
            for at in sorted(begins):
                lo, hi = max(0, at - k), min(len(h), at + len(pattern) + k)
                if reach and at <= reach[1] and reach[0] <= lo:  # near the last hit: search both at once
                    reach = (reach[0], max(hi, reach[1]))
                    continue
                best, reach = self._nearer(best, h, reach, pattern), (lo, hi)
            best = self._nearer(best, h, reach, pattern)
            if best[0] <= k:
                out.append((item_id, *best))
        return out

    @staticmethod
    def _nearer(best: tuple[int, int] | None, h: np.ndarray, reach: tuple[int, int] | None, pattern: list[int]) -> tuple[int, int] | None:
        if reach is None:
            return best
        distance, end = myers(pattern, h[reach[0]:reach[1]].tolist())
        new = (distance, reach[0] + end)
        return new if best is None or new < best else best


def _blocks(benchmark: DataFrame, chars: int, most: int) -> list[list[tuple[int, str]]]:
    """The test items in blocks of bounded size; one block in the usual case."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id is not null and text is not null").distinct()
    blocks, size = [[]], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if blocks[-1] and (size + len(r["text"]) > chars or len(blocks[-1]) >= most):
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["text"]))
        size += len(r["text"])
    return [b for b in blocks if b]


def _pass(docs: DataFrame, pieces: Pieces, names: list[str]) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(pieces)  # at most BLOCK_CHARS of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            texts, rows = b.column(1).to_pylist(), []
            for lo, hi in text_slices(texts):
                cut = [words_of(t) for t in texts[lo:hi]]
                h = hashes([w for ws in cut for w in ws])
                at = 0
                for i, ws in enumerate(cut):
                    rows += [(lo + i, *m) for m in p.matches(h[at:at + len(ws)])]
                    at += len(ws)
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    return docs.mapInArrow(run, f"{names[0]} long, item_id long, distance long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET,
                 chars: int = BLOCK_CHARS, most: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, distance, end_word: items that stand in a document with at most `budget` of their words edited.

    distance is the edit distance in words, end_word the word at which the nearest
    passage ends (the first of equally near ones). One row per row of `docs` and item;
    items that are null or without a word match nothing, nor do null or empty texts.
    Rows of `docs` are searched in one pass, without a shuffle; a benchmark beyond
    `chars` characters or `most` items takes one pass per block of that size.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "distance", "end_word"]
    out = None
    for block in _blocks(benchmark, chars, most):
        one = _pass(plain, Pieces.of(block, budget), names)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, distance long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """`docs` without the rows that hold a test item; each pass filters rows where they are, nothing is shuffled."""
    bound_batches(docs.sparkSession)
    names, text_at, schema = docs.columns, docs.columns.index("text"), docs.schema
    for block in _blocks(benchmark, BLOCK_CHARS, BLOCK_ITEMS):
        held = docs.sparkSession.sparkContext.broadcast(Pieces.of(block, budget))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stay = [not held.value.matches(hashes(words_of(t.as_py()))) for t in b.column(text_at)]
                yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(stay, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
