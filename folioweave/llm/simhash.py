"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, an exact check.

A fingerprint is cut into 32 segments of two bits; the number of set bits of each
segment makes a point of 32 small integers. Flipping one bit moves one coordinate by
one, so two fingerprints at Hamming distance d have Manhattan distance at most d:
points further apart than the limit need no check. The coordinates are dealt to eight
groups. At most four coordinates' worth of change can touch four groups at most, so
near points agree on four whole groups: those are the grid cells, 70 for a point. Each
further group makes the cells about six times smaller for less than twice as many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import as_document, bound_batches, checkpointed
from folioweave.llm.components import components

WORDS = 4
LIMIT = 4
SEED = 42
GROUPS = 8
_LOW = 0x5555555555555555


def shingle_bits(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """XXH64 of each n-word shingle; of the whole sequence if it is shorter."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < n:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.fromiter(map(digest, joined), np.uint64, len(words) - n + 1)


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Bits set in more than half of the shingle hashes; 0 without words.

    Only A-Z are lower-cased and only the six ASCII blanks separate words, which is
    what bytes.lower() and bytes.split() do.
    """
    hashes = shingle_bits((text or "").encode("utf-8", "surrogatepass").lower().split(), n)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; a null text counts as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t.as_py(), n) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return as_document(docs).mapInArrow(run, "doc_id long, fp long")


def _segment_counts(fp: Column) -> Column:
    """Counts of two-bit segments in unary (0, 01, 11), so that xor counts Manhattan distance."""
    low, half = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(half).bitwiseAND(low), fp.bitwiseAND(half).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _cell_masks(limit: int, groups: int) -> list[int]:
    """Bit masks of all sets of groups - limit groups of segments, as signed longs."""
    if not limit < groups <= 32:
        raise ValueError("the limit must be below the number of groups, and these at most 32")
    cut = [round(i * 32 / groups) for i in range(groups + 1)]
    group = [sum(3 << (2 * s) for s in range(cut[g], cut[g + 1])) for g in range(groups)]
    masks = [sum(group[g] for g in chosen) for chosen in combinations(range(groups), groups - limit)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


_CELLS = "kind int, grid int, cell long, fp long, other long"
SMALL = 64  # points of a cell that are compared with each other where they lie


def _roots(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of linked positions: each that is not the first of those it is linked with, and that first one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    at = np.array([x for x in up if root(x) != x], np.int64)
    return at, np.array([root(x) for x in at.tolist()], np.int64)


def _cells(points: DataFrame, limit: int, groups: int, small: int) -> DataFrame:
    """Every point in all its cells, cell by cell: links of small cells (kind 0: fp, other), points of the others (kind 1).

    A small cell's links join each point to the smallest of its component there: no
    more of them than points.

    Cells are dealt out by ranges of (grid, cell, fp), so a crowded cell fills several
    partitions. Its points, and those of the cells at either end of a partition, which
    may have more points in the next one, are only passed on.
    """
    masks = F.array(*[F.lit(m) for m in _cell_masks(limit, groups)])
    cells = points.select("fp", _segment_counts(F.col("fp")).alias("u")).select(
        "fp", "u", F.posexplode(masks).alias("grid", "mask")).select("grid", F.col("u").bitwiseAND(F.col("mask")).alias("cell"), "fp")
    names = [part.split()[0] for part in _CELLS.split(", ")]

    def batch(kind: int, grid: np.ndarray, cell: np.ndarray, fp: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(fp), kind, np.int32), grid, cell, fp, other)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, crowded = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy() for c in b.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            grid, cell, fp = rows
            first = first or (grid[0], cell[0])
            new = np.append(True, (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]))
            number = np.cumsum(new) - 1
            size = np.bincount(number)
            passed = (size > small)[number]
            for key in (first, crowded):
                if key is not None:
                    passed |= (grid == key[0]) & (cell == key[1])
            last = number == number[-1]  # the cell may go on in the next batch
            if size[-1] > small:
                crowded, last = (grid[-1], cell[-1]), np.zeros(len(fp), bool)
            out = passed & ~last
            if out.any():
                yield batch(1, grid[out], cell[out], fp[out], fp[out])
            number[passed | last] = -1 - np.arange((passed | last).sum())  # alike with no other
            pairs = []
            for apart in range(1, small):
                at = np.flatnonzero(number[apart:] == number[:-apart])
                if not len(at):
                    break
                at = at[np.bitwise_count((fp[at] ^ fp[at + apart]).view(np.uint64)) <= limit]
                pairs += zip(at.tolist(), (at + apart).tolist())
            at, root = _roots(pairs)
            yield batch(0, grid[at], cell[at], fp[at], fp[root])
            held = [x[last] for x in rows]
        if held is not None and len(held[0]):
            yield batch(1, *held, held[2])

    return cells.repartitionByRange("grid", "cell", "fp").sortWithinPartitions("grid", "cell", "fp").mapInArrow(run, _CELLS)


def near_components(points: DataFrame, limit: int = LIMIT, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """fp -> comp for distinct fingerprints that have a partner within `limit` bits.

    Small cells are settled pair by pair. In crowded ones every point is first checked
    against the cell's smallest: that joins the bulk of a large group of copies with one
    check per point and cell. Then only pairs from different components can add
    anything: points outside a cell's commonest component meet the others. A crowded
    cell that lies within one component takes no part, so no group's pairs are
    enumerated, and no pair between components is left out.
    """
    dealt = checkpointed(_cells(points, limit, groups, small))
    crowd = dealt.where("kind = 1").select("grid", "cell", "fp")
    lead = crowd.groupBy("grid", "cell").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = checkpointed(crowd.join(lead, ["grid", "cell"]))
    star = members.where((F.col("fp") != F.col("lead")) & (_apart("fp", "lead") <= limit))
    links = star.select(F.col("fp").alias("a"), F.col("lead").alias("b")).unionByName(
        dealt.where("kind = 0").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    first = components(links.distinct())

    known = first.withColumnRenamed("node", "fp")
    placed = members.drop("lead").join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    common = (
        placed.groupBy("grid", "cell", "comp").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("grid", "cell").agg(F.max_by("comp", F.struct("n", "comp")).alias("common"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1").drop("comps")
    )
    mixed = checkpointed(placed.join(common, ["grid", "cell"]).withColumn("u", _segment_counts(F.col("fp"))))
    rest = mixed.where("comp != common").select("grid", "cell", *[F.col(c).alias(f"{c}2") for c in ("fp", "u", "comp")])
    pairs = mixed.join(
        rest,
        (mixed["grid"] == rest["grid"]) & (mixed["cell"] == rest["cell"]) & (F.col("comp") != F.col("comp2"))
        & (_apart("u", "u2") <= limit) & (_apart("fp", "fp2") <= limit)
        & ((F.col("comp") == F.col("common")) | (F.col("fp") < F.col("fp2"))),
    ).select(F.col("comp").alias("a"), F.col("comp2").alias("b")).distinct()
    second = components(pairs).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    alone = second.join(known, second["comp"] == known["fp"], "left_anti").select(F.col("comp").alias("fp"), "whole")
    joined = known.join(second, "comp", "left").select("fp", F.coalesce("whole", "comp").alias("comp"))
    return joined.unionByName(alone.select("fp", F.col("whole").alias("comp")))


def simhash_components(docs: DataFrame, limit: int = LIMIT, n: int = WORDS, groups: int = GROUPS) -> DataFrame:
    """doc_id, fp, component_id of every row of `docs`.

    component_id is the smallest doc_id that links of `limit` or fewer differing bits
    reach. Equal texts, repeated rows and rows of equal fingerprints share a class;
    empty, blank and null texts all have fingerprint zero and link like any other.
    A row with a null doc_id keeps it and gets the component of its class; component_id
    is null only where no row of the component has an id. An empty table gives none.
    """
    rows = checkpointed(fingerprints(docs, n))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = near_components(classes.select("fp"), limit, groups)
    named = classes.join(comps, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    named = checkpointed(named)
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, limit: int = LIMIT, n: int = WORDS) -> DataFrame:
    """`docs` without near-duplicates: of each component the row with the smallest doc_id stays.

    Repeated rows of one doc_id are one document, and one of them stays. Rows with a
    null doc_id cannot be named and all stay.
    """
    found = checkpointed(simhash_components(docs, limit, n).where("doc_id is not null")
                         .groupBy("doc_id").agg(F.min("component_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    going = found.where("doc_id != _first or _n > 1").select(F.col("doc_id").alias("_id"))
    twice = found.where("doc_id = _first and _n > 1").select(F.col("doc_id").alias("_id"))
    key = docs["doc_id"].cast("bigint")
    once = docs.join(going, key == going["_id"], "left_anti")
    return once.unionByName(docs.join(twice, key == twice["_id"], "left_semi").dropDuplicates(["doc_id"]))
