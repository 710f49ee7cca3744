"""Embedding whitening: eigenpairs of the covariance by contour integration (FEAST), counted by inertia.

Vectors are turned into integers, so sums and products over all rows are exact and the
covariance is rounded once, however far from zero the vectors lie. The largest
eigenvalues are fenced in: the inertia of the covariance shifted to a point says how
many eigenvalues lie above it, and bisection puts fences into gaps until few lie
between two of them. For each stretch between fences, a quadrature of complex shifted
solves around it projects random vectors onto its eigenspace, Rayleigh-Ritz extracts
the pairs, and the projection is repeated until the residuals are rounding errors and
as many pairs lie inside as the inertia says. Stretches are independent Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
FACTOR = 64
OFFSET = 1_000_000   # of all integers; drops out of all that is centred
PER_STRETCH = 8      # eigenvalues between two fences, unless they lie too close together to be parted
NODES = 12           # quadrature points on a half circle
ROUNDS = 40          # projections of a stretch at most
_LARGEST = float(1 << 50)


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, k = floor(FACTOR * c) of each entry c. Rows with a null vector or a null or non-finite entry go.

    So do rows with an entry of 2^44 and more, whose integers have no room for exact
    sums. Empty vectors have no entry that could be missing, and stay.
    """
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * FACTOR < _LARGEST))
    return embeddings.where(F.col("embedding").isNotNull()).where(fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(c, lambda v: F.floor(v * FACTOR)).alias("k"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    return out


def _exact_gram(e: np.ndarray) -> np.ndarray:
    """e' e in exact integers: by floating point where it holds them, else by Python's."""
    top = int(np.abs(e).max(initial=0))
    if top * top * len(e) < 1 << 53:
        f = e.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top * top * len(e) < 1 << 62:
        return (e.T @ e).astype(object)
    return e.astype(object).T @ e.astype(object)


def _summed(rows: DataFrame, run) -> dict[tuple[int, int], int]:
    """Sums over all tasks of (i, j, integer as text); a bounded table of dimensions squared."""
    got = rows.mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in got.collect()}


def _emitted(values: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(values.shape).reshape(2, -1)
    keep = i <= j if values.shape[0] == values.shape[1] else np.ones(len(i), bool)
    return pa.RecordBatch.from_arrays(
        [pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array([str(v) for v in values.ravel()[keep]], pa.string())],
        names=["i", "j", "v"])


@dataclass
class Moments:
    """Exact facts of all rows: how many, their sums, and the covariance times n * n."""

    n: int
    sums: list[int]
    scaled: np.ndarray  # of Python integers

    @property
    def covariance(self) -> np.ndarray:
        """Rounded once, from exact integers."""
        return np.array([[int(v) / self.n**2 for v in row] for row in self.scaled], np.float64).reshape(self.scaled.shape)


def moments(rows: DataFrame) -> Moments:
    """Two passes over vec_id, k: the sums, then the products of what is centred at the rounded means."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("k")).alias("dim")).first()
    n, dim = facts["n"], facts["dim"] or 0
    if not n or not dim:
        return Moments(n, [], np.zeros((0, 0), object))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, dim), object)
        for b in batches:
            m = _matrix(b.column(0), dim)
            top = int(np.abs(m).max(initial=0))
            total[0] += (m.sum(axis=0) if top * len(m) < 1 << 62 else m.astype(object).sum(axis=0)).astype(object)
        yield _emitted(total)

    got = _summed(rows.select("k"), add)
    sums = [got.get((0, j), 0) for j in range(dim)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, shift = np.zeros((dim, dim), object), np.zeros(dim, object)
        for b in batches:
            e = _matrix(b.column(0), dim) - middle
            gram += _exact_gram(e)
            shift += e.astype(object).sum(axis=0)
        yield _emitted(gram)

    got = _summed(rows.select("k"), multiply)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]  # sums of what is centred
    scaled = np.zeros((dim, dim), object)
    for (i, j), v in got.items():
        scaled[i, j] = scaled[j, i] = n * v - rest[i] * rest[j]
    return Moments(n, sums, scaled)


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are positive, negative and zero: signs of its pivots of one and two rows."""
    a = np.array(a, np.float64)
    positive = negative = 0
    least = np.finfo(float).tiny
    while len(a):
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), len(a))
        if max(diagonal[r], off[p, q]) <= least:
            break
        if diagonal[r] >= 0.6404 * off[p, q]:  # (1 + sqrt(17)) / 8 bounds the growth
            keep = np.delete(np.arange(len(a)), r)
            pivot, side = a[r, r], a[keep, r]
            positive, negative = positive + (pivot > 0), negative + (pivot < 0)
            a = a[np.ix_(keep, keep)] - np.outer(side, side / pivot)
        else:
            two = [p, q]
            keep = np.delete(np.arange(len(a)), two)
            positive, negative = positive + 1, negative + 1  # its determinant is negative
            side = a[np.ix_(keep, two)]
            a = a[np.ix_(keep, keep)] - side @ np.linalg.solve(a[np.ix_(two, two)], side.T)
        a = (a + a.T) / 2
    return positive, negative, len(a)


def fences(v: np.ndarray, k: int, per: int = PER_STRETCH) -> list[tuple[float, float, int]]:
    """Stretches (low, high, eigenvalues inside) from the top down that hold the k largest eigenvalues above rounding."""
    dim = len(v)
    top = float(np.abs(v).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    if not top:
        return []

    def above(x: float) -> int:
        return inertia(v - x * np.eye(dim))[0]

    def drawn_in(low: float, high: float, over_low: int, over_high: int) -> tuple[float, float]:
        """Fences moved half-way towards the eigenvalues inside, so that none outside is as near."""
        inner_low, inner_high, a, b = low, high, high, low
        for _ in range(7):
            mid = (inner_low + a) / 2
            inner_low, a = (mid, a) if above(mid) == over_low else (inner_low, mid)
            mid = (inner_high + b) / 2
            inner_high, b = (mid, b) if above(mid) == over_high else (inner_high, mid)
        return (low + inner_low) / 2, (high + inner_high) / 2

    floor = top * dim * 1e-14  # what is below cannot be told from zero
    out, have = [], 0
    todo = [(floor, top, above(floor), 0)]
    while todo and have < k:
        low, high, over_low, over_high = todo.pop()
        inside = over_low - over_high
        if not inside:
            continue
        if inside <= per or high - low <= 1e-11 * top:
            out.append((*drawn_in(low, high, over_low, over_high), int(inside)))
            have += inside
            continue
        for part in (0.5, 0.43, 0.57, 0.36, 0.64, 0.29, 0.71):  # a fence should not stand on an eigenvalue
            fence = low + part * (high - low)
            over, room = above(fence), 0.01 * (high - low)
            if above(fence - room) == above(fence + room):
                break
        todo += [(low, fence, over_low, over), (fence, high, over, over_high)]
    return out


def stretch_pairs(v: np.ndarray, low: float, high: float, inside: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues between two fences, and their vectors as columns.

    Raises ArithmeticError if the residuals stay above rounding, or not as many pairs
    as `inside` are found.
    """
    dim = len(v)
    scale = float(np.abs(v).sum(axis=1).max())
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(-0.5j * np.pi * (x - 1))
    solves = [np.linalg.inv((centre + radius * t) * np.eye(dim) - v) if dim <= 256 else None for t in turn]
    width = min(dim, inside + max(6, inside // 2))
    y = np.random.default_rng(seed).normal(size=(dim, width))
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for t, weight, inverse in zip(turn, w, solves):
            got = inverse @ y if inverse is not None else np.linalg.solve((centre + radius * t) * np.eye(dim) - v, y.astype(complex))
            q += 0.5 * weight * (radius * t * got).real
        q, _ = np.linalg.qr(q)
        values, turned = np.linalg.eigh(q.T @ v @ q)
        y = q @ turned
        mine = (values > low) & (values <= high)
        rest = np.linalg.norm(v @ y[:, mine] - y[:, mine] * values[mine], axis=0)
        if mine.sum() == inside and rest.max(initial=0) <= 4e-15 * scale * dim**0.5:
            return values[mine], y[:, mine]
    raise ArithmeticError(f"{int(mine.sum())} pairs of {inside} between {low} and {high}, residual {rest.max(initial=0)}")


@dataclass
class Whitening:
    n: int
    sums: list[int]          # of k
    values: np.ndarray       # falling
    vectors: np.ndarray      # as columns
    trace: float

    def white(self, m: np.ndarray) -> np.ndarray:
        """Rows of integers, centred, on the components, over the square roots of the eigenvalues."""
        return (self.centred(m).astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))

    def centred(self, m: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.n * int(np.abs(m).max(initial=0)) < 1 << 62 and max(map(abs, self.sums)) < 1 << 62:
            return self.n * m - np.array(self.sums, np.int64)
        return self.n * m.astype(object) - np.array(self.sums, object)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The largest eigenpairs of the covariance of all rows (vec_id, k), `components` of them at most.

    Eigenvalues that rounding cannot tell from zero make no component: constant or
    dependent dimensions have none, and neither has a table of one row or of equal ones.
    """
    spark = rows.sparkSession
    facts = moments(rows)
    v = facts.covariance if facts.n else np.zeros((0, 0))
    plan = fences(v, components)
    if not plan:
        return Whitening(facts.n, facts.sums, np.empty(0), np.empty((len(v), 0)), float(np.trace(v)))
    held = spark.sparkContext.broadcast(v)  # dimensions squared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, inside in zip(*(c.to_pylist() for c in b.columns)):
                values, vectors = stretch_pairs(held.value, low, high, inside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    dealt = spark.createDataFrame(plan, "low double, high double, inside int").repartition(len(plan))
    got = sorted(dealt.mapInArrow(run, "value double, vector array<double>").collect(), key=lambda r: -r["value"])  # a few more than `components`
    # one more Rayleigh-Ritz over all stretches makes vectors of neighbours orthogonal to the last digit
    q, _ = np.linalg.qr(np.array([r["vector"] for r in got]).T)
    values, turned = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(facts.n, facts.sums, values[order], (q @ turned)[:, order], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity; a pass over the rows."""
    dim, size = len(model.sums), len(model.values)
    if not size:
        return 0.0
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            white = held.value.white(_matrix(b.column(0), dim))
            total += np.concatenate([white.T @ white, white.sum(axis=0)[:, None]], axis=1)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    got = np.zeros((size, size + 1))
    for r in rows.select("k").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(got[:, :size] - np.outer(got[:, size], got[:, size]) - np.eye(size)).max())


def _deviations(z: np.ndarray) -> pa.Array:
    """Sums of squares of each row, exact; null beyond the range of a long."""
    top = int(np.abs(z).max(initial=0))
    if z.dtype != object and top * top * z.shape[1] < 1 << 62:
        return pa.array((z * z).sum(axis=1))
    exact = [sum(int(c) ** 2 for c in row) for row in z]
    return pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained: a row per vector and component; nothing is shuffled.

    Rows count as often as they occur; those without an id keep a null id. Vectors
    shorter than the longest are filled up with zeros.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model)  # dimensions times components
    dim, size = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        share = m.values / m.trace if size else m.values
        for whole in batches:
            for at in range(0, whole.num_rows if size else 0, 2048):
                b = whole.slice(at, 2048)
                x = _matrix(b.column(1), dim)
                each = pa.array(np.repeat(np.arange(len(x)), size))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(each), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)),
                     _deviations(m.centred(x)).take(each), pa.array(m.white(x).ravel()), pa.array(np.tile(share, len(x)))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.select("vec_id", "k").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double")
