"""Repeated passages: compact windows over shingle min-hashes, joins of their intervals, verification.

A text is a sequence of five-word shingles. For one hash function, the Cartesian tree
over the shingles' hashes gives for each shingle the widest stretch in which it is the
minimum: all passages inside that stretch and across that shingle share the min-hash,
so one window stands for all of them. Windows of two functions whose stretches
overlap in at least the passage length make a window with a joint signature; eight
functions give four such signatures, and passages that agree on any meet.

Windows of one signature are checked against the earliest one only, so a passage that
a third of the corpus shares costs one check each and no pairs. Where the whole
stretches are equal a hash of them tells; else the shingles of both are compared.
Those that differ, further windows of the earliest text too, go round again under
finer signatures (where they leave the earliest one, to the left and to the right);
two texts with a common passage always share one of these.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import as_document, bound_batches, forget, free_names, kept, stored, text_slices

WORDS = 5                     # words of a shingle
PASSAGE = 50                  # words of the shortest passage
SIMILARITY = 0.8
CHUNK = 512                   # shingles of a piece of text that travels to a check
_BANDS = 4                    # a power of two: a signature ends with the number of its band
_WORD = re.compile(rb"[^ \t-\r]+")
_U = np.uint64
_FACTORS = [pow(0xA0761D6478BD642F, 2 * k + 1, 1 << 64) for k in range(2 * _BANDS)]  # odd


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each n words in a row; A-Z are lower-cased, ASCII blanks separate words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j]
    return _mix(out)


def _argmin_of_stretches(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each `width` values in a row."""
    bits = max(1, int(len(v)).bit_length())
    small = len(v) and int(v.max()) < 1 << (64 - bits)
    # a value and its position in one number where there is room: its minimum tells both
    at = np.arange(len(v), dtype=np.uint64 if small else np.int64)
    low, have = (v << _U(bits)) | at if small else v, 1
    while have < width:
        step = min(have, width - have)
        if small:
            low = np.minimum(low[:-step], low[step:])
        else:
            left = low[:-step] <= low[step:]
            at, low = np.where(left, at[:-step], at[step:]), np.minimum(low[:-step], low[step:])
        have += step
    return (low & _U((1 << bits) - 1)).astype(np.int64) if small else at


def compact_windows(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per stretch of `width` values its minimum; per position that is one, its widest stretch.

    Returns the minimum's position for each stretch, and three arrays: the positions
    that occur, and the first and last position up to which each stays the leftmost
    minimum. That is the node's interval in the Cartesian tree; nodes with shorter
    intervals are minima of no stretch and never ancestors of one that is, so the tree
    over the positions that occur has the same intervals.
    """
    at = _argmin_of_stretches(v, width)
    if not len(at):
        none = np.empty(0, np.int64)
        return at, none, none, none
    nodes = at[np.append(True, at[1:] != at[:-1])]
    values = v[nodes].tolist()
    places = nodes.tolist()
    first, last, path = [0] * len(places), [len(v) - 1] * len(places), []
    for i, value in enumerate(values):
        while path and values[path[-1]] > value:
            last[path.pop()] = places[i] - 1
        if path:
            first[i] = places[path[-1]] + 1
        path.append(i)
    return at, nodes, np.array(first), np.array(last)


def clipped_windows(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `compact_windows`, but with the intervals only as far as stretches of `width` that the position is the minimum of.

    These are the stretches that have it as their minimum, from the first to the last:
    they follow one another, as a node's interval is one piece.
    """
    at = _argmin_of_stretches(v, width)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    ends = np.append(new[1:], len(at)) if len(at) else at
    return at, at[new], new, ends + width - 2


def signatures(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as shingles: text number, signature, packed place and body of each joint window.

    The place holds the position of the first of the two minima and how far, left and
    right of it, passages of `width` shingles with this signature reach; the body is a
    hash of all shingles of that stretch.
    """
    wall = np.zeros(1, np.uint64)
    parts, owner, base = [wall], [], []
    size = 1
    for i, s in enumerate(texts):
        base.append(size)
        owner.append(i)
        parts += [s, wall]
        size += len(s) + 1
    flat = np.concatenate(parts)
    walls = np.append(np.array(base, np.int64) - 1, size - 1)
    upto = np.concatenate([wall, np.cumsum(_mix(flat + _U(1)), dtype=np.uint64)])
    out = []
    for band in range(_BANDS):
        sides = []
        for side in range(2):
            # shingles are well mixed already: an odd factor orders them anew
            v = (flat * _U(_FACTORS[2 * band + side]) >> _U(22)) | _U(1)
            v[walls] = 0  # below every hash: no window crosses from one text to the next
            at, nodes, first, last = clipped_windows(v, width)
            sides.append((v, at, nodes, first, last))
        (v1, at1, n1, f1, l1), (v2, at2, n2, f2, l2) = sides
        runs = np.flatnonzero(np.append(True, (at1[1:] != at1[:-1]) | (at2[1:] != at2[:-1]))) if len(at1) else at1
        c1, c2 = at1[runs], at2[runs]
        real = v1[c1] != 0
        c1, c2 = c1[real], c2[real]
        i1, i2 = np.searchsorted(n1, c1), np.searchsorted(n2, c2)
        low, high = np.minimum(c1, c2), np.maximum(c1, c2)
        left = np.maximum(np.maximum(f1[i1], f2[i2]), high - width + 1)
        right = np.minimum(np.minimum(l1[i1], l2[i2]), low + width - 1)
        key = _mix(flat[c1] * _U(0x9E3779B97F4A7C15) + flat[c2] + _U(band)) & ~_U(_BANDS - 1) | _U(band)
        which = np.searchsorted(walls, low) - 1
        own = low - (walls[which] + 1)
        body = _mix(upto[right + 1] - upto[left]).astype(np.uint32).view(np.int32)
        out.append((which, key, own << 14 | (low - left) << 7 | (right - low), body))
    which, key, place, body = (np.concatenate(x) for x in zip(*out))
    return np.array(owner, np.int64)[which] if len(owner) else which, key, place, body


def _edition(s: np.ndarray, several: bool) -> int:
    """Tells texts of one doc_id apart, where there are `several`."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 33 if several else 0


def _windows(docs: DataFrame, width: int, shingle: int, several: bool) -> DataFrame:
    """key, doc, place, body of all joint windows of all texts; the upper half of `body` is the text's edition."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in text_slices(texts, 2_000_000):
                cut = [shingles(t, shingle) for t in texts[lo:hi]]
                long = [i for i, s in enumerate(cut) if len(s) >= width]
                if not long:
                    continue
                which, key, place, body = signatures([cut[i] for i in long], width)
                editions = np.array([_edition(cut[i], several) for i in long], np.int64)
                body = editions[which] << 32 | body.astype(np.int64) & 0xFFFFFFFF
                doc = ids[lo:hi][np.array(long)][which]
                for at in range(0, len(key), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[part].view(np.int64)), pa.array(doc[part].astype(np.int64)), pa.array(place[part]), pa.array(body[part])],
                        names=["key", "doc", "place", "body"])

    return docs.mapInArrow(run, "key long, doc long, place long, body long")


_LED = "kind int, doc long, other long, key long, place long, place2 long, body long, body2 long, equal boolean"
_LOW = 0xFFFFFFFF


def _led(windows: DataFrame, bodies: bool, within: bool = False, lean: bool = False) -> tuple[DataFrame, str]:
    """doc, other, key, place, place2, body, body2, equal: windows whose signature an earlier document has, with its earliest window.

    With `within`, also the further windows of that document itself, unless they are equal to its earliest one.
    Second comes the path of the table it reads. `lean` leaves out equal windows of all
    bands but the first: windows of one band cover a text, and where those of the first
    are not equal to their leads they are checked.

    One range partitioning by signature, document and place brings the rows of a
    signature together, those of a frequent one in several partitions; each then takes
    the earliest window of its own rows first, and a join with those few front rows sets
    them right.
    """
    names = [part.split()[0] for part in _LED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(kind, doc, other, key, place, place2, body, body2, equal):
            kinds = np.broadcast_to(np.asarray(kind, np.int32), len(doc))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (kinds, doc, other, key, place, place2, body, body2, equal)], names=names)

        def front(lead):
            key, doc, place, body = (np.array([v], np.int64) for v in lead)
            return batch(2, doc, doc, key, place, place, body, body, np.array([False]))

        first = last = None  # the partition's first key; the lead of the group settled last

        def settled(groups):
            """Rows of whole groups of one key each: the earliest window of a group leads the others."""
            nonlocal last
            key, doc, place, body = (np.concatenate(c) for c in zip(*groups))
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            lead = np.repeat(np.minimum.reduceat(doc, start), size)
            least = np.minimum.reduceat(np.where(doc == lead, place, np.iinfo(np.int64).max), start)
            of_lead = np.flatnonzero((doc == lead) & (place == np.repeat(least, size)))
            # the first row of each group that is its lead
            own = np.repeat(of_lead[np.searchsorted(of_lead, start)], size)
            doc2, place2, body2 = doc[own], place[own], body[own]
            edge = key == first  # an earlier partition may have an earlier window
            if edge[0]:
                yield front((key[0], doc2[0], place2[0], body2[0]))
            last = tuple(c[own[-1]] for c in (key, doc, place, body))
            equal = (body & _LOW == body2 & _LOW) & (place & 16383 == place2 & 16383) if bodies else np.zeros(len(key), bool)
            out = (doc != doc2) | edge
            if within:
                out |= (place != place2) & ~equal
            if lean:
                out &= edge | ~equal | (key % _BANDS == 0)
            body, body2 = (np.where(equal & ~edge, 0, c) for c in (body, body2))  # not needed any more
            yield batch(edge[out].astype(np.int32), *(c[out] for c in (doc, doc2, key, place, place2, body, body2, equal)))

        held = []  # the last group may go on in the next batch; no more is held than a partition has
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy() for i in range(4)]
            key = rows[0]
            first = key[0] if first is None else first
            if held and held[-1][0][-1] != key[0]:
                yield from settled(held)
                held = []
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from settled([*held, [c[:cut] for c in rows]])
                held = []
            held.append([c[cut:] for c in rows])
        if held:
            yield from settled(held)
        if last is not None and last[0] != first:
            yield front(last)

    dealt = windows.select("key", "doc", "place", "body").repartitionByRange("key", "doc", "place").sortWithinPartitions("key")
    out, path = kept(dealt.mapInArrow(run, _LED), "led")
    fronts = out.where("kind = 2").groupBy("key").agg(F.min(F.struct("doc", "place", "body")).alias("lead"))
    edge = F.col("kind") == 1
    moved = F.expr(f"body & {_LOW} = lead.body & {_LOW} and place & 16383 = lead.place & 16383") if bodies else F.lit(False)
    # two front rows a partition at most are broadcast
    found = out.where("kind < 2").join(F.broadcast(fronts), "key", "left").select(
        "doc", "key", "place", "body", *[F.when(edge, new).otherwise(F.col(old)).alias(old) for old, new in (
            ("other", F.col("lead.doc")), ("place2", F.col("lead.place")), ("body2", F.col("lead.body")), ("equal", moved))])
    return found.where("doc != other or place != place2 and not equal" if within else "doc != other").select(
        "doc", "other", "key", "place", "place2", "body", "body2", "equal"), path


_BESIDE = 24  # shingles beside a window that are searched with it
_REACH = 96  # shingles that a window may reach beyond its chunk, on either side


def _pieces(docs: DataFrame, needed: DataFrame, shingle: int, chunk: int, several: bool) -> DataFrame:
    """doc, edition, piece, content: the needed pieces of texts as 32-bit shingle hashes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, pieces in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                s = shingles(text.as_py(), shingle)
                edition = _edition(s, several)
                s = s.astype(np.uint32)
                mine = [p["piece"] for p in pieces if p["edition"] == edition]
                got = [s[max(0, p * chunk - _REACH):(p + 1) * chunk + _REACH].tobytes() for p in mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(got), pa.int64()), pa.array([edition] * len(got), pa.int64()), pa.array(mine, pa.int64()),
                     pa.array(got, pa.binary())], names=["doc", "edition", "piece", "content"])

    one = docs.join(needed.groupBy("doc").agg(F.collect_set(F.struct("edition", "piece")).alias("pieces")), docs["doc_id"] == F.col("doc"))
    found = stored(one.select("doc_id", "text", "pieces").mapInArrow(run, "doc long, edition long, piece long, content binary"), "pieces")
    keys = ["doc", "edition", "piece"]
    if several:  # repeated rows
        found = stored(found.groupBy(*keys).agg(F.min("content").alias("content")), "pieces")
    return found


def _found_in(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each value of `a` is one of `b`, and where in `b` its first one is; whether neighbours in the order of `b` are equal."""
    order = np.argsort(b, kind="stable")
    low = b[order]
    at = np.minimum(np.searchsorted(low, a), len(b) - 1)
    return low[at] == a, order[at], low[1:] == low[:-1]


def _paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal values; of a value that either has several times the k-th ones belong together."""
    common, at, twice = _found_in(a, b)
    i, j = np.flatnonzero(common), at[common]
    if not twice.any() and len(np.unique(j)) == len(j):  # none of the common ones is repeated
        return i, j

    def numbered(v: np.ndarray) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for x in v.tolist():
            seen[x] = seen.get(x, -1) + 1
            out.append((x, seen[x]))
        return out

    at = {x: j for j, x in enumerate(numbered(b))}
    both = [(i, at[x]) for i, x in enumerate(numbered(a)) if x in at]
    i, j = np.array(both, np.int64).reshape(-1, 2).T
    return i, j


def _longest_rise(j: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence."""
    if (np.diff(j) > 0).all():
        return np.arange(len(j))
    tails, at, before = [], [], []
    for n, x in enumerate(j.tolist()):
        k = bisect_left(tails, x)
        tails[k:k + 1] = [x]
        at[k:k + 1] = [n]
        before.append(at[k - 1] if k else -1)
    out, n = [], at[-1]
    while n >= 0:
        out.append(n)
        n = before[n]
    return np.array(out[::-1])


def _similar_in_order(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Stretches of `a` that are similar to one of `b`, and the positions of the common shingles in order that were looked at.

    Common shingles that come in the same order in both make a chain. All stretches of
    `width` to 2 * width - 1 shingles from the begin of a run of it to the end of one are
    tried (and those of the greatest length that begin or end within a run); growing by
    a pair of equal shingles never makes two stretches less similar. Of those with one
    begin the longest is returned.
    """
    i, j = _paired(a, b)
    rise = _longest_rise(j)
    i, j = i[rise], j[rise]
    step = (np.diff(i) == 1) & (np.diff(j) == 1)
    begins, ends = np.flatnonzero(np.append(True, ~step)), np.flatnonzero(np.append(~step, True))
    reach = 2 * width - 1

    def on_chain(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(i, x), len(i) - 1)
        return at[i[at] == x]

    s, e = np.unique(np.append(begins, on_chain(i[ends] + 1 - reach))), np.unique(np.append(ends, on_chain(i[begins] + reach - 1)))
    size, size2 = i[e][None, :] + 1 - i[s][:, None], j[e][None, :] + 1 - j[s][:, None]
    both = e[None, :] + 1 - s[:, None]
    fits = (size >= width) & (size <= reach) & (both * (1 + similarity) >= similarity * (size + size2) - 1e-9)
    longest = np.where(fits, i[e][None, :] + 1, 0).max(axis=1)
    return [(int(x), int(y)) for x, y in zip(i[s], longest) if y], i


def _alike(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> tuple[int, int] | None:
    """The stretch of `a` that is long and similar enough to one of `b` and has the most shingles in common with it.

    It begins and ends with a common shingle: shorter ones are not filled up with what
    stands beside them. Growing two stretches by a pair of equal shingles never makes
    them less similar, so only those from the begin of a run of pairs to the end of one
    are looked at, all of them.
    """
    if len(a) < least or np.isin(a, b).sum() < least * similarity:
        return None
    i, j = _paired(a, b)
    if len(i) < least * similarity:
        return None
    step = (np.diff(i) == 1) & (np.diff(j) == 1)
    begins, ends = np.append(True, ~step), np.append(~step, True)
    xs, ys, us, vs = np.unique(i[begins]), np.unique(i[ends]) + 1, np.unique(j[begins]), np.unique(j[ends]) + 1
    points = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    points[i + 1, j + 1] = 1
    points = points.cumsum(axis=0).cumsum(axis=1)
    x, y = (g.ravel() for g in np.meshgrid(xs, ys, indexing="ij"))
    u, v = (g.ravel() for g in np.meshgrid(us, vs, indexing="ij"))
    long, some = y - x >= least, v > u
    x, y, u, v = x[long], y[long], u[some], v[some]
    common = points[y][:, v] - points[x][:, v] - points[y][:, u] + points[x][:, u]
    size = (y - x)[:, None] + (v - u)[None, :]
    fits = common * (1 + similarity) >= similarity * size - 1e-9
    if not fits.any():
        return None
    best = int(np.where(fits, common * 1024 - size, -(1 << 30)).argmax()) // len(u)
    return int(x[best]), int(y[best])


def _agreement(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray, sign: int, most: int) -> np.ndarray:
    """How many shingles of `a` from each place on, up to `most`, equal those of `b`, to the left or to the right."""
    step = sign * np.arange(most)
    x, y = at[:, None] + step, bt[:, None] + step
    inside = (x >= 0) & (x < len(a)) & (y >= 0) & (y < len(b))
    same = inside & (a[np.where(inside, x, 0)] == b[np.where(inside, y, 0)])
    return np.where(same.all(axis=1), most, same.argmin(axis=1))


def _dense(common: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, share: float) -> np.ndarray:
    """Whether each range has `width` or more positions in a row of which at least `share` are common; no similar stretch has less."""
    excess = np.concatenate([[0], np.cumsum(common - share)])
    at = lo[:, None] + np.arange(2 * width)
    rows = np.where(at <= hi[:, None], excess[np.minimum(at, hi[:, None])], -np.inf)
    return (rows[:, width:] - np.minimum.accumulate(np.where(np.isinf(rows), np.inf, rows), axis=1)[:, :width] >= -1e-9).any(axis=1)


def _united(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and adjoining ranges as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    upto = np.maximum.accumulate(last)
    new = np.append(True, first[1:] > upto[:-1]) if len(first) else np.empty(0, bool)
    ends = np.append(new[1:], True) if len(first) else new
    return list(zip(first[new].tolist(), upto[ends].tolist()))


def check_piece(a: np.ndarray, b: np.ndarray, a0: int, b0: int, key: np.ndarray, place: np.ndarray, other: np.ndarray, width: int,
                similarity: float, spans_too: bool = True) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Passages of one piece that occur in another; finer signatures of windows that differ from theirs, and these windows' places.

    Those with a passage have finer ones too: a later text may share with them what the other piece lacks.

    `a`, `b`: shingles of the pieces; a0, b0: positions of their first ones; key, place,
    other: signature, place in a and place in b of each window. Passages are (first,
    last + 1) shingle, without `spans_too` none. Equal shingles around all places are
    counted at once, common shingles in order are searched once; windows with common
    shingles in another order are searched one by one.
    """
    at, bt = (place >> 14) - a0, (other >> 14) - b0
    lo, hi = np.maximum(at - (place >> 7 & 127), 0), np.minimum(at + (place & 127) + 1, len(a))
    lo2, hi2 = np.maximum(bt - (other >> 7 & 127), 0), np.minimum(bt + (other & 127) + 1, len(b))
    before, after = _agreement(a, b, at, bt, -1, width), _agreement(a, b, at, bt, 1, width)
    first, last = at - np.maximum(before - 1, 0), at + after  # the equal shingles around the place; none if these differ
    found = last - first >= width
    spans = [(x + a0, y + a0) for x, y in _united(first[found], last[found])] if spans_too else []
    finer, places = [], []
    for x in (np.where(after > 0, first - 1, at), np.where(after > 0, last, at)):
        out = np.flatnonzero((lo <= x) & (x < hi))  # where the two part within the window
        mark = (a[x[out]].astype(np.uint64) << _U(9) | ((x[out] - at[out]) & 511).astype(np.uint64)) + key[out].view(np.uint64) * _U(0x9E3779B97F4A7C15)
        finer.append(_mix(mark).view(np.int64))
        places.append(place[out])
    if not spans_too:
        return [], np.concatenate(finer), np.concatenate(places)

    left = np.flatnonzero(~found)
    if len(left):
        common, common2 = _found_in(a, b)[0], _found_in(b, a)[0]
        left = left[_dense(common, lo[left], hi[left], width, similarity)]
        left = left[_dense(common2, lo2[left], hi2[left], width, similarity)]
    if len(left):
        some, settled = _similar_in_order(a, b, width, similarity)
        for x, y in some:
            spans.append((x + a0, y + a0))
            common[x:y] = False
        # shingles in the same order in both are settled; others may be common to stretches in another order,
        # of windows whose place lies in none of the passages found
        other_order, free = common.copy(), np.ones(len(a), bool)
        other_order[settled] = False
        for x, y in spans:
            free[x - a0:y - a0] = False
        left = left[free[at[left]]]
    while len(left):
        new = np.concatenate([[0], np.cumsum(other_order)])
        gain = new[hi[left]] - new[lo[left]]
        left, gain = left[gain > 0], gain[gain > 0]
        if not len(left):
            break
        best = int(gain.argmax())
        i, left = left[best], np.delete(left, best)
        # a little more than the window: what lies within is searched with it
        x0, x1, y0, y1 = max(0, lo[i] - _BESIDE), min(len(a), hi[i] + _BESIDE), max(0, lo2[i] - _BESIDE), min(len(b), hi2[i] + _BESIDE)
        near = _alike(a[x0:x1], b[y0:y1], width, similarity)
        if near:
            x, y = near[0] + int(x0), near[1] + int(x0)
            spans.append((x + a0, y + a0))
            other_order[x:y] = False  # found
        else:
            left = left[(lo[left] < x0) | (hi[left] > x1) | (lo2[left] < y0) | (hi2[left] > y1)]
    return spans, np.concatenate(finer), np.concatenate(places)


def _checked(units: DataFrame, width: int, similarity: float, chunk: int) -> DataFrame:
    """doc, other, first, last of found passages; doc, key, place, body of windows that go round again."""
    names = ["doc", "other", "first", "last", "key", "place", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, edition, piece, other, piece2 = (b.column(i).to_pylist() for i in range(5))
            windows, x, y = b.column(5), b.column(6), b.column(7)
            ends, fields = windows.offsets.to_numpy(), windows.values
            key, place, place2 = (fields.field(n).to_numpy() for n in ("key", "place", "place2"))
            found, again = [], []
            for r in range(b.num_rows):
                part = slice(ends[r], ends[r + 1])
                spans, finer, places = check_piece(
                    np.frombuffer(x[r].as_buffer(), np.uint32), np.frombuffer(y[r].as_buffer(), np.uint32), max(0, piece[r] * chunk - _REACH),
                    max(0, piece2[r] * chunk - _REACH), key[part], place[part], place2[part], width, similarity, doc[r] != other[r])
                found += [(doc[r], other[r], s, e) for s, e in spans]
                again.append((np.full(len(finer), doc[r]), finer, places, np.full(len(finer), edition[r] << 32)))
            cols = [pa.array(c, pa.int64()) for c in list(zip(*found)) or [()] * 4]
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, none, none, none], names=names)
            if again:
                doc_, key_, place_, body_ = (pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*again))
                none = pa.nulls(len(doc_), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_, none, none, none, key_, place_, body_], names=names)

    return units.select("doc", "edition", "piece", "other", "piece2", "windows", "content", "content2").mapInArrow(
        run, "doc long, other long, first long, last long, key long, place long, body long")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, shingle: int = WORDS) -> DataFrame:
    """doc_id, first_doc_id, start_word, end_word (exclusive): passages that an earlier document has.

    A passage has at least `passage` words in a row and at least `similarity` of its
    `shingle`-word shingles in common with one of the document with the smaller
    doc_id. Exactly repeated passages are always found, similar ones if one of four
    joint min-hash signatures agrees. Overlapping passages from the same document are
    merged. Texts that are null, empty or shorter than a passage have none; rows with a
    null doc_id take no part; rows repeated under one doc_id are one document and not
    compared with each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    width = passage - shingle + 1
    if not 8 <= width <= 64:
        raise ValueError("a passage has 7 to 63 words more than a shingle")
    plain = as_document(docs).where("doc_id is not null and text is not null")
    several = bool(plain.groupBy("doc_id").count().where("count > 1").limit(1).count())
    windows, path = kept(_windows(plain, width, shingle, several), "windows")
    bodies, found, content = True, None, None
    while True:
        pair, led = _led(windows, bodies, True, bodies)
        forget(spark, path)
        whole = pair.where("equal").select("doc", "other", F.expr("(place >> 14) - (place >> 7 & 127)").alias("first"),
                                           F.expr("(place >> 14) + (place & 127) + 1").alias("last"))
        units, unit_path = kept(pair.where("not equal").groupBy(
            "doc", F.expr("body >> 32").alias("edition"), F.expr(f"(place >> 14) div {CHUNK}").alias("piece"),
            "other", F.expr("body2 >> 32").alias("edition2"), F.expr(f"(place2 >> 14) div {CHUNK}").alias("piece2")).agg(
            F.collect_set(F.struct("key", "place", "place2")).alias("windows")), "units")
        if content is None:
            needed = units.select("doc", "edition", "piece").unionByName(
                units.select(F.col("other").alias("doc"), F.col("edition2").alias("edition"), F.col("piece2").alias("piece"))).distinct()
            content = _pieces(plain, needed, shingle, CHUNK, several)
        theirs = content.toDF("other", "edition2", "piece2", "content2")
        checked, path = kept(_checked(
            units.join(content, ["doc", "edition", "piece"]).join(theirs, ["other", "edition2", "piece2"]), width, similarity, CHUNK), "checked")
        spans = stored(whole.unionByName(checked.where("first is not null").select("doc", "other", "first", "last")), "spans")
        forget(spark, led, unit_path)
        found = spans if found is None else found.unionByName(spans)
        windows, bodies = checked.where("key is not null").select("key", "doc", "place", "body"), False
        if not windows.limit(1).count():
            break
    forget(spark, path)
    return _merged(found, shingle)


def _merged(spans: DataFrame, shingle: int) -> DataFrame:
    """Overlapping and adjoining shingle spans of a pair of documents, as word spans."""
    step = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))))
    one = spans.groupBy("doc", "other").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return one.select(F.col("doc").alias("doc_id"), F.col("other").alias("first_doc_id"), F.explode(step).alias("s")).select(
        "doc_id", "first_doc_id", F.col("s.first").alias("start_word"), (F.col("s.last") + shingle - 1).alias("end_word"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word ranges and the blanks that follow them."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for first, last in sorted((min(a, len(starts) - 1), min(b, len(starts) - 1)) for a, b in spans):
        out.append(data[at:max(at, starts[first])])
        at = max(at, starts[last])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass").strip()


def cut_repeats(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the passages that a document with a smaller doc_id has; rows left without a word go.

    n_chars, where there is such a column, follows the text. Texts without a repeated
    passage, and rows with a null doc_id or text, stay as they are.
    """
    bound_batches(docs.sparkSession)
    names, fields = docs.columns, docs.schema.fields
    of, cuts = free_names(names, "of_doc", "cuts")
    spans = repeated_passages(docs, passage, similarity).groupBy(F.col("doc_id").alias(of)).agg(
        F.collect_set(F.struct("start_word", "end_word")).alias(cuts))
    joined = docs.join(spans, docs["doc_id"].cast("bigint") == spans[of], "left").drop(of)
    plain = [f"c{i}" for i in range(len(names))]  # names with dots cannot travel
    text_at = names.index("text")
    size_at = names.index("n_chars") if "n_chars" in names else None
    size_type = {"bigint": pa.int64(), "int": pa.int32()}.get(dict(docs.dtypes).get("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cuts = cols.pop().to_pylist()
            touched = [i for i, c in enumerate(cuts) if c]
            if touched:
                texts = cols[text_at].to_pylist()
                for i in touched:
                    texts[i] = without_words(texts[i], [(c["start_word"], c["end_word"]) for c in cuts[i]])
                if size_at is not None and size_type is not None:
                    sizes = cols[size_at].to_pylist()
                    for i in touched:
                        sizes[i] = len(texts[i])
                    cols[size_at] = pa.array(sizes, size_type)
                cols[text_at] = pa.array(texts, cols[text_at].type)
                stay = np.ones(len(texts), bool)
                stay[[i for i in touched if not texts[i]]] = False
                yield pa.RecordBatch.from_arrays(cols, names=plain).filter(pa.array(stay))
            else:
                yield pa.RecordBatch.from_arrays(cols, names=plain)

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, fields)])
    return joined.toDF(*plain, "cuts").mapInArrow(run, schema).toDF(*names)
