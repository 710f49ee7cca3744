"""Cross-tokenizer alignment: groups of tokens of two tokenizers, composed from fragments.

Two token streams of one text are cut where tokens of both end at the same byte. A
fragment of a text is what a range of its bytes yields: an open prefix up to the first
common end, closed groups, an open suffix after the last. Putting two neighbouring
fragments together closes the group between them; this is associative, so fragments
may be made anywhere and put together in any tree.

That is used twice. Within a task the fragments of the words of a text are kept and
put together again: a word's tokens are made once for all texts that hold it, since
both tokenizers end a token before a single blank (see `Pair`). Long
texts are dealt to many tasks, cut into byte ranges wherever these fall, inside tokens
too, and a tree of aggregates composes what is open at their edges; what is closed
stays where it is.

How often a pair of ids is linked in the corpus is looked up for the distinct pairs of
a block of texts, not for each text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import as_document, bound_batches, stored

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
LONG = 1 << 16        # bytes of a text that one task aligns as a whole; also of the pieces that longer ones travel in
RANGE = 1 << 13       # bytes of a fragment of a longer text
FAN = 16              # fragments that a step of the tree composes
BLOCK_CHARS = 2_000_000  # characters of the texts of a block, about
BLOCK_TEXTS = 20_000  # texts of a block at most
_KEPT = 100_000       # words whose fragments a task keeps from block to block
LATIN = 0x250         # characters below this one have a faster encoder
_BEYOND = chr(LATIN)
LINE = 512            # words whose tokens are made at a time
_BORDER = re.compile(r"(?<=\S) (?=\S)")
# fixed values: the words of the byte-level tokenizer
_WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level(piece: str) -> bytes:
    """The bytes of a byte-level token: printable Latin-1 stands for itself, other bytes for characters from U+0100 on."""
    return bytes(map(_byte_of_char().__getitem__, piece))


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Fragment:
    """What a stretch of bytes yields; ids as lists, closed groups as text."""

    ok: bool = True                                          # the tokens' bytes are those of the text
    ends: bool = False                                       # it holds a common end
    a: list[int] = field(default_factory=list)               # open prefix; all tokens if there is no common end
    b: list[int] = field(default_factory=list)
    closed: list[str] = field(default_factory=list)          # groups between the first and the last common end
    links: list[tuple[int, int]] = field(default_factory=list)
    a2: list[int] = field(default_factory=list)              # open suffix
    b2: list[int] = field(default_factory=list)

    def then(self, other: Fragment) -> Fragment:
        """This fragment and the one that follows it; associative, with Fragment() as neutral element."""
        ok = self.ok and other.ok
        if not self.ends:
            return Fragment(ok, other.ends, self.a + other.a, self.b + other.b, other.closed, other.links, other.a2, other.b2)
        if not other.ends:
            return Fragment(ok, True, self.a, self.b, self.closed, self.links, self.a2 + other.a, self.b2 + other.b)
        text, link = group(self.a2 + other.a, self.b2 + other.b)
        return Fragment(ok, True, self.a, self.b, [*self.closed, text, *other.closed], [*self.links, link, *other.links], other.a2, other.b2)


def group(a: list[int], b: list[int]) -> tuple[str, tuple[int, int]]:
    """A closed group as text, and the pair of tokens that end with it."""
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}", (a[-1], b[-1])


def fragments(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, cuts: list[int], ok: bool = True) -> list[Fragment]:
    """Token streams with the byte each token ends at, as one fragment for each range of bytes up to the next cut.

    A token belongs to the range that holds its last byte.
    """
    common = np.intersect1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
    of_a, of_b, of_common = (np.searchsorted(x, cuts, "right").tolist() for x in (ends_a, ends_b, common))
    a, b, at_a, at_b = a.tolist(), b.tolist(), at_a.tolist(), at_b.tolist()
    out, i, j, k = [], 0, 0, 0
    for i2, j2, k2 in zip(of_a, of_b, of_common):
        if k == k2:
            out.append(Fragment(ok, False, a[i:i2], b[j:j2]))
        else:
            made = [group(a[at_a[g - 1]:at_a[g]], b[at_b[g - 1]:at_b[g]]) for g in range(k + 1, k2)]
            out.append(Fragment(ok, True, a[i:at_a[k]], b[j:at_b[k]], [g[0] for g in made], [g[1] for g in made],
                                a[at_a[k2 - 1]:i2], b[at_b[k2 - 1]:j2]))
        i, j, k = i2, j2, k2
    return out


class Word(NamedTuple):
    """The closed fragment of a word: all its groups."""

    ok: bool
    text: str
    n_a: int
    n_b: int
    links: bytes  # first id << 32 | second id, as 64-bit integers


_CHANGED = Word(False, "", 0, 0, b"")


def packed(links: Iterable[tuple[int, int]]) -> list[int]:
    return [a << 32 | b for a, b in links]


class Words(dict):
    """Word -> number, in the order of arrival, and what is known of the words by number."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.texts: list[str] = []
        self.links: list[bytes] = []
        self.facts = np.empty((0, 4), np.int64)  # whether it is unchanged, tokens of both, links

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def add(self, made: list[Word]) -> None:
        self.texts += [w.text for w in made]
        self.links += [w.links for w in made]
        self.facts = np.concatenate([self.facts, np.array([(w.ok, w.n_a, w.n_b, len(w.links) // 8) for w in made], np.int64).reshape(-1, 4)])
        self.new = []

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Pair:
    """The two tokenizers and the fragments of words seen so far. `folder` holds both files."""

    def __init__(self, folder: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_file(os.path.join(folder, FILES[0]))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, FILES[1]))
        added = {t.content for t in self.first.get_added_tokens_decoder().values()}
        self.bytes_a = {i: t.encode() if t in added else byte_level(t) for t, i in self.first.get_vocab().items()}
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in pieces]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, t in self.bytes_a.items():
            self.size_a[i] = len(t)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.marks = [np.array([[f"{i},", f"{i}{last}"] for i in range(n)], object) for n, last in ((len(self.size_a), "|"), (len(self.size_b), ";"))]
        # Before a single blank that follows what is no white space, the first one's pattern of words always begins a
        # new word, and the second one ends a piece if none of its pieces holds a blank behind something else.
        with open(os.path.join(folder, FILES[0]), encoding="utf-8") as file:
            rules = json.load(file)
        words = rules.get("pre_tokenizer") or {}
        self.cuts = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.quick = self._ranked(rules) if self.cuts else None
        self.words = Words()

    def _ranked(self, rules: dict):
        """A faster encoder of Latin words from the same vocabulary, if its numbers are the order of its merges.

        It is tried on every character it will be used for.
        """
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
        vocabulary = rules["model"]["vocab"]
        if any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)) or len(vocabulary) != 256 + len(merges):
            return None
        quick = tiktoken.Encoding("words", pat_str=_WORDS, mergeable_ranks={byte_level(t): i for t, i in vocabulary.items()}, special_tokens={})
        for c in map(chr, range(LATIN)):
            sample = f" x{c}y {c} {c}{c}1 '{c} 9{c}{c} z\t{c}"
            if quick.encode_ordinary(sample) != self.first.encode(sample, add_special_tokens=False).ids:
                return None
        return quick

    def streams(self, texts: list[str]) -> list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of a blank and each text: whether the tokens give its bytes, ids and ends (in bytes) of both tokenizers."""
        out = []
        ones = self.first.encode_batch([" " + t for t in texts], add_special_tokens=False)
        for text, one, b in zip(texts, ones, self.second.encode(texts, num_threads=1)):
            parts, parts2 = [self.bytes_a[i] for i in one.ids], [self.bytes_b[i] for i in b]
            whole = b" " + text.encode("utf-8", "surrogatepass")
            out.append((b"".join(parts) == whole and b"".join(parts2) == whole,
                        np.array(one.ids, np.int64), np.cumsum([len(p) for p in parts], dtype=np.int64),
                        np.array(b, np.int64), np.cumsum([len(p) for p in parts2], dtype=np.int64)))
        return out

    def words_of(self, text: str) -> list[str]:
        """The text, cut at single blanks, which are left out."""
        return _BORDER.split(text) if self.cuts else [text]

    def border(self, text: str, start: int) -> int:
        """The first place from `start` on where the text may be cut; its length if there is none."""
        found = _BORDER.search(text, start) if self.cuts else None
        return found.start() if found else len(text)

    def learn(self) -> None:
        """Makes the fragments of all words that have been numbered since the last time."""
        new = self.words.new
        if not new:
            return
        plain = [bool(self.quick) and (w.isascii() or max(w) < _BEYOND) for w in new]
        made: list[Word | None] = [None] * len(new)
        for quick, encode in ((True, self._quickly), (False, self._slowly)):
            some = [i for i, p in enumerate(plain) if p is quick]
            inner = [i for i in some if not (new[i][0].isspace() or new[i][-1].isspace())]
            lines = [inner[lo:lo + LINE] for lo in range(0, len(inner), LINE)]
            # what begins or ends with white space does not stand between single blanks, nor in a line with others
            lines += [[i] for i in some if new[i][0].isspace() or new[i][-1].isspace()]
            for part in lines:
                for i, word in zip(part, self._line([new[i] for i in part], encode)):
                    made[i] = word
        self.words.add(made)

    def _quickly(self, text: str) -> list[int]:
        return self.quick.encode_ordinary(text)

    def _slowly(self, text: str) -> list[int]:
        return self.first.encode(text, add_special_tokens=False).ids

    def _line(self, words: list[str], encode) -> list[Word]:
        """Fragments of words written behind one another with single blanks, which changes none of them."""
        line = " ".join(words)
        a, b = encode(" " + line), self.second.encode(line)
        whole = b" " + line.encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            if len(words) == 1:
                return [_CHANGED]
            half = len(words) // 2
            return self._line(words[:half], encode) + self._line(words[half:], encode)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a, upto_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
        # the text of a group: ids of the one with commas, a bar, ids of the other with commas, a semicolon
        marks = np.empty(len(a) + len(b), object)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        marks[np.arange(len(a)) + np.concatenate([[0], upto_b])[of_a]] = self.marks[0][a, (ends_a == common[of_a]).astype(int)]
        marks[np.arange(len(b)) + upto_a[of_b]] = self.marks[1][b, (ends_b == common[of_b]).astype(int)]
        marks = marks.tolist()
        links = (a[upto_a - 1] << 32 | b[upto_b - 1]).tobytes()
        sizes = np.cumsum([len(w) + 1 for w in words] if line.isascii() else [len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
        groups = np.searchsorted(common, sizes, "right").tolist()
        in_a, in_b = np.searchsorted(ends_a, sizes, "right").tolist(), np.searchsorted(ends_b, sizes, "right").tolist()
        out, g, x, y = [], 0, 0, 0
        for g2, x2, y2 in zip(groups, in_a, in_b):
            out.append(Word(True, "".join(marks[x + y:x2 + y2])[:-1], x2 - x, y2 - y, links[8 * g:8 * g2]))
            g, x, y = g2, x2, y2
        return out


@lru_cache(maxsize=1)
def pair(folder: str) -> Pair:
    """Loaded once in a process."""
    return Pair(folder)


_BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, sha array<string>, upto array<long>, links binary, "
          "a array<int>, b array<int>, n array<long>")


def _block(number: int, items: list[tuple[int | None, int, int, str]], upto: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """A row of the block table: items (id, tokens, tokens, digest), where each one's links end, and all links as places in `pairs`.

    The links are most of a block, and Spark only carries them: they are compressed 32-bit integers, no array.
    """
    def one(values, kind) -> pa.Array:
        return pa.array([values], pa.list_(kind))

    ids, n_a, n_b, sha = map(list, zip(*items))
    n = np.bincount(at, minlength=len(pairs)).astype(np.int64)
    places = pa.compress(at.astype("<i4").tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one(ids, pa.int64()), one(n_a, pa.int64()), one(n_b, pa.int64()), one(sha, pa.string()),
         one(upto, pa.int64()), pa.array([places], pa.binary()), one((pairs >> 32).astype(np.int32), pa.int32()),
         one((pairs & 0xFFFFFFFF).astype(np.int32), pa.int32()), one(n, pa.int64())], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _block_of_texts(number: int, ids: list[int | None], texts: list[np.ndarray], words: Words) -> pa.RecordBatch:
    """The block of texts given as numbers of words: the words' fragments put together, by arrays over the whole block."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    used, at = np.unique(np.concatenate(texts), return_inverse=True)
    facts = words.facts[used]
    distinct = used.tolist()
    pairs, local = np.unique(np.frombuffer(b"".join([words.links[i] for i in distinct]), np.int64), return_inverse=True)
    first = np.cumsum(facts[:, 3]) - facts[:, 3]
    upto = np.concatenate([[0], np.cumsum(1 - facts[at, 0])])
    fine = (upto[starts + sizes] == upto[starts]) & (sizes > 0)
    at = at[np.repeat(fine, sizes)]
    count = facts[at, 3]
    ends = np.cumsum(count)
    links = local[np.repeat(first[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.cumsum(np.where(fine, sizes, 0))
    sums = [np.concatenate([[0], np.cumsum(facts[at, c])]) for c in (1, 2, 3)]
    n_a, n_b, n = (np.diff(np.concatenate([[0], s[bounds]])).tolist() for s in sums)
    closed = words.texts
    items = [(doc, a, b, hashlib.sha256(";".join([closed[i] for i in text.tolist()]).encode()).hexdigest() if ok else "")
             for doc, a, b, text, ok in zip(ids, n_a, n_b, texts, fine.tolist())]
    return _block(number, items, np.cumsum(n), links, pairs)


def _numbers(sign: int) -> Iterator[int]:
    """Numbers that no other task gives."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    while True:
        at += 1
        yield sign * at


def _short_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """Blocks of whole texts, aligned where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, numbers = pair(folder), _numbers(1)
        held, texts, chars = [], [], 0

        def block() -> pa.RecordBatch:
            tokenizers.learn()
            return _block_of_texts(next(numbers), held, texts, tokenizers.words)

        for b in batches:
            for doc, scalar in zip(b.column(0).to_pylist(), b.column(1)):
                text = scalar.as_py() or ""
                held.append(doc)
                texts.append(tokenizers.words.numbers(tokenizers.words_of(text) if text else []))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(held) >= BLOCK_TEXTS:
                    yield block()
                    held, texts, chars = [], [], 0
                    if len(tokenizers.words) > _KEPT:
                        tokenizers.words = Words()
                    pa.default_memory_pool().release_unused()
        if held:
            yield block()
        tokenizers.words = Words()

    return docs.mapInArrow(run, _BLOCK)


_PIECE = "key long, doc_id long, piece long, byte long, text string"
_OPEN = "ok boolean, ends boolean, a array<int>, b array<int>, a2 array<int>, b2 array<int>, n_a long, n_b long"
_LEAF = f"key long, doc_id long, seq long, at long, {_OPEN}, closed string, links array<long>"


def _leaves(docs: DataFrame, folder: str, piece: int, span: int) -> DataFrame:
    """Fragments of long texts. A text is cut into pieces where its tokenizers allow it, a piece's tokens wherever a byte range ends.

    The pieces are dealt to all tasks; only long texts are shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, numbers = pair(folder), _numbers(1)
        for b in batches:
            for doc, held in zip(b.column(0).to_pylist(), b.column(1)):
                text, key, start, byte, number = held.as_py(), next(numbers), 0, 0, 0
                while start < len(text):
                    stop = tokenizers.border(text, start + piece)
                    part = text[start:stop]
                    yield _batch([(key, doc, number, byte, part)], _PIECE)
                    start, byte, number = stop + 1, byte + 1 + len(part.encode("utf-8", "surrogatepass")), number + 1

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair(folder)
        for b in batches:
            for key, doc, number, byte, text in zip(*(c.to_pylist() for c in b.columns)):
                ok, a, ends_a, b2, ends_b = tokenizers.streams([text])[0]
                rows = []
                if ok:
                    last = int(ends_a[-1])
                    cuts = [*range(span - byte % span, last, span), last]
                    for i, f in enumerate(fragments(a, ends_a, b2, ends_b, cuts)):
                        inner = (sum(map(_ids_a, f.closed)), sum(map(_ids_b, f.closed)))
                        rows.append((key, doc, number << 32 | i, (byte + cuts[i] - 1) // span, True, f.ends, f.a, f.b, f.a2, f.b2,
                                     len(f.a) + inner[0] + len(f.a2), len(f.b) + inner[1] + len(f.b2), ";".join(f.closed), packed(f.links)))
                else:
                    rows.append((key, doc, number << 32, byte // span, False, False, [], [], [], [], 0, 0, "", []))
                yield _batch(rows, _LEAF)

    pieces = docs.mapInArrow(cut, _PIECE).repartition("key", "piece")
    return pieces.mapInArrow(align, _LEAF)


def _ids_a(closed: str) -> int:
    return closed.partition("|")[0].count(",") + 1


def _ids_b(closed: str) -> int:
    return closed.partition("|")[2].count(",") + 1


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


_NODE = f"key long, at long, seq long, lead long, {_OPEN}, text string, link long"


def _step(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes composed, `fan` ranges at a time: one node each, and a row with text and link for each group that this closed.

    `lead` is the first leaf of a node with a common end; a group belongs to the leaf in which it ends.
    """
    parts = ["seq", "lead", *[c.split()[0] for c in _OPEN.split(", ")]]
    groups = nodes.groupBy("key", F.expr(f"at div {fan}").alias("at")).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, at, parts in zip(*(c.to_pylist() for c in b.columns)):
                whole, lead, n_a, n_b = Fragment(), None, 0, 0
                for p in parts:
                    closing = whole.ends and p["ends"]
                    whole = whole.then(Fragment(p["ok"], p["ends"], p["a"], p["b"], [], [], p["a2"], p["b2"]))
                    if closing:
                        rows.append((key, at, p["lead"], p["lead"], True, True, [], [], [], [], 0, 0, whole.closed.pop(), packed([whole.links.pop()])[0]))
                    lead = p["lead"] if lead is None else lead
                    n_a, n_b = n_a + p["n_a"], n_b + p["n_b"]
                rows.append((key, at, parts[0]["seq"], lead, whole.ok, whole.ends, whole.a, whole.b, whole.a2, whole.b2, n_a, n_b, None, None))
            yield _batch(rows, _NODE)

    return groups.select("key", "at", "nodes").mapInArrow(run, _NODE)


def _long_texts(leaves: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """(key, n_a, n_b, sha) of every long text; (key, seq, text, links) of its leaves with all groups that end there.

    A text whose tokens do not give its bytes has zeros, no digest and no leaves.
    """
    nodes = leaves.withColumn("lead", F.when(F.col("ends"), F.col("seq")))
    top = leaves.agg(F.max("at").alias("top")).first()["top"]
    joints = None
    while True:
        step = stored(_step(nodes, fan), "alignment-tree")
        nodes, closed = step.where("text is null"), step.where("text is not null").select("key", "seq", "text", "link")
        joints = closed if joints is None else joints.unionByName(closed)
        top //= fan
        if not top:
            break
    whole = F.col("ok") & F.col("ends")
    roots = nodes.select("key", whole.alias("ok"), *[F.when(whole, F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b")])
    # both streams begin with the text: its open prefix is a group
    ids = [F.array_join(F.col(c).cast("array<string>"), ",") for c in "ab"]
    begins = nodes.where("ok and ends").select(
        "key", F.col("lead").alias("seq"), F.concat_ws("|", *ids).alias("text"),
        F.shiftleft(F.element_at("a", -1).cast("bigint"), 32).bitwiseOR(F.element_at("b", -1).cast("bigint")).alias("link"))
    mine = leaves.where("ends").select("key", "seq", "closed", "links").join(joints.unionByName(begins), ["key", "seq"]).join(
        roots.where("ok").select("key"), "key")
    text = F.when(F.col("closed") == "", F.col("text")).otherwise(F.concat_ws(";", "text", "closed"))
    mine = stored(mine.select("key", "seq", text.alias("text"), F.concat(F.array("link"), "links").alias("links")), "alignment-leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "sha"])
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b";")
                digest.update(text.encode())
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "sha"])

    # leaf after leaf goes through the hash; no more than a batch of them is held
    digests = mine.select("key", "text", "seq").repartition("key").sortWithinPartitions("key", "seq").select("key", "text").mapInArrow(
        run, "key long, sha string")
    facts = roots.join(digests, "key", "left").select("key", "n_a", "n_b", F.coalesce("sha", F.lit("")).alias("sha"))
    return facts, mine


def _leaf_blocks(leaves: DataFrame) -> DataFrame:
    """Blocks of the leaves of long texts; their ids are the texts' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(-1)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                links = part.column(1).to_pylist()
                pairs, at = np.unique(np.fromiter(chain.from_iterable(links), np.int64), return_inverse=True)
                yield _block(next(numbers), [(k, 0, 0, "") for k in part.column(0).to_pylist()], np.cumsum([len(x) for x in links]), at, pairs)

    return leaves.select("key", "links").mapInArrow(run, _BLOCK)


def _looked_up(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_links, n_best, count_sum, sha of every item of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n_a, n_b, sha, upto, links, found = (b.column(i) for i in range(7))
            for r in range(b.num_rows):
                ends = upto[r].values.to_numpy()
                at = np.frombuffer(pa.decompress(links[r].as_buffer(), 4 * int(ends[-1]), codec="zstd"), "<i4")
                entries = found[r].values
                counts, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if entries is not None and len(entries):
                    place = entries.field("i").to_numpy()
                    counts, best = np.zeros(len(entries), np.int64), np.zeros(len(entries), np.int64)
                    counts[place] = entries.field("n").to_numpy()
                    best[place] = entries.field("best").to_numpy(zero_copy_only=False)
                sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (counts, best)]
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [ids[r].values, n_a[r].values, n_b[r].values, pa.array(ends - starts), pa.array(sums[1][ends] - sums[1][starts]),
                     pa.array(sums[0][ends] - sums[0][starts]), sha[r].values],
                    names=["doc_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "sha"])

    joined = blocks.join(answers, "block", "left").select("doc_id", "n_a", "n_b", "sha", "upto", "links", "found")
    return joined.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, sha string")


def aligned(docs: DataFrame, folder: str = FOLDER, long: int = LONG, span: int = RANGE, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`.

    The first tokenizer gets a blank and the text, the second the text, to which it adds
    a blank. Rows count as often as they occur; a row without an id keeps a null one.
    Texts that are null or empty, or that a tokenizer changes, have zeros and no digest.
    Both files of the tokenizers are read from `folder` on every machine.

    Texts of up to `long` bytes are aligned where they lie; longer ones travel in pieces,
    are composed from fragments of `span` bytes, `fan` at a time, and digested leaf by
    leaf. How often pairs of ids are linked is counted over all texts.
    """
    bound_batches(docs.sparkSession)
    plain = as_document(docs).withColumn("text", F.coalesce("text", F.lit("")))
    bytes_ = F.octet_length("text")
    short = stored(_short_blocks(plain.where(bytes_ <= long), folder), "alignment-blocks")
    leaves = stored(_leaves(plain.where(bytes_ > long), folder, long, span), "alignment-fragments")
    blocks, texts = short, None
    if leaves.limit(1).count():
        facts, mine = _long_texts(leaves, fan)
        texts = stored(facts.join(leaves.select("key", "doc_id").distinct(), "key"), "alignment-texts")
        more = stored(_leaf_blocks(mine), "alignment-leaf-blocks")
        blocks = short.unionByName(more)

    counted = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    counted = stored(counted, "alignment-pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    pairs = counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select("block", "i", "p.a", "p.b")
    # a block has a bounded number of distinct pairs
    answers = stored(asked.join(pairs, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("i", "n", "best")).alias("found")),
                     "alignment-answers")
    out = _looked_up(short, answers)
    if texts is not None:
        sums = _looked_up(more, answers).groupBy(F.col("doc_id").alias("key")).agg(
            *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
        out = out.unionByName(texts.join(sums, "key", "left").select(
            "doc_id", "n_a", "n_b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")], "sha"))
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum",
                      F.col("sha").alias("groups_sha256"))
