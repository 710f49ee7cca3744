"""Alignment: fragments against whole streams, queries against a plain restatement."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioweave.llm import alignment as A
from folioweave.llm import queries

SCHEMA = "doc_id long, text string"


def plain(texts):
    """doc -> (n_a, n_b, groups, links) by encoding each text whole and walking over its bytes."""
    one = Tokenizer.from_file(f"{A.FOLDER}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{A.FOLDER}/piece_bpe_32k.model")
    out = []
    for t in texts:
        if not t:
            out.append((0, 0, [], []))
            continue
        whole = b" " + t.encode()
        a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        bytes_a = [A.byte_level(one.id_to_token(i)) for i in a]
        bytes_b = [bytes.fromhex(p[3:5]) if two.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b, map(two.id_to_piece, b))]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((0, 0, [], []))
            continue
        groups, links, i, j, i0, j0, x, y = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            if x <= y:
                x, i = x + len(bytes_a[i]), i + 1
            while y < x and j < len(b):
                y, j = y + len(bytes_b[j]), j + 1
            if x == y:
                groups.append((a[i0:i], b[j0:j]))
                links.append((a[i - 1], b[j - 1]))
                i0, j0 = i, j
        out.append((len(a), len(b), groups, links))
    return out


def expected(rows):
    made = plain([t for _, t in rows])
    counts = Counter(x for m in made for x in m[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, made):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = ["", None, " ", "  two  blanks ", "tab\tand\nline \n x", "\u2581 sign", "<|endoftext|> <s>hi</s> <0x41>", "日本語のテキスト 日本", "e\u0301 é ﬁ", "a\x00b c",
       "\u00a0nbsp \u00a0x\u00a0 y\u2003 z", "x" * 300, "don't we'll I'M", "٣ 12345678901234567890 ½", "🙂🙂 👩‍👩‍👧 x", "\u180e a \u180e b", "end ", "\x1c a\x1d b \x1f", "ÿÿ þ\u0080 \u0085 c"]


def texts_of(rng, n):
    words = ["the", "tokens", "Straße", "naïve", "foo_bar(x)", "日本", "\n\n", "  ", "https://a.b/c?d=e", "x9y8", "'s", "…", "0x1F", "zzzzqqqq", "été", "\u00a0"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_composition_is_associative_and_whole():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randint(1, 40)
        ends = [np.array(sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))})) for _ in range(2)]
        ids = [np.arange(len(e)) + 100 * k for k, e in enumerate(ends)]
        whole = A.fragments(ids[0], ends[0], ids[1], ends[1], [size])[0]
        cuts = sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, min(8, size)))})
        parts = A.fragments(ids[0], ends[0], ids[1], ends[1], cuts)
        assert len(parts) == len(cuts)
        while len(parts) > 1:  # any tree
            at = rng.randrange(len(parts) - 1)
            parts[at:at + 2] = [parts[at].then(parts[at + 1])]
        assert parts[0] == whole == A.Fragment().then(whole) == whole.then(A.Fragment())


def test_byte_level_covers_every_byte():
    assert sorted(A.byte_level("".join(A._byte_of_char()))) == list(range(256))


@pytest.mark.parametrize("long,span,fan", [(1 << 16, 1 << 13, 16), (40, 7, 2), (0, 3, 3), (60, 1, 4)])
def test_against_whole_texts(spark, long, span, fan):
    rng = random.Random(long + span)
    texts = ODD + texts_of(rng, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[-2]), (3, texts[-2])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(A.aligned(df, long=long, span=span, fan=fan)) == expected(rows)


def test_blocks_and_kept_words_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(ODD + texts_of(rng, 50)))
    monkeypatch.setattr(A, "BLOCK_CHARS", 500)
    monkeypatch.setattr(A, "_KEPT", 5)
    monkeypatch.setattr(A, "LINE", 3)
    for quick in (True, False):
        pair = A.Pair(A.FOLDER)
        assert pair.quick is not None and pair.cuts
        pair.quick = pair.quick if quick else None
        numbers = [pair.words.numbers(pair.words_of(t)).tolist() if t else [] for _, t in rows]
        pair.learn()
        for at, (n_a, n_b, groups, links) in zip(numbers, plain([t for _, t in rows])):
            ok = bool(at) and all(pair.words.facts[i, 0] for i in at)
            found = [x for i in at for x in np.frombuffer(pair.words.links[i], np.int64).tolist()] if ok else []
            assert (sum(pair.words.facts[i, 1] for i in at) if ok else 0) == n_a and found == A.packed(links)
    extra = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, block int, key string")
    assert got(A.aligned(extra)) == expected(rows)


def test_empty_table_and_one_long_text(spark):
    assert got(A.aligned(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, " ".join(texts_of(random.Random(3), 900))), (2, "x" * 70_000), (3, None)]
    assert len(rows[0][1]) > 1 << 16
    assert got(A.aligned(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op11_alignment(spark, sf)) == expected(rows)


def test_blocks_are_carried_as_few_bytes(spark):
    """Spark sees one compressed value for the links of a block, not an array of them."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "tokens", "of", "naïve", "texts", "been"]) for _ in range(2000))) for i in range(8)]
    blocks = A._short_blocks(spark.createDataFrame(rows, SCHEMA).coalesce(1), A.FOLDER)
    made = blocks.selectExpr("octet_length(links) AS size", "element_at(upto, -1) AS n").first()
    assert made["n"] >= 16_000 and made["size"] < 1.5 * made["n"]
    assert got(A.aligned(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
