"""SimHash: fingerprints against the definition, components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folioweave.llm import simhash

SCHEMA = "doc_id long, text string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, limit=4):
    """Smallest reachable position for each of a list of fingerprints."""
    comp = list(range(len(prints)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "One TWO three", "a b c d", "a b c d a b c d a b c d",
                                  "É x Ä b\x0bc\x1cd e f g", "w " * 70000])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == plain(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("the café is open"))).first()[0]
    assert got & (2**64 - 1) == int(simhash.shingle_bits(["the", "café", "is", "open"] and "the café is open".encode().split())[0])


@pytest.mark.parametrize("small,partitions", [(64, 8), (2, 8), (5, 61)])
def test_components_against_brute_force(spark, small, partitions):  # with 2, most cells are crowded
    if partitions > 8:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        check_components(spark, small)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def check_components(spark, small):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0]
    for _ in range(400):  # chains and clusters of every distance up to six
        x = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        prints.append(x)
    prints = sorted(set(prints), key=signed)
    want = brute(prints)
    points = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r["fp"]: r["comp"] for r in simhash.near_components(points, small=small).collect()}
    place = {signed(p): i for i, p in enumerate(prints)}
    assert [place[got.get(signed(p), signed(p))] for p in prints] == want


def test_edges_of_the_input(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (7, None), (6, ""), (9, "q r s t u v w")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, 1), (1, 1), (3, 1), (3, 1), (6, 6), (7, 6), (9, 9)]
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 6, 9]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one_each(empty).count() == 0


def test_repeated_id_stays_once(spark):
    docs = spark.createDataFrame([(2, "one two three four five")] * 3, SCHEMA)
    assert simhash.keep_one_each(docs).count() == 1
