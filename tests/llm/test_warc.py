"""Archives: round trips, and what is left of damaged ones."""

import base64
import gzip
import hashlib
import random

import pytest

from folioweave.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, size string"


def record(i, body=b"hello", extra=b""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(block).digest())
    return (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\n%sContent-Length: %d\r\n\r\n"
            % (i, digest, extra, len(block))) + block + b"\r\n\r\n"


def good(data):
    return [int(f["warc-record-id"][10:-1]) for _, _, f, _ in W.salvage(data) if f]


def gaps(data):
    return [(s, e) for s, e, f, _ in W.salvage(data) if f is None]


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_damage(pack):
    one, two, three = (pack(record(i, bytes([65 + i]) * 3000)) for i in (1, 2, 3))
    assert good(one + two + three) == [1, 2, 3] and not gaps(one + two + three)
    cut = two[:len(two) // 2]
    assert good(one + cut + three) == [1, 3] and gaps(one + cut + three) == [(len(one), len(one) + len(cut))]
    flipped = bytearray(two)
    flipped[len(two) // 2] ^= 1
    assert good(one + bytes(flipped) + three) == [1, 3]
    assert gaps(one + bytes(flipped) + three)[0][0] == len(one)
    assert good(b"junk\r\n" + one + two[:-9]) == [1]
    assert gaps(b"junk\r\n" + one) == [(0, 6)]
    assert good(b"") == [] and gaps(b"nothing here") == [(0, 12)]


def test_wrong_length_and_embedded_version_line():
    a = record(1, b"text\r\nWARC/1.1\r\nnot: a record\r\n\r\nmore")
    b = record(2).replace(b"Content-Length: 24", b"Content-Length: 99999")
    c = record(3).replace(b"Content-Length: 24", b"Content-Length: no")
    assert good(a + b + c + record(4)) == [1, 4]
    assert gaps(a + b + c + record(4)) == [(len(a), len(a + b + c))]


def test_every_byte_is_accounted_for():
    rng = random.Random(3)
    for _ in range(200):
        data = bytearray(b"".join((gzip.compress if rng.random() < 0.5 else bytes)(record(i, rng.randbytes(rng.randint(0, 80)))) for i in range(6)))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(data))
            data[at:at + rng.randint(0, 30)] = rng.randbytes(rng.randint(0, 20))
        seen = bytearray(len(data))
        for start, end, _, _ in W.salvage(bytes(data)):
            seen[start:end] = b"x" * (end - start)
        assert not bytes(b for b, x in zip(data, seen) if not x).strip(b"\r\n")


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>", "d", "s"), (2, "http://a/y\r\nEvil: 1", "<p>é</p>", "d", "s"), (3, None, None, "d", "s"), (4, "u", "", "d", "s"),
            (5, "u", "a\r\n\r\nWARC/1.1\r\nb", "d", "s"), (None, "u", "<p>é</p>", "d", "s"), (1, "again", "<p>é</p>", "d", "s"), (None, "u", "solo", "d", "s"),
            (9, "u", "x" * 17_000_000, "d", "s")]
    W.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    back = W.read_warc(spark, str(tmp_path / "w"))
    assert W.quarantined(back).count() == 0
    got = sorted(((r["page_id"] or 0, r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in back.collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>é</p>": 1, "": 3}
    want = []
    for i, url, html, *_ in rows:
        f = first.get(html or "")
        again = f if f is not None and f != i else None
        url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
        want.append((i or 0, url, "revisit" if again else "response", again, len((html or "").encode()), digest(html)))
    assert got == sorted(want, key=str)
    assert {bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()} == {r[2] or "" for r in rows}


def test_members_end_with_zero():
    for size in (0, 1, 300, 1 << 24):
        packed = W.member(b"a" * size)
        assert packed[-1] == 0 and gzip.decompress(packed) == b"a" * size


def test_least_size_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcd", "", ""), (4, "u", "abcd", "", "")]
    W.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), least=3)
    got = {r["page_id"]: r["refers_to"] for r in W.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    W.write_warc(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert W.read_warc(spark, str(tmp_path / "none")).count() == 0
