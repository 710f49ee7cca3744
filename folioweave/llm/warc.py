"""WARC archives: pages out as response and revisit records, and a reader that survives damage.

Records are text columns, tasks compress each to a member of its own and Spark writes
the files, so any file system will do. The reader takes whole files as rows. Where a record fails its checks it looks for the
next compressed member or version line, goes on there and logs the bytes in between.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.common import bound_batches

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")  # after a record that is cut short, not at the start of a line
_MEMBER = b"\x1f\x8b\x08"


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1 of a string's UTF-8: four numbers of 40 bits, eight digits each."""
    digest = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _with_roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, body, digest, size and first, the page whose payload this one repeats (null: none)."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).withColumn("size", F.octet_length("body").cast("bigint"))
    first = rows.groupBy("digest", "size").agg(F.min("page_id").alias("least"))
    joined = rows.join(first, ["digest", "size"])
    repeats = (F.col("size") >= least) & F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return joined.withColumn("first", F.when(repeats, F.col("least"))).drop("least")


def _record() -> Column:
    """A whole record."""
    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def page(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    again = F.col("first").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(F.lit(_HTTP), F.when(again, F.lit("")).otherwise(F.col("body")))
    return F.concat(
        F.lit(VERSION + "\r\n"), field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", page("page_id")), F.coalesce(field("WARC-Target-URI", url), F.lit("")),
        F.when(again, F.concat(field("WARC-Refers-To", page("first")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("X-Payload-Length", F.col("size").cast("string")),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit(_END))


def member(record: bytes) -> bytes:
    """The record as a compressed member that ends with a zero byte.

    The last byte is the highest of the record's length. Where that is not zero, an
    empty member follows.
    """
    packed = gzip.compress(record, 6, mtime=0)
    return packed if not packed[-1] else packed + gzip.compress(b"", 6, mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            packed = [member(r.as_buffer().to_pybytes())[:-1] for r in b.column(0).slice(lo, 200)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write one record per row of `pages` (page_id, url, html) below `path`.

    Of rows with equal payloads of at least `least` bytes the one with the smallest
    page_id is a response and the others revisit it. A null html is an empty
    payload. Rows with a null page_id never are what others refer to, unless no row of
    the payload has one: then all are responses; rows repeated under the page_id that
    is referred to are all responses. Files are of the session's advisory size. The
    text writer ends each value with the zero byte that ends every member.
    """
    bound_batches(pages.sparkSession)
    rows = _with_roles(pages, least).select(_record().cast("binary").alias("value")).mapInArrow(_members, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").mode("error").text(path)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, fields, block) of the record at `at`; ValueError says which check fails."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("header without an end")
    lines = data[at:head].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,15}", fields.get("content-length", "")):
        raise ValueError("no content length")
    start = head + 4
    end = start + int(fields["content-length"])
    if end > len(data):
        raise ValueError("record is cut short")
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where it says")
    block = data[start:end]
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != _sha1(block):
        raise ValueError("block digest differs")
    return end + 4, fields, block


def _member(data: bytes, at: int) -> tuple[int, bytes]:
    """(end, content) of the compressed member at `at`."""
    inflate, content, fed = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and fed < len(data):
            content.append(inflate.decompress(data[fed:fed + 65536]))
            fed = min(fed + 65536, len(data))
    except zlib.error as e:
        raise ValueError(f"member is damaged: {e}") from e
    if not inflate.eof:
        raise ValueError("member is cut short")
    return fed - len(inflate.unused_data), b"".join(content)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """(start, end, fields, block) of each good record, (start, end, None, reason) of each gap, in order.

    `data` holds records one after the other, each plain or a compressed member of its
    own. Every byte belongs to a record, a gap or line ends between records.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        got: list[tuple[int, int, dict[str, str] | None, bytes | str]] = []
        try:
            if data.startswith(_MEMBER, at):
                end, content = _member(data, at)
                for _, _, fields, block in salvage(content):
                    got.append((at, end, fields, block))
            elif bad is None and data[at] in b"\r\n":
                at += 1
                continue
            else:
                end, fields, block = _parse(data, at)
                got.append((at, end, fields, block))
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            following = _NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield bad, at, None, why
            bad = None
        yield from got
        at = end
    if bad is not None:
        yield bad, len(data), None, why


_SCHEMA = ("path string, start long, end long, gap string, page_id long, url string, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string, payload binary")


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record and every gap of the archives below `path`.

    gap is null for records; for quarantined bytes it says which check failed, and
    start and end say where they are. Size and digest of a response are computed from
    its payload, those of a revisit are what it states of the payload it refers to.
    `payload`: whether the payloads themselves are wanted.
    """
    bound_batches(spark)
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for start, end, fields, block in salvage(data):
            if fields is None:
                yield path, start, end, block, *[None] * 7
                continue
            kind = fields.get("warc-type", "")
            head = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
            body = block[head + 4:] if head >= 0 else block
            if kind == "revisit":
                stated = fields.get("x-payload-length", "")
                size = int(stated) if re.fullmatch("[0-9]{1,15}", stated) else None
                digest, body = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
            else:
                size, digest = len(body), _sha1(body)
            yield (path, start, end, None, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind,
                   _page(fields.get("warc-refers-to")), size, digest, body if payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                part, size = [], 0
                for row in rows(path.as_py(), content.as_py()):
                    part.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def quarantined(archive: DataFrame) -> DataFrame:
    """path, start, end, gap: the log of bytes that could not be read."""
    return archive.where("gap is not null").select("path", "start", "end", "gap")


_DIGIT = "translate(to_base(('0x' || substr(h, {}, 10))::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
ARCHIVE_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {' || '.join(_DIGIT.format(10 * i + 1) for i in range(4))} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
