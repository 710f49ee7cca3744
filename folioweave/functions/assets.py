"""Image and data-URI expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.text import _col


def to_data_uri(fmt, b) -> Column:
    return F.concat(F.lit("data:image/"), _col(fmt), F.lit(";base64,"), F.base64(_col(b)))


def parse_data_uri(src) -> Column:
    """struct(mime, is_base64, bytes); null for anything that is not a data URI.

    A base64 body that does not decode gives null bytes instead of failing the job.
    """
    s = _col(src)
    header = F.regexp_extract(s, "^data:([^,]*),", 1)
    body = F.regexp_extract(s, r"^data:[^,]*,([\s\S]*)$", 1)
    is_b64 = F.contains(header, F.lit("base64"))
    data = F.when(is_b64, F.try_to_binary(body, F.lit("base64"))).otherwise(
        # '+' is literal in a data URI, while the form decoder would make it a blank
        F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    )
    return F.when(
        s.rlike("^data:[^,]*,"),
        F.struct(
            F.regexp_extract(header, "^([^;]*)", 1).alias("mime"),
            is_b64.alias("is_base64"),
            data.alias("bytes"),
        ),
    )


def image_name(src, idx) -> Column:
    """Last path piece of an address, else `image_<idx>`."""
    path = F.regexp_extract(_col(src), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.when(last != "", last).otherwise(F.concat(F.lit("image_"), _col(idx).cast("string")))


def _big_endian(b: Column, start: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(b, start, width)), 16, 10).try_cast("int")


def _little_endian(b: Column, start: int, width: int) -> Column:
    digits = F.concat(*[F.hex(F.substring(b, start + i, 1)) for i in reversed(range(width))])
    return F.conv(digits, 16, 10).try_cast("int")


def image_dims(b) -> Column:
    """struct(format, width, height) read from the leading bytes."""
    c = _col(b)
    head = F.hex(F.substring(c, 1, 8))
    enough = F.length(c) >= 26

    def dims(fmt: str, w: Column, h: Column) -> Column:
        return F.struct(F.lit(fmt).alias("format"), w.alias("width"), h.alias("height"))

    return (
        F.when(head.startswith("89504E470D0A1A0A") & enough,
               dims("png", _big_endian(c, 17, 4), _big_endian(c, 21, 4)))
        .when((head.startswith("474946383761") | head.startswith("474946383961")) & (F.length(c) >= 10),
              dims("gif", _little_endian(c, 7, 2), _little_endian(c, 9, 2)))
        .when(head.startswith("424D") & enough,
              dims("bmp", _little_endian(c, 19, 4), _little_endian(c, 23, 4)))
        .otherwise(dims("unknown", F.lit(0), F.lit(0)))
    )
