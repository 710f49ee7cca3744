"""Content and option hashes: the key under which results are reused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.text import _col


def content_hash(b) -> Column:
    return F.sha2(_col(b), 256)


def config_hash(**options) -> Column:
    """First 16 hex digits of SHA-256 over the key-sorted JSON of the options."""
    fields = [_col(options[name]).alias(name) for name in sorted(options)]
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def cache_key(content, config) -> Column:
    return F.concat_ws("_", _col(content), _col(config))
