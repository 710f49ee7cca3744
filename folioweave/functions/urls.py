"""Reference resolution (RFC 3986 section 5) as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.text import _col

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"^[^#]*#(.*)$"


def _fold_dots(segments: Column) -> Column:
    """Path text of segments, '.' dropped and '..' taking one segment back."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    dangling = F.element_at(segments, -1).isin(".", "..")
    kept = F.when(dangling, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _suffix(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise(F.lit(""))


def resolve_url(base, ref) -> Column:
    """`ref` as seen from `base`; empty queries and fragments are dropped."""
    b, r = _col(base), _col(ref)
    parts = F.struct(
        b.alias("b"), r.alias("r"),
        F.regexp_extract(b, _SCHEME, 1).alias("scheme"),
        F.regexp_extract(b, _AUTHORITY, 1).alias("authority"),
        F.regexp_extract(b, _PATH, 1).alias("b_path"),
        F.regexp_extract(b, _QUERY, 1).alias("b_query"),
        F.regexp_extract(r, _PATH, 1).alias("path"),
        F.regexp_extract(r, _QUERY, 1).alias("query"),
        F.regexp_extract(r, _FRAGMENT, 1).alias("fragment"),
    )
    # a one-element array binds the parts, so that each pattern runs once per value
    joined = F.transform(F.array(parts), _join_parts)[0]
    return (
        F.when(b.isNull() | r.isNull(), F.lit(None).cast("string"))
        .when(r == "", b)
        .when(r.rlike(_SCHEME), r)
        .otherwise(joined)
    )


def _join_parts(p: Column) -> Column:
    path, query, fragment = p["path"], p["query"], p["fragment"]
    scheme = F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit(""))
    has_authority = (p["authority"] != "") | (p["scheme"] == "file")
    root = F.concat(scheme, F.when(has_authority, F.concat(F.lit("//"), p["authority"])).otherwise(F.lit("")))
    used_query = F.when((path == "") & (query == ""), p["b_query"]).otherwise(query)
    tail = F.concat(_suffix("?", used_query), _suffix("#", fragment))

    # An absolute path only folds its dots; a relative one is first merged with
    # the directory of the base, whose doubled slashes collapse.
    own = F.split(F.substring(path, 2, 1 << 30), "/")
    pieces = F.split(p["b_path"], "/")
    merged = F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.split(path, "/"))
    inner = F.filter(F.slice(merged, F.lit(1), F.size(merged) - 1), lambda s: s != "")
    full_path = (
        F.when(path == "", p["b_path"])
        .when(path.startswith("/") & ~F.contains(path, F.lit("/.")), path)
        .when(path.startswith("/"), _fold_dots(own))
        .otherwise(_fold_dots(F.concat(inner, F.slice(merged, -1, 1))))
    )
    return F.when(p["r"].startswith("//"), F.concat(scheme, p["r"])).otherwise(F.concat(root, full_path, tail))
