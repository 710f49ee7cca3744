"""Text expressions.

`WS` matches the code points that Python's `str.split()` treats as blanks: the
Unicode White_Space property and the four ASCII separators.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
WS = f"[{_BLANKS}]"
NON_WS = f"[^{_BLANKS}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(t) -> Column:
    """Both ends freed of blanks, including non-breaking and wide ones."""
    # possessive, and only from the first blank of a run: linear in long runs
    return F.regexp_replace(_col(t), rf"\A{WS}++|(?<!{WS}){WS}++\z", "")


def squeeze(t) -> Column:
    """Every run of blanks becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(t), f"{WS}+", " "))


def has_text(t) -> Column:
    return F.coalesce(_col(t).rlike(NON_WS), F.lit(False))


def stripped_length(t) -> Column:
    return F.length(strip(t)).cast("bigint")


def word_count(t) -> Column:
    """Number of pieces between blanks; null counts as no words."""
    return F.coalesce(F.regexp_count(_col(t), F.lit(f"{NON_WS}+")), F.lit(0)).cast("bigint")


def approx_words(t) -> Column:
    return F.floor(F.length(_col(t)) / 5).cast("bigint")


def decode_text(content) -> Column:
    """Bytes to string: UTF-8 where valid, else Latin-1 (which never fails)."""
    c = _col(content)
    as_text = c.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(c, "ISO-8859-1"))


def tidy_markdown(md) -> Column:
    """Spacing around headings and fences, trimmed, no triple newlines left."""
    t = _col(md)
    t = F.regexp_replace(t, r"\n(#{1,6} [^\n]+)\n", "\n\n$1\n\n")
    t = F.regexp_replace(t, r"```([0-9A-Za-z_]*)\n", "\n```$1\n")
    t = F.regexp_replace(t, r"\n```\n", "\n```\n\n")
    return F.regexp_replace(strip(t), r"\n{3,}", "\n\n")


def escape_cell(t) -> Column:
    """Text fit for a pipe table cell."""
    return squeeze(F.replace(_col(t), F.lit("|"), F.lit("\\|")))


def pad_row(cells, width) -> Column:
    """Cells filled with '' or cut to `width`."""
    c, w = _col(cells), (F.lit(width) if isinstance(width, int) else _col(width))
    return F.slice(F.concat(c, F.array_repeat(F.lit(""), w.cast("int"))), F.lit(1), w.cast("int"))


def cell_text(c, floating: bool = False) -> Column:
    """A value as cell text: null (and NaN, for floating columns) is ''."""
    v = _col(c)
    text = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(F.isnan(v), F.lit("")).otherwise(text) if floating else text


def _code_point(n: Column) -> Column:
    """Character of a code point; out-of-range numbers give U+FFFD, 128 to 159 what Windows has there."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    windows = [bytes([c]).decode("cp1252", "replace").replace("\ufffd", chr(c)) for c in range(128, 160)]
    safe = F.when(n.between(128, 159), F.get(F.array(*[F.lit(ord(c)) for c in windows]), (n - 128).cast("int"))).when(ok, n).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe.cast("bigint")), 8, "0")), "UTF-32")


def html_unescape(t) -> Column:
    """Named and numeric character references to characters, in one pass.

    Names come from the standard library's HTML 5 table; those that may stand without
    a semicolon are found at the start of longer words too. One pass means that
    `&amp;lt;` gives `&lt;` and is not unescaped again.
    """
    v = _col(t)
    # one literal that the optimizer folds into a map, not two thousand literals
    table = "\u0001".join(f"&{n}\u0002{c}" for n, c in sorted(html5.items()))
    names = F.str_to_map(F.lit(table), F.lit("\u0001"), F.lit("\u0002"))
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))

    def one(tok: Column) -> Column:
        digits = F.regexp_extract(tok, r"^&#0*([0-9]+);?$", 1)
        hexa = F.regexp_extract(tok, r"^&#[xX]0*([0-9A-Fa-f]+);?$", 1)
        start = F.regexp_extract(tok, f"^&(?:{'|'.join(bare)})", 0)
        return (
            F.when(~tok.startswith("&"), tok)
            .when(digits != "", _code_point(F.when(F.length(digits) < 9, digits.try_cast("bigint")).otherwise(F.lit(-1))))
            .when(hexa != "", _code_point(F.when(F.length(hexa) < 8, F.conv(hexa, 16, 10).try_cast("bigint")).otherwise(F.lit(-1))))
            .when(F.try_element_at(names, tok).isNotNull(), F.try_element_at(names, tok))
            .when(start != "", F.concat(F.try_element_at(names, start), F.substr(tok, F.length(start) + 1)))
            .otherwise(tok)
        )

    pieces = F.regexp_extract_all(v, F.lit("&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"), F.lit(0))
    return F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(v)


def pdf_date(s) -> Column:
    """`D:YYYYMMDDHHmmSS` with an optional tail; missing parts default, bad ones give null."""
    t = F.regexp_replace(_col(s), "^D:", "")

    def part(start: int, width: int, default: str) -> Column:
        text = F.when(F.length(t) >= start + width - 1, F.substring(t, start, width))
        text = text.otherwise(F.lit(default)) if default else text
        return F.when(text.rlike("^[0-9]+$"), text).try_cast("int")

    year, second = part(1, 4, ""), part(13, 2, "00")
    stamp = F.try_make_timestamp_ntz(
        year, part(5, 2, "01"), part(7, 2, "01"), part(9, 2, "00"), part(11, 2, "00"),
        second.cast("decimal(16,6)"),
    )
    return F.when((year >= 1) & (second < 60), stamp)
