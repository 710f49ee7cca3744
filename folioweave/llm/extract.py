"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of block tags and texts. Pages of one host are aligned one after the
other: what both have stays, what only one has becomes optional, neighbours of one
shape become a repeated group, and texts that differ become slots. The result describes
the host's template; from it follows where the changing text is, which all pages of the
host then give, and which fixed texts inside it belong to the template.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import bound_batches, stored

FIXED_PAGES = 10    # pages that must agree on a text before it counts as part of the template
HOSTS_AT_ONCE = 2000  # wrappers a task holds before it hands them on
SALT = 32           # groups that the partial wrappers of one host are merged in first

# Element names of the language, by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary
    table tbody td tfoot th thead tr ul button svg""".split())
CLOSED_BY = {
    "p": frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3
        h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "head": frozenset({"body"}),
}
ASIDE = frozenset("nav footer aside form button select dialog menu head svg".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification
    overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup
    skip social sponsor sponsored subscribe toolbar topbar widget widgets""".split())
CONTAINERS = frozenset("""area bar block body bottom box button buttons container content form group holder icon icons info inner items
    left link links list main module outer page panel posts right row section site text title top unit wrap wrapper zone""".split())
HEADERS = frozenset("header siteheader pageheader topheader".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_INTERESTING = re.compile(r"class|id|role|hidden|style", re.I)


def host_of(url: Column) -> Column:
    """Lower-case host of an address, '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _named_aside(names: str) -> bool:
    """Whether a name says so: by its last word, or by its first one if the others only name a container (share-price does not)."""
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if parts and parts[0] not in ("with", "has", "no", "without") and (
                parts[-1] in ASIDE_NAMES or "".join(parts) in HEADERS
                or parts[0] in ASIDE_NAMES and all(p in CONTAINERS or p in ASIDE_NAMES for p in parts[1:])):
            return True
    return False


def _own_text(e: Element) -> int:
    """Characters outside of links in an element and in what is not beside the main text below it."""
    total, below = 0, [e]
    while below:
        for c in below.pop().children:
            if isinstance(c, tuple):
                total += len(c[0]) - c[1]
            elif not c.aside:
                below.append(c)
    return total


def _forms_around_the_page(root: Element) -> None:
    """A form that holds more text than all that is outside of it is a container like any other."""
    found, below = [], [root]
    while below:
        e = below.pop()
        for c in e.children:
            if isinstance(c, Element):
                if c.tag == "form" and c.aside and not c.named:
                    found.append(c)
                elif not c.aside:
                    below.append(c)
    for form in found:
        if _own_text(form) > _own_text(root):
            form.aside = False
            _forms_around_the_page(form)


class Element:
    """A block element: label, children (elements and texts in order), whether it is beside the main text."""

    __slots__ = ("tag", "label", "children", "aside", "named")

    def __init__(self, tag: str, label: str, aside: bool, named: bool) -> None:
        self.tag, self.label, self.aside, self.children = tag, label, aside, []
        self.named = named  # its attributes say that it is beside the main text


def _opened(tag: str, text: str, inside: set[str]) -> Element:
    names, role, hidden = "", "", False
    if text and _INTERESTING.search(text):
        for name, value in _ATTRIBUTE.findall(text):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("class", "id"):
                names += " " + value
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    named = hidden or role in ASIDE_ROLES or tag not in ("html", "body", "main") and _named_aside(names)
    aside = named or tag in ASIDE
    if tag == "header" and not inside & {"article", "main"}:
        aside = True
    first = names.split()
    return Element(tag, tag + ("." + re.sub(r"\d{2,}", "00", first[0]) if first else ""), aside, named)


def parse(text: str) -> Element:
    """The block structure of a page. Texts are (words, characters in links) pairs, one for each run between block tags."""
    root = Element("#page", "#page", False, False)
    open_, words, linked, in_link, at = [root], [], [0], False, 0
    lower = None

    def flush() -> None:
        run = " ".join("".join(words).split())
        if run:
            open_[-1].children.append((run, min(len(run), linked[0])))
        words.clear()
        linked[0] = 0

    def say(part: str) -> None:
        part = html.unescape(part) if "&" in part else part
        words.append(part)
        if in_link:
            linked[0] += len(part)

    while True:
        m = _TOKEN.search(text, at)
        if not m:
            say(text[at:])
            break
        if m.start() > at:
            say(text[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in RAW:
            lower = lower or text.lower()
            end = lower.find("</" + tag, at)
            while end >= 0 and lower[end + len(tag) + 2:end + len(tag) + 3] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
                end = lower.find("</" + tag, end + 1)
            if end < 0:
                break
            at = text.find(">", end) + 1 or len(text)
        elif tag == "br":
            words.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            flush()
            in_link = False
            if closing:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == tag:
                        del open_[i:]
                        break
                continue
            while len(open_) > 1 and tag in CLOSED_BY.get(open_[-1].tag, ()):
                open_.pop()
            if tag in ("html", "body") and any(e.tag == tag for e in open_):
                continue
            element = _opened(tag, m[3], {e.tag for e in open_})
            open_[-1].children.append(element)
            if tag not in VOID and not (m[3].endswith("/") and tag == "svg"):
                open_.append(element)
        elif not closing and tag not in VOID and m[3] and _INTERESTING.search(m[3]):
            element = _opened(tag, m[3], set())
            if element.aside:  # an inline element beside the text: a block of its own
                flush()
                open_[-1].children.append(element)
                open_.append(element)
        elif closing and open_[-1].tag == tag:
            flush()
            open_.pop()
    flush()
    _forms_around_the_page(root)
    return root


# ---------------------------------------------------------------- expressions
# A group is [label, members, optional, repeated]; a text is ["#", fixed text or None, pages, characters].


def _expression(e: Element) -> list:
    members = [["#", c[0], 1, len(c[0]) - 2 * c[1]] if isinstance(c, tuple) else _expression(c) for c in e.children if isinstance(c, tuple) or not c.aside]
    return [e.label, _folded(members), False, False]


def _one_shape(a: set[str], b: set[str]) -> bool:
    """Whether elements with members of these labels may be two of a kind."""
    return not a or not b or 2 * len(a & b) >= min(len(a), len(b))


def _alike(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] == "#" or _one_shape({m[0] for m in a[1]}, {m[0] for m in b[1]}))


def _folded(members: list) -> list:
    """Runs of neighbours of one shape (up to three members long) as one repeated member each."""
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(members):
            unit, j = members[i:i + period], i + period
            if len(unit) == period and any(m[0] != "#" for m in unit):
                while len(members) >= j + period and all(map(_alike, unit, members[j:j + period])):
                    unit = [_aligned(a, b) for a, b in zip(unit, members[j:j + period])]
                    j += period
            if j > i + period:
                out += [m if m[0] == "#" else [m[0], m[1], m[2], True] for m in unit]
                i = j
            else:
                out.append(members[i])
                i += 1
        members = out
    return members


def _aligned(a: list, b: list) -> list:
    """The expression that covers both; they have one label."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3]]
    return [a[0], _merged(a[1], b[1]), a[2] or b[2], a[3] or b[3]]


def _merged(a: list, b: list) -> list:
    """Members of both in order; those that only one has are optional."""
    out, i, j = [], 0, 0
    blocks = SequenceMatcher(None, [m[0] for m in a], [m[0] for m in b], autojunk=False).get_matching_blocks()
    for x, y, n in blocks:
        out += [_maybe(m) for m in a[i:x]] + [_maybe(m) for m in b[j:y]]
        out += [_aligned(p, q) for p, q in zip(a[x:x + n], b[y:y + n])]
        i, j = x + n, y + n
    return _folded(out)


def _maybe(m: list) -> list:
    return m if m[0] == "#" else [m[0], m[1], True, m[3]]


def pattern(e: list) -> str:
    """An expression as text: (..)? optional, (..)+ repeated, # a slot, '..' a fixed text."""
    if e[0] == "#":
        return "#" if e[1] is None else repr(e[1])
    body = f"<{e[0]}>" + "".join(map(pattern, e[1])) + "</>"
    return body if not (e[2] or e[3]) else f"({body}){'*' if e[2] and e[3] else '?' if e[2] else '+'}"


def _mass(e: list, fixed: bool) -> int:
    if e[0] == "#":
        return max(0, e[3]) if fixed or e[1] is None or e[2] < FIXED_PAGES else 0
    return sum(_mass(m, fixed) for m in e[1])


def region(e: list) -> list[str]:
    """The way to the smallest container with all of the changing text: labels, each with those of its members.

    An article or main element need only have nearly all of it.
    """
    fixed = not _mass(e, False)
    path = []
    while True:
        groups = [m for m in e[1] if m[0] != "#"]
        tags = [m[0].split(".")[0] for m in groups]
        whole = max(1, _mass(e, fixed))
        best = [m for m, t in zip(groups, tags) if t in ("article", "main") and _mass(m, fixed) >= 0.8 * whole]
        best = best or [m for m, t in zip(groups, tags) if t in ("html", "body", "div", "section", "article", "main", "center")
                        and _mass(m, fixed) >= whole]
        if not best:
            return path
        e = max(best, key=lambda m: _mass(m, fixed))
        path.append(" ".join([e[0], *sorted({m[0] for m in e[1]})]))


def fixed_texts(e: list, path: list[str]) -> list[str]:
    """Texts inside the region that are the same on all of many pages, while others change."""
    for step in path:
        e = next(m for m in e[1] if " ".join([m[0], *sorted({x[0] for x in m[1]})] if m[0] != "#" else "#") == step)
    if not _mass(e, False):
        return []
    out = []

    def walk(e: list) -> None:
        for m in e[1]:
            if m[0] == "#":
                if m[1] is not None and m[2] >= FIXED_PAGES:
                    out.append(m[1])
            elif not m[3] and m[0].split(".")[0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th"):
                walk(m)

    walk(e)
    return sorted(set(out))


def blocks_of(page: Element, path: list[str], fixed: frozenset[str]) -> list[str]:
    """Texts below all elements that the path leads to, without those beside the main text."""
    level = [page]
    for step in path:
        label, *members = step.split(" ")
        level = [c for e in level for c in e.children if isinstance(c, Element) and c.label == label and not c.aside]
        level = [c for c in level if _one_shape(set(members), {"#" if isinstance(x, tuple) else x.label for x in c.children})] or level
    out = []
    for top in level:
        below = [(top, iter(top.children))]
        while below:
            child = next(below[-1][1], None)
            if child is None:
                below.pop()
            elif isinstance(child, tuple):
                if child[0] not in fixed:
                    out.append(child[0])
            elif not child.aside:
                below.append((child, iter(child.children)))
    return out


def main_text(text: str | None, path: list[str], fixed: frozenset[str]) -> str:
    """The page's main text by its host's wrapper; by its own structure where that leads nowhere."""
    if not text:
        return ""
    page = parse(text)
    got = blocks_of(page, path, fixed)
    if not got:
        got = blocks_of(page, region(_expression(page)), frozenset())
    return "\n".join(got)


# ---------------------------------------------------------------- jobs


def _partial(rows: Iterator[tuple[str, int, list]]) -> Iterator[tuple[str, int, str]]:
    """(host, least page, expression) triples merged by host, handed on when there are many."""
    held: dict[str, tuple[int, list]] = {}
    for host, page, e in rows:
        old = held.get(host)
        held[host] = (page, e) if old is None else (min(old[0], page), _aligned(old[1], e))
        if len(held) >= HOSTS_AT_ONCE:
            yield from ((h, p, json.dumps(x)) for h, (p, x) in held.items())
            held.clear()
    yield from ((h, p, json.dumps(x)) for h, (p, x) in held.items())


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (an expression as JSON), path and fixed: from all pages of every host.

    Tasks align the pages they read, so only wrappers are shuffled; those of one host
    are merged in SALT groups and then together, in the order of their first page.
    """
    bound_batches(pages.sparkSession)
    schema, names = "host string, page long, wrapper string", ["host", "page", "wrapper"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, list]]:
            for b in batches:
                for host, page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    yield host, page or 0, _expression(parse(text.as_py()))

        for row in _partial(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(names).to_pylist(), key=lambda r: (r["page"], r["wrapper"]))
        got = list(_partial(((r["host"], r["page"], json.loads(r["wrapper"])) for r in rows)))
        return pa.table([pa.array(c) for c in zip(*got)], names=names)

    def finish(table: pa.Table) -> pa.Table:
        host, _, text = (c[0].as_py() for c in merge(table).columns)
        e = json.loads(text)
        path = region(e)
        lists = [pa.array([x], pa.list_(pa.string())) for x in (path, fixed_texts(e, path))]
        return pa.table([pa.array([host]), pa.array([text]), *lists], names=["host", "wrapper", "path", "fixed"])

    some = pages.select(host_of(F.col("url")).alias("host"), F.col("page_id").cast("bigint").alias("page"),
                        F.col("html").cast("string").alias("html")).where("html is not null and html != ''")
    parts = some.mapInArrow(read, schema).withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALT)))
    once = parts.groupBy("host", "salt").applyInArrow(merge, schema)
    return once.groupBy("host").applyInArrow(finish, "host string, wrapper string, path array<string>, fixed array<string>")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html), text by its host's wrapper.

    Null and empty pages, and pages without main text, have an empty text. Pages
    without a host are aligned with each other. White space inside a block is one
    space, blocks are joined by a line feed.
    """
    wrappers = stored(infer_wrappers(pages).select("host", "path", "fixed"), "wrappers")  # a row per host; broadcast only if small
    names = ["page_id", "url", "text", "n_chars"]
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "path", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py(), p.as_py() or [], frozenset(f.as_py() or ())) for t, p, f in zip(*(b.column(i) for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
