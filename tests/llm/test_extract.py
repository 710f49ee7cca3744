"""HTML extraction: alignment, odd markup, and pages whose main text is known."""

import random
import time

import pytest

from folioweave.llm import extract as X

PAGES = "page_id long, url string, html string, text string, path string"


def wrapper(*pages):
    out = None
    for p in pages:
        e = X._expression(X.parse(p))
        out = e if out is None else X._aligned(out, e)
    return out


def test_alignment_gives_optional_and_repeated_groups():
    w = wrapper("<body><h1>One</h1><p>a</p><p>b</p><div>fix</div></body>", "<body><h1>Two</h1><h2>x</h2><p>c</p><div>fix</div></body>")
    assert X.pattern(w) == "<#page><body><h1>#</>(<h2>'x'</>)?(<p>#</>)+<div>'fix'</></></>"
    w = wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>")
    assert X.pattern(w) == "<#page><dl>(<dt>#</>)+(<dd>#</>)+</></>"


@pytest.mark.parametrize("page,want", [
    ("", ""), (None, ""), ("plain  text &amp; more", "plain text & more"), ("<p>a<br>b<p>c", "a b\nc"),
    ("<p>a &lt; b &copy &check; &#150;</p>", "a < b © ✓ –"), ("<script>x</script><p>y</p><style>p{}</style>", "y"),
    ("<p>a</p><script>never closed <p>b", "a"), ("<p>a</p><!-- <p>b</p> --><p>c</p>", "a\nc"), ("<p title='1 > 0'>t</p>", "t"),
    ("<nav>n</nav><article><h1>T</h1><p>x <b>y<i>z</b></i></p><aside>q</aside><form><input>f</form></article><footer>f</footer>", "T\nx yz"),
    ("<body><div class='menu'>m</div><div class='content with-sidebar'><p>x</p><p>y</p></div><div id=comments><p>c c c c c c</p></div></body>", "x\ny"),
    ("<article><p>one <span class='ad'>buy</span> two</p></article>", "one\ntwo"), ("<div hidden>h</div><p>v</p>", "v"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<article><p>x</p></article><article class=comment><p>y</p></article>", "x"),
    ("<p>un<closed", "un"), ("<p>  \n</p>", ""), ("a < b", "a < b"), ("</div></p>x", "x"), ("<p><![CDATA[z]]>w", "w"),
])
def test_text(page, want):
    assert X.main_text(page, [], frozenset()) == want


def test_long_and_hostile_pages_take_linear_time():
    start = time.time()
    for page in ("<" * 200_000, "<a " * 100_000, "<p>" * 50_000, "<div>" * 20_000 + "x", "<a b='" + "c" * 300_000, "&" * 200_000, "<!--" * 100_000, "<script>" + "</scr" * 50_000):
        X.main_text(page[:300_000], [], frozenset())
    assert time.time() - start < 30


def site(rng, host, n, shape):
    """(page_id, url, html, text): pages of one template around invented articles."""
    words = lambda k: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(k))
    menu = "".join(f"<li><a href=/{i}>{words(1)}</a></li>" for i in range(6))
    for _ in range(n):
        blocks = [words(6)] + [words(rng.randint(8, 60)) for _ in range(rng.randint(1, 9))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b.replace(' ', '  ', 1)}</p>" for b in blocks[1:])
        yield host, shape(menu, body, words), "\n".join(blocks)


SHAPES = [
    lambda menu, body, w: f"<html><head><title>{w(3)}</title></head><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer>{w(9)}</footer></body>",
    lambda menu, body, w: f"<body><header><h2>Site</h2></header><div class='row'><div class='sidebar'><ul>{menu}</ul></div><div class='post'>{body}</div></div><div class='comments'><p>{w(300)}</p></div>",
    lambda menu, body, w: f"<table><tr><td>x</table><div id=c1>{menu}</div><div id=c2>{body}<div class='byline'>All rights kept by us</div></div><div class='cookie-bar'>{w(4)}</div><script>var a='<p>no</p>'</script>",
]


def test_sites(spark):
    rng = random.Random(1)
    rows = [r for i, s in enumerate(SHAPES) for r in site(rng, f"Host{i}.example.org", 40, s)]
    rng.shuffle(rows)
    pages = [(i, f"https://u@{h}:80/p/{i}", page, "t", "p") for i, (h, page, _) in enumerate(rows)]
    pages += [(None, None, None, None, None), (900, "nonsense", "", "", ""), (901, None, "<p>alone</p>", "", ""), (0, pages[0][1], pages[0][2], "", "")]
    got = X.extract_main_text(spark.createDataFrame(pages, PAGES)).collect()
    assert len(got) == len(pages)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [text[(i, p[1])] for i, p in enumerate(pages[:len(rows)])] == [t for _, _, t in rows]
    assert text[(None, None)] == "" and text[(900, "nonsense")] == "" and text[(901, None)] == "alone"
    assert X.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<body><h1>Title</h1><p>lead</p><div>%s</div></body>", "Title\nlead\n%s"),
    ("<body><article class=teaser>short</article><div>%s</div></body>", "short\n%s"),
    ("<body><article class=one>first text</article><article class=two>%s</article><article class=three>third text</article></body>", None),
    ("<body><div><a href=/>Home</a></div><div><div>%s</div></div></body>", "%s"),
])
def test_text_beside_the_main_container_stays(page, want):
    long = "word " * 15 + "end"
    got = X.main_text(page % long, X.region(wrapper(page % long)), frozenset())
    assert got == (want or "first text\n%s\nthird text") % long
    few = [page.replace("Title", f"Title {i}").replace("lead", f"lead {i}").replace("short", f"short {i}") % f"{long} {i}" for i in range(12)]
    path = X.region(wrapper(*few))
    for i, p in enumerate(few):
        assert f"{long} {i}" in X.main_text(p, path, frozenset())
        assert not want or ("Title" not in page or X.main_text(p, path, frozenset()).startswith(f"Title {i}\nlead {i}\n"))


def test_a_form_around_the_page_is_a_container():
    text = "<html><body><form id='f'><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>All the words of it.</p></article><input name=q></form></body></html>"
    assert X.main_text(text, [], frozenset()) == "Title\nAll the words of it."
    beside = "<html><body><article><h1>Title</h1><p>All the words of it, which are many.</p></article><form>Your name <input> <button>Send</button></form></body></html>"
    assert X.main_text(beside, [], frozenset()) == "Title\nAll the words of it, which are many."
    named = "<html><body><p>Short</p><form class=newsletter-form>Many words that ask for your address, again and again</form></body></html>"
    assert X.main_text(named, [], frozenset()) == "Short"


def test_names_that_only_begin_like_a_side_block():
    text = ("<article><h1>T</h1><section class='related-work'><p>Others did this.</p></section><div class='share-price'><p>Up by two.</p></div>"
            "<div class='share-buttons'>Share</div><div class='acme-footer'>Foot</div><div class='related-posts-list'>More</div></article>")
    assert X.main_text(text, [], frozenset()) == "T\nOthers did this.\nUp by two."
