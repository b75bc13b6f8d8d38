import itertools
import math
import random
import time

import pytest

from querent.llm import main_text as M

LONG = "The council met again on Tuesday and heard three reports about the bridge, the school and the harbour."
MORE = "Nobody had expected the vote to be so close, least of all the people who had asked for it in spring."


def text(page):
    return "\n\n".join(M.main_blocks(page)[0])


@pytest.mark.parametrize("seed", range(12))
def test_cut_equals_enumeration(seed):
    """All labellings of small graphs: the cut is least, and of the least ones its source side is smallest."""
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.25, 1.0, 3.0]) for _ in range(n)]
    edges = [(*rng.sample(range(n), 2), rng.choice([0.25, 0.5, 1.0, 2.0])) for _ in range(rng.randint(0, 2 * n))] if n > 1 else []

    def cost(side):
        ends = sum(math.log1p(math.exp(-z)) if s else math.log1p(math.exp(z)) for z, s in zip(odds, side, strict=True))
        return ends + sum(c for i, j, c in edges if side[i] != side[j])

    best = min(map(cost, itertools.product([False, True], repeat=n)))
    got = M.source_side(odds, edges)
    assert cost(got) == pytest.approx(best, abs=1e-6)
    assert sum(got) == min(sum(s) for s in itertools.product([False, True], repeat=n) if cost(s) < best + 1e-7)


@pytest.fixture
def whole():
    return f"""<!DOCTYPE html><html><head><title>Not this</title><style>p {{}}</style><script>var s = "</p><p>no";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a><h2>The Daily</h2></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>{LONG} We use cookies.</p></div>
<div id="page-content"><article><header><h1>A close vote</h1></header><p>{LONG}<p>Yes.
<aside>Read also: {MORE}</aside><div class="ad-box"><p>{MORE}</p></div><ul><li>First item</li><li><a href="/x">Second item</a></li></ul>
<p>Caf&eacute;s &amp; bars&nbsp;&mdash; a<br>b &lt;tag&gt;</p><table><tr><td>1<td>2</table>
<form><p>{MORE}</p><input name=x><button>Send</button></form><footer>Filed under news</footer></article></div>
<section id="comments"><article class="comment"><p>{MORE} {LONG}</p></article></section>
<div role="complementary"><p>{LONG}</p></div><div class="sidebar widget"><p>{MORE}</p></div>
<div hidden>{LONG}</div><noscript><p>{LONG}</p></noscript><footer><p>&copy; {LONG}</p></footer></body></html>"""


def test_article_without_what_surrounds_it(whole):
    assert text(whole).split("\n\n") == ["A close vote", LONG, "Yes.", "First item", "Second item", "Cafés & bars — a b <tag>", "1", "2"]


def test_page_without_semantic_elements():
    page = f"""<body><div class=menu><a href=1>Home</a> <a href=2>About</a></div><div><h1>Title</h1><p>{LONG}</p><p>So.</p><p>{MORE}</p></div>
<div><a href=3>One</a> | <a href=4>Two</a> | <a href=5>Three</a></div><div class=footer>All rights reserved, of course, in every country of the world.</div>"""
    assert text(page).split("\n\n") == ["Title", LONG, "So.", MORE]


def test_smoothing_decides_what_the_classifier_leaves_open():
    """A short line among paragraphs stays, the same line among links goes."""
    among = f"<body><div><p>{LONG}</p><div>So it was</div><p>{MORE}</p></div>"
    links = "<body><div><p><a href=1>Home page</a></p><div>So it was</div><p><a href=2>About us</a></p></div>"
    odds = M.log_odds(M.blocks_of(among)[1])
    assert odds == M.log_odds(M.blocks_of(links)[1])
    assert "So it was" in text(among) and "So it was" not in text(links)


def test_wrapper_named_like_boilerplate():
    page = f'<body><div class="header-fixed banner"><main><p>{LONG}</p></main></div><div class="banner"><p>{MORE}</p></div>'
    assert text(page) == LONG


def test_broken_markup():
    assert text("") == text("<!-- never closed") == text("<script>alert(1)") == ""
    assert text(f"<article><p>{LONG}<b><p>{MORE}") == f"{LONG}\n\n{MORE}"
    assert text(f"<article></div></p><p title='a > b' data-x=\"<p>\">{LONG}</section></b>") == LONG
    assert text(f"<article><p>3 < 4 and a <5 &am") == "3 < 4 and a <5 &am"
    assert text("<article><p>tail <a href='x") == "tail"
    assert text(f"<ARTICLE><P>{LONG}</P></ARTICLE>") == LONG
    assert text(f"<head><meta charset=utf-8><p>{LONG}") == LONG


def test_long_pages_in_bounded_time():
    began = time.monotonic()
    page = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)) + "</article><footer>" + "<p>x</p>" * 20_000 + "</footer>"
    assert len(M.main_blocks(page)[0]) == 20_000
    assert M.main_blocks("<p '" * 20_000)[0] == [] and M.main_blocks("<div>" * 100_000 + LONG)[1] == 1
    assert time.monotonic() - began < 30


def test_table(spark, whole):
    rows = [(1, "u", whole, "x", 1), (1, "u", whole, "y", 2), (2, None, None, "", 3), (None, "v", "", None, 4), (3, "w", "plain text without any markup at all.", "", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page string, n_blocks int")
    got = sorted(map(tuple, M.extract(pages).collect()), key=repr)
    n = len(M.blocks_of(whole))
    assert got == sorted([(1, "u", text(whole), 8, n)] * 2 + [(2, None, "", 0, 0), (None, "v", "", 0, 0), (3, "w", "plain text without any markup at all.", 1, 1)], key=repr)
    assert M.extract(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="clash"):
        M.extract(pages, keep=["page_id", "n_blocks"])
