from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomstead.llm.html_text import extract, lines_of, main_text, spans

LONG = "A sentence of the article that is long enough to count as text on its own, with a comma and more words."


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href='/a'>Home of the site</a></li><li><a href='/b'>About us and more</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 All that remains, a long line of imprint that is as long as the article's own lines are.</footer>"


def test_marked_article():
    html = page(f"{NAV}<!-- ad --><div class='ad'>{LONG} Buy!</div><article><h1>Head &amp; shoulders</h1><p><b>{LONG}<br><p>Short.</p><p>x</p><div class='comments'><p>{LONG} said who</p></div></article>{FOOT}")
    assert main_text(html) == f"Head & shoulders\n{LONG}\nShort.\nx"


@pytest.mark.parametrize("close", ["</body></html>", ""])
def test_unmarked_article(close):
    html = f"<html><body>{NAV}<aside><p>{LONG} aside</p></aside><div id='content'><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG} end</p></div><form>{LONG}</form>{FOOT}{close}"
    assert main_text(html) == f"Head\n{LONG}\nShort.\n{LONG} end"


def test_white_space_and_references():
    assert main_text(page("<article><p> a\n\t b&nbsp;c &lt;d&gt; <i>e</i>f &#233;</p>  <p> </p></article>")) == "a b c <d> ef é"


@pytest.mark.parametrize("html", [None, "", " ", "<p></p>", "<script>x</script>", "<nav>only a menu</nav>", "<", "<<<>>>", "</article></p>", "<!-- never closed", "<script>never closed"])
def test_nothing_to_extract(html):
    assert main_text(html) in ("", "<", "<<<>>>")[: 1 if html not in ("<", "<<<>>>") else 3]


def test_unclosed_menu_does_not_swallow_the_article():
    assert main_text(page(f"<nav><ul><li>menu<article><p>{LONG}</p></article>")) == LONG


def test_script_ends_at_its_own_end_only():
    html = page(f"<script>var t='<article>';var SECRET=1;</script><article><p>{LONG}</p></article>", head="")
    assert main_text(html) == LONG
    assert main_text(f"<html><head><title>T<body><p>{LONG}</p>") == LONG  # a head that is never closed


@pytest.mark.parametrize("around", ["<div class='comments'><article><p>{}</p></article></div>", "<aside><article><h2>Card</h2><p>{}</p></article></aside>", "<article class='comment'><p>{}</p></article>", "<section id=comments><article>{}</article><article>{}</article></section>"])
@pytest.mark.parametrize("body", ["<article><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_comments_and_cards_stay_out(around, body):
    other = around.replace("{}", f"{LONG} by a reader")
    assert main_text(page(body.replace("{}", LONG) + other)) == LONG
    assert main_text(page(f"<article><p>{LONG}</p>{other}<p>{LONG} end</p></article>")) == f"{LONG}\n{LONG} end"


def test_class_names_count_whole():
    for name, there in [("layout no-sidebar", True), ("with-sidebar", True), ("sidebarless", True), ("add", True), ("sidebar", False), ("site-footer", False), ("comment-list", False), ("post ad-banner", False), ("cookie_notice", False)]:
        assert main_text(page(f"<div class='{name}'><p>{LONG}</p></div>")) == (LONG if there else "")


@pytest.mark.parametrize("tag", ["article", "div"])
def test_adverts_do_not_split_an_article(tag):
    ads = f"<div class='ad'>{LONG}</div><aside>{LONG}</aside><div class='newsletter'>{LONG}</div>"
    html = page(f"{NAV}<{tag}><p>{LONG} one</p>{ads}<p>{LONG} two</p><p>{LONG} three</p></{tag}>{FOOT}")
    assert main_text(html) == f"{LONG} one\n{LONG} two\n{LONG} three"


@pytest.mark.parametrize("tag", ["article", "div"])
def test_short_articles_count(tag):
    assert main_text(page(f"{NAV}<{tag}><h1>Hi</h1><p>Short.</p></{tag}>{FOOT}")) == "Hi\nShort."


def distribution(weights, window, threshold):
    """Lines between dive points with a surge, by the definition: every window is summed anew."""
    n, half = len(weights), window // 2
    total = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(n)]
    least = min(threshold, max(total, default=0) / 2)
    out = []
    for i in range(n):
        a = b = i
        while total[i] and a > 0 and total[a - 1]:
            a -= 1
        while total[i] and b < n - 1 and total[b + 1]:
            b += 1
        out.append(total[i] > 0 and any(x > least for x in total[a : b + 1]))
    return out


def test_spans_against_every_window():
    rng = random.Random(4)
    cases = [[], [5], [0, 0, 100, 0, 0, 0, 0, 50, 50], [100] * 5, [0] * 9, [4, 0, 0, 0, 500]]
    cases += [[rng.choice([0, 0, 0, 3, 20, 90]) for _ in range(rng.randrange(40))] for _ in range(300)]
    for w in cases:
        for window in (1, 3, 5):
            got = [any(a <= i < b for a, b in spans(w, window, 60)) for i in range(len(w))]
            assert got == distribution(w, window, 60)


def test_whole_pages_against_every_window():
    """Extraction by the definition, on whole pages of the tables; and the distribution finds the article without its tag."""
    pages = [r.as_py() for r in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"]]
    alone = 0
    for html in pages:
        lines = lines_of(html)
        marked = any(x[2] and x[0] for x in lines)
        weight = [(len(x[0]) if x[2] else 0) if marked else x[1] for x in lines]
        inside = distribution(weight, 3, 60)
        assert main_text(html).split("\n") == ([x[0] for x, w, k in zip(lines, weight, inside, strict=True) if k and w] or [""])
        alone += main_text(html, marks=False) == main_text(html)
    assert alone >= 0.95 * len(pages)


def test_link_text_does_not_count():
    assert [x[1] for x in lines_of("<p>ab <a href=x>cdef</a></p>")] == [3]


def test_table(spark):
    rows = [(1, "u", page(f"<article>{LONG}</article>")), (1, "u", page(f"<article>{LONG}</article>")), (None, None, None), (2, "v", page("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars, len(r.text)) for r in out.collect()) == sorted([("1", len(LONG), len(LONG))] * 2 + [("None", 0, 0), ("2", 3000 * (len(LONG) + 1) - 1, 3000 * (len(LONG) + 1) - 1)])
    assert extract(df.limit(0)).collect() == []
