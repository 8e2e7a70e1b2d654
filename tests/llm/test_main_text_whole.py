"""Main text keeps whole articles, in linear time."""

import time

import pytest

from brindle.llm import main_text

P = "A long paragraph, with commas, and words enough, to give the element that holds it a good score."


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<article><h2>Head</h2><div><p>{P}<p>{P}<p>{P}</div><h3>Mid heading</h3><ul><li>one<li>two</ul><pre>code x</pre><div><p>Short tail.</p></div></article>", f"Head {P} {P} {P} Mid heading one two code x Short tail."),
        (f"<main><section><p>{P}<p>{P}<p>{P}<p>{P}</section><section><h2>Two</h2><p>Short one.</p></section></main>", f"{P} {P} {P} {P} Two Short one."),
        (f"<main><nav>menu</nav><h1>Title</h1><article><section><section><p>{P}</section><table><tr><td>a<td>b<tr><td>c</table></section><div class='comments'><p>{P}</div></article><aside>{P}</aside></main>", f"Title {P} a b c"),
        (f"<div><h2>Head</h2><div><p>{P}<p>{P}</div><h3>Mid</h3><ul><li>short</ul><div><a href=x>{P}</a></div><div><p>{P}</div><div>tail</div></div>", f"Head {P} {P} Mid short {P}"),
        (f"<body><div id=a><p>{P} first</div><hr><ul><li><a>menu</a></ul><div id=b><p>{P} second</div></body>", f"{P} first {P} second"),
        ("<dl><dt>t<dd>u<dt>v</dl><ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "t u v a b c d"),
    ],
)
def test_whole_article(html, want):
    assert main_text.main_text(html) == want


@pytest.mark.parametrize("tag", ["<header>", "<div>", "<p><button>", "<ul><li>", "<td>", "<table><tr>", "<article>", "<p><button><div><li>x</li>"])
def test_linear_in_depth(tag):
    def seconds(n):
        began = time.process_time()
        main_text.main_text(tag * n + "x")
        return time.process_time() - began

    small = seconds(12_500)
    assert seconds(100_000) < 25 * max(small, 0.05)


def test_equal_containers_go_to_the_first_and_rows_repeat(spark):
    page = f"<table><tr><td>x</td></tr></table><section><div><p>{P} one</div></section><section><div><p>{P} two</div></section>"
    assert main_text.main_text(page) == f"{P} one"
    rows = spark.createDataFrame([(1, "u", page, 7, "old"), (1, "u", page, 7, "old"), (2, None, None, 8, "old")], "page_id long, url string, html string, n_chars int, text string")
    got = main_text.extract(rows)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, f"{P} one", len(P) + 4)] * 2 + [(2, "", 0)]
