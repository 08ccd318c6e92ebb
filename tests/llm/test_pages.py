"""Site style trees: importances against plain Python, branches that only the tree can tell, odd pages."""

from __future__ import annotations

import math
import re
import time
from collections import Counter, defaultdict

import pytest

from tracewright.llm.pages import GAMMA, MAX_DEPTH, MIN_PAGES, Page, _features, low_paths, main_texts, page_paths, style_tree

SHAPE = "page_id long, url string, html string"


def site(i: int) -> str:
    """A page without any class or id, and of tags that say nothing."""
    words = f"Story {i} tells of {i} things and of nothing else"
    top = "<div><p>The Daily Something</p><p>Read by many since long ago</p></div>"
    links = "<div><span>Home</span><ul><li>World</li><li>Sports</li></ul></div>"
    own = f"<section><h1>Head {i}</h1><p>{words}</p><p>{words} again</p></section>"
    return f"<html><body>{top}{links}{own}<table><tr><td>All rights belong to us</td></tr></table></body></html>"


def test_importances_against_plain_python(spark):
    hosts = {"a": [site(i) for i in range(12)], "b": [site(i % 3) for i in range(9)], None: [site(0)]}
    rows = [(h, x) for h, xs in hosts.items() for x in xs]
    got = {(r.host, r.path): r for r in style_tree(page_paths(spark.createDataFrame(rows, "host string, html string"))).collect()}
    want = {}
    for host, pages in hosts.items():
        looks, children, texts, ups = defaultdict(Counter), Counter(), defaultdict(Counter), {}
        for x in pages:
            for path, above, _, _, _, style, n, own in _features(x):
                looks[path][style] += 1
                children[path] += n
                texts[path].update(own)
                ups[path] = above
        for path, styles in looks.items():
            pages_of = sum(styles.values())
            base = math.log(max(pages_of, 2))
            presentation = -sum(n / pages_of * math.log(n / pages_of) for n in styles.values()) / base
            # Of every text in the branch, for each path that has it, the entropy over the branch's pages.
            below = [n for p, counts in texts.items() if path in ups[p] for n in counts.values()]
            content = 1 - sum(n * math.log(n) for n in below) / sum(below) / base if below else 0.0
            share = GAMMA ** (children[path] / pages_of)
            want[host, path] = (pages_of, presentation, content, (1 - share) * presentation + share * content)
    assert got.keys() == want.keys()
    for key, (n, *values) in want.items():
        r = got[key]
        assert r.pages == n and [r.presentation, r.content, r.importance] == pytest.approx(values, abs=1e-9)


def test_low_paths_against_plain_python(spark):
    rows = [("a", site(i)) for i in range(12)] + [("few", site(i)) for i in range(MIN_PAGES - 1)]
    tree = style_tree(page_paths(spark.createDataFrame(rows, "host string, html string")))
    told = tree.collect()
    low = {(r.host, r.path) for r in told if r.judged and r.pages >= MIN_PAGES and r.importance < 0.2}
    kept = {(r.host, p) for r in told if r.says and (r.host, r.path) not in low for p in r.ups[:-1]}
    got = [tuple(r) for r in low_paths(tree).collect()]
    assert len(got) == len(set(got)) and set(got) == low - kept and {h for h, _ in got} == {"a"}


def test_a_site_without_names(spark):
    """Nothing but the tree can tell the branches that this site repeats; few pages are no evidence."""
    rows = [(i, "http://a.example/", site(i)) for i in range(30)] + [(100, "http://b.example/", site(100))]
    out = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SHAPE)).collect()}
    words = "Story {0} tells of {0} things and of nothing else"
    for i in range(30):
        assert out[i] == f"Head {i}\n\n{words.format(i)}\n\n{words.format(i)} again"
    assert out[100].startswith("The Daily Something") and out[100].endswith("All rights belong to us")


def test_low_branches_with_something_important_below_stay(spark):
    """A wrapper of ten parts that are alike on all pages looks low itself; the one that tells something stays."""
    parts = "".join(f"<{t}><p>Fixed words {t}</p></{t}>" for t in ("section", "dl", "ul", "ol", "center", "address"))
    rows = [(i, "http://a.example/", f"<body><div>{parts}<blockquote><p>Own words {i}</p></blockquote></div></body>") for i in range(40)]
    out = main_texts(spark.createDataFrame(rows, SHAPE)).collect()
    assert all(r.text == f"Own words {r.page_id}" for r in out)


def test_names_in_part_inside_articles(spark):
    """The tree decides whether a part of a name belongs to the template of a host."""
    article = "<article><h1>Head {0}</h1><p>Own words {0} of this article, and {0} more of them than anybody could say</p>{1}</article>"
    tail = "".join(f'<div class="{c}"><p>{{0}} {c}</p></div>' for c in (
        "user-comments", "comments-section", "comments-wrapper", "sponsored-content", "related-stories"))
    rows = [(i, "http://a.example/", article.format(i, tail.format(i))) for i in range(MIN_PAGES)]
    rows += [(50, "http://b.example/", article.format(50, '<div class="ad-hoc-work"><p>Once</p></div>'))]
    rows += [(60 + i, "http://c.example/", article.format(i, f'<pre><span class="comment"># note {i}</span></pre>')) for i in range(20)]
    out = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SHAPE)).collect()}
    for i in range(MIN_PAGES):
        assert out[i].split("\n\n") == [f"Head {i}", f"Own words {i} of this article, and {i} more of them than anybody could say"]
    assert out[50].endswith("Once") and out[63].endswith("# note 3")


def test_no_name_takes_the_whole_page():
    for start in ('<div class="page comments-open">', '<div class="layout sidebar-left">', '<div id="cookie-policy">'):
        assert Page(start + "<p>An essay</p><p>of two</p></div>").main_text() == "An essay\n\nof two"
    assert Page('<div class="ads">only this</div>').main_text() == "only this"
    assert Page('<div class="sidebar"><p>menu menu menu</p></div><p>text</p>').main_text() == "text"
    assert Page('<div class="main-menu"><p>a b c</p></div><main><p>t</p></main>').main_text() == "t"
    assert Page('<div class="page comments-open"><p>An essay of ours</p><div class="comments"><p>Me too and more than all that</p></div></div>'
                ).main_text() == "An essay of ours"
    assert Page('<article><p>Short</p></article><div class="comments-area"><p>Much longer than that</p></div>').main_text() == "Short"


def test_inline_elements_are_judged():
    html = ('<article><p>a <span hidden>x</span> b <span style="display: none">y</span><span class="ad">z</span>'
            '<a class="skip" href="#m">q</a> <b class="x">c</b> <span class="comment">d</span></p></article>')
    assert Page(html).main_text() == "a b c d"


def test_odd_pages_take_time_in_proportion():
    start = time.time()
    assert len(Page("<p>a<svg>" * 20_000).blocks) == 20_000
    deep = Page("".join(f"<div class=c{i % 7}>t{i} " for i in range(20_000)))
    assert len(deep.paths) == MAX_DEPTH and len(deep.blocks) == 20_000
    assert re.sub(r"\s+", " ", deep.main_text()).startswith("t0 t1 t2") and deep.main_text().endswith("t19999")
    assert len(_features("<div class=ads>x" * 20_000)) == MAX_DEPTH
    assert time.time() - start < 20
