"""The lexer of tag soup and the balancer."""

import random
import re
import time

from interlinea.sources import html

VOID = set(html.VOID)


def read(spark, pages, f=html.balanced):
    got = {}
    for r in f(spark.createDataFrame(list(enumerate(pages)), "doc_id int, html string").repartition(2)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r)
    return [got.get(i, []) for i in range(len(pages))]


def written(rows):
    return "".join(r.tok for r in rows)


def safe(rows):
    """As written() but for a < that begins no tag."""
    return "".join("&lt;" if r.tok == "<" else r.tok for r in rows)


def check(rows):
    """Every start has its end, inside out; ids follow each other."""
    stack = []
    for k, r in enumerate(rows):
        assert r.ord == k + 1
        if r.kind == "open":
            stack.append(r.name)
        elif r.kind == "close":
            assert stack and stack.pop() == r.name
    assert not stack


SOUP = [
    ("<p>3 < 5 and so</p>", "<p>3 < 5 and so</p>"),
    ("""<p title="a>b" id='c>d"'>x</p>""", """<p title="a>b" id='c>d"'>x</p>"""),
    ('<p title="a>b<i>c</i>', '<p title="a>b<i>c</i></p>'),
    ("<p>one<p>two<br>x", "<p>one</p><p>two<br>x</p>"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
    ("<table><tr><td>a<td>b<tr><th>c</table>d", "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>d"),
    ("<table><tbody><tr><td><p>a<tbody><tr><td>b</table>", "<table><tbody><tr><td><p>a</p></td></tr></tbody><tbody><tr><td>b</td></tr></tbody></table>"),
    ("<b>x<i>y</b>z</i>", "<b>x<i>y</i></b>z"),
    ("<p>a<table><tr><td></p>b</table>c</p>", "<p>a<table><tr><td>b</td></tr></table>c</p>"),
    ("</div>a</p>", "a"),
    ("<div><p>a<div>b</div></p></div>", "<div><p>a<div>b</div></p></div>"),
    ("<p>cut <a hre", "<p>cut <a hre</p>"),
    ("a<!x y>b<?pi?>c</ >d<3", "a<!x y>b<?pi?>c</ >d<3"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<IMG SRC='x'/><Hr><b/>", "<IMG SRC='x'/><Hr><b/>"),
    ("", ""),
    (None, ""),
]


def test_soup(spark):
    found = read(spark, [page for page, _ in SOUP])
    for (page, want), rows in zip(SOUP, found):
        assert written(rows) == want, page
        check(rows)
    again = read(spark, [safe(rows) for rows in found])
    assert [safe(rows) for rows in again] == [safe(rows) for rows in found]
    assert not any(r.implied for rows in again for r in rows)


def test_texts_of_odd_tags(spark):
    rows = read(spark, ['<p title="x>y">3 < 5 &lt; 6</p>'], html.tokens)[0]
    assert [(r.kind, r.name, r.text) for r in rows] == [("open", "p", None), ("text", "", "3 "), ("text", "", "﹤"), ("text", "", " 5 ﹤ 6"), ("close", "p", None)]


def test_any_soup(spark):
    rng = random.Random(4)
    names = ["p", "li", "ul", "td", "tr", "table", "tbody", "b", "i", "div", "dl", "dt", "dd", "br", "option", "select", "x1"]
    pages = ["".join(rng.choice([f"<{n}>", f"</{n}>", f"<{n} a='>'>", "t ", "<", ">", '"', "é"]) for n in (rng.choice(names) for _ in range(rng.randrange(80)))) for _ in range(300)]
    plain, right = read(spark, pages, html.tokens), read(spark, pages)
    texts = lambda rows: [r.text for r in rows if r.kind == "text"]
    for page, a, b in zip(pages, plain, right):
        assert written(a) == page
        check(b)
        assert texts(a) == texts(b) and [r.tok for r in b if not r.implied and r.kind != "close"] == [r.tok for r in a if r.kind != "close"]
    again = read(spark, [safe(b) for b in right])
    assert [safe(b) for b in again] == [safe(b) for b in right] and not any(r.implied for b in again for r in b)


def test_pages_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id AS doc_id", "html")
    rows, plain = {}, {}
    for r in html.balanced(docs).orderBy("doc_id", "ord").collect():
        rows.setdefault(r.doc_id, []).append(r)
    for r in html.tokens(docs).where("kind = 'text'").orderBy("doc_id", "ord").collect():
        plain.setdefault(r.doc_id, []).append(r.text)
    assert any(r.implied for v in rows.values() for r in v)
    for i, v in rows.items():
        check(v)
        assert [r.text for r in v if r.kind == "text"] == plain.get(i, [])


def test_long_pages_and_tags(spark):
    """A page of 20,000 unclosed paragraphs, a tag of 20,000 attributes, a run of 20,000 bare signs."""
    pages = ["<p>a" * 20_000, "<p " + " ".join(f"a{i}='>{i}'" for i in range(20_000)) + ">x", "<" * 20_000]
    began = time.time()
    rows = read(spark, pages)
    assert time.time() - began < 240
    check(rows[0])
    assert sum(r.implied for r in rows[0]) == 20_000 and len(rows[1]) == 3 and len(rows[2]) == 20_000
    assert re.sub("</p>", "", written(rows[0])) == pages[0]


def test_pages_that_windows_read_are_shuffled_as_pages(spark):
    """Not as tokens, by the plan: no exchange stands above the one that deals out pages with their repairs."""
    docs = spark.createDataFrame([(1, "<p>a<p>b")], "doc_id int, html string")
    plan = html.number_in_order(html.balanced(html.dealt_out(docs), deal=True), ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan and "Python" in plan


def test_cells_are_looked_for_in_pages_that_have_some(spark):
    pages = ["<p>a</p>", "<table><tr><TH>a</table>", "<!-- <td> -->b", "<<!-- -->td>c</td>", None, "<thing>", "<td a='b'>"]
    kept = html.with_cells(spark.createDataFrame(list(enumerate(pages)), "doc_id int, html string"))
    assert {1, 3, 6} <= {r.doc_id for r in kept.collect()} <= {1, 3, 5, 6}
