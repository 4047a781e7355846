"""Elements put in and moved, held against rewriting of the pages' strings."""

import random
import re

from pyspark.sql import functions as F

from interlinea.operators import edit
from interlinea.sources import html


def pages():
    rng = random.Random(5)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["<br>", "<br>", "t", "<img>", " "])
        name = rng.choice(["b", "i", "p"])
        return f"<{name}>" + "".join(part(depth - 1) for _ in range(rng.randrange(4))) + f"</{name}>"

    return [(i, "<div>" + "".join(part(4) for _ in range(3)) + "</div>") for i in range(60)] + [(100, ""), (101, None), (102, "<b><br></b>"), (103, "<b><i><br><br>x<br></i><br></b>")]


def written(t):
    rows = {}
    for r in t.orderBy("doc_id", "ord").collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert all([r.ord for r in x] == list(range(1, len(x) + 1)) for x in rows.values())
    return {d: "".join(r.tok for r in x) for d, x in rows.items()}


def tokens(spark, rows=None):
    return html.tokens(spark.createDataFrame(rows or pages(), "doc_id int, html string"))


def test_repelled_at_edges(spark):
    got = written(edit.renumber(edit.repel(edit.keyed(tokens(spark)), ["b", "i"], ["br"])))
    moved = 0
    for d, page in pages():
        want = page or ""
        for pattern in (r"(<[bi]>)(<br>)", r"(<br>)(</[bi]>)"):
            while want != (nxt := re.sub(pattern, r"\2\1", want)):
                want = nxt
        assert got.get(d, "") == want
        moved += want != page
    assert moved > 20 and got[102] == "<br><b></b>" and got[103] == "<br><br><b><i>x</i></b><br><br>"


def test_layers_and_round_trip(spark):
    t = tokens(spark)
    around, errors = edit.insert_parent_layer(edit.keyed(t), F.col("name") == "p", "block")
    both = edit.insert_child_layer(around, F.col("name") == "p", "body")
    more, _ = edit.insert_parent_layer(both, F.col("name") == "img", "figure")
    got = written(edit.renumber(more))
    for d, page in pages():
        want = re.sub("<p>", "<block><p><body>", re.sub("</p>", "</body></p></block>", (page or "").replace("<img>", "<figure><img></figure>")))
        assert got.get(d, "") == want
    assert errors.count() == 0
    back = html.unwrap_elements(edit.renumber(more), ["block", "body", "figure"])
    assert written(edit.renumber(edit.keyed(back))) == {d: p for d, p in pages() if p}


def test_child_of_an_empty_element(spark):
    t = edit.insert_child_layer(edit.keyed(tokens(spark, [(1, "<x><page id='4'/></x>")])), F.col("name") == "page", "pb")
    assert written(edit.renumber(t)) == {1: "<x><page id='4'><pb/></page></x>"}


def test_targets_of_several_names(spark):
    rows = [(1, "<p>a</p><q>b</q>"), (2, "<p>a</p><r>b</r>"), (3, "<r>b</r>"), (4, None)]
    t, errors = edit.insert_parent_layer(edit.keyed(tokens(spark, rows)), F.col("name").isin("p", "q"), "w")
    assert written(edit.renumber(t)) == {1: rows[0][1], 2: "<w><p>a</p></w><r>b</r>", 3: rows[2][1]}
    assert [tuple(r) for r in errors.collect()] == [(1, "insert_parent_layer", "targets of several names: p, q")]
    none, errors = edit.insert_parent_layer(edit.keyed(tokens(spark, rows)), F.lit(None), "w")
    assert written(edit.renumber(none)) == {d: h for d, h in rows if h} and errors.count() == 0
