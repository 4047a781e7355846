"""Axes between elements, held against all pairs on small trees."""

import random

from pyspark.sql import functions as F

from interlinea.operators import axes
from interlinea.sources import html


def trees():
    rng = random.Random(11)
    out = []
    for i in range(40):
        page, depth = "", 0
        for _ in range(rng.randrange(40)):
            if depth and rng.random() < 0.4:
                page, depth = page + "</div>" if rng.random() < 0.5 else page + "</b>", depth
            else:
                page, depth = page + rng.choice(["<div>", "<b>", "<br>", "<img src='x'>", "t", "<div>"]), depth + 1
        out.append((i, page))
    return out


def test_axes_by_all_pairs(spark):
    t = html.balanced(spark.createDataFrame(trees(), "doc_id int, html string")).cache()
    r = axes.regions(t)
    rows = {}
    for x in r.collect():
        rows.setdefault(x.doc_id, []).append(x)
    hit = F.col("name") == "b"
    counted = {(x.doc_id, x.start): x for x in axes.counts(r, hit).collect()}
    near = {(x.doc_id, x.start): x for x in axes.nearest(r, hit).collect()}
    pairs = {(x.doc_id, x.ancestor, x.descendant) for x in axes.descendants(r, F.col("name") == "div", hit).collect()}
    want = set()
    assert sum(map(len, rows.values())) == t.where("kind IN ('open', 'empty')").count() and len(rows) > 30
    for d, xs in rows.items():
        for x in xs:
            others = [y for y in xs if y.start != x.start]
            up = [y for y in others if y.start < x.start and y.end > x.start]
            assert x.level == len(up) + 1 and x.parent == max((y.start for y in up), default=0)
            b = [y for y in others if y.name == "b"]
            c = counted[d, x.start]
            assert c.descendants == sum(x.start < y.start < x.end for y in b) and c.ancestors == sum(y in up for y in b)
            assert c.preceding == sum(y.end < x.start for y in b) and c.following == sum(y.start > x.end for y in b)
            assert c.siblings_before == sum(y.parent == x.parent and y.start < x.start for y in b) and c.siblings_after == sum(y.parent == x.parent and y.start > x.start for y in b)
            n = near[d, x.start]
            assert n.next_start == min((y.start for y in b if y.start > x.end), default=None)
            assert n.previous_start == max(((y.end, y.start) for y in b if y.end < x.start), default=(0, None))[1]
            want |= {(d, x.start, y.start) for y in b if x.name == "div" and x.start < y.start < x.end}
    assert pairs == want and want


def test_no_elements(spark):
    r = axes.regions(html.balanced(spark.createDataFrame([(1, "only text"), (2, None)], "doc_id int, html string")))
    assert r.count() == 0 and axes.counts(r, F.lit(True)).count() == 0 and axes.nearest(r, F.lit(True)).count() == 0 and axes.descendants(r, F.lit(True), F.lit(True)).count() == 0
