"""Batches of new and changed documents give the tables of a full run, replays and failures included."""

import pytest
from pyspark.sql import functions as F

from interlinea.operators import layout
from interlinea.sources import html
from interlinea.streaming import incremental

PAGES = [("a", "<p>one<br>two</p>"), ("b", "<p>three</p>"), ("c", ""), (None, "<p>of no name</p>")]


def lines(docs):
    d = layout.lines(html.balanced(docs)).select("doc_id", "line_id", "text")
    return {"lines": d, "counts": d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, html string")


def rows(d):
    return sorted(map(repr, d.collect()))


def test_batches_give_what_a_full_run_gives(spark, tmp_path):
    made = []
    inc = incremental.Increments(spark, str(tmp_path), lambda d: made.append(sorted((r.doc_id or "") for r in d.collect())) or lines(d))
    with pytest.raises(ValueError, match="no batch"):
        inc.table("lines")
    now = dict(PAGES)
    batches = [PAGES, [("a", "<p>one<br>two</p>"), ("b", "<p>three, changed</p>")], [("d", "<p>new</p>"), ("c", None)], [("b", "<p>three</p>"), (None, "<p>of no name</p>")]]
    for n, batch in enumerate(batches):
        now |= dict(batch)
        inc.process(frame(spark, batch), n)
        for name, full in lines(frame(spark, list(now.items()))).items():
            assert rows(inc.table(name)) == rows(full)
    assert made == [["", "a", "b", "c"], ["b"], ["c", "d"], ["b"]]
    # Replays of any batch: the same documents, the same parts, the same tables.
    want = rows(inc.table("lines"))
    made.clear()
    inc.process(frame(spark, batches[3]), 3)
    assert made == [["b"]] and rows(inc.table("lines")) == want


def test_a_batch_that_breaks_off(spark, tmp_path):
    """Tables written by half don't count until the state says so."""
    inc = incremental.Increments(spark, str(tmp_path), lines)
    inc.process(frame(spark, PAGES), 0)
    want = rows(inc.table("lines"))
    broken = incremental.Increments(spark, str(tmp_path), lambda d: {"lines": lines(d)["lines"], "counts": d.select("doc_id", F.raise_error(F.lit("broken")).alias("n"))})
    edit = [("a", "<p>edited</p>")]
    with pytest.raises(Exception, match="broken"):
        broken.process(frame(spark, edit), 1)
    assert rows(inc.table("lines")) == want
    inc.process(frame(spark, edit), 1)
    assert rows(inc.table("lines")) == rows(lines(frame(spark, list((dict(PAGES) | dict(edit)).items())))["lines"])


def test_parameters_and_abbreviations_count(spark, tmp_path):
    docs = frame(spark, PAGES)
    params = lambda v: spark.createDataFrame([("a", v, None), ("b", "x", "y")], "doc_id string, ex_number_regex string, other string")
    abbr = lambda *v: spark.createDataFrame([("b", x) for x in v], "doc_id string, abbr string")
    inc = lambda p, a: incremental.Increments(spark, str(tmp_path), lines, p, a)
    inc(params("x"), abbr("PL", "SG")).process(docs, 0)
    ids = lambda p, a: sorted((r.doc_id or "") for r in inc(p, a).changed(docs, 1).collect())
    assert ids(params("x"), abbr("SG", "PL", "PL")) == [] and ids(params("z"), abbr("SG", "PL")) == ["a"] and ids(params("x"), abbr("SG")) == ["b"]


def test_stream_of_files(spark, tmp_path):
    """Files that come, change their name or come again: only what is new is extracted."""
    source, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    source.mkdir()
    made = []
    inc = incremental.Increments(spark, str(out), lambda d: made.extend(sorted(r.doc_id for r in d.collect())) or lines(d))
    run = lambda: incremental.process_new(incremental.stream_documents(spark, str(source)), mark, inc.process)
    (source / "x_body_1.htm").write_text("<p>first</p>")
    (source / "y_body_1.html").write_text("<p>second</p>")
    run()
    (source / "z_body_1.htm").write_text("<p>third</p>")
    run()
    run()
    assert made == ["x_body_1", "y_body_1", "z_body_1"]
    assert sorted((r.doc_id, r.text) for r in inc.table("lines").collect()) == [("x_body_1", "first"), ("y_body_1", "second"), ("z_body_1", "third")]
