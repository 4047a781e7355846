"""One file a document, whatever fails or is repeated."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from interlinea.sources import files


def content(folder):
    return {n: open(os.path.join(folder, n), encoding="utf-8").read() for n in sorted(os.listdir(folder))}


def test_lines_in_order(spark, tmp_path):
    rows = [(f"f{i % 7}.txt", i, f"line {i} é") for i in range(70)] + [("empty.txt", 0, None)]
    d = spark.createDataFrame(rows, "name string, i int, line string").repartition(5)
    out = files.write_files(d, str(tmp_path / "a"), order=["i"])
    assert out == {"made": 8, "there": 0}
    assert content(tmp_path / "a") == {f"f{k}.txt": "".join(f"line {i} é\n" for i in range(k, 70, 7)) for k in range(7)} | {"empty.txt": ""}
    changed = d.withColumn("line", F.lit("new"))
    assert files.write_files(changed, str(tmp_path / "a"), order=["i"]) == {"made": 0, "there": 8} and "new" not in content(tmp_path / "a")["f1.txt"]
    assert files.write_files(changed, f"file://{tmp_path}/a", order=["i"], existing=files.REPLACE)["made"] == 8 and content(tmp_path / "a")["f1.txt"] == "new\n" * 10


def test_attempts_that_fail_and_come_again(spark, tmp_path):
    """The same rows written by several attempts, some of which break off: each file is whole and there is one of it."""
    folder = str(tmp_path)
    rows = [("a.txt", "1"), ("a.txt", "2"), ("b.txt", "3")]

    def broken():
        yield from rows[:2]
        yield rows[2]
        raise RuntimeError("lost")

    for keep in (files.KEEP, files.REPLACE):
        writer = files.FileWriter({"path": folder, "existing": keep, "job": "j"})
        with pytest.raises(RuntimeError):
            writer.write(broken())
        done = [writer.write(iter(rows)) for _ in range(3)]
        threads = [threading.Thread(target=lambda: done.append(writer.write(iter(rows)))) for _ in range(4)]  # noqa: B023
        [t.start() for t in threads]
        [t.join() for t in threads]
        writer.commit(done)
        told = content(folder)
        assert {n: c for n, c in told.items() if not n.startswith("_")} == {"a.txt": "1\n2\n", "b.txt": "3\n"} and not any(n.startswith("_attempts") for n in told)
        os.remove(f"{folder}/_job-j.json")
    # The last file of an attempt that broke off isn't published by it.
    assert sum(m.made for m in done) == 2 * len(done)


def test_a_task_that_is_repeated(spark, tmp_path):
    """A job that fails, run again: what the first one published stays, and the rest is made."""
    d = spark.range(40).select(F.concat(F.lit("g"), F.col("id")).alias("name"), F.concat(F.lit("x"), F.col("id")).alias("line"))
    bad = d.withColumn("line", F.when(F.col("name") == "g17", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        files.write_files(bad, str(tmp_path))
    assert not any(n.startswith("_attempts") for n in os.listdir(tmp_path))
    before = len([n for n in os.listdir(tmp_path) if not n.startswith("_")])
    out = files.write_files(d, str(tmp_path))
    assert out["made"] + out["there"] == 40 and out["there"] == before
    assert content(tmp_path) == {f"g{i}": f"x{i}\n" for i in range(40)}


def test_default_parameters_are_never_overwritten(spark, tmp_path):
    (tmp_path / "two_params.txt").write_text("mine")
    docs = spark.createDataFrame([("one",), ("two",), ("three",), ("one",)], "doc_id string")
    template = spark.createDataFrame([(2, "ex_sub_number_regex:\t"), (1, "lacks_numbered_examples:\tFALSE")], "line_no int, text string")
    assert files.write_default_params(docs, template, str(tmp_path)) == 2
    assert files.write_default_params(docs, template, str(tmp_path)) == 0
    assert content(tmp_path) == {"one_params.txt": "lacks_numbered_examples:\tFALSE\nex_sub_number_regex:\t\n", "three_params.txt": "lacks_numbered_examples:\tFALSE\nex_sub_number_regex:\t\n", "two_params.txt": "mine"}


def test_reports_and_pages(spark, tmp_path):
    r = spark.createDataFrame([("d", 2, "b\tc"), ("d", 1, None), ("e", 1, "x\ny")], "doc_id string, n int, v string")
    assert files.write_reports(r, str(tmp_path / "r"), "_examples.tsv", ["n", "v"], ["n"])["made"] == 2
    assert content(tmp_path / "r") == {"d_examples.tsv": "1\t\n2\tb c\n", "e_examples.tsv": "1\tx y\n"}
    files.write_reports(r, str(tmp_path / "r"), "_examples.tsv", ["n", "v"], ["n"], header=True)
    assert content(tmp_path / "r")["e_examples.tsv"] == "n\tv\n1\tx y\n"
    assert files.write_pages(spark.createDataFrame([("d", "<p>é</p>")], "doc_id string, html string"), str(tmp_path / "p")) == {"made": 1, "there": 0}
    assert content(tmp_path / "p") == {"d.html": "<p>é</p>\n"}


def test_what_isn_t_written(spark, tmp_path):
    with pytest.raises(ValueError, match="no folder"):
        files.write_files(spark.createDataFrame([("a", "b")], "name string, line string"), "hdfs://x/y")
    for name in ("../a", ".hidden", "_job", ""):
        with pytest.raises(Exception, match="no name of a file"):
            files.write_files(spark.createDataFrame([(name, "b")], "name string, line string"), str(tmp_path))
    assert files.write_files(spark.createDataFrame([], "name string, line string"), str(tmp_path)) == {"made": 0, "there": 0}
    assert os.listdir(tmp_path) == []
