"""Grouping of labelled lines into gloss groups (xgg) and translation groups (xfg), and nested examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import WS


def _w() -> Window:
    return Window.partitionBy("doc_id", "x_line").orderBy("line_id")


def group_lines(labels: DataFrame) -> DataFrame:
    """labels with xgg_no and xfg_no: running numbers inside an example, null where a line is in no such group.

    A gloss group starts at an unparsed line, or at a parsed one that no unparsed line precedes; it ends with the last
    gloss line in a row. A translation group starts at the first gloss group and at each that follows a translation."""
    before = F.lag("fn").over(_w())
    starts = (F.col("fn") == "xu") | ((F.col("fn") == "xv") & (F.coalesce(before, F.lit("")) != "xu"))
    d = labels.withColumns({"starts_xgg": starts, "before": before})
    running = _w().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    xgg = F.sum(F.col("starts_xgg").cast("int")).over(running)
    fresh = F.col("starts_xgg") & (F.coalesce("before", F.lit("xf")).isin("xf", "xh"))
    xfg = F.sum(fresh.cast("int")).over(running)
    d = d.withColumns({"xgg_no": xgg.cast("int"), "xfg_no": xfg.cast("int")})
    in_gloss = F.col("fn").isin("xu", "xv", "xg")
    return d.withColumns({"xgg_no": F.when(in_gloss & (F.col("xgg_no") > 0), F.col("xgg_no")), "xfg_no": F.when((F.col("fn") != "xh") & (F.col("xfg_no") > 0), F.col("xfg_no"))}).drop("starts_xgg", "before")


def example_lines(grouped: DataFrame) -> DataFrame:
    """Grouped lines with their examples' numbers; the number is cut off the first line."""
    first = F.col("line_id") == F.col("x_line")
    cut = F.regexp_replace(F.substring(F.col("text"), F.length("ex_number_text") + 1, F.length("text")), f"^{WS}+", "")
    named = Window.partitionBy("doc_id", "x_line")
    return grouped.withColumns(
        {
            "x_number": F.max(F.when(first, F.col("ex_number_head"))).over(named),
            "x_sub_number": F.max(F.when(first, F.col("ex_number_sub"))).over(named),
            "text": F.when(first, cut).otherwise(F.col("text")),
        }
    ).drop("ex_number_text", "ex_number_head", "ex_number_sub")


def examples(lines: DataFrame) -> DataFrame:
    """One row an example: headers and an array of translation groups, each with its gloss groups and translations."""
    lines = lines.where((F.col("fn") == "xh") | F.col("xfg_no").isNotNull())
    keys = ["doc_id", "x_line", "x_number", "x_sub_number"]
    texts = lambda fn: F.transform(F.filter("l", lambda x: x["fn"] == fn), lambda x: x["text"]).alias(fn)
    # Gloss groups, and beside them one group of each translation group's translations, and one of the headers.
    each = lines.groupBy(*keys, "xfg_no", "xgg_no").agg(F.sort_array(F.collect_list(F.struct("line_id", "fn", "text"))).alias("l"))
    each = each.select(*keys, "xfg_no", "xgg_no", *map(texts, ("xu", "xv", "xg", "xf", "xh")))
    xgg = F.when(F.col("xgg_no").isNotNull(), F.struct("xgg_no", "xu", "xv", "xg"))
    groups = each.groupBy(*keys, "xfg_no").agg(F.sort_array(F.collect_list(xgg)).alias("xggs"), F.flatten(F.collect_list("xf")).alias("xf"), F.flatten(F.collect_list("xh")).alias("xh"))
    g = F.struct("xfg_no", "xggs", "xf")
    return groups.groupBy(*keys).agg(F.flatten(F.collect_list("xh")).alias("xh"), F.sort_array(F.collect_list(F.when(F.col("xfg_no").isNotNull(), g))).alias("xfgs"))


def gloss_group_ids(lines: DataFrame) -> DataFrame:
    """lines with xgg_id: the gloss groups of a document numbered through, null outside them."""
    w = Window.partitionBy("doc_id", F.col("xgg_no").isNull()).orderBy("x_line", "xgg_no")
    return lines.withColumn("xgg_id", F.when(F.col("xgg_no").isNotNull(), F.dense_rank().over(w)))


def split_paras_at_examples(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """lines with x_line of the example that holds them, and paragraph numbers that also change where an example begins or ends."""
    of = labels.select(F.col("doc_id").alias("l_doc"), F.col("line_id").alias("l_line"), "x_line")
    d = lines.join(of, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("line_id") == F.col("l_line")), "left").drop("l_doc", "l_line")
    w = Window.partitionBy("doc_id").orderBy("line_id")
    edge = (F.lag("para_id").over(w) != F.col("para_id")) | ~F.lag("x_line").over(w).eqNullSafe(F.col("x_line"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("edge", F.coalesce(edge, F.lit(True)) | (F.row_number().over(w) == 1))
    return d.withColumn("para_id", F.sum(F.col("edge").cast("int")).over(running).cast("int")).drop("edge")


def example_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, x_line, page_no): the page on which an example begins, from lines with x_line and page_no."""
    return lines.where("x_line is not null").groupBy("doc_id", "x_line").agg(F.min_by("page_no", "line_id").alias("page_no"))


def join_html_ids(lines: DataFrame) -> DataFrame:
    """(doc_id, x_line, html_id): the ids of the paragraphs that an example came from, in order, joined by plus signs."""
    one = F.struct("line_id", F.coalesce("html_id", F.lit("unknown")).alias("html_id"))
    paras = lines.withColumn("new", F.coalesce(F.lag("para_id").over(_w()) != F.col("para_id"), F.lit(True))).where("new")
    return paras.groupBy("doc_id", "x_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["html_id"]), "+").alias("html_id"))


def merge_paras_across_pages(lines: DataFrame) -> DataFrame:
    """Paragraph numbers where a paragraph that begins with a page marker goes on with the one before it."""
    w = Window.partitionBy("doc_id").orderBy("line_id")
    starts = F.coalesce(F.lag("para_id").over(w) != F.col("para_id"), F.lit(True))
    opens = starts & (~F.coalesce(F.col("starts_page"), F.lit(False)) | F.lag("para_id").over(w).isNull())
    number = F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("para_id", number.cast("int"))
