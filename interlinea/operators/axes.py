"""Axes between elements: descendant, ancestor, following, preceding, siblings.

Each element is a region of its document: start and end (the places of its tags), level, and the start of its parent. In regions every
axis is a comparison of numbers, so counts come from running sums, nearest ones from ordered windows, and pairs from a merge with a stack: documents
are sorted by start, the stack holds the elements that are open, and each element meets those on it only. Nothing compares all pairs, and
all steps share one partitioning by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "start"]


def regions(t: DataFrame) -> DataFrame:
    """regions(doc_id, start, end, level, name, parent, tok) of the elements of balanced tokens; empty ones end where they start. The root's
    parent is 0."""
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Tags are dealt out by a stated number of partitions, which isn't coalesced: it settles what a task sorts. Regions are read more than once, and
    # what is dealt out here is made once for all of them.
    d = t.where("kind <> 'text'").select("doc_id", "ord", "kind", "name", "tok").repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    # A start tag and its end tag have one level, and so has an empty element among its siblings.
    d = d.withColumn("level", (F.sum(step).over(order) + (F.col("kind") != "open").cast("int")).cast("int"))
    level = Window.partitionBy("doc_id", "level").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("kind") == "close", F.col("ord")), ignorenulls=True).over(level)
    d = d.withColumn("end", F.when(F.col("kind") == "open", end).otherwise(F.col("ord"))).where("kind <> 'close'")
    # An element stands on its own level, for its children, and on the one above, to find its parent.
    each = d.withColumn("among", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    own = (F.col("among") == F.col("level")) & (F.col("kind") == "open")
    above = Window.partitionBy("doc_id", "among").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("parent", F.coalesce(F.last(F.when(own, F.col("ord")), ignorenulls=True).over(above), F.lit(0)))
    return each.where("among < level").select("doc_id", F.col("ord").alias("start"), "end", "level", "name", "parent", "tok")


def counts(r: DataFrame, of: Column, prefix: str = "") -> DataFrame:
    """regions with descendants, ancestors, following, preceding and siblings before and after: how many elements of each axis are of a kind."""
    hit = F.coalesce(of.cast("boolean"), F.lit(False)).cast("long")
    # Places of starts and ends in order; a running sum at an end less that at its start counts what is between.
    marks = r.select("doc_id", F.col("start").alias("at"), hit.alias("hit"), F.lit(0).alias("gone"), F.lit(True).alias("opens"), "start")
    ends = r.select("doc_id", F.col("end").alias("at"), F.lit(0).cast("long").alias("hit"), hit.alias("gone"), F.lit(False).alias("opens"), "start")
    w = Window.partitionBy("doc_id").orderBy("at", F.col("opens").desc())
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = marks.unionByName(ends).withColumns({"seen": F.sum("hit").over(running), "ended": F.sum("gone").over(running), "all": F.sum("hit").over(Window.partitionBy("doc_id"))})
    side = lambda opens, c: F.max(F.when(F.col("opens") == opens, F.col(c)))
    d = d.groupBy("doc_id", "start").agg(side(True, "seen").alias("s0"), side(False, "seen").alias("s1"), side(True, "ended").alias("e0"), F.max(F.when(F.col("opens"), F.col("hit"))).alias("own"), F.max("all").alias("total"))
    # What started before and hasn't ended is an ancestor; what has is preceding; what starts after the end is following.
    d = d.select(*KEYS, (F.col("s1") - F.col("s0")).alias(f"{prefix}descendants"), (F.col("s0") - F.col("own") - F.col("e0")).alias(f"{prefix}ancestors"), F.col("e0").alias(f"{prefix}preceding"), (F.col("total") - F.col("s1")).alias(f"{prefix}following"))
    siblings = Window.partitionBy("doc_id", "parent").orderBy("start")
    before = F.coalesce(F.sum(hit).over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum(hit).over(siblings.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return r.withColumns({f"{prefix}siblings_before": before, f"{prefix}siblings_after": after}).join(d, KEYS)


def nearest(r: DataFrame, of: Column) -> DataFrame:
    """regions with next_start and previous_start: the first element of a kind that starts after the end, and the last that ended before the start."""
    hit = F.coalesce(of.cast("boolean"), F.lit(False))
    side = lambda at, opens: r.select("doc_id", F.col(at).alias("at"), F.lit(opens).alias("opens"), "start", F.when(hit, F.col("start")).alias("found"))
    w = Window.partitionBy("doc_id").orderBy("at", F.col("opens").desc())
    d = side("start", True).unionByName(side("end", False))
    after = F.first(F.when(F.col("opens"), F.col("found")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(F.when(~F.col("opens"), F.col("found")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumns({"after": after, "before": before})
    d = d.groupBy("doc_id", "start").agg(F.max(F.when(~F.col("opens"), F.col("after"))).alias("next_start"), F.max(F.when(F.col("opens"), F.col("before"))).alias("previous_start"))
    return r.join(d, KEYS)


def descendants(r: DataFrame, above: Column, below: Column) -> DataFrame:
    """(doc_id, ancestor, descendant): pairs of starts, by a merge with a stack; as many rows as there are pairs."""
    kind = dict(r.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, ancestor int, descendant int"
    d = r.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce(above, F.lit(False)).alias("a"), F.coalesce(below, F.lit(False)).alias("b")).where("a OR b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stack = object(), []
        for batch in batches:
            ids, up, down = [], [], []
            for i, start, end, a, b in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if i != doc:
                    doc, stack = i, []
                while stack and stack[-1][1] < start:
                    stack.pop()
                if b and stack:
                    ids += [i] * len(stack)
                    up += [s for s, _ in stack]
                    down += [start] * len(stack)
                if a and end > start:
                    stack.append((start, end))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(up, pa.int32()), pa.array(down, pa.int32())], ["doc_id", "ancestor", "descendant"])

    return d.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(run, ddl)
