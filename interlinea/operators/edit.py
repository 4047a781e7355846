"""Elements put into documents and moved in them: layers around an element or around what it holds, and elements driven out at the edges.

Tokens carry an order-keeping key, an array of integers that is compared from its first one on. An edit gives each token and what it puts
beside it one more integer, or puts the number of a stretch before it, so any number of edits follow each other without a token being numbered anew;
renumber() does that once, by one window. All steps keep one partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDITED = ["tok", "kind", "name", "text"]


def keyed(t: DataFrame) -> DataFrame:
    """tokens(doc_id, ord, tok, kind, name, text, ...) with their key."""
    return t.withColumn("key", F.array(F.col("ord").cast("int")))


def renumber(t: DataFrame) -> DataFrame:
    """Keyed tokens with ord from 1 in the order of their keys, without the key."""
    return t.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))).drop("key")


def _before() -> Window:
    return Window.partitionBy("doc_id").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _targets(t: DataFrame, target: Column) -> DataFrame:
    """Balanced tokens with hit: start tags and empty elements that are targets, and the end tags of these."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    # A start tag and its end tag stand on one level, and between them no other tag of this level does.
    d = t.withColumn("level", F.sum(step).over(_before()) + (F.col("kind") == "close").cast("int"))
    own = F.coalesce(target.cast("boolean"), F.lit(False)) & F.col("kind").isin("open", "empty")
    level = Window.partitionBy("doc_id", "level").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("kind") == "open", own), ignorenulls=True).over(level)
    return d.withColumn("hit", F.when(F.col("kind") == "close", F.coalesce(opened, F.lit(False))).otherwise(own)).drop("level")


def _put(d: DataFrame, parts: Column) -> DataFrame:
    """Each token's parts in its place."""
    rest = [c for c in d.columns if c not in ("key", "hit", "mixed", *EDITED)]
    d = d.select(*rest, "key", F.posexplode(parts).alias("j", "p"))
    return d.select(*rest, F.concat("key", F.array(F.col("j"))).alias("key"), *[f"p.{c}" for c in EDITED])


def _tag(tok: Column | str, kind: str, name: Column | str) -> Column:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(of(tok).alias("tok"), F.lit(kind).alias("kind"), of(name).alias("name"), F.lit(None).cast("string").alias("text"))


def insert_parent_layer(t: DataFrame, target: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Keyed balanced tokens with an element around each target, and errors(doc_id, stage, msg).

    The targets of a document must share one name. A document where they don't stays as it is and is told in errors; one without targets
    stays as it is. A target that isn't known (null) is none."""
    d = _targets(t, target)
    doc = Window.partitionBy("doc_id")
    named = F.when(F.col("hit"), F.col("name"))
    d = d.withColumn("mixed", F.coalesce(F.min(named).over(doc) != F.max(named).over(doc), F.lit(False)))
    names = F.array_join(F.array_sort(F.collect_set(named)), ", ")
    errors = d.where("mixed").groupBy("doc_id").agg(F.lit("insert_parent_layer").alias("stage"), F.concat(F.lit("targets of several names: "), names).alias("msg"))
    own, opening, closing = F.struct(*EDITED), _tag(f"<{name}>", "open", name), _tag(f"</{name}>", "close", name)
    kind = F.when(F.col("hit") & ~F.col("mixed"), F.col("kind"))
    parts = F.when(kind == "open", F.array(opening, own)).when(kind == "close", F.array(own, closing)).when(kind == "empty", F.array(opening, own, closing))
    return _put(d, parts.otherwise(F.array(own))), errors


def insert_child_layer(t: DataFrame, target: Column, name: str) -> DataFrame:
    """Keyed balanced tokens with one child in each target that holds all that the target held; an empty target holds an empty child then."""
    d = _targets(t, target)
    own, opening, closing = F.struct(*EDITED), _tag(f"<{name}>", "open", name), _tag(f"</{name}>", "close", name)
    start = _tag(F.regexp_replace("tok", r"\s*/?>$", ">"), "open", F.col("name"))
    unit = F.array(start, _tag(f"<{name}/>", "empty", name), _tag(F.concat(F.lit("</"), "name", F.lit(">")), "close", F.col("name")))
    kind = F.when(F.col("hit"), F.col("kind"))
    parts = F.when(kind == "open", F.array(own, opening)).when(kind == "close", F.array(closing, own)).when(kind == "empty", unit)
    return _put(d, parts.otherwise(F.array(own)))


def _sifted(t: DataFrame, first: Column, second: Column) -> DataFrame:
    """In each stretch of tokens of two kinds, those of the first kind before those of the second; the order in a kind stays."""
    rank = F.when(first, 1).when(second, 2).otherwise(0)
    # A token of neither kind begins a stretch and is its first.
    stretch = F.sum((rank == 0).cast("int")).over(_before()).cast("int")
    return t.withColumn("key", F.concat(F.array(stretch, rank), "key"))


def repel(t: DataFrame, repellers: list[str], repelled: list[str]) -> DataFrame:
    """Keyed balanced tokens where no empty element of the repelled names stands at an edge of an element of the other names.

    At the left edge they go before the start tag, at the right edge behind the end tag, through nested elements as far as it takes, all of them and in their
    order; an element that holds nothing else has them before it. Text, blank text too, holds its place, and no text is moved."""
    out = (F.col("kind") == "empty") & F.col("name").isin(repelled)
    tag = lambda kind: (F.col("kind") == kind) & F.col("name").isin(repellers)
    return _sifted(_sifted(t, out, tag("open")), tag("close"), out)
