"""Mixing sources to target weights under a time-varying curriculum, in DataFrame functions only.

Targets: the sources share the corpus's words by weight; no target passes MAX_EPOCHS times its
source's size, and what is above goes to the others by weight (the fixed point is a water level).
Documents of a source are put in the order of a hash of their ids. The first floor(target / size)
epochs take every document; the last, partial epoch takes the documents up to the rest, to within
half a document. Prefix sums are of integers and in two steps: over the sums of hash buckets, then
inside each bucket, so that no source has to pass through one task.

Curriculum: source s has the schedule w_s(t) = target_s * (1 + c_s * (2 t - 1)) over training time 0
to 1. Its integral up to t is the words of s that are trained on by then; inverting it gives each copy
of a document its position, the time at which the words before it have been used up.

Defined cases: null text has size 0; null source is a source, the last; null ids are ordered by their texts; sources without
words get target 0; rows equal in id are ordered by size and text, so reruns agree; rows that are repeated count one by one and may
get the same or neighbouring positions; very long texts count whole; an empty table gives an empty plan. mix() carries all
columns, whatever their names. Sources are one row each where targets are found, so a window over all of them is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, words

MAX_EPOCHS = 3
#: Hash buckets of a source in the two-step prefix sums: hex digits of the id's MD5.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target from (source, source_size): one row a source, so a window over all is small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((MAX_EPOCHS * F.col("source_size") / F.col("weight")), "no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    big = lambda c: c.cast("decimal(38,0)")
    s = sizes.withColumn("no", F.row_number().over(by_name)).withColumn("weight", ((F.col("no") - 1) % 3 + 1).cast("long"))
    s = s.withColumn("capped", MAX_EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("long"))
    s = s.withColumn("left_weight", F.sum("weight").over(after)).withColumn("all_words", F.sum("source_size").over(everything))
    free = big(MAX_EPOCHS * F.col("source_size")) * F.col("left_weight").cast("decimal(18,0)") > big(F.col("all_words") - F.col("capped")) * F.col("weight").cast("decimal(18,0)")
    s = s.withColumn("level", F.min(F.when(free, F.struct("capped", "left_weight"))).over(everything))
    share = ((F.col("all_words") - F.col("level.capped")) * F.col("weight")).cast("double") / F.col("level.left_weight").cast("double")
    cap = (MAX_EPOCHS * F.col("source_size")).cast("double")
    return s.select(*sizes.columns, "weight", F.when(free, share).otherwise(cap).alias("target"))


def slope(weight: Column) -> Column:
    """The curriculum of a source: light sources fade out, heavy ones come in."""
    return (weight.cast("double") - 2.0) * 0.5


def position(q: Column, target: Column, c: Column) -> Column:
    """The time t at which q words of the target are used up: the inverse of t + c (t^2 - t) = q / target."""
    u = F.least(q.cast("double") / target, F.lit(1.0))
    return F.when(target > 0, 2.0 * u / ((1.0 - c) + F.sqrt((1.0 - c) * (1.0 - c) + 4.0 * c * u)))


def plan(sized: DataFrame, *carried: str) -> DataFrame:
    """A row for each of sizes(): target, copies, taken and the positions of the copies, and the columns carried along.

    Rows move once, to their bucket of a source; what is joined to them there are the sums of buckets."""
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # equal for equal sources, never null
    keyed = sized.withColumn("s", named).withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    sums = keyed.groupBy("s", "b").agg(F.sum("size").alias("n"), F.min("source").alias("source"))
    goal = targets(sums.groupBy("s").agg(F.min("source").alias("source"), F.sum("n").alias("source_size")))
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("s", "b", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("head"))
    heads = heads.join(goal.select(F.col("s").alias("s2"), "source_size", "weight", "target"), F.col("s") == F.col("s2")).select(F.col("s").alias("s1"), F.col("b").alias("b1"), "head", "source_size", "weight", "target")
    inside = Window.partitionBy("s", "b").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = keyed.withColumn("inner", F.sum("size").over(inside)).join(heads, (F.col("s") == F.col("s1")) & (F.col("b") == F.col("b1")))
    end = F.col("head") + F.col("inner")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("source_size") > 0) & (F.col("epochs") < MAX_EPOCHS) & ((2 * F.col("end") - F.col("size")).cast("double") <= 2.0 * rest)
    d = d.withColumn("end", end).withColumn("epochs", epochs).withColumn("copies", F.col("epochs") + extra.cast("long"))
    used = lambda e: e * F.col("source_size") + F.col("end") - F.col("size")
    times = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda e: position(used(e), F.col("target"), slope(F.col("weight"))))
    return d.select("doc_id", "source", "size", "t", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")).alias("positions"), *carried)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *carried: Column) -> DataFrame:
    """(doc_id, source, size, h, t): h orders the documents of a source, t those with one h. Null ids are ordered by their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(text))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), h.alias("h"), F.xxhash64(F.col(text_col)).alias("t"), *carried)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every copy of every document that is taken, range-sorted by position; the columns of docs.

    Texts are shuffled twice: to their bucket, where a document gets its positions, and to their part of the training time. The words
    of all sources are taken nearly evenly over that time, so its ranges are equal stretches of it and nothing is sampled."""
    planned = plan(sizes(docs, "doc_id", "text", "source", F.struct(*docs.columns).alias("row")), "row")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = planned.select("doc_id", "t", "row", F.explode("positions").alias("at"))
    dealt = taken.repartitionById(n, F.least(F.floor(F.col("at") * n), F.lit(n - 1)).cast("int"))
    return dealt.sortWithinPartitions("at", "doc_id", "t").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, _ = stored(sizes(table(spark, sf_dir, "documents")), "sizes")
    first = plan(sized).select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("position"))
    return first.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s0),
s2 AS (SELECT *, CAST((no - 1) % 3 + 1 AS BIGINT) AS weight FROM s1),
s3 AS (SELECT *, 3 * coalesce(sum(source_size) OVER (ORDER BY 3.0 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
              sum(weight) OVER (ORDER BY 3.0 * source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
              sum(source_size) OVER () AS all_words FROM s2),
s4 AS (SELECT *, 3 * CAST(source_size AS HUGEINT) * left_weight > (all_words - capped) * weight AS free FROM s3),
s5 AS (SELECT *, min(CASE WHEN free THEN capped END) OVER () AS level_capped, max(CASE WHEN free THEN left_weight END) OVER () AS level_weight FROM s4),
goal AS (SELECT source, source_size, weight,
                CASE WHEN free THEN CAST((all_words - level_capped) * weight AS DOUBLE) / CAST(level_weight AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target
         FROM s5),
d AS (SELECT z.doc_id, z.size, g.source_size, g.weight, g.target,
             CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY h, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
             CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / CAST(g.source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS epochs
      FROM sized z JOIN goal g ON z.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, epochs + CASE WHEN source_size > 0 AND epochs < 3 AND CAST(2 * e - size AS DOUBLE) <= 2.0 * (target - CAST(epochs * source_size AS DOUBLE)) THEN 1 ELSE 0 END AS copies FROM d),
u AS (SELECT *, least(CAST(e - size AS DOUBLE) / target, CAST(1.0 AS DOUBLE)) AS u, (CAST(weight AS DOUBLE) - 2.0) * CAST(0.5 AS DOUBLE) AS k FROM c)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
       CASE WHEN copies > 0 AND target > 0 THEN CAST(2.0 AS DOUBLE) * u / ((CAST(1.0 AS DOUBLE) - k) + sqrt((CAST(1.0 AS DOUBLE) - k) * (CAST(1.0 AS DOUBLE) - k) + CAST(4.0 AS DOUBLE) * k * u)) END AS position
FROM u
"""
