"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Unigrams and bigrams of words are hashed into a fixed number of buckets. Two multinomials are
counted over the buckets: one of trusted target documents, one of the whole raw corpus. A
document's score is the mean over its n-grams of log p(target) - log p(raw). Weights are rounded to
fixed-point integers, so a document's sum doesn't depend on the order of addition and the verdict
is the same in every run.

Defined cases: a null or blank text has no words, fails the base rules and isn't kept; a text with
words but no weights known (empty corpus) scores 0; very long texts are judged whole; repeated rows are judged one by one, so there are
no ties; an empty table gives no rows; all columns of the input are carried through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, fresh, indexes, let, sieve, table, words

#: Buckets of the hashed n-grams: the size of the model, whatever the corpus.
N_BUCKETS = 1 << 15
#: Pseudo-count of each bucket in either multinomial.
ALPHA = 1.0
#: Weights are stored in units of 1 / SCALE.
SCALE = 1 << 16
#: Least mean log-likelihood ratio of a document that is kept, in nats.
THRESHOLD = -0.3


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(N_BUCKETS)).cast("int")


def target_ids(labels: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Ids of trusted documents: all that are labelled of good quality and not toxic, or so many of them by hash if a number is given."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select("doc_id").distinct()
    return ids if max_docs is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)


def bucket_counts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each bucket in the raw corpus and in the target; partial sums before the shuffle.

    Only documents that a sieve doesn't prove to be outside the target are shuffled, to be joined with its ids."""
    ids = target.select(F.col("doc_id").alias("_t"))
    may_be = sieve(ids.select(F.xxhash64("_t").alias("h")))
    each = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_x"), may_be(F.xxhash64(F.col(id_col))).alias("_m"))
    met = each.where("_m").join(ids.hint("merge"), F.col("_d") == F.col("_t"), "left")
    flagged = each.where("NOT _m").select(F.lit(0).cast("long").alias("_g"), "_x").unionByName(met.select(F.col("_t").isNotNull().cast("long").alias("_g"), "_x"))
    each = flagged.select("_g", words(F.col("_x")).alias("_w"))
    each = each.select("_g", "_w", F.posexplode("_w").alias("_i", "_x"))
    follows = F.get("_w", F.col("_i") + 1)
    grams = each.select("_g", F.explode(F.array(_bucket(F.col("_x")), F.when(follows.isNotNull(), _bucket(F.col("_x"), follows)))).alias("bucket"))
    return grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"), F.sum("_g").alias("n_target"))


def weights(counts: DataFrame) -> list[int]:
    """Log ratio of the smoothed multinomials for each bucket, in units of 1 / SCALE. N_BUCKETS rows come to the driver."""
    raw, target = [0] * N_BUCKETS, [0] * N_BUCKETS
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["n_raw"], r["n_target"]
    if not any(target):
        return [0] * N_BUCKETS
    shift = math.log(sum(raw) + ALPHA * N_BUCKETS) - math.log(sum(target) + ALPHA * N_BUCKETS)
    return [round(SCALE * (math.log(t + ALPHA) - math.log(r + ALPHA) + shift)) for t, r in zip(target, raw)]


def _repeated(w: Column) -> Column:
    """Words in 3-word windows found twice or more: windows sorted by hash, equal neighbours flagged, their union measured."""
    windows = F.transform(indexes(F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def starts(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        return F.sort_array(F.transform(F.filter(indexes(F.size(s)), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["p"]))

    covered = lambda d: F.aggregate(indexes(F.size(d)), F.lit(0), lambda acc, i: acc + F.coalesce(F.least(F.get(d, i + 1) - F.get(d, i), F.lit(3)), F.lit(3)))
    return let(F.sort_array(windows), lambda s: let(starts(s), covered))


def _ratio(w: Column, table_: Column) -> Column:
    def gram(i: Column) -> Column:
        one = F.get(table_, _bucket(F.get(w, i)))
        return one + F.when(i + 1 < F.size(w), F.get(table_, _bucket(F.get(w, i), F.get(w, i + 1)))).otherwise(F.lit(0))

    return F.aggregate(indexes(F.size(w)), F.lit(0).cast("long"), lambda acc, i: acc + gram(i))


def measures(text: Column, model: list[int]) -> Column:
    """A struct of the base counts and the summed log ratio of a text."""
    t = F.coalesce(text, F.lit(""))
    model_col = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            _ratio(w, model_col).alias("llr_sum"),
        ),
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    return weights(bucket_counts(docs, target_ids(labels), id_col, text_col))


def judge(docs: DataFrame, model: list[int], text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of the measures and the verdict; and that column's name."""
    name = fresh(docs, "quality_rules")
    least = round(threshold * SCALE)
    m = measures(F.col(text_col), model)

    def verdict(m: Column) -> Column:
        n_grams = 2 * m["n_words"] - 1
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        fields = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        passed = m["llr_sum"] >= F.lit(least).cast("long") * n_grams
        return F.struct(*fields, failed.alias("base_failed"), (~failed & passed).alias("kept"), F.when(m["n_words"] > 0, m["llr_sum"] / (n_grams * SCALE)).alias("llr"))

    return docs.withColumn(name, let(m, verdict)), name


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged, name = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", f"{name}.*")
