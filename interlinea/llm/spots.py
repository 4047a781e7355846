"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature is a common word (an anchor) with the chain of content words that follow it: places where a text runs on in natural
language, so lists, links and markup leave none. A fingerprint is the set of its signatures' hashes. Likeness is the Jaccard similarity of two sets.

similar() compares documents: equal sets are one, and sets are partitioned by their length so that those as alike as asked for are in the
same partition or in neighbouring ones. In a partition, sets meet under their rarest signatures only, as many of them as that similarity needs;
a meeting is dropped if lengths, or what is left of both sets after their first common signature, can't make up the overlap. What is left
is compared in full.

edited() gives each document the text that follows it in descending order of ids. Documents are dealt out by ranges of ids, whose bounds
come from Spark's own range partitioning of the ids alone; the first document of each range is sent to the range before it as well, and the text
of the first one of all to the last range. So each text is shuffled once, and no range is larger than others.

Defined cases: null text is empty; a text without a chain counts each word as an anchor (three words in a row are a signature), and one of one or
two words is one signature; a text without words has the empty fingerprint, whose likeness to itself is 1 and to others 0; repeated
signatures count once; very long texts are taken whole; ids may repeat and be null: equal ids go by the hash of their text, then by the text,
nulls come last; of a single document the next one is itself; an empty table gives no rows. Only the id and the text are read, so other columns
may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import indexes, let, stored, table

#: Anchors by language: the commonest function words.
ANCHORS = {
    "en": "a an and are as at be by for from had has have he in is it of on or that the this to was were will with",
    "de": "als auf aus bei das dem den der des die ein eine einer es für im in ist mit nicht sich und von wie zu zum",
    "fr": "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une",
    "es": "al como con de del el en es la las lo los no para por que se su un una y",
}
#: Content words of a chain, and how many content words are gone on for each.
CHAIN, DISTANCE = 2, 1
SIMILARITY = 0.8
#: Ranges of ids for each shuffle partition.
RANGES = 4


def anchors(languages: list[str] | None = None) -> list[str]:
    return sorted({w for k, v in ANCHORS.items() if languages is None or k in languages for w in v.split()})


def signatures(text: Column, common: list[str] | None = None, chain: int = CHAIN, distance: int = DISTANCE) -> Column:
    """The fingerprint of a text as a sorted array of distinct 32-bit hashes."""
    common = anchors() if common is None else common
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    hashed = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(0xFFFFFFFF))

    def chains(s: Column) -> Column:
        """The j-th anchor, at place p, has p - j content words before it, so its chain begins there among the content words."""
        whole = lambda p, j: p - j + chain * distance <= F.size(s["content"])
        one = lambda p, j: F.when(whole(p, j), hashed(F.get(s["words"], p), *[F.get(s["content"], p - j + (k + 1) * distance - 1) for k in range(chain)]))
        return F.filter(F.transform(s["at"], one), lambda h: h.isNotNull())

    def plain(w: Column) -> Column:
        three = F.transform(indexes(F.size(w) - chain), lambda i: hashed(*[F.get(w, i + k) for k in range(chain + 1)]))
        return F.when(F.size(w) > chain, three).when(F.size(w) > 0, F.array(hashed(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    def of(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*common), i)), lambda i: i.isNotNull())
        content = F.filter(w, lambda x: ~x.isin(*common))
        found = let(F.struct(w.alias("words"), content.alias("content"), at.alias("at")), chains)
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(plain(w)))

    return F.sort_array(F.array_distinct(let(words, of)))


def shown(prints: Column) -> Column:
    """A fingerprint as a string: eight hex digits for each hash, in order."""
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; equal ones and those that can't overlap aren't intersected."""
    both = lambda n: n / (F.size(a) + F.size(b) - n)
    apart = (F.get(a, F.size(a) - 1) < F.get(b, F.lit(0))) | (F.get(b, F.size(b) - 1) < F.get(a, F.lit(0)))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(apart, 0.0).otherwise(let(F.size(F.array_intersect(a, b)), both))


def part(size: Column, similarity: float) -> Column:
    """The partition of a set of that length: lengths in a ratio of the similarity or more are at most one apart."""
    return F.floor(F.log(size.cast("double")) / -math.log(similarity) + 1e-9).cast("int") if similarity < 1 else size.cast("int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: list[str] | None = None) -> DataFrame:
    """(doc_id, prints)."""
    return docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col), common).alias("prints"))


def similar(prints: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """members(doc_id, set_id) and pairs(a, b, likeness) of set ids, a < b, of that similarity or more, from (doc_id, prints).

    Documents of equal sets have one id; empty sets are in no pair. A group of unequal sets that are all alike gives all its pairs, which are
    the result; copies don't."""
    members, _ = stored(prints.select("doc_id", "prints", F.xxhash64("prints").alias("set_id")), "spot_members")
    sets = members.where(F.size("prints") > 0).groupBy("set_id").agg(F.first("prints").alias("prints"), F.size(F.first("prints")).alias("n"))
    sets, _ = stored(sets, "spot_sets")
    often = sets.select(F.explode("prints").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = sets.select("set_id", "n", F.explode("prints").alias("h_")).join(often, F.col("h_") == F.col("h"))
    # Signatures of one set only come before all others in the order; they take up places and meet nothing.
    order = Window.partitionBy("set_id").orderBy("df", "h")
    ranked = ranked.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("set_id"))).withColumn("i", F.row_number().over(order) - 1 + F.col("n") - F.col("shared"))
    first = ranked.where(F.col("i") < F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).select("set_id", "n", "h", "i", part(F.col("n"), similarity).alias("p"))
    a = first.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("h").alias("ha"), F.col("p").alias("pa"))
    # Each set stands in its own partition, and as a visitor in the next one.
    b = first.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("h").alias("hb"), F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("pb"), "p")
    fits = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6
    met = a.join(b, (F.col("ha") == F.col("hb")) & (F.col("pa") == F.col("pb")) & fits & ((F.col("p") < F.col("pa")) | (F.col("a") < F.col("b"))))
    met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("ia", "ib", "na", "nb")).alias("at"))
    left = F.least(F.col("at.na") - F.col("at.ia"), F.col("at.nb") - F.col("at.ib"))
    met = met.where(left >= (F.col("at.na") + F.col("at.nb")) * similarity / (1 + similarity) - 1e-6).select("a", "b")
    of = lambda c: sets.select(F.col("set_id").alias(f"{c}_"), F.col("prints").alias(f"prints_{c}"))
    pairs = met.join(of("a"), F.col("a") == F.col("a_")).join(of("b"), F.col("b") == F.col("b_"))
    pairs = pairs.select("a", "b", likeness(F.col("prints_a"), F.col("prints_b")).alias("likeness")).where(F.col("likeness") >= similarity - 1e-9)
    return members.select("doc_id", "set_id"), pairs


def _ranges(ids: DataFrame, n: int) -> tuple[list[int], int, int]:
    """The greatest id of each of about n ranges, falling; rows with an id; rows without."""
    dealt = ids.where("doc_id IS NOT NULL").repartitionByRange(n, F.col("doc_id").desc())
    found = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # n rows at most
    nulls = ids.where("doc_id IS NULL").count()
    return sorted((r["first"] for r in found), reverse=True), sum(r["n"] for r in found), nulls


def _place(id_: Column, firsts: list[int]) -> Column:
    """The range of an id, the last one whose greatest id isn't less, found by halving."""
    held = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]
    step = lambda at, s: F.when(F.coalesce(F.get(held, at + s - 1) >= id_, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) - 1


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text, prints, next_prints): each document with the text and fingerprint of the next one in falling order of ids."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts, filled, nulls = _ranges(own.select("doc_id"), n)
    # Rows without an id come last, in parts by ranges of their texts' hashes.
    h = F.xxhash64("text")
    parts = -(-nulls * n // (filled + nulls)) if nulls else 0
    sub = lambda h: F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * max(parts, 1)).cast("int"), F.lit(max(parts, 1) - 1))
    known = len(firsts)
    place = F.when(F.col("doc_id").isNotNull(), _place(F.col("doc_id"), firsts) if known else F.lit(0)).otherwise(F.lit(known) + sub(h))
    leads = {i: (v, None) for i, v in enumerate(firsts)}
    if nulls:
        for r in own.where("doc_id IS NULL").select(h.alias("h")).groupBy(sub(F.col("h")).alias("s")).agg(F.min("h").alias("h")).collect():
            leads[known + r["s"]] = (None, r["h"])
    filled_places = sorted(leads)
    before = {p: filled_places[i - 1] for i, p in enumerate(filled_places)}  # of the first range, the last one
    dealt = own.withColumn("place", place)
    if leads:
        # The first rows of a range also go to the one before; ranges are looked up by number in two arrays.
        by_place = lambda of: F.split(F.lit(",".join(str(of(p)) for p in range(filled_places[-1] + 1))), ",").cast("array<bigint>")
        lead = by_place(lambda p: 0 if p not in leads else leads[p][0] if leads[p][0] is not None else leads[p][1])
        to = by_place(lambda p: before.get(p, 0)).cast("array<int>")
        is_lead = F.coalesce(F.col("doc_id"), h) == F.get(lead, F.col("place"))
        both = F.array(F.struct(F.col("place").alias("place"), F.lit(False).alias("extra")), F.struct(F.get(to, F.col("place")).alias("place"), F.lit(True).alias("extra")))
        dealt = dealt.withColumn("at", F.explode(F.when(is_lead, both).otherwise(F.slice(both, 1, 1)))).select("doc_id", "text", "at.place", "at.extra")
    else:
        dealt = dealt.withColumn("extra", F.lit(False))
    dealt = dealt.repartition("place").withColumn("prints", signatures(F.col("text")))
    w = Window.partitionBy("place").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    near = dealt.withColumns({"next_text": F.lead("text").over(w), "next_prints": F.lead("prints").over(w)})
    return near.where("NOT extra").select("doc_id", "text", "next_text", "prints", "next_prints")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """followed() with edited: the text whose last half, rounded down, is replaced by as much of the next text's start."""
    d = followed(docs, id_col, text_col, ranges)
    half = F.floor(F.length("text") / 2).cast("int")
    return d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edited(table(spark, sf_dir, "documents")).withColumn("edited_prints", signatures(F.col("edited")))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("prints")).alias("fingerprint"),
        shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
