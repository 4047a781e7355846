"""SpotSigs fingerprints, held against a plain version of the same rules."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from interlinea.llm import registry, spots

ANCHORS = set(spots.anchors())


def plain(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    content, out, before = [x for x in w if x not in ANCHORS], set(), 0
    for x in w:
        if x in ANCHORS:
            if before + 2 <= len(content):
                out.add((x, content[before], content[before + 1]))
        else:
            before += 1
    return out or {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def held(spark, tmp_path, rows, schema="doc_id long, text string"):
    """The query's rows against the rules, for rows whose order is told by (id, text)."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op12_spot_signatures"](spark, str(tmp_path)).collect()
    return {r.doc_id: r for r in got}, got


def test_query_by_definition(spark, tmp_path):
    base = "the quick fox jumps over a lazy dog and the small cat sleeps in the warm house with a red door"
    texts = [base, base, base + " the end of it all", None, "", "one", "one two", "one two three four five", "die Katze und der Hund", "zzz qqq " * 3000, "the " * 50, "𝒳 is the é of à ñ " * 5]
    rows = [(3 * i - 5, t) for i, t in enumerate(texts)]
    by_id, got = held(spark, tmp_path, rows)
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(plain(t)) and len(r.edited_fingerprint) == 8 * len(plain(edited))
        assert abs(r.near_edited - jaccard(plain(t), plain(edited))) < 1e-9 and abs(r.near_next - jaccard(plain(t), plain(nxt))) < 1e-9
    assert by_id[-5].fingerprint == by_id[-2].fingerprint != by_id[1].fingerprint


def test_ids_that_repeat_and_are_null(spark, tmp_path):
    """Whatever the order of equal ids, each row is followed by one of the rows that may follow."""
    rows = [(5, "the big red house"), (5, "the big red house"), (4, "a small green tree"), (None, "of the deep blue sea"), (None, None), (None, "of the deep blue sea")]
    _, got = held(spark, tmp_path, rows + [(None, f"the word{i} number{i}") for i in range(40)])
    assert len(got) == 46
    # The two rows of id 5 are followed by each other and by 4; the last null by the first row of all.
    assert sorted(r.near_next for r in got if r.doc_id == 5) == [0.0, 1.0]
    assert sum(r.near_next == 1.0 for r in got if r.doc_id is None) == 1


def test_ranges_give_what_one_window_gives(spark):
    docs = spark.range(500).select((F.pmod(F.col("id") * 7919, F.lit(1009)) - 300).alias("doc_id"), F.concat(F.lit("the word"), F.col("id"), F.lit(" of number"), F.col("id"), F.lit(" again")).alias("text"))
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for n in (1, 2, 37):
        got = {r.doc_id: r.next_text for r in spots.followed(docs, ranges=n).collect()}
        assert got == {i: texts[ids[k - 1]] for k, i in enumerate(ids)}


def test_odd_tables(spark, tmp_path):
    by_id, got = held(spark, tmp_path, [(1, "the only text of this table", 9.0, "x")], "doc_id long, text string, place double, prints string")
    assert len(got) == 1 and by_id[1].near_next == 1.0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spots.edited(empty).collect() == []
    only_null = spark.createDataFrame([(None, "the one and only")], "doc_id long, text string")
    assert [r.next_text for r in spots.edited(only_null).collect()] == ["the one and only"]


def test_empty_fingerprints(spark):
    d = spark.createDataFrame([("", "", 1.0), ("", "the a b", 0.0), ("!!", None, 1.0), ("the a b", "", 0.0)], "a string, b string, want double")
    for r in d.select("want", spots.likeness(spots.signatures(F.col("a")), spots.signatures(F.col("b"))).alias("got")).collect():
        assert r.got == r.want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", "of", "Und", "la", "cat", "dog", "x9", "été", "-", "!", "\n"]), max_size=30).map(" ".join), min_size=1, max_size=20))
def test_any_words(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {r.doc_id: r.prints for r in spots.fingerprints(d).collect()}
    for i, t in enumerate(texts):
        assert len(prints[i]) == len(plain(t)) and prints[i] == sorted(set(prints[i]))
        assert all((prints[i] == prints[j]) == (plain(t) == plain(u)) for j, u in enumerate(texts))


def test_similar_finds_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" the end of these words was near")).alias("text"))
    rows = docs.unionByName(near)
    for least in (0.8, 0.95, 1.0):
        members, pairs = spots.similar(spots.fingerprints(rows), least)
        set_of = {r.doc_id: r.set_id for r in members.collect()}
        sets = {set_of[r.doc_id]: plain(r.text) for r in rows.collect() if plain(r.text)}
        want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= least - 1e-9}
        got = {(r.a, r.b): r.likeness for r in pairs.collect()}
        assert set(got) == want and all(abs(v - jaccard(sets[a], sets[b])) < 1e-9 for (a, b), v in got.items())
    assert len(want) == 0


def test_similar_of_nothing(spark):
    members, pairs = spots.similar(spots.fingerprints(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")))
    assert members.count() == 2 and pairs.count() == 0
