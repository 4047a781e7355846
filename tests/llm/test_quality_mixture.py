import math
import random
import re
from collections import Counter

import duckdb
import xxhash
from pyspark.sql import functions as F

from interlinea.llm import mixture, quality

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = SPLIT.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def grams(text):
    w = [x.encode() for x in SPLIT.findall(text or "")]
    h = lambda x, seed=42: xxhash.xxh64_intdigest(x, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for i, x in enumerate(w):
        out.append(signed(h(x)) % quality.N_BUCKETS)
        if i + 1 < len(w):
            out.append(signed(h(w[i + 1], h(x))) % quality.N_BUCKETS)
    return out


def corpus():
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "and", "house", "river", "é", "walks"]) + str(rng.randrange(8)) for _ in range(rng.randint(40, 120))) for _ in range(30)]
    bad = [" ".join(rng.choice(["BUY", "$$$", "NOW!!", "&&&", "<click>"]) + str(rng.randrange(30)) for _ in range(80)) for _ in range(15)]
    odd = [None, "", " \n\t ", "one", "a b c a b c a b c " * 10, "x\ny\nx\n \n\ny\r\nx", "# * | <>\x0b\x0c"]
    return list(enumerate(good + bad + odd)), len(good)


def test_quality_against_brute_force(spark):
    rows, n_good = corpus()
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, quality_rules string, n_words int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, n_good, 2)] + [(40, 0, 0), (1, 1, 1), (None, 1, 0), (2, None, None), (0, 1, None)], "doc_id long, quality int, toxic int")
    trusted = set(range(0, n_good, 2))
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    shift = math.log(sum(raw.values()) + quality.N_BUCKETS) - math.log(sum(target.values()) + quality.N_BUCKETS)
    weight = lambda b: round(quality.SCALE * (math.log(target[b] + 1) - math.log(raw[b] + 1) + shift))
    judged, name = quality.judge(docs, quality.fit(docs, labels))
    assert judged.columns[:-1] == docs.columns
    got = {r["doc_id"]: r for r in judged.collect()}
    for i, t in rows:
        q, (n, chars, symbols, dup, rep) = got[i][name], counts(t)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        failed = n < 50 or 100 * rep > 50 * n
        total = sum(map(weight, grams(t)))
        assert q["base_failed"] == failed
        assert q["kept"] == (not failed and total >= round(quality.THRESHOLD * quality.SCALE) * (2 * n - 1))
        assert q["llr"] is None if n == 0 else abs(q["llr"] - total / (2 * n - 1) / quality.SCALE) < 1e-9
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0)))[0].count() == 0


def test_every_trusted_document_counts(spark):
    n = (1 << 16) + 500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    counts = quality.bucket_counts(docs, quality.target_ids(labels)).collect()
    assert [(r["n_raw"], r["n_target"]) for r in counts] == [(n, n)]


def test_target_sample_is_bounded(spark):
    labels = spark.range(100).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    ids = quality.target_ids(labels.union(labels), 10).collect()
    assert len({r["doc_id"] for r in ids}) == len(ids) == 10


def mixed_rows():
    rng = random.Random(8)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rng.randrange(60))), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(200)]
    return rows + [(500, None, "s1"), (501, "only one here", "tiny"), (502, "null source words", None), (503, "", "blank"), (None, "no id at all", "s2"), (7, rows[7][1], rows[7][2]), (504, "Z", "Ä")]


def test_targets_and_takes(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixture.plan(mixture.sizes(docs)).collect()
    assert len(p) == len(rows)
    size, source_of = Counter(), lambda r: r["source"]
    for _, t, s in rows:
        size[s] += len(SPLIT.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target, free = float(sum(size.values())), {}, set(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    target |= share
    taken = Counter()
    for r in p:
        assert r["source_size"] == size[source_of(r)] and abs(r["target"] - target[source_of(r)]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 and len(r["positions"]) == r["copies"]
        assert all(0 <= x <= 1 for x in r["positions"] if x is not None)
        taken[source_of(r)] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 60


def test_plan_equals_sql(spark):
    rows = [r for r in mixed_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixture.plan(mixture.sizes(docs)).selectExpr("doc_id", "size", "source_size", "target", "taken", "copies", "get(positions, 0) as position").toPandas()
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cols = ["doc_id", "size", "source_size", "target", "taken", "copies", "position"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({mixture.OP9_SQL})").fetchall()
    clean = lambda x: None if x is None or x != x else float(x)
    assert sorted((tuple(map(clean, r)) for r in want), key=repr) == sorted((tuple(map(clean, r)) for r in first[cols].itertuples(index=False)), key=repr)


def test_mix_gives_each_copy(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, source string, position string")
    out = mixture.mix(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    want = Counter()
    for r in mixture.plan(mixture.sizes(docs)).collect():
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    by_size = Counter()
    for (d, t, s), n in got.items():
        by_size[d, len(SPLIT.findall(t or "")), s] += n
    assert by_size == Counter({k: v for k, v in want.items() if v})
    assert mixture.mix(docs.limit(0)).count() == 0


def test_mix_is_in_order_and_the_same_in_reruns(spark):
    rows = mixed_rows() + [(9000 + i // 2, f"{i} b c", "s1") for i in range(40)] + [(None, f"{i} x", "s2") for i in range(40)]
    schema = "doc_id long, text string, source string"
    runs = [[tuple(r) for r in mixture.mix(spark.createDataFrame(x, schema).repartition(k)).collect()] for k, x in ((3, rows), (5, rows[::-1]))]
    assert runs[0] == runs[1]
    first = {}
    for r in mixture.plan(mixture.sizes(spark.createDataFrame(rows, schema))).collect():
        if r["positions"]:
            first[r["doc_id"], r["t"]] = min(r["positions"])
    assert len({k for k in first if k[0] is None}) > 20  # rows without an id are told apart
