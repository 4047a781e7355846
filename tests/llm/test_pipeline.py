import math
import os
import re
from collections import Counter

import pytest
from test_graph_simhash import shingle_set
from test_quality_mixture import SPLIT, counts, grams

from interlinea.llm import mixture, pieces, pipeline, quality, suffix_array
from interlinea.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not (os.path.exists(SF) and os.path.exists(pieces.MODEL)), reason="no test data here")
def test_stages_against_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    outs = []
    for name, stage in pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, SF), name)
        outs.append(docs)

    # Quality rules.
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    raw, target = Counter(), Counter()
    for d, r in before.items():
        raw.update(grams(r["text"]))
        if d in trusted:
            target.update(grams(r["text"]))
    shift = math.log(sum(raw.values()) + quality.N_BUCKETS) - math.log(sum(target.values()) + quality.N_BUCKETS)
    weight = lambda b: round(quality.SCALE * (math.log(target[b] + 1) - math.log(raw[b] + 1) + shift))
    kept = {}
    for d, r in before.items():
        n, _, _, _, rep = counts(r["text"])
        if n >= 50 and 100 * rep <= 50 * n and sum(map(weight, grams(r["text"]))) >= round(quality.THRESHOLD * quality.SCALE) * (2 * n - 1):
            kept[d] = r
    assert {r["doc_id"]: r.asDict() for r in outs[0].collect()} == kept

    # SimHash: a document goes if it is like one before it that stays.
    sets = {d: shingle_set(r["text"]) for d, r in kept.items()}
    single = {}
    for d in sorted(kept):
        if not any(len(sets[d] & sets[x]) >= 0.8 * len(sets[d] | sets[x]) for x in single):
            single[d] = kept[d]
    assert len(single) < len(kept)
    assert {r["doc_id"]: r.asDict() for r in outs[1].collect()} == single

    # Passages of LENGTH words that an earlier place has too.
    seen, cut = set(), {}
    for d in sorted(single):
        text = single[d]["text"]
        spans = [m.span() for m in SPLIT.finditer(text)]
        w = [text[a:b] for a, b in spans]
        gone = set()
        for i in range(len(w) - suffix_array.LENGTH + 1):
            win = tuple(w[i : i + suffix_array.LENGTH])
            if win in seen:
                gone |= set(range(i, i + suffix_array.LENGTH))
            seen.add(win)
        out = text[: spans[0][0]] + "".join(text[a : spans[i + 1][0] if i + 1 < len(spans) else len(text)] for i, (a, b) in enumerate(spans) if i not in gone)
        cut[d] = single[d] | {"text": out, "n_chars": len(out)} if gone else single[d] | {"n_chars": len(text)}
    got = {r["doc_id"]: r.asDict() for r in outs[2].collect()}
    assert {d: r["text"] for d, r in got.items()} == {d: r["text"] for d, r in cut.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    # The mix: each document as often as planned, in the order of positions.
    plan = {r["doc_id"]: r for r in mixture.plan(mixture.sizes(outs[2])).collect()}
    mixed = outs[3].collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: p["copies"] for d, p in plan.items() if p["copies"]})
    assert all(r["text"] == got[r["doc_id"]]["text"] for r in mixed)

    # Piece ids.
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in outs[4].collect()) == Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in mixed)


def test_stages_on_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long_ = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long_, "en", "a", 5), (1, long_, "en", "a", 5), (2, None, None, None, None), (None, long_ + " more", None, None, 3), (3, "", "x", "", 0), (4, "tiny", "x", "b", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES:
            docs, _ = stored(stage(spark, docs, str(tmp_path)), name)
            docs.count()
            if name != "sentencepiece":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in pipeline.STAGES:  # each on the odd rows themselves
        stage(spark, spark.createDataFrame(rows, schema), str(tmp_path)).count()


def test_words_pattern():
    assert re.findall(SPLIT, "a\x0bb c") == ["a", "b", "c"]
