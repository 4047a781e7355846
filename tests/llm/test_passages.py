import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from interlinea.llm import passages, suffix_array, suffix_trees

LENGTH, GRAM = 6, 2


def texts(seed):
    rng = random.Random(seed)
    shared = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(14)]
    out = [None, "", "one two", "same same same same same same same same same same", "é ü ß à ç ñ ö"]
    for _ in range(25):
        w = [f"{rng.choice('abcdefghijkl')}{rng.randrange(4)}" for _ in range(rng.randint(3, 30))]
        if rng.random() < 0.6:
            a, b = sorted(rng.sample(range(len(shared) + 1), 2))
            at = rng.randrange(len(w))
            w[at:at] = shared[a:b]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out + out[-4:] + [out[-1]]


def expected(rows, length, keep_first):
    """rows in the order of their ids, without two that are equal; the words that stay."""
    words = [(t or "").encode().split() for _, t in rows]
    places = [(tuple(w[i : i + length]), r, i) for r, w in enumerate(words) for i in range(len(w) - length + 1)]
    count = Counter(p[0] for p in places)
    first = {}
    for win, r, i in places:
        first.setdefault(win, (r, i))
    gone = [set() for _ in rows]
    for win, r, i in places:
        if (first[win] != (r, i)) if keep_first else count[win] > 1:
            gone[r] |= set(range(i, i + length))
    return {d: (len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()) for (d, _), w, g in zip(rows, words, gone)}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1, 3, passages.BLOCK])
@pytest.mark.parametrize("module", [suffix_trees, suffix_array])
def test_against_brute_force(spark, seed, block, module):
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, anchor string, m int").repartition(3)
    found = module.repeated(docs, length=LENGTH, gram=GRAM, block=block)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.digest(docs, found, LENGTH).collect()}
    assert got == expected(rows, LENGTH, module is suffix_array)


def test_repeated_rows(spark):
    text = " ".join("abcdefghij")
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (None, "x y"), (None, None)], "doc_id long, text string")
    trees = passages.digest(docs, suffix_trees.repeated(docs, length=LENGTH, gram=GRAM), LENGTH).collect()
    assert sorted(r["n_removed"] for r in trees) == [0, 0, 0, 10, 10]
    array = passages.digest(docs, suffix_array.repeated(docs, length=LENGTH, gram=GRAM), LENGTH).collect()
    assert [r["n_removed"] for r in array] == [0] * 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.digest(docs, suffix_trees.repeated(docs), 35).count() == 0
    assert suffix_array.dedup(docs).count() == 0


def test_dedup_keeps_white_space_and_columns(spark):
    shared = [f"s{i}" for i in range(60)]
    one = "Start here.\n\n" + " ".join(shared) + "\nThe\tend  now."
    two = "Another text\n" + "  ".join(shared) + "\nwith its own end."
    docs = spark.createDataFrame([(1, one, "r", None), (2, two, "k", 5), (3, None, "t", 6)], "doc_id long, text string, `row` string, kept int")
    got = {r["doc_id"]: r for r in suffix_array.dedup(docs).collect()}
    assert got[1]["text"] == one and got[2]["text"] == "Another text\nwith its own end." and got[3]["text"] is None
    assert [tuple(got[i])[2:] for i in (1, 2, 3)] == [("r", None), ("k", 5), ("t", 6)]


def contexts(texts, length, groups=None):
    import pyarrow as pa

    words = [t.encode() for t in texts]
    n = [max(1, len(w.split()) - length + 1) for w in words]
    table = {"anchor": groups or [1] * len(texts), "prefix": [0] * len(texts), "places": [1] * len(texts), "n": n, "o": [0] * len(texts), "words": words}
    return passages.Contexts(pa.table(table), length)


def test_tree_nodes():
    assert set(suffix_trees.nodes(np.array([3, 1, 0, 2, 2]))) == {(3, 0, 1), (1, 0, 2), (2, 3, 5)}
    assert suffix_trees.deep_leaves(np.array([3, 1, 0, 2, 2]), 2).tolist() == [True, True, False, True, True, True]


def test_maximal_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(30):
        length = rng.choice([2, 3])
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(length, 12))) for _ in range(4)]
        c = contexts(texts, length)
        got = {tuple(texts[p[0][0]].split()[p[0][1] : p[0][1] + len(w)]): p for w, p in suffix_trees.maximal_repeats(c)}
        want = {}
        for i, a in enumerate(texts):
            w = a.split()
            for s in range(len(w)):
                for e in range(s + length, len(w) + 1):
                    run = tuple(w[s:e])
                    places = [(j, k) for j, b in enumerate(texts) for k in range(len(b.split()) - len(run) + 1) if tuple(b.split()[k : k + len(run)]) == run]
                    left = {texts[j].split()[k - 1] if k else (j, k) for j, k in places}
                    right = {b[k + len(run)] if k + len(run) < len(b := texts[j].split()) else (j, k) for j, k in places}
                    if len(places) > 1 and len(left) > 1 and len(right) > 1:
                        want[run] = places
        assert got == want


def test_spans(spark):
    shared = [f"s{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(["a", *shared, "b"])), (2, " ".join([*shared, "c"])), (3, None), (4, "d " * 3)], "doc_id long, text string")
    found = suffix_trees.repeated(docs, length=LENGTH, gram=GRAM)
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in passages.spans(docs, found, LENGTH).collect()}
    assert got == {1: [(1, 21, " ".join(shared))], 2: [(0, 20, " ".join(shared))], 3: [], 4: []}


def test_one_frequent_passage_and_very_long_texts(spark):
    """A passage in every document, amid words of its own: its anchors have more contexts than the bound."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(9)]
    rows = [(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(8)] + passage + [f"y{rng.randrange(10**6)}" for _ in range(8)])) for i in range(60)]
    rows.append((100, " ".join(f"z{i}" for i in range(40_000)) + " " + " ".join(passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for module in (suffix_trees, suffix_array):
        found = module.repeated(docs, length=LENGTH, gram=GRAM, block=10)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.digest(docs, found, LENGTH).collect()}
        assert got == expected(rows, LENGTH, module is suffix_array)
