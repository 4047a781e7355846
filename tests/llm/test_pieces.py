import hashlib
import os
import random
import struct

import pytest

from interlinea.llm import pieces

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return pieces.Machine(pieces.read_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


TEXTS = ["", " ", "a", "Hello, world!", "  two  spaces ", "▁mark ▁▁", "naïve café 漢字 \U0001f600", "tab\tline\n\nend\r\n", "x" * 300, "the" * 200, "1234567890.50%", "don't re-use “quotes” …", "\x00\x01", "á b​"]


@needs_model
@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(both, text):
    m, sp = both
    ids = m.encode(text).tolist()
    assert ids == sp.encode(text)
    assert m.decode(ids) == sp.decode(ids)
    if "▁" not in text:
        assert m.decode(ids) == text


@needs_model
def test_random_texts(both):
    m, sp = both
    rng = random.Random(5)
    alphabet = "abcdefghij ▁ \n.,-'éß漢1" + "etaoin" * 3 + "    "
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))
        assert m.encode(text).tolist() == sp.encode(text)


@needs_model
def test_small_caches_change_nothing(both, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_PARTS", 3)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 3)
    m, sp = pieces.Machine(pieces.read_model()), both[1]
    text = "some words that come and go and come again, some words"
    assert m.encode(text).tolist() == sp.encode(text) and len(m.parts) <= 3


@needs_model
def test_very_long_texts(both, spark, monkeypatch):
    m, sp = both
    text = "some words, more words\n" * 20000 + "x" * 5000 + "漢字" * 3000
    assert m.encode(text).tolist() == sp.encode(text)
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(docs).collect()} == {1: sp.encode(text), 2: sp.encode("short"), 3: []}


def test_normaliser_machine():
    m = unigram({"a": -1.0}, squeeze=1, dummy=1)
    assert [m.normalise(x) for x in ("", "  ", " a  b ", "a", "a\n  b")] == ["", "", "▁a▁b", "▁a", "▁a\n▁b"]


def field(number, kind, value):
    out, n = bytearray(), number << 3 | kind
    for v in [n] + ([len(value)] if kind == 2 else []):
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out) + (value if kind != 0 else bytes([value]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def unigram(scores, squeeze=0, dummy=0):
    model = b""
    for p, s, k in [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in scores.items()]:
        model += field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k))
    return pieces.Machine(model + field(2, 2, field(3, 0, 1)) + field(3, 2, field(3, 0, dummy) + field(4, 0, squeeze)))


def test_unigram_shortest_path_against_all_paths():
    rng = random.Random(7)
    scores = {p: 1 - rng.random() * 5 for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb", "aab"]}
    m = unigram(scores)

    def best(s):
        if not s:
            return 0.0
        return max(scores[s[:k]] + best(s[k:]) for k in range(1, 4) if s[:k] in scores)

    for _ in range(100):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids = m.shortest(s)
        assert "".join(m.pieces[i] for i in ids) == s
        assert sum(scores[m.pieces[i]] for i in ids) == pytest.approx(best(s), abs=1e-4)


@needs_model
def test_frames(spark, both):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3])]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, ids int")
    back = pieces.decode(pieces.encode(docs)).collect()
    assert len(back) == len(rows)
    digests = sorted(map(repr, pieces.digest(docs.select("doc_id", "text")).collect()))
    assert len(digests) == len(rows) and pieces.digest(docs.limit(0)).count() == 0
    for r in pieces.digest(docs).where("doc_id is not null").collect():
        ids = both[1].encode(TEXTS[r["doc_id"]])
        text = both[1].decode(ids)
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), len(text), sha(text))
    for r in back:
        assert (r["text"] == both[1].decode(both[1].encode(TEXTS[r["doc_id"]]))) if r["doc_id"] is not None else r["text"] == ""
    assert pieces.encode(docs.limit(0)).count() == 0
