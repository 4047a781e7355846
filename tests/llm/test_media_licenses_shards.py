import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import regex

from interlinea.llm import licenses, media, shards


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("data", [b"", b"a", b"\x00" * 576, bytes(range(256)) * 9, "é漢".encode() * 999, b"x" * 200_000])
def test_png_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 576 == 0 and payload and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    png = media.encode_png(payload)
    assert png == media.encode_png(payload)
    samples = media.decode_png(png)
    assert samples.tobytes() == payload
    assert media.cosine_hash(samples) == media.cosine_hash(samples.copy())


def slow_filter(kind, rows):
    out = []
    for i, row in enumerate(rows.astype(int)):
        up = rows[i - 1].astype(int) if i else np.zeros(len(row), int)
        line = [kind]
        for j, x in enumerate(row):
            a, b, c = (row[j - 1] if j else 0), up[j], (up[j - 1] if j else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
    return b"".join(out)


@pytest.mark.parametrize("kind", range(5))
def test_reads_every_filter(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (7, 5), dtype=np.uint8)
    raw = slow_filter(kind, rows)
    head = struct.pack(">IIBBBBB", 5, 7, 8, 0, 0, 0, 0)
    body = zlib.compress(raw)
    png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"a\x00b") + media._chunk(b"IDAT", body[:9]) + media._chunk(b"IDAT", body[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == rows).all()


def test_damage_is_found():
    png = media.encode_png(media.pad(b"some text"))
    for i in (0, 10, 20, 40, len(png) - 10):
        with pytest.raises(ValueError):
            media.decode_png(png[:i] + bytes([png[i] ^ 1]) + png[i + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-6])
    with pytest.raises(ValueError):
        media.encode_png(b"x" * 25)


def test_low_coefficients_against_the_definition():
    x = np.random.default_rng(1).integers(0, 256, (48, 24), dtype=np.uint8)
    low = np.array([[sum(x[i, j] * np.cos(np.pi * u * (i + 0.5) / 48) * np.cos(np.pi * v * (j + 0.5) / 24) for i in range(48) for j in range(24)) for v in range(8)] for u in range(8)]).ravel() / x.size
    bits = low > np.median(low[1:])
    bits[0] = False
    assert media.cosine_hash(x) == np.packbits(bits).tobytes().hex()


def test_media_frames(spark):
    rows = [(1, "a"), (2, None), (None, ""), (1, "a"), (4, "é" * 5000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, media int")
    got = media.features(media.media_columns(docs)).collect()
    assert sorted(r["n_bytes"] for r in got) == [0, 0, 1, 1, 10000]
    same = [tuple(r) for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]
    assert media.features(media.media_columns(docs.limit(0))).count() == 0


def test_media_values_by_definition(spark):
    """Every value of the table from the text alone; the stored form is opened by hand."""
    texts = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "é漢\U0001f600" * 400, "line\n" * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.media_columns(docs).collect()}
    for r in media.features(media.media_columns(docs)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        png = stored[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest())
        at, body, wide = 8, b"", None
        while at < len(png):
            n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            chunk = png[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + chunk) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
            wide = int.from_bytes(chunk[:4], "big") if kind == b"IHDR" else wide
            body += chunk if kind == b"IDAT" else b""
            at += 12 + n
        flat = zlib.decompress(body)
        out, before = b"", bytes(wide)
        for i in range(0, len(flat), wide + 1):
            kind, row = flat[i], bytearray(flat[i + 1 : i + 1 + wide])
            for x in range(wide):
                a, up, c = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
                nearest = min((abs(a + up - c - v), k, v) for k, v in enumerate((a, up, c)))[2]
                row[x] = row[x] + (0, a, up, (a + up) // 2, nearest)[kind] & 255
            before = bytes(row)
            out += before
        assert out == payload
        assert r["feature"] == media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, wide))


# ---------------------------------------------------------------- licenses


def slow_base(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), labels


TEXTS = [None, "", "MIT License", "mit license mit LICENSE, mit-license!", "the Apache  License and the GNU General\nPublic License", "emit license", "mit licensed", "é mit license ü", "general public license general public license x apache license", "0 1 2 mit license"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_phrases(text):
    assert licenses.scan((text or "").encode())[:5] == slow_base(text)


def test_random_base_phrases():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["mit", "license", "apache", "general", "public", "x"]) + rng.choice([" ", "-", "\n", ", "]) for _ in range(rng.randrange(12)))
        assert licenses.scan(text.encode())[:5] == slow_base(text)


def edit(rng, s, n, exact=()):
    """s with n errors, none of them in an exact word or at its edges."""
    s = list(s)
    while n:
        i = rng.randrange(1, len(s) - 1)
        if any(set(range(m.start() - 1, m.end() + 1)) & {i} for w in exact for m in re.finditer(rf"\b{w}\b", "".join(s))):
            continue
        if rng.random() < 0.5:
            s[i] = rng.choice("abcxyz")
        else:
            del s[i]
        n -= 1
    return "".join(s)


@pytest.mark.parametrize("notice", list(licenses.NOTICES))
def test_fuzzy_notices(notice):
    rng = random.Random(notice)
    k = len(notice) // licenses.CHARS_PER_ERROR
    label, exact = licenses.NOTICES[notice]
    for n in range(k + 1):
        text = f"some words before {edit(rng, notice, n, exact)} and some after"
        found = licenses.scan(text.encode())[5]
        assert any(f[2] == label and f[3] <= k for f in found), (notice, n, text)
    assert not licenses.scan(("unrelated words of no kind " * 20).encode())[5]


def labels(text):
    return {f[2] for f in licenses.scan(text.encode())[5]}


@pytest.mark.parametrize("notice", list(licenses.NOTICES))
def test_a_whole_notice_gets_its_own_label_only(notice):
    assert labels(f"words before {notice} words after") == {licenses.NOTICES[notice][0]}


def test_other_licences_get_no_label_of_a_near_one():
    assert labels("licensed under cc by sa 4 0") == {"cc-by-sa-notice"}
    assert labels("licensed under cc by nd 4 0") == {"cc-by-nd-notice"}
    for text in ("released under the bsd license", "released under the zlib license", "licensed under the gnu lesser general public license", "licensed under the gnu affero general public license", "no rights reserved", "some rights reserved", "licensed under cc 0 1 0", "licensed under the eclipse license version 2 0", "the terms of the eclipse public license"):
        assert labels(text) == set(), text


FAMILIES = {
    "licensed under the apache license version 1 1": {"apache-1-notice"},
    "licensed under the apache license version 3 0": set(),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": {"agpl-notice"},
    "this program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": {"lgpl-notice"},
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3": {"gpl-notice"},
    "this program is free software you can redistribute it and or modify it as you like": {"gpl-notice"},
    "licensed under cc by 4 0 sa": {"cc-by-sa-notice"},
    "licensed under CC BY-NC-ND 4.0": {"cc-by-nc-nd-notice"},
    "licensed under cc by 4 0 nc sa": {"cc-by-nc-sa-notice"},
    "licensed under cc by 4 0": {"cc-by-notice"},
    "licensed under cc by 3 0 sa": {"cc-by-sa-notice"},
    "licensed under cc by 9 0": set(),
    "released under the isc license": set(),
    "subject to the terms of the common public license": set(),
}


@pytest.mark.parametrize("text", list(FAMILIES))
def test_families(text):
    assert labels(f"words before {text} words after") == FAMILIES[text]


def test_long_texts_of_notices():
    """A notice at the end of a long text, and very many of them."""
    notice = "licensed under the gnu general public license"
    found = licenses.scan(f"{'word ' * 300000}{notice}".encode())
    assert found[0] == 300007 and [f[2] for f in found[5]] == ["gpl-notice"] and found[2:4] == (300004, 300004)
    assert len(licenses.scan(f"{notice} x ".encode() * 3000)[5]) == 3000


def test_catalogue_from_a_table(spark):
    rows = [("Copying is allowed, to everybody", "own", ["Copying"]), ("copying is allowed to everybody", "zzz", None), ("...", "none", None), (None, "null", None), ("one without a label", None, None), ("all is free for all", "free", None)]
    table = spark.createDataFrame(rows, "notice string, label string, exact array<string>")
    notices = licenses.catalogue(table)
    assert notices == {"copying is allowed to everybody": ("own", ("copying",)), "all is free for all": ("free", ())}
    docs = spark.createDataFrame([(1, "Copying is allowd to everybody."), (2, "All is free for al!")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs, notices=notices).collect()} == {1: "own", 2: "free"}
    assert licenses.catalogue(table.limit(0)) == {}
    with pytest.raises(ValueError):
        licenses.catalogue(table, most=3)


def test_own_catalogue(spark):
    docs = spark.createDataFrame([(1, "Copying is allowd to everybody for every purpose."), (2, "all rights reserved"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs, notices={"copying is allowed to everybody": ("own", ("copying",))}).collect()}
    assert got == {1: "own", 2: "", 3: ""}


def test_license_query_against_brute_force(spark):
    """Base columns by definition; the method's labels by a search for whole notices, with errors, at every place."""
    rng = random.Random(11)
    plain = ["word", "mit", "license", "apache", "general", "public", "by", "cc"]
    rows = []
    for i in range(60):
        w = [rng.choice(plain) for _ in range(rng.randrange(30))]
        if i % 3 == 0:
            notice = rng.choice(list(licenses.NOTICES))
            w.append(edit(rng, notice, len(notice) // licenses.CHARS_PER_ERROR, licenses.NOTICES[notice][1]))
        rows.append((i, " ".join([*w, "end"])))
    rows.append((100, "word " * 60000 + "MIT License"))
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        n, n_base, first, last, base = slow_base(text)
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, n_base, first, last, ",".join(sorted(base)))
        if d == 100:
            assert r["labels"] == "mit"
            continue
        want, hits = set(base), []
        for notice, (label, exact) in licenses.NOTICES.items():
            k = len(notice) // licenses.CHARS_PER_ERROR
            for m in regex.finditer(f"(?e)(?<!\\S)(?:{notice}){{e<={k}}}(?!\\S)", " ".join(text.split())):
                if all(x in m.group().split() for x in exact):
                    hits.append((label, set(exact), set(range(*m.span()))))
        want |= {label for label, exact, at in hits if not any(exact and exact < e and at & a for _, e, a in hits)}
        assert r["labels"] == ",".join(sorted(want)), text


def test_every_place_is_found():
    notice = "permission is hereby granted free of charge to any person obtaining a copy"
    text = f"{notice.replace('granted', 'grantd')} x {notice} {notice.replace('charge', 'chrge')}"
    found = licenses.scan(text.encode())[5]
    assert [(f[2], f[3]) for f in found] == [("mit-notice", 1), ("mit-notice", 0), ("mit-notice", 1)]
    assert all(text[a:b].split() == text[a:b].strip().split() for a, b, _, _ in found)


def test_license_frames(spark):
    docs = spark.createDataFrame([(i, t, "l", 1.0) for i, t in enumerate(TEXTS)] + [(None, "Permission is hereby grantd, free of charge, to any person obtaining a copy", "", 0.0)], "doc_id long, text string, labels string, score double")
    got = licenses.license_scan(docs).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["base_labels"] for r in got}[4] == "apache,gpl"
    fuzzy = next(r for r in got if r["doc_id"] is None)
    assert fuzzy["labels"] == "mit-notice" and fuzzy["base_labels"] == "" and fuzzy["spans"][0]["errors"] == 1
    assert licenses.license_scan(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- shards


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_compact_vacuum(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=40_000, least=1_000, fanout=3)
    assert store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.read()
    batches = [spark.createDataFrame([(k * 100 + i, f"text {i} " * 20, None if i % 7 else "s") for i in range(60)], "doc_id long, text string, path string").repartition(2) for k in range(5)]
    for b in batches:
        store.append(b)
    everything = sorted((tuple(r) for b in batches for r in b.collect()), key=repr)
    before = store.manifest()
    assert before["version"] == 5 and len(before["shards"]) >= 5 and rows_of(store.read()) == everything
    assert rows_of(store.read(1)) == rows_of(batches[0])
    assert store.compact() >= 1
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) and rows_of(store.read()) == everything
    assert rows_of(store.read(5)) == everything  # old versions stay readable until vacuum
    small = [s for s in after["shards"] if s["bytes"] < store.target // 2]
    assert all(sum(store._tier(s["bytes"]) == t for s in small) < store.fanout for t in range(10))
    assert store.vacuum() > 0 and rows_of(store.read()) == everything and store.versions() == [after["version"]]


def test_two_writers(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.range(3)
    store.append(df)
    old = store.manifest()
    store._commit(old, df.schema, [], set())
    with pytest.raises(FileExistsError):
        store._commit(old, df.schema, [], set())
    store.commit(df.schema, [])  # goes on top of the winner
    assert store.versions() == [1, 2, 3]
    with pytest.raises(FileExistsError):
        store.commit(df.schema, [], {"data/none"})


def test_versions_are_changes_on_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SPAN", 3)
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=10**6, least=1, fanout=100)
    for k in range(7):
        store.append(spark.range(k, k + 1, numPartitions=1))
    assert store._numbers("l") == [3, 6] and len(store._load("v", 7)["add"]) == 1
    assert [sorted(r[0] for r in store.read(v).collect()) for v in range(1, 8)] == [list(range(v)) for v in range(1, 8)]
    store.fanout = 2
    assert store.compact() >= 1 and sorted(r[0] for r in store.read().collect()) == list(range(7))
    last = store.versions()[-1]
    store.vacuum()
    assert store.versions() == store._numbers("l") == [last] and sorted(r[0] for r in store.read().collect()) == list(range(7))
    store.append(spark.range(7, 9))
    assert sorted(r[0] for r in store.read().collect()) == list(range(9))


def test_folders_whose_files_are_all_live_are_read_whole(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(0, 40, numPartitions=4))
    m = store.manifest()
    assert len(m["shards"]) == 4 and len(store._paths(m["shards"])) == 1 and len(store._paths(m["shards"][1:])) == 3
    store.commit(spark.range(1).schema, [], {m["shards"][0]["path"]})
    assert store.read().count() == 30


def test_a_merge_that_loses_the_race(spark, tmp_path, monkeypatch):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", fanout=2)
    other = shards.ShardStore(spark, f"file://{tmp_path}/s", fanout=2)
    for k in range(2):
        store.append(spark.range(k * 10, k * 10 + 10, numPartitions=1))
    write, raced = store._write, []

    def first_let_the_other(df):
        files = write(df)
        if not raced:
            raced.append(other.compact())
        return files

    monkeypatch.setattr(store, "_write", first_let_the_other)
    assert store.compact() == 0 and raced == [1]
    assert sorted(r[0] for r in store.read().collect()) == list(range(20)) and len(list((tmp_path / "s" / "data").iterdir())) == 3


def test_empty_arrivals(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(0))
    store.compact()
    assert store.read().columns == ["id"] and store.read().count() == 0
