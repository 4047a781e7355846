"""License scans: exact phrases, and fuzzy short notices by pigeonhole seeds and bounded-error matching.

A text's words, in lower case and joined by one space, are scanned twice. Exact phrases are places where a
phrase's words stand consecutively. A notice with at most k errors (inserted, deleted or replaced characters)
has one of its k + 1 pieces unharmed, so an Aho-Corasick automaton of all notices' pieces locates the
candidates; round each, the regex library matches the whole notice with at most k errors and reports the span. Words that tell
a notice from others, versions too, have to be in the match as they are, so errors can't turn one licence into another; where notices of a family
overlap, the one with more such words stays, which is the longest.

Defined cases: null text is empty, has no words and no labels and scores 0; overlapping places all count;
repeated rows are scanned one by one; very long texts are scanned whole; of matches that begin together, all labels are
reported, in order; an empty table gives no rows. Only the id and the text columns are read, so others may have any names.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, in normalised words, the labels they give, and their words that tell them from other notices: these have to be exact.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit-notice", ()),
    "licensed under the apache license version 2 0": ("apache-notice", ("apache", "2", "0")),
    "licensed under the apache license version 1 1": ("apache-1-notice", ("apache", "1")),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd-notice", ()),
    "this program is free software you can redistribute it and or modify": ("gpl-notice", ("software",)),
    "permission to use copy modify and or distribute this software for any purpose": ("isc-notice", ()),
    "this source code form is subject to the terms of the mozilla public license": ("mpl-notice", ("mozilla",)),
    "released under the mit license": ("mit-notice", ("mit",)),
    "licensed under the gnu general public license": ("gpl-notice", ("gnu", "general")),
    "this is free and unencumbered software released into the public domain": ("public-domain-notice", ()),
    "all rights reserved": ("rights-reserved", ("rights",)),
}
# Families: the sentence that the general licences share goes on with their names, and terms of the same licence stand before or after its version.
for _name, _words in {"gpl": ("general",), "agpl": ("affero", "general"), "lgpl": ("lesser", "general")}.items():
    NOTICES[f"this program is free software you can redistribute it and or modify it under the terms of the gnu {' '.join(_words)} public license"] = (f"{_name}-notice", ("software", "gnu", *_words))
for _version in (("4", "0"), ("3", "0")):
    NOTICES[f"licensed under cc by {' '.join(_version)}"] = ("cc-by-notice", ("cc", "by", *_version))
    for _words in (("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd")):
        for _places in ((*_words, *_version), (*_version, *_words)):
            NOTICES[f"licensed under cc by {' '.join(_places)}"] = (f"cc-by-{'-'.join(_words)}-notice", ("cc", "by", *_version, *_words))
#: Most notices of a catalogue that is read from a table: it is held by each Python worker.
MOST_NOTICES = 10_000
#: Errors allowed for each so many characters of a notice.
CHARS_PER_ERROR = 12
#: Bytes to one: letters A-Z lowered, digits, lower-case letters and all beyond ASCII kept, the rest blank.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def catalogue(rows: DataFrame, most: int = MOST_NOTICES) -> dict[str, tuple]:
    """A catalogue like NOTICES from rows(notice string, label string, exact array<string>).

    Notices and exact words are folded as texts are. A notice that has no words, or no label, is left out; of one that is there more than once the least
    label stays; exact words that are null are none. More than `most` rows are refused."""
    got = rows.select("notice", "label", "exact").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a catalogue may have {most} notices")
    words = lambda x: (x or "").encode().translate(FOLD).decode().split()
    kept = sorted((" ".join(words(r.notice)), r.label, tuple(w for x in r.exact or () for w in words(x))) for r in got if words(r.notice) and r.label)
    return {notice: (label, exact) for notice, label, exact in reversed(kept)}


class Scanner:
    """The automaton of the pieces and the bounded-error patterns; made once in each Python worker."""

    def __init__(self, notices: dict[str, tuple] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> None:
        self.notices, self.seeds, at = list(notices.items()), ahocorasick.Automaton(), {}
        self.patterns, self.errors = [], []
        for i, (notice, _) in enumerate(self.notices):
            k = len(notice) // chars_per_error
            self.errors.append(k)
            self.patterns.append(regex.compile(f"(?e)(?<!\\S)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?!\\S)"))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                at.setdefault(notice[a:b], []).append((i, a))
        for piece, where in at.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the merged stretches of text in which it may stand."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for i, offset in where:
                start, k, n = end - size + 1 - offset, self.errors[i], len(self.notices[i][0])
                lo, hi = max(0, start - k - 1), min(len(text), start + n + k + 1)
                spans = found.setdefault(i, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        return found

    def matches(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, errors) of each notice found in normalised text; spans of one notice don't overlap."""
        out = set()
        for i, spans in self.windows(text).items():
            _, (label, exact) = self.notices[i]
            for lo, hi in spans:
                # A match has the exact words whole, so a stretch without them has no match.
                near = f" {text[lo:hi]} "
                if not all(f" {w} " in near for w in exact):
                    continue
                for m in self.patterns[i].finditer(text, lo, hi):
                    found = m.group().split(" ")
                    if all(w in found for w in exact):
                        out.add((m.start(), m.end(), label, sum(m.fuzzy_counts), frozenset(exact)))
        # Where matches overlap, one whose exact words are a part of the other's is that other notice with errors.
        return sorted({x[:4] for x in out if not any(x[4] and x[4] < y[4] and x[0] < y[1] and y[0] < x[1] for y in out)})


@functools.lru_cache(8)
def scanner(notices: tuple = tuple(NOTICES.items()), chars_per_error: int = CHARS_PER_ERROR) -> Scanner:
    """The scanner of a catalogue, made once in each Python worker."""
    return Scanner(dict(notices), chars_per_error)


def scan(text: bytes, notices: tuple = tuple(NOTICES.items()), chars_per_error: int = CHARS_PER_ERROR) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, notices found (as matches()), of a text in UTF-8."""
    w = text.translate(FOLD).split()
    joined = b" %b " % b" ".join(w)
    n_base, starts, labels = 0, [], set()
    if b"licen" in joined:
        for phrase, label in PHRASES.items():
            at = [m.start() for m in re.finditer(b"(?= %b )" % phrase.encode(), joined)]
            if at:
                n_base += len(at)
                starts += [at[0], at[-1]]
                labels.add(label)
    found = scanner(notices, chars_per_error).matches(joined[1:-1].decode("utf-8", "replace"))
    word = lambda a: joined.count(b" ", 0, a)
    return len(w), n_base, word(min(starts)) if starts else None, word(max(starts)) if starts else None, labels, found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, tuple] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """One row a document; spans are of code points in the text's words joined by one space. notices: a catalogue like NOTICES."""
    listed = tuple((n, (label, tuple(exact))) for n, (label, exact) in notices.items())

    def batch(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for x in b.column(1):
            n, n_base, first, last, base, found = scan(x.as_py() or b"", listed, chars_per_error)
            close = max((1 - e / (z - a) for a, z, _, e in found), default=0.0)
            for k, v in zip(out, (n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | {f[2] for f in found})), 1.0 if base else max(0.0, min(1.0, close)), [dict(zip(("start", "end", "label", "errors"), f)) for f in found])):
                out[k].append(v)
        return {"doc_id": b.column(0)} | out

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,errors:long>>"
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw")), batch, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
