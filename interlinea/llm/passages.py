"""Repeated passages of a corpus: the common ground of the suffix-tree and the suffix-array operators.

A window is a run of `length` consecutive words of a document. Its anchor is the leftmost of its `gram`-word
grams with the least hash, so equal windows have equal anchors at equal places. Consecutive windows of a document
with one anchor make a stretch; a stretch's words are its context. Hence a window can be repeated
only inside the stretches of one anchor, and:

1. Stretches whose anchor occurs once are dropped; of those whose anchor always has the same context, every window is
   repeated. Both follow from partial counts by anchor; no text is moved for them.
2. Contexts of the other anchors are taken once each, with the number of their places and the first of them. Their words
   are fetched, and a decider (a suffix tree or a suffix array) tells for each of a context's windows what it needs.
   The contexts of an anchor that has more than BLOCK are split: each of their windows is a context of its own and goes to the
   group of its first words, of a fifth, then of a half of its words, whatever first gives a group within the bound. What agrees
   in half a window more often than that is keyed by the whole window, where all of a group are equal and are summed before the shuffle.
3. Verdicts go back to the places by anchor and context, are gathered by document and applied to its words.

Only numbers are shuffled in steps 1 and 3, about one row for each seven to ten words; texts are shuffled once for step 2 and
once for step 3. Documents are known by their id and a hash of their text, so ids may repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_schema, grouped, remove, runs, stored

#: Contexts of an anchor, or windows with the same first words, that one task compares at most: some 30 MB of words.
BLOCK = 1 << 14
#: Contexts, or those of one anchor if they are more, whose words a worker has in memory at once.
PART = 1 << 11
#: Words whose hashes a worker remembers.
MAX_WORDS = 1 << 17
#: Windows whose anchors are found at once.
CHUNK = 1 << 14
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxh64_intdigest(word, 7)
        return h


_hashes = _Hashes()
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _stretch_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo to hi - 1, wherever they stand."""
    n = len(h) + 1
    if not _powers or len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
    up, down = _powers
    total = np.zeros(n, np.uint64)
    np.cumsum(h * up[: n - 1], out=total[1:])
    return _mix((total[hi] - total[lo]) * down[lo])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def stretches(words: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, context (hashes), lo (first window), n (windows), o (the anchor's place from lo) of a document's stretches."""
    n = len(words) - length + 1
    h = word_hashes(words)
    g = h[: len(words) - gram + 1].copy()
    for j in range(1, gram):
        g = g * np.uint64(_BASE) + h[j : j + len(g)]
    g = _mix(g)
    wide = length - gram + 1
    at = np.empty(n, np.int64)
    for s in range(0, n, CHUNK):
        e = min(n, s + CHUNK)
        at[s:e] = np.lib.stride_tricks.sliding_window_view(g[s : e + wide - 1], wide).argmin(axis=1) + np.arange(s, e)
    lo = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    hi = np.append(lo[1:], n)
    o, count = at[lo] - lo, hi - lo
    context = _mix(_stretch_hash(h, lo, hi + length - 1) + (o * 1024 + count).astype(np.uint64) * np.uint64(_BASE))
    return g[at[lo]].view(np.int64), context.view(np.int64), lo, count, o


def _places(length: int, gram: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, sizes = [], []
            for x in b.column(2):
                w = (x.as_py() or b"").split()
                parts.append(stretches(w, length, gram) if len(w) >= length else None)
                sizes.append(len(parts[-1][0]) if parts[-1] else 0)
            if not any(sizes):
                continue
            rows = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            cols = [np.concatenate([p[i] for p in parts if p]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), b.column(0).take(rows), b.column(1).take(rows), *(pa.array(c, pa.int32()) for c in cols[2:])], schema=schema)
        _hashes.clear()  # the worker lives on

    return run


def _fetch(schema: pa.Schema, length: int) -> Callable:
    """Words of the contexts of a document: (doc_id, t, raw, list of (anchor, context, places, n_contexts, lo, n, o)) to one row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(3)
            flat = wanted.flatten()
            col = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            sizes = np.diff(wanted.offsets.to_numpy())
            lo, n = col["lo"].to_numpy(), col["n"].to_numpy()
            texts, k = [], 0
            for x, size in zip(b.column(2), sizes):
                w = x.as_py().split()
                for _ in range(size):
                    texts.append(b" ".join(w[lo[k] : lo[k] + n[k] - 1 + length]))
                    k += 1
            rows = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            made = {"doc_id": b.column(0).take(rows), "t": b.column(1).take(rows), "words": pa.array(texts, pa.binary())} | {c: col[c] for c in ("anchor", "context", "places", "n_contexts", "n", "o")} | {"at": pa.array(lo + col["o"].to_numpy(), pa.int32())}
            out = pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)
            for s in range(0, out.num_rows, 1 << 14):
                yield out.slice(s, 1 << 14)

    return run


class Contexts:
    """Contexts of whole groups, in the order of group, document and place, with their words as numbers."""

    def __init__(self, t: pa.Table, length: int) -> None:
        self.length = length
        new = np.append(True, np.any([t.column(c).to_numpy()[1:] != t.column(c).to_numpy()[:-1] for c in ("anchor", "prefix")], axis=0))
        self.group = np.cumsum(new).astype(np.int32)
        self.places, self.n, self.o = (t.column(c).to_numpy().astype(np.int64) for c in ("places", "n", "o"))
        number: dict[bytes, int] = {}
        self.words = [np.array([number.setdefault(w, len(number)) for w in x.as_py().split(b" ")], np.int32) for x in t.column("words")]


def _decide(decider: Callable[[Contexts], np.ndarray], length: int, schema: pa.Schema) -> Callable:
    """The decider's verdict for rows (anchor, prefix, context, j, ...), which come sorted; j is the first window of the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            # Rows that are repeated in the input fetch a context twice, side by side; one is enough.
            again = np.all([t.column(c).to_numpy()[1:] == t.column(c).to_numpy()[:-1] for c in ("anchor", "prefix", "context", "j")], axis=0)
            if again.any():
                t = t.filter(pa.array(np.append(True, ~again)))
            ends = runs([t.column(c).to_numpy() for c in ("anchor", "prefix")])
            at = 0
            while at < len(t):  # whole groups, about PART contexts at once
                to = int(ends[max(np.searchsorted(ends, at + PART, "right") - 1, np.searchsorted(ends, at, "right"))])
                part = t.slice(at, to - at)
                mask = decider(Contexts(part, length)) << part.column("j").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("anchor").combine_chunks(), part.column("context").combine_chunks(), pa.array(mask, pa.int64())], schema=schema)
                at = to

    return run


def _windows(length: int, schema: pa.Schema) -> Callable:
    """Each window of each context as a context of its own, with hashes of its first words and of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, PART):
                b = whole.slice(s, PART)
                sizes = b.column(b.schema.get_field_index("n")).to_numpy()
                some, half, window, words = [], [], [], []
                for x, n in zip(b.column(b.schema.get_field_index("words")), sizes):
                    w = x.as_py().split(b" ")
                    h, lo = word_hashes(w), np.arange(n)
                    for out, size in ((some, length // 5), (half, length // 2), (window, length)):
                        out.append(_stretch_hash(h, lo, lo + max(1, size)))
                    words += [b" ".join(w[j : j + length]) for j in range(n)]
                rows = pa.array(np.repeat(np.arange(b.num_rows), sizes))
                made = {c: b.column(b.schema.get_field_index(c)).take(rows) for c in ("anchor", "context", "places", "doc_id", "t", "at")}
                j = np.concatenate([np.arange(n) for n in sizes])
                made |= {"j": pa.array(j, pa.int32()), "n": pa.array(np.ones(len(j)), pa.int32()), "o": pa.array(made_o(b, rows, j), pa.int32()), "words": pa.array(words, pa.binary())}
                made |= {c: pa.array(np.concatenate(x).view(np.int64)) for c, x in (("some", some), ("half", half), ("window", window))}
                yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)
        _hashes.clear()

    def made_o(b: pa.RecordBatch, rows: pa.Array, j: np.ndarray) -> np.ndarray:
        return b.column(b.schema.get_field_index("o")).take(rows).to_numpy().astype(np.int64) - j

    return run


def _hot(df: DataFrame, by: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose (anchor, by) has no more than block rows, and the others."""
    n = df.groupBy(F.col("anchor").alias("a_"), F.col(by).alias("b_")).agg(F.count(F.lit(1)).alias("c_")).where(F.col("c_") > block)
    n, _ = stored(n, "hot_prefixes")
    here = (F.col("anchor") == F.col("a_")) & (F.col(by) == F.col("b_"))
    return df.join(n, here, "left_anti"), df.join(n, here, "left_semi")


def _split(large: DataFrame, length: int, kind: str, block: int, decide: Callable[[DataFrame], DataFrame], keep_first: bool) -> DataFrame:
    """(anchor, context, mask) for the contexts of anchors that have too many to be compared at once."""
    ddl = f"anchor long, context long, places long, doc_id {kind}, t long, at int, j int, n int, o int, words binary, some long, half long, window long"
    each, _ = stored(large.mapInArrow(_windows(length, arrow_schema(ddl)), ddl), "windows")
    few, more = _hot(each, "some", block)
    less, most = _hot(more, "half", block)
    decided = decide(few.withColumn("prefix", F.col("some"))).unionByName(decide(less.withColumn("prefix", F.col("half"))))
    sums = most.groupBy(F.col("anchor").alias("anchor_"), F.col("window").alias("window_")).agg(F.sum("places").alias("total"), F.min(F.struct("doc_id", "t", "at")).alias("least"))
    sums, _ = stored(sums, "window_sums")
    back = most.join(sums, (F.col("anchor") == F.col("anchor_")) & (F.col("window") == F.col("window_")))
    is_first = F.struct("doc_id", "t", "at").eqNullSafe(F.col("least"))
    hit = ~is_first if keep_first else F.col("total") > 1
    return decided.unionByName(back.select("anchor", "context", F.when(hit, F.expr("shiftleft(1L, j)")).otherwise(F.lit(0).cast("long")).alias("mask")))


def marks(docs: DataFrame, length: int, gram: int, decider: Callable[[Contexts], np.ndarray], keep_first: bool, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, t, m): for each document with repeated windows the array of (lo, mask); bit j stands for window lo + j.

    keep_first: the first place of a window, by (id, text hash, place), isn't marked; otherwise all places are."""
    spark = docs.sparkSession
    kind = docs.select(id_col).dtypes[0][1]
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("binary").alias("raw"))
    ddl = f"anchor long, context long, doc_id {kind}, t long, lo int, n int, o int"
    places, places_path = stored(source.mapInArrow(_places(length, gram, arrow_schema(ddl)), ddl), "places")

    first = F.min(F.struct("doc_id", "t", F.expr("lo + o").alias("at"))).alias("first")
    by_anchor = places.groupBy(F.col("anchor").alias("anchor_")).agg(F.count(F.lit(1)).alias("all_places"), F.min("context").alias("c0"), F.max("context").alias("c1"), first).where("all_places > 1")
    # A table of its own, so that the join has an exchange on either side and a frequent anchor's places can be split.
    by_anchor, anchors_path = stored(by_anchor, "anchors")
    live = places.join(by_anchor, F.col("anchor") == F.col("anchor_"))
    live = live.select("anchor", "context", "doc_id", "t", "lo", "n", "o", (F.col("c0") != F.col("c1")).alias("mixed"), F.when(F.col("c0") == F.col("c1"), F.col("first")).alias("first"))
    live, _ = stored(live, "live")
    remove(spark, places_path)
    remove(spark, anchors_path)

    mixed = live.where("mixed").groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("doc_id", "t", F.expr("lo + o").alias("at"), "lo", "n", "o")).alias("f"))
    mixed, _ = stored(mixed, "mixed")
    often = mixed.groupBy(F.col("anchor").alias("anchor_")).agg(F.count(F.lit(1)).alias("n_contexts"))
    wanted = mixed.join(often, F.col("anchor") == F.col("anchor_"))
    wanted = wanted.groupBy(F.col("f.doc_id").alias("d"), F.col("f.t").alias("t_")).agg(F.collect_list(F.struct("anchor", "context", "places", "n_contexts", "f.lo", "f.n", "f.o")).alias("wanted"))
    ddl = f"anchor long, context long, places long, n_contexts long, doc_id {kind}, t long, n int, o int, at int, words binary"
    joined = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("t_"))).select("doc_id", "t", "raw", "wanted")
    texts, texts_path = stored(joined.mapInArrow(_fetch(arrow_schema(ddl), length), ddl), "contexts")

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = "anchor long, context long, mask long"

    def decide(contexts: DataFrame) -> DataFrame:
        """contexts with a prefix and j; groups are those of (anchor, prefix)."""
        dealt = contexts.select("anchor", "prefix", "context", "j", "places", "n", "o", "words", "doc_id", "t", "at")
        return dealt.repartition(n_parts, "anchor", "prefix").sortWithinPartitions("anchor", "prefix", "doc_id", "t", "at", "context", "j").mapInArrow(_decide(decider, length, arrow_schema(ddl)), ddl)

    decided = decide(texts.where(F.col("n_contexts") <= block).withColumns({"prefix": F.lit(0).cast("long"), "j": F.lit(0)}))
    large = texts.where(F.col("n_contexts") > block)
    if not large.isEmpty():
        decided = decided.unionByName(_split(large, length, kind, block, decide, keep_first))
    verdict = decided.groupBy("anchor", "context").agg(F.bit_or("mask").alias("mask"))

    everything = F.expr("shiftleft(1L, n) - 1")
    here = F.struct("doc_id", "t", F.expr("lo + o").alias("at"))
    plain = live.where("not mixed").select("doc_id", "t", "lo", F.when(here.eqNullSafe(F.col("first")), F.lit(0).cast("long")).otherwise(everything).alias("mask") if keep_first else everything.alias("mask"))
    of = mixed.select(F.col("anchor").alias("anchor_"), F.col("context").alias("context_"), "places", F.struct("f.doc_id", "f.t", "f.at").alias("least"))
    of = of.join(verdict, (F.col("anchor_") == F.col("anchor")) & (F.col("context_") == F.col("context"))).select("anchor_", "context_", "places", "least", "mask")
    # As above: a table of its own lets the join with the places of a frequent context be split.
    of, _ = stored(of, "verdicts")
    remove(spark, texts_path)
    judged = live.where("mixed").join(of, (F.col("anchor") == F.col("anchor_")) & (F.col("context") == F.col("context_")))
    own = F.when(here.eqNullSafe(F.col("least")), F.col("mask")).otherwise(everything) if keep_first else F.when(F.col("places") > 1, everything).otherwise(F.col("mask"))
    found = plain.unionByName(judged.select("doc_id", "t", "lo", own.alias("mask"))).where("mask <> 0")
    return found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "mask")).alias("m"))


def covered(n_words: int, lo: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which words the marked windows cover."""
    bits = ((mask[:, None].astype(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    k, j = np.nonzero(bits)
    step = np.zeros(n_words + 1, np.int64)
    starts = np.unique(lo[k] + j)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def apply_marks(docs: DataFrame, found: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins the marks to the documents and maps fn over batches of (input row as struct, raw text, marks)."""
    arrow = arrow_schema(schema)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("raw"))
    joined = rows.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("t")), "left").select("row", "raw", "m")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return joined.mapInArrow(run, schema)


def removed(raw: bytes | None, m: object, length: int) -> tuple[list[bytes], np.ndarray | None]:
    """The words of a text and which of them are covered; None: none is."""
    words = (raw or b"").split()
    if m is None or not len(m):
        return words, None
    lo = np.array([x["lo"] for x in m], np.int64)
    mask = np.array([x["mask"] for x in m], np.int64)
    return words, covered(len(words), lo, mask, length)


def spans(docs: DataFrame, found: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (start, end, passage)): the repeated passages of each document, as long as they go on, by words from 0."""

    def batch(b: pa.RecordBatch) -> dict:
        out = []
        for raw, m in zip(b.column(1), b.column(2)):
            words, gone = removed(raw.as_py(), m.as_py(), length)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2) if gone is not None else []
            out.append([{"start": int(s), "end": int(e), "passage": b" ".join(words[s:e]).decode("utf-8", "replace")} for s, e in edges])
        return {"doc_id": b.column(0).field(0), "spans": out}

    kind = docs.select(id_col).dtypes[0][1]
    return apply_marks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), found, batch, f"doc_id {kind}, spans array<struct<start:long,end:long,passage:string>>")


def digest(docs: DataFrame, found: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the words that stay, joined by one space."""
    import hashlib
    from itertools import compress

    def batch(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column(0).field(0), "n_words": [], "n_removed": [], "kept_sha256": []}
        for raw, m in zip(b.column(1), b.column(2)):
            words, gone = removed(raw.as_py(), m.as_py(), length)
            n = int(gone.sum()) if gone is not None else 0
            out["n_words"].append(len(words))
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(compress(words, (~gone).tolist()) if n else words)).hexdigest())
        return out

    kind = docs.select(id_col).dtypes[0][1]
    return apply_marks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), found, batch, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
