"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering.

The 64 bits form a ring of d + 1 segments. If two fingerprints differ in at most d bits, then from some segment on
every chain of l consecutive segments holds at most floor(l d / (d + 1)) of the differences: 0, 1, 2, and so on. So an
index key is a chain of two segments with its whole budget built in: the first segment exact, the second with one bit
wiped out (64 keys a fingerprint, whatever d is). Pairs that meet under a key are pruned by the chain of three, then
checked in full. Only distinct fingerprints take part, and a dense bucket gives a spanning forest of its
links rather than all pairs. A bucket above BLOCK fingerprints is dealt out as pairs of blocks. Joins are merge joins by hint: tables just
below the size that Spark broadcasts are built whole on the driver, and there are dozens of joins in a run.

near_duplicates() links by fingerprints alone. near_copies() takes the links of fingerprints of wider shingles as candidates, adds
those of an exact search, and holds texts against those that lead their component by their sets of shingles, so that only
true copies are one and all of them are found. The exact search is a prefix filter: in any one order of all shingles, two sets
of similarity s share a shingle among the first n - ceil(s n) + 1 of each. Its order puts shingles that are frequent in a sample
last, which only saves time. Sets that meet are linked unless the parities of their hashes prove them unlike.

Defined cases: null text is empty; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle are one shingle; very long texts are hashed whole, in pieces of bounded size; ties between copies go to the
least id, nulls last, then to the least hash; a group whose ids are all null has a null component; repeated rows are
in one group; an empty table gives no rows. near_duplicates() reads the id and the text columns only; near_copies() carries
all columns, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_schema, fresh, grouped, map_arrow, remove, runs, sieve, stored, table
from .graph import components
from .passages import _mix

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: For near_copies: words of a shingle, least similarity, and the fingerprints and their distance that give candidates.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
COPY_PRINTS, COPY_DISTANCE = 1, 3
#: The order of shingles: one of so many documents is sampled, shingles that so many of those hold are frequent, and at most so many are told to all tasks.
ORDER_SAMPLE, ORDER_LEAST, ORDER_MOST = 16, 4, 1 << 20
#: Sets under a shingle that one task compares at most, against as many others.
SET_BLOCK = 1 << 11
#: Texts of a component in which one task finds leaders at once. Spark cuts ranks of up to 1000 before it shuffles.
GROUP = 1000
#: Distinct fingerprints of a bucket that one task compares at most, against as many others.
BLOCK = 1 << 15
#: Buckets up to this size are compared together; in a larger one, links are a forest if there are more than this a member.
SMALL, DENSE = 16, 8
CHUNK = 1 << 16


def chains(distance: int) -> np.ndarray:
    """For each starting segment, the bits of the chain of three."""
    width = 64 // (distance + 1)
    ones = (1 << 3 * width) - 1
    return np.array([((ones << i) | (ones >> (64 - i))) & ((1 << 64) - 1) for i in range(0, 64, width)], np.uint64)


def shingle_hashes(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    w = raw.lower().split()
    if len(w) < size:
        return np.array([xxh64_intdigest(b" ".join(w), SEED)] if w else [], "<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(w) - size + 1)


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    if not len(h):
        return 0
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        set_ += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer: bits set in over half the shingles' hashes."""
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def batch(b: pa.RecordBatch) -> dict:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        return {"doc_id": b.column(0), "fp": pa.array(fp.view(np.int64))}

    kind = docs.select(id_col).dtypes[0][1]
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), batch, f"doc_id {kind}, fp long")


def index_keys(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(k, fp): the 64 chain keys of each (r, fp); bits 32 to 37 of a key say the segment and the bit wiped out, those above it r."""
    width = 64 // (distance + 1)
    each = fps.select("r", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("e"))
    turned = each.select("r", "fp", "e", F.expr(f"shiftrightunsigned(fp, {width} * int(e div {width})) | shiftleft(fp, 64 - {width} * int(e div {width}))").alias("turned"))
    return turned.select(F.expr(f"shiftleft(64L * r + e, 32) | (turned & {(1 << 2 * width) - 1}L & ~shiftleft(1L, {width} + int(e % {width})))").alias("k"), "fp")


def _pairs(f: np.ndarray, a: np.ndarray, b: np.ndarray, chain: np.ndarray | np.uint64, distance: int) -> np.ndarray:
    """Which of the pairs f[a], f[b] pass the chain of three and then the whole ring."""
    x = f[a] ^ f[b]
    ok = np.bitwise_count(x & chain) <= 2
    ok[ok] = np.bitwise_count(x[ok]) <= distance
    return ok


def forest(f: np.ndarray, chain: np.uint64, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is linked among f: a search from each unseen place, over the places not yet reached."""
    left, queue, src, dst = np.arange(1, len(f)), [0], [], []
    while True:
        if queue:
            at = queue.pop()
        elif len(left):
            at, left = left[0], left[1:]
        else:
            return src, dst
        if len(left):
            ok = _pairs(f, np.full(len(left), at), left, chain, distance)
            if ok.any():
                hit, left = left[ok], left[~ok]
                queue.extend(hit.tolist())
                src.append(np.full(len(hit), at))
                dst.append(hit)


def bucket_links(f: np.ndarray, chain: np.uint64, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All links among f while they are few, otherwise a forest of them."""
    rows, src, dst, n = max(1, (1 << 20) // len(f)), [], [], 0
    for i in range(0, len(f), rows):
        a, b = np.nonzero(np.bitwise_count((f[i : i + rows, None] ^ f[None, i:]) & chain) <= 2)
        a, b = a[a < b] + i, b[a < b] + i
        ok = np.bitwise_count(f[a] ^ f[b]) <= distance
        src.append(a[ok])
        dst.append(b[ok])
        n += len(src[-1])
        if n > DENSE * len(f):
            return forest(f, chain, distance)
    return src, dst


def _links(distance: int) -> Callable:
    """Links of each bucket; rows (k, lo, hi, fp) come sorted."""
    chain, width = chains(distance), 64 // (distance + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            k, lo, hi, f = (t.column(i).to_numpy() for i in range(4))
            f, at, r = f.view(np.uint64), (k >> 32 & 63) // width, k >> 38
            ends = runs([k, lo, hi])
            size = np.diff(ends)
            end = np.repeat(np.where(size <= SMALL, ends[1:], 0), size)  # of a row's bucket, if it is small
            src, dst = [], []
            for gap in range(1, min(SMALL, int(size.max()))):
                a = np.flatnonzero(np.arange(gap, len(f) + gap) < end)
                a = a[_pairs(f, a, a + gap, chain[at[a]], distance)]
                src.append(a)
                dst.append(a + gap)
            for s, n in zip(ends[:-1][size > SMALL], size[size > SMALL]):
                a, b = bucket_links(f[s : s + n], chain[at[s]], distance)
                src += [x + s for x in a]
                dst += [x + s for x in b]
            if sum(map(len, src)):
                a, b = np.concatenate(src), np.concatenate(dst)
                yield pa.RecordBatch.from_arrays([pa.array(r[a], pa.int32()), pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["r", "a", "b"])

    return run


def links(fps: DataFrame, block: int = BLOCK, distance: int = DISTANCE) -> DataFrame:
    """(r, a, b): links within the distance that join exactly what all such links join; fps holds distinct (r, fp), r a small
    number that says which fingerprint of a document it is."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = index_keys(fps.repartition(n, "fp"), distance)  # each row becomes 64, so rows are dealt out evenly before
    often = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("k", "k2")
    met = keys.join(often.hint("merge"), F.col("k") == F.col("k2")).select("k", "fp", F.ceil(F.col("n") / block).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    return dealt.repartition(n, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "fp").mapInArrow(_links(distance), "r int, a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row a document, with the least id that is reachable from it."""
    spark = docs.sparkSession
    prints, _ = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    distinct, distinct_path = stored(distinct, "distinct_fingerprints")
    found = components(links(distinct.select(F.lit(0).alias("r"), "fp")).select("a", "b"))
    rooted = distinct.join(found.withColumnRenamed("node", "fp2").hint("merge"), F.col("fp") == F.col("fp2"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted, _ = stored(rooted, "rooted")
    remove(spark, distinct_path)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "root2")
    of = rooted.join(named.hint("merge"), F.col("root") == F.col("root2")).select(F.col("fp").alias("fp2"), "component_id")
    return prints.join(of.hint("merge"), F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def frequent_shingles(source: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are frequent in a sample of the rows (q, raw), and how often they are there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), size)).view(np.int64))], ["h"])

    sample = source.where(F.pmod(F.xxhash64("q"), F.lit(ORDER_SAMPLE)) == 0).select("raw").mapInArrow(run, "h long")
    often = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_LEAST)
    found = often.orderBy(F.col("n").desc(), "h").limit(ORDER_MOST).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set's sorted hashes, rare ones before frequent ones: any two sets of that similarity share one of theirs."""
    n = len(h) - max(int(np.ceil(similarity * len(h) - 1e-6)), 1) + 1 if len(h) else 0
    if not len(frequent[0]) or not n:
        return h[:n]
    at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
    return h[np.lexsort((h, np.where(frequent[0][at] == h, frequent[1][at], 0)))[:n]]


def parities(h: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of 64 or more slots, at least as many as there are hashes, a power of two."""
    slots = 1 << max(6, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_alike(a: tuple[int, int, int], b: tuple[int, int, int], similarity: float) -> bool:
    """False only for sets (size, slots, parities) less similar than that: at least as many shingles differ as parities do."""
    (n, slots, x), (m, others, y) = (a, b) if a[1] <= b[1] else (b, a)
    if min(n, m) < similarity * max(n, m) - 1e-6:
        return False
    while others > slots:
        others >>= 1
        y = (y >> others) ^ (y & ((1 << others) - 1))
    return (x ^ y).bit_count() <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def _copy_prints(prints: int, size: int, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> Callable:
    """The number of a text's distinct shingles, fingerprints of their set, each from hashes of its own, its prefix and parities."""

    def batch(b: pa.RecordBatch) -> dict:
        n, fps, first, bits, seen = [], [], [], [], set()
        for t, its in zip(b.column(3), b.column(2).to_pylist()):
            h = np.unique(shingle_hashes(t.as_py(), size))
            n.append(len(h))
            fps.append(np.array([majority(h if not r else _mix(h + np.uint64(r))) for r in range(prints)], np.uint64).view(np.int64))
            # Of equal texts side by side, one is searched for.
            first.append((h[:0] if its in seen else prefix(h, frequent, similarity)).view(np.int64))
            seen.add(its)
            bits.append(parities(h))
        lists = pa.list_(pa.int64())
        return {"doc_id": b.column(0), "q": b.column(1), "t": b.column(2), "n": n, "fps": pa.array(fps, lists), "first": pa.array(first, lists), "bits": bits}

    return batch


def _repeated(block: int) -> Callable:
    """Rows (k, node) whose k has more than one node, with the number of their block of the group; rows come sorted by both.

    A group of more blocks than one is ended by a row without a node that tells their number. Groups aren't held in memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k0, node0, n0, waiting = None, None, 0, False  # the last row, its number in its group, and whether it may be the only one
        for b in batches:
            k, node = (b.column(i).to_numpy() for i in range(2))
            if not len(k):
                continue
            new = np.append(k0 is None or k[0] != k0 or node[0] != node0, (k[1:] != k[:-1]) | (node[1:] != node[:-1]))
            k, node = k[new], node[new]
            if not len(k):
                continue
            ends = runs([k])
            size, first = np.diff(ends), int(k0 is not None and k[0] == k0) and n0
            at = np.arange(len(k)) - np.repeat(ends[:-1], size)
            at[: size[0]] += first
            alone = np.repeat(np.append(size[0] + first, size[1:]) == 1, size)
            out_k, out_node, out_own = [k[~alone]], [node[~alone]], [at[~alone] // block]
            if waiting and first:
                out_k.append(np.array([k0]))
                out_node.append(np.array([node0]))
                out_own.append(np.zeros(1, np.int64))
            total = np.append(size[0] + first, size[1:])
            closed_k, closed_n = k[ends[:-1]][:-1], total[:-1]
            if k0 is not None and not first:
                closed_k, closed_n = np.append(closed_k, k0), np.append(closed_n, n0)
            large = closed_n > block
            k0, node0, n0, waiting = k[-1], node[-1], int(total[-1]), bool(alone[-1])
            yield from rows(np.concatenate(out_k), np.concatenate(out_node), np.concatenate(out_own))
            yield from rows(closed_k[large], None, -(-closed_n[large] // block))
        if n0 > block:
            yield from rows(np.array([k0]), None, np.array([-(-n0 // block)]))

    def rows(k: np.ndarray, node: np.ndarray | None, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.nulls(len(k), pa.int64()) if node is None else pa.array(node, pa.int64()), pa.array(own, pa.int32())], ["k", "node", "own"])

    return run


def _set_links(similarity: float) -> Callable:
    """Links that join all sets that may be alike in each bucket: a search as in forest(); rows (k, lo, hi, node, n, bits) come sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            ends = runs([t.column(i).to_numpy() for i in range(3)])
            node = t.column(3).to_numpy()
            sets = [(n, 8 * len(x), int.from_bytes(x, "little")) for n, x in zip(t.column(4).to_pylist(), t.column(5).to_pylist())]
            src, dst = [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                left = list(range(s, e))
                while left:
                    queue = [left.pop(0)]
                    while queue and left:
                        at, rest = queue.pop(), []
                        for x in left:
                            if may_be_alike(sets[at], sets[x], similarity):
                                queue.append(x)
                                src.append(at)
                                dst.append(x)
                            else:
                                rest.append(x)
                        left = rest
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(node[src]), pa.array(node[dst])], ["a", "b"])

    return run


def set_links(sets: DataFrame, similarity: float = COPY_SIMILARITY, block: int = SET_BLOCK) -> DataFrame:
    """(a, b): links that join at least all nodes whose sets have that similarity; sets holds (node, n, first, bits), where rows of
    one node agree but for empty firsts."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = sets.select(F.explode("first").alias("k"), "node").repartition(n, "k").sortWithinPartitions("k", "node")
    met, _ = stored(keys.mapInArrow(_repeated(block), "k long, node long, own int"), "copy_prefixes")
    large = met.where("node IS NULL").select(F.col("k").alias("k_"), F.col("own").alias("s"))
    dealt = met.where("node IS NOT NULL").join(large.hint("merge"), F.col("k") == F.col("k_"), "left").select("k", "node", "own", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1)).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("node").alias("node_"))
    sets = sets.select("node", "n", "bits").dropDuplicates(["node"])
    whole = dealt.join(sets.select("node", "n", "bits").hint("merge"), F.col("node_") == F.col("node")).select("k", "lo", "hi", "node", "n", "bits")
    return whole.repartition(n, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "node").mapInArrow(_set_links(similarity), "a long, b long").distinct()


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class Led:
    """Sets that lead, with their prefixes indexed: a set is held only against those that it shares a hash of its prefix with."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.sets, self.at = similarity, [], {}

    def _first(self, h: np.ndarray) -> list[int]:
        # Any one order of hashes does; -1 stands for the empty set, which is like itself only.
        return h[: len(h) - max(int(np.ceil(self.similarity * len(h) - 1e-6)), 1) + 1].tolist() or [-1]

    def has_like(self, h: np.ndarray) -> bool:
        seen = set()
        for x in self._first(h):
            for k in self.at.get(x, ()):
                if k not in seen:
                    seen.add(k)
                    if _alike(h, self.sets[k], self.similarity):
                        return True
        return False

    def add(self, h: np.ndarray) -> None:
        for x in self._first(h):
            self.at.setdefault(x, []).append(len(self.sets))
        self.sets.append(h)


def _leaders(size: int, similarity: float, schema: pa.Schema) -> Callable:
    """Rows (root, o, t, raw) that are unlike all leaders before them in their component; rows come sorted by the first three."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, led = None, Led(similarity)
        for b in batches:
            stays = np.zeros(b.num_rows, bool)
            for i, (root, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(3))):
                if root != now:
                    now, led = root, Led(similarity)
                h = np.unique(shingle_hashes(raw.as_py(), size))
                if not led.has_like(h):
                    led.add(h)
                    stays[i] = True
            if stays.any():
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(stays)) for i in range(4)], schema=schema)

    return run


def _unlike(size: int, similarity: float, schema: pa.Schema) -> Callable:
    """Rows (root, part, leads, o, t, raw) that don't lead and are unlike all leaders of their part; rows come sorted, leaders first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, led = None, Led(similarity)
        for b in batches:
            stays = np.zeros(b.num_rows, bool)
            for i, (root, part, follows, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), b.column(5))):
                if (root, part) != now:
                    now, led = (root, part), Led(similarity)
                h = np.unique(shingle_hashes(raw.as_py(), size))
                if follows:
                    stays[i] = not led.has_like(h)
                else:
                    led.add(h)
            if stays.any():
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(stays)) for i in (0, 3, 4, 5)], schema=schema)

    return run


def leaders(pool: DataFrame, size: int, similarity: float, block: int = GROUP) -> DataFrame:
    """(q_, t_) of the rows of pool(root, o, t, raw) that lead: in the order (o, t), those unlike all leaders before them in their component.

    Each round takes the first rows of every component, as many as a block, and finds their leaders in one task; what comes after them and
    is like a new leader goes, in parts of the component that each see these leaders only. What is left is the next round's. So the result is
    the rule's, whatever the block; no task holds more than a block's leaders, and rounds are as many as blocks of texts that are alike to
    none before them."""
    spark = pool.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = f"root long, o {dict(pool.dtypes)['o']}, t long, raw binary"
    find, hold, done, old = _leaders(size, similarity, arrow_schema(ddl)), _unlike(size, similarity, arrow_schema(ddl)), [], None
    order = Window.partitionBy("root").orderBy("o", "t")
    while True:
        # A task sends no more than a block of rows of any component.
        first = pool.select("root", "o", "t").withColumn("n", F.row_number().over(order)).where(F.col("n") <= block)
        cuts, cuts_path = stored(first.where(F.col("n") == block).select(F.col("root").alias("root_"), F.struct("o", "t").alias("cut")), "copy_cuts")
        more = not cuts.isEmpty()
        cut = pool.join(cuts.hint("merge"), F.col("root") == F.col("root_"), "left") if more else pool.withColumn("cut", F.lit(None))
        within = F.lit(True) if not more else F.coalesce(F.struct("o", "t") <= F.col("cut"), F.lit(True))
        now = cut.where(within).select("root", "o", "t", "raw")
        led, _ = stored(now.repartition(n, "root").sortWithinPartitions("root", "o", "t").mapInArrow(find, ddl), "copy_leaders")
        done.append(led.select(F.col("o.q").alias("q_"), F.col("t").alias("t_")))
        rest = None
        if more:
            sizes, sizes_path = stored(cut.where(~within).groupBy(F.col("root").alias("root_")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "copy_sizes")
            at_root = F.col("root") == F.col("root_")
            part = F.pmod(F.xxhash64("o", "t"), F.col("parts")).cast("int")
            after = cut.where(~within).drop("root_").join(sizes.hint("merge"), at_root).select("root", part.alias("part"), F.lit(True).alias("follows"), "o", "t", "raw")
            before = led.join(sizes.hint("merge"), at_root).select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("follows"), "o", "t", "raw")
            dealt = after.unionByName(before).repartition(n, "root", "part").sortWithinPartitions("root", "part", "follows", "o", "t")
            rest, path = stored(dealt.mapInArrow(hold, ddl), "copy_rest")
            remove(spark, sizes_path)
        remove(spark, cuts_path)
        if old:
            remove(spark, old)
        if rest is None or rest.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        pool, old = rest, path


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY, prints: int = COPY_PRINTS, distance: int = COPY_DISTANCE, block: int = GROUP) -> DataFrame:
    """docs with one document of each group of copies.

    Texts linked by their fingerprints or by the exact search make a component; texts of that similarity are always in one. In it, by id
    (nulls last), a document goes if its set of shingles has at least that similarity to that of one before it that leads. So no two that
    stay are like each other, each that goes is like one that stays, and a document that is only linked to unlike ones isn't left out."""
    spark = docs.sparkSession
    paths = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    q, t = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.col(text_col))
    kind = docs.select(id_col).dtypes[0][1]
    source = docs.select(F.col(id_col).alias("doc_id"), q.alias("q"), t.alias("t"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    marked = _copy_prints(prints, size, frequent_shingles(source, size), similarity)
    found = kept(map_arrow(source, marked, f"doc_id {kind}, q long, t long, n long, fps array<long>, first array<long>, bits binary"), "copy_prints")

    # Of equal texts, only the first takes part. o: the order of documents.
    o = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "q")
    texts = kept(found.groupBy("n", "t", "fps").agg(F.min(o).alias("o")).withColumn("node", F.xxhash64("t", "fps")), "copy_texts")
    each = texts.select("node", F.posexplode("fps").alias("r", "fp"))
    by_print = kept(each.groupBy("r", "fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")), "by_print")
    met = kept(links(by_print.select("r", "fp"), BLOCK, distance), "copy_links")

    def rep(c: str) -> DataFrame:
        return by_print.select(F.col("r").alias(f"r_{c}"), F.col("fp").alias(f"fp_{c}"), F.col("rep").alias(f"rep_{c}"))

    near = met.join(rep("a").hint("merge"), (F.col("r") == F.col("r_a")) & (F.col("a") == F.col("fp_a"))).join(rep("b").hint("merge"), (F.col("r") == F.col("r_b")) & (F.col("b") == F.col("fp_b")))
    shared = kept(by_print.where("n > 1").select(F.col("r").alias("r_"), F.col("fp").alias("fp_"), "rep"), "shared_prints")
    same = each.join(shared.hint("merge"), (F.col("r") == F.col("r_")) & (F.col("fp") == F.col("fp_"))).where("node <> rep")
    by_print_links = near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(same.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    sets = found.select(F.xxhash64("t", "fps").alias("node"), "n", "first", "bits")
    of = components(by_print_links.unionByName(set_links(sets, similarity)))

    members = kept(texts.join(of.withColumnRenamed("node", "node_").hint("merge"), F.col("node") == F.col("node_")).select("root", "o", F.col("t").alias("t_")), "copy_members")
    may_be = sieve(members.select(F.col("o.q").alias("h")))
    pool = source.where(may_be(F.col("q"))).join(members.hint("merge"), (F.col("q") == F.col("o.q")) & (F.col("t") == F.col("t_"))).select("root", "o", "t", "raw")
    led = leaders(kept(pool, "copy_pool"), size, similarity, block)

    # Documents that go, or that have repeated rows.
    gone = members.select(F.col("o.q").alias("q_"), "t_").join(led.hint("merge"), ["q_", "t_"], "left_anti")
    staying = texts.select(F.col("o.q").alias("q_"), F.col("t").alias("t_"), F.lit(True).alias("first")).join(gone.hint("merge"), ["q_", "t_"], "left_anti")
    counted = found.groupBy("q", "t").agg(F.count(F.lit(1)).alias("c"))
    marks = counted.join(staying.hint("merge"), (F.col("q") == F.col("q_")) & (F.col("t") == F.col("t_")), "left").where("first IS NULL OR c > 1")
    marks, _ = stored(marks.select(F.col("q").alias("q_"), F.col("t").alias("t_"), F.col("first").isNotNull().alias("stays")), "copy_marks")
    for path in paths:
        remove(spark, path)
    q_, t_, s_ = (fresh(docs, c) for c in ("mark_q", "mark_t", "mark_no"))
    marks = marks.select(F.col("q_").alias(q_), F.col("t_").alias(t_), "stays")
    here = (q == F.col(q_)) & (t == F.col(t_))
    once = docs.join(marks.hint("merge"), here, "left_anti")
    repeated = marks.where("stays").drop("stays")
    if repeated.isEmpty():
        return once
    again = docs.join(repeated.hint("merge"), here).withColumn(s_, F.row_number().over(Window.partitionBy(q_, t_).orderBy(q_))).where(F.col(s_) == 1)
    return once.unionByName(again.select(*docs.columns))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
