"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into four machines:

- the normaliser: a transducer of three states (at the start, in the text, after spaces that may be the last ones) that reads
  spaces and other characters and writes U+2581 for spaces, squeezed and after a dummy prefix if the model says so;
- the pieces: a trie of characters; an arc that ends a piece may write the piece's id and go back to the start;
- byte fallback: a character that no piece is made of in, the ids of its UTF-8 bytes out;
- the pairs: an acceptor of ids whose state is the last piece. In a unigram model it has one state, and pieces weigh minus their
  score. In a BPE model pieces weigh nothing, and a pair weighs nothing if the merges leave the two pieces side by side, else infinity:
  a sequence of pieces is what the merges make of its text exactly if all its neighbours are such pairs.

They are composed with each input while the shortest path is searched for: states are (place, last piece), weights are added along
a path, of paths to a state the least counts (the tropical semiring), and states are settled by growing weight, of equal ones the furthest
first. Arcs are made when their state is settled and pairs when an arc is taken, so only what the path may need is compiled.
All weights are made positive first by the same amount for each character, which is the same for all paths.

The input is cut where no piece can reach across (before U+2581 that follows another character, between
characters that no piece has side by side, round line feeds); shortest paths of the parts join up to the shortest path of the whole,
and a part met before is taken from a cache of bounded size. A model with pieces across such places isn't cut there.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text is a space to the
model, so it decodes to one; very long texts are encoded whole, part by part, and a worker holds one text's ids at a time; ties
between paths go to the longer first piece; repeated rows are encoded one by one; an empty table gives no rows. Only the id and the
text columns are read, so others may have any names. The model's bytes are broadcast: a vocabulary, whatever the corpus. Models with
a character map or user-defined symbols are refused.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Entries of the caches of parts and of pairs in a worker, about 170 and 100 bytes each; a full cache's entries go unless used again.
MAX_PARTS, MAX_PAIRS = 3 << 17, 1 << 18
#: Characters of a part that is cached at most.
LONGEST_PART = 64
#: Ids that a worker gathers before it hands them on.
MAX_IDS = 1 << 20
#: What byte fallback weighs above the worst piece, in a unigram model.
PENALTY = 10.0
#: The last piece at the start and after byte fallback.
NONE = -1


class Recent:
    """A cache in two generations: what isn't used while a generation fills up is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = max(1, most // 2), {}, {}

    def get(self, key):
        if (value := self.new.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def __len__(self) -> int:
        return len(self.new) + len(self.old)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: numbers, and bytes, integers or four raw bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value: object = number()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = number() if n is None else n
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


class Machine:
    """The compiled transducer."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.model_type, self.dummy_prefix, self.squeeze, escape, charsmap = UNIGRAM, True, True, True, b""
        for n, v in _fields(model):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif n == 2:
                self.model_type = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                f = dict(_fields(v))
                charsmap, self.dummy_prefix, self.squeeze, escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if charsmap or not escape or self.model_type not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and BPE models with the identity character map and without user-defined symbols are compiled")
        self.scores = scores
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        # The trie: from a state by a character to the id that is written there, or NONE, and the next state.
        self.trie: dict[str, tuple[int, dict]] = {}
        for p, i in self.ids.items():
            state = self.trie
            for c in p[:-1]:
                state = state.setdefault(c, (NONE, {}))[1]
            state[p[-1]] = (i, state[p[-1]][1] if p[-1] in state else {})
        self.bytes = [0] * 256
        self.has_bytes = False
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)], self.has_bytes = i, True
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.weight, self.fallback_weight = self._weights()
        self.pairs, self.alone = Recent(MAX_PAIRS), {}
        self.parts = Recent(MAX_PARTS)
        self.cut = self._cuts()
        self.out = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds)]
        self.named = list(map(str, range(len(self.pieces))))
        self.packed = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")  # ids as they are cached and joined

    def _weights(self) -> tuple[list[float], float]:
        """Weights of pieces and of byte fallback, none below zero."""
        if self.model_type == BPE or not self.ids:
            return [0.0] * len(self.pieces), 0.0
        fallback = PENALTY - min(self.scores[i] for i in self.ids.values())
        lift = max(0.0, -fallback, *(self.scores[i] / len(p) for p, i in self.ids.items()))
        return [lift * len(p) - x for p, x in zip(self.pieces, self.scores)], fallback + lift

    def _cuts(self) -> re.Pattern | None:
        """What the parts of an input look like, from the neighbours that pieces hold: word characters are those that
        chains of neighbours join to "e"; parts end where no piece has the two neighbours. None: no cuts are safe."""
        near = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in near):
            return None
        joined: dict[str, set[str]] = {}
        for a, b in near:
            if SPACE not in (a, b):
                joined.setdefault(a, set()).add(b)
                joined.setdefault(b, set()).add(a)
        word, more = {"e"}, ["e"]
        while more:
            more = [b for a in more for b in joined.get(a, ()) if b not in word and not word.add(b)]
        w = "".join(map(re.escape, sorted(word - {"\n"})))
        line = "" if any("\n" in x for x in near) else "\n"
        return re.compile(f"{SPACE}*[{w}]+|{SPACE}*[^{w}{SPACE}{line}]+|{SPACE}+" + f"|{line}" * bool(line))

    # ------------------------------------------------------------ the machines

    def normalise(self, text: str) -> str:
        """The output of the normaliser. Spaces are one symbol and a run of other characters is read at once."""
        if not self.squeeze:  # all states but the start write alike
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""
        # (state, whether spaces are read) to (next state, output before what is read); spaces themselves write nothing.
        start, inside, gap = range(3)
        first = SPACE if self.dummy_prefix else ""
        arcs = {(start, True): (start, ""), (start, False): (inside, first), (inside, True): (gap, ""), (inside, False): (inside, ""), (gap, True): (gap, ""), (gap, False): (inside, SPACE)}
        state, out = start, []
        for run in re.findall(" +|[^ ]+", text):
            state, written = arcs[state, run[0] == " "]
            out += [written, "" if run[0] == " " else run]
        return "".join(out)

    def merged(self, chars: str) -> list[int | None]:
        """The ids that BPE merges make of a short string: the pair of the highest score first, of equals the leftmost."""
        parts = list(chars)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and self.scores[p] > best:
                    best, at = self.scores[p], i
            if at < 0:
                return [self.ids.get(p) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_weight(self, a: int, b: int) -> float:
        """What the pair machine adds for b after a."""
        if b == NONE or self.model_type == UNIGRAM:
            return 0.0
        known, key = (self.alone, b) if a == NONE else (self.pairs, a * len(self.pieces) + b)
        if (weight := known.get(key)) is None:
            before = [] if a == NONE else [a]
            weight = 0.0 if self.merged("".join(self.pieces[p] for p in [*before, b])) == [*before, b] else math.inf
            if a == NONE:
                known[key] = weight  # at most one a piece
            else:
                known.put(key, weight)
        return weight

    def arcs(self, s: str, place: int) -> list[tuple[float, int, int]]:
        """(weight, minus the end, piece) of the arcs of the pieces and of byte fallback from a place, the lightest first, then the longest."""
        state, out, end = self.trie, [], -place
        for c in s[place:] if place else s:
            if c not in state:
                break
            p, state = state[c]
            end -= 1
            if p != NONE:
                out.append((self.weight[p], end, p))
        if s[place] not in self.ids:
            out.append((self.fallback_weight, -place - 1, NONE))
        if len(out) > 1:
            out.sort()
        return out

    def shortest(self, s: str) -> list[int]:
        """Ids along the path of least weight through the composition of s with the pieces, byte fallback and the pairs."""
        if not s:
            return []
        bpe, n, pairs = self.model_type == BPE, len(s), self.pairs
        v, arcs, pair_weight = len(self.pieces), self.arcs, self.pair_weight
        fan = arcs(s, 0)
        fans = {0: fan}
        settled = [(0, NONE, -1, 0.0)]  # place, last piece, the state before, weight
        queue, seen = [(fan[0][0], fan[0][1], 0, 0)], set()
        while True:
            weight, end, at, k = queue[0]
            place, last, _, so_far = settled[at]
            fan = fans[place]
            p = fan[k][2]
            if k + 1 < len(fan):
                heapreplace(queue, (so_far + fan[k + 1][0], fan[k + 1][1], at, k + 1))
            else:
                heappop(queue)
            state = (end, p) if bpe else end
            if state in seen:  # a lighter path has been there
                continue
            # A pair weighs 0 or infinity; those met lately are looked up here.
            if (pair := pairs.new.get(last * v + p) if last != NONE else None) is None:
                pair = pair_weight(last, p)
            if pair:
                continue
            seen.add(state)
            settled.append((-end, p, at, weight))
            if -end == n:
                break
            if (fan := fans.get(-end)) is None:
                fan = fans[-end] = arcs(s, -end)
            heappush(queue, (weight + fan[0][0], fan[0][1], len(settled) - 1, 0))
        path, at = [], len(settled) - 1
        while at:
            end, p, at, _ = settled[at]
            path.append((settled[at][0], end, p))
        out: list[int] = []
        for start, end, p in reversed(path):
            if p != NONE:
                out.append(p)
            elif self.has_bytes:
                out += [self.bytes[b] for b in s[start:end].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    # ------------------------------------------------------------ whole texts

    def encode(self, text: str | None) -> np.ndarray:
        s = self.normalise(text or "")
        new, out, packed = self.parts.new, [], self.packed
        for part in self.cut.findall(s) if self.cut else [s] if s else []:
            if (ids := new.get(part)) is None:
                if (ids := self.parts.get(part)) is None:
                    ids = np.array(self.shortest(part), packed).tobytes()
                    if len(part) <= LONGEST_PART:
                        self.parts.put(part, ids)
                new = self.parts.new
            out.append(ids)
        return np.frombuffer(b"".join(out), packed)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_machines: dict[int, Machine] = {}


def machine(model: bytes) -> Machine:
    """The compiled model, once in each Python worker."""
    key = hash(model)
    if key not in _machines:
        _machines[key] = Machine(model)
    return _machines[key]


def read_model(path: str = MODEL):
    with open(path, "rb") as f:
        return f.read()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), docs.select(id_col).dtypes[0][1]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>). The model is read on the driver and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model))
    source, kind = _texts(docs, id_col, text_col)
    ddl = f"doc_id {kind}, ids array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(sent.value)
        for b in batches:
            first, n, each = 0, 0, []
            for i, t in enumerate(b.column(1), 1):
                each.append(m.encode(t.as_py()))
                n += len(each[-1])
                if n >= MAX_IDS or i == b.num_rows:
                    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i - first), ids.cast(schema.field(1).type)], schema=schema)
                    first, n, each = i, 0, []

    return source.mapInArrow(run, ddl)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text): the texts that the ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    ddl = f"doc_id {encoded.select('doc_id').dtypes[0][1]}, text string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(sent.value)
        for b in batches:
            texts = [m.decode(x.values.to_pylist()) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, ddl)


def digest(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_chars, decoded_sha256): each text encoded and its ids decoded again, one text at a
    time in one set of workers; ids_sha256 is of the comma-joined ids."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model))
    source, kind = _texts(docs, id_col, text_col)
    ddl = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_chars long, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(sent.value)
        for b in batches:
            rows = []
            for t in b.column(1):
                ids = m.encode(t.as_py()).tolist()
                text = m.decode(ids)
                rows.append((len(ids), hashlib.sha256(",".join(map(m.named.__getitem__, ids)).encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, list(schema)[1:]))], schema=schema)

    return source.mapInArrow(run, ddl)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
