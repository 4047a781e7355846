"""Media columns: bytes as PNG images in binary columns, read back by chunks, with low-frequency cosine hashes.

An image is 8-bit greyscale, WIDTH samples wide. Writing picks for each row the filter (none, sub, up) with the
least sum of absolute differences. Reading walks the chunks, tests each checksum, inflates the data chunks and
undoes the filters with numpy; all five filter types are read. The feature is a hash of the signs of the lowest
two-dimensional cosine-transform coefficients against their median.

Defined cases: a null text is an empty payload, which is padded to one image; damaged chunks raise ValueError in
decode_png; equal payloads, repeated rows too, give equal images and features; very long texts make tall images, stored whole; samples
equal to the median give a zero bit; an empty table gives no rows. Only the id and the text columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row, and bytes that a payload is padded to a multiple of.
WIDTH, UNIT = 24, 576
LEVEL = 6
#: Coefficients of the hash in each direction.
LOW = 8
#: Rows of one stretch when filters are chosen, so that a long payload needs no large temporaries.
STRETCH = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray) -> bytes:
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for s in range(0, len(rows), STRETCH):
        part = rows[s : s + STRETCH]
        above = np.zeros_like(part)
        above[1:] = part[:-1]
        if s:
            above[0] = rows[s - 1]
        left = np.zeros_like(part)
        left[:, 1:] = part[:, :-1]
        kinds = np.stack([part, part - left, part - above])
        cost = np.minimum(kinds, 0 - kinds).sum(axis=2, dtype=np.int64)
        best = cost.argmin(axis=0)
        out[s : s + len(part), 0] = best
        out[s : s + len(part), 1:] = kinds[best, np.arange(len(part))]
    return out.tobytes()


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """payload, a positive multiple of width bytes, as a greyscale PNG file."""
    height, rest = divmod(len(payload), width)
    if rest or not height:
        raise ValueError(f"{len(payload)} bytes don't fill rows of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(_filtered(rows), level)) + _chunk(b"IEND", b"")


def _chunks(png: bytes):
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r}: checksum or length is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end chunk")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters. Runs of one filter type are undone together; of the last two types, sample by sample."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)]):
        kind, part = int(kinds[a]), rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                up = out[i - 1].astype(int) if i else np.zeros(rows.shape[1], int)
                west = corner = 0
                for j, x in enumerate(rows[i].tolist()):
                    north = int(up[j])
                    if kind == 3:
                        guess = (west + north) >> 1
                    else:
                        p = west + north - corner
                        guess = min((abs(p - west), 0, west), (abs(p - north), 1, north), (abs(p - corner), 2, corner))[2]
                    west, corner = (x + guess) & 255, north
                    out[i, j] = west
        else:
            raise ValueError(f"filter type {kind}")
        above = out[b - 1]
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing, as rows."""
    head, data = None, []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if not head or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError(f"only 8-bit greyscale is read, not {head}")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("the data don't fill the image")
    raw = raw.reshape(height, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:])


@lru_cache(64)
def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(LOW), np.arange(n) + 0.5) / n)


def cosine_hash(samples: np.ndarray) -> str:
    """Signs of the LOW x LOW lowest coefficients, less the constant one, against their median; 16 hex digits."""
    down = np.zeros((LOW, samples.shape[1]))
    for s in range(0, len(samples), STRETCH) if len(samples) > STRETCH else [0]:
        part = samples[s : s + STRETCH].astype(np.float64)
        down += (np.cos(np.pi * np.outer(np.arange(LOW), np.arange(s, s + len(part)) + 0.5) / len(samples)) if len(samples) > STRETCH else _cosines(len(samples))) @ part
    low = np.round((down @ _cosines(samples.shape[1]).T) / samples.size, 9).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PNG in a binary column."""

    def batch(b: pa.RecordBatch) -> dict:
        raw = [x.as_py() or b"" for x in b.column(1)]
        return {"doc_id": b.column(0), "n_bytes": list(map(len, raw)), "media": [encode_png(pad(x)) for x in raw]}

    kind = docs.select(id_col).dtypes[0][1]
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw")), batch, f"doc_id {kind}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold: payload, tail checksum, hashes; media has (doc_id, n_bytes, media)."""

    def batch(b: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for x in b.column(2):
            png = x.as_py()
            samples = decode_png(png)
            payload = samples.tobytes()
            for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples))):
                out[k].append(v)
        return {"doc_id": b.column(0), "n_bytes": b.column(1)} | out

    kind = media.select("doc_id").dtypes[0][1]
    return map_arrow(media, batch, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(media_columns(table(spark, sf_dir, "documents")))
