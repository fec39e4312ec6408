"""Media columns: PNG through zlib chunks with checksum tests and numpy unfiltering.

``encode_png`` and ``decode_png`` work on 8-bit grey rows; ``dct_hash`` is a
perceptual hash from the low frequencies of a cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of one IDAT chunk.
CHUNK = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey PNG of (height, width); one of the filters none, sub and up is taken for the whole image."""
    h, w = pixels.shape
    up = np.concatenate((pixels[:1], pixels[1:] - pixels[:-1]))
    sub = np.concatenate((pixels[:, :1], pixels[:, 1:] - pixels[:, :-1]), axis=1)
    ways = {0: pixels, 1: sub, 2: up}
    cost = {k: int(np.minimum(x, 256 - x.astype(np.int16)).sum()) for k, x in ways.items()}
    best = min(ways, key=lambda k: (cost[k], k))
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best, ways[best]
    body = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    near = sorted((abs(p - x), i, x) for i, x in enumerate((a, b, c)))
    return near[0][2]


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the five PNG row filters for one byte a pixel; runs of none, sub and up rows are whole-array sums modulo 256."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    cuts = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kind = kinds[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                prior = out[y - 1].tolist() if y else [0] * out.shape[1]
                row, left, corner = [], 0, 0
                for x, v in enumerate(out[y].tolist()):
                    left = (v + ((left + prior[x]) // 2 if kind == 3 else _paeth(left, prior[x], corner))) & 255
                    corner = prior[x]
                    row.append(left)
                out[y] = row
        elif kind != 0:
            raise ValueError(f"unknown PNG filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG without interlace; every chunk's checksum and order is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, parts, ended = 8, None, [], False
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
            shape = (h, w)
        elif kind == b"IDAT":
            parts.append(body)
        ended |= kind == b"IEND"
        at += 12 + size
    if shape is None or not ended:
        raise ValueError("truncated PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)
    return unfilter(rows)


_COS = np.cos(np.pi * (2 * np.arange(32) + 1) * np.arange(8)[:, None] / 64)


def _shrink(x: np.ndarray, axis: int) -> np.ndarray:
    n = x.shape[axis]
    if n >= 32:
        cuts = np.arange(32) * n // 32
        shape = [1, 1]
        shape[axis] = 32
        return np.add.reduceat(x, cuts, axis=axis) / np.diff(np.append(cuts, n)).reshape(shape)
    return np.take(x, np.arange(32) * n // 32, axis=axis)


def dct_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: signs of the 8 x 8 lowest frequencies of the 32 x 32 mean image against their median."""
    small = _shrink(_shrink(pixels.astype(np.float64), 0), 1)
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: bytes) -> np.ndarray:
    """Text bytes with zeros up to a positive multiple of WIDTH, as rows of pixels."""
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)


def media_columns(docs: DataFrame, level: int = 6) -> DataFrame:
    """Every row with its text stored as a PNG: doc_id, n_bytes, media (binary).

    Null and empty texts give one row of zero pixels.  Equal texts give equal
    files; repeated rows are stored each; extra columns are ignored; an empty
    table gives none.
    """
    docs = docs.select("doc_id", "text")

    def make():
        def step(part, data, offsets):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return [pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(payload_of(t), level) for t in texts], pa.binary())]

        return step

    return C.pick(C.append_columns(docs, make, "long, binary"), docs, ["doc_id"], n_bytes="x0", media="x1")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads stored media back and derives the digest columns."""

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for m in part.column(2).to_pylist():
                    pixels = decode_png(m)
                    back = pixels.tobytes()
                    out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), dct_hash(pixels)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
