"""Media columns: Netpbm and BMP images as binary columns.

Images are decoded to numpy arrays, area-resized by integral images (summed-area tables), and
given out as NPY tiles with difference hashes.

Defined results: a null payload is an empty one; bytes that are no whole image (a broken header, too few
samples, samples or palette indexes out of range) give null values, tile and hash; equal bytes give equal
values; rows with null or repeated doc_id are kept each; very long payloads are one image of many rows;
other columns, also of names that differ in case only, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, materialize, modest_batches, only, sliced

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3) arrays; bitmaps become 0 and 255."""
    kind, at = data[:2], 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    head = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("truncated header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = *head[:2], (head[2] if len(head) > 2 else 1)
    if min(width, height, top) < 1 or top > 65535 or width * height > 8 * len(data):
        raise ValueError("impossible size")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = int(np.prod(shape))
    if kind == b"P1":
        digits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])
        if digits[:n].strip(b"01"):
            raise ValueError("a sample that is no bit")
        out = (np.frombuffer(digits, np.uint8, n) == ord("0")) * np.uint8(255)
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        out = (bits[:, :width] == 0) * np.uint8(255)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if out.size != n or (kind in (b"P2", b"P3", b"P5", b"P6") and n and not 0 <= out.min() <= out.max() <= top):
        raise ValueError("too few samples or one out of range")
    return out.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-, 24- and 32-bit bitmaps, as RGB or, with a grey palette, as one channel."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24, 32):
        raise ValueError("only uncompressed 8, 24 and 32 bits")
    if width < 1 or not height or width * abs(height) * depth // 8 > len(data):
        raise ValueError("impossible size")
    row = (width * depth // 8 + 3) & ~3
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * depth // 8]
    raw = raw if height < 0 else raw[::-1]
    if depth > 8:
        return raw.reshape(abs(height), width, depth // 8)[:, :, 2::-1].copy()
    palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
    if raw.max() >= len(palette):
        raise ValueError("a sample outside the palette")
    return palette[raw][:, :, 0].copy() if (palette == palette[:, :1]).all() else palette[raw]


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey or 24-bit RGB."""
    height, width = samples.shape[:2]
    grey = samples.ndim == 2
    depth = 8 if grey else 24
    row = (width * depth // 8 + 3) & ~3
    body = np.zeros((height, row), np.uint8)
    body[:, : width * depth // 8] = (samples if grey else samples[:, :, ::-1].reshape(height, -1))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.empty(0, np.uint8)
    start = 54 + palette.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, width, height, 1, depth, 0, body.size, 2835, 2835, 256 * grey, 0) + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The samples of an image; ValueError for any bytes that are none."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (IndexError, OverflowError, struct.error) as e:
        raise ValueError(f"not a whole image: {e}") from e


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, edges weighted by their share."""
    a = samples if samples.ndim == 2 else samples.mean(2)
    sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def cut(table: np.ndarray, n: int) -> np.ndarray:
        size = len(table) - 1
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    box = cut(cut(sums, height).T, width).T
    return np.diff(np.diff(box, axis=0), axis=1) / (a.shape[0] / height * a.shape[1] / width)


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its left neighbour."""
    small = np.round(area_resize(samples, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(samples, side, side)).astype(np.uint8))
    return out.getvalue()


def text_to_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): the text's bytes, padded with 0, as an 8-bit PGM ``width`` wide."""

    def run(rows):
        for b in sliced(rows):
            size, media = [], []
            for text in b.column(1).to_pylist():
                data = (text or "").encode("utf-8")
                payload = data + bytes(-len(data) % width or width * (not data))
                size.append(len(data))
                media.append(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, tile: int = 16) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) what the stored bytes decode to; ``npy`` is the resized tile."""

    def one(data: bytes | None):
        data = data or b""
        head = (len(data), hashlib.sha256(data).hexdigest())
        try:
            samples = decode(data)
        except ValueError:
            return None, None, None, *head, None, None
        raw = samples.tobytes()
        if not raw:
            return 0, hashlib.sha256(b"").hexdigest(), 0, *head, None, None
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), *head, difference_hash(samples), npy_tile(samples, tile)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "npy"]

    def run(rows):
        for b in sliced(rows):
            found = list(zip(*(one(x.as_py()) for x in b.column(2)), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    return only(media, "doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, npy binary")


def op5_media(spark, sf_dir):
    """Images are written as a table of binary columns, and their features computed from what is read back."""
    with modest_batches(spark):
        stored = materialize(text_to_media(documents(spark, sf_dir)), "media")
    return media_features(stored)
