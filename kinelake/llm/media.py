"""Media columns: texts as PNG images in a binary column, and hashes of the images.

The writer emits 8-bit greyscale PNG: signature, IHDR, one IDAT through zlib, IEND.
The reader tests every chunk's CRC, inflates, and undoes the row filters with
numpy (None, Sub and Up whole rows at a time; Average and Paeth, which the writer
never picks, byte by byte). The feature is a perceptual hash: signs of the
8 x 8 lowest cosine-transform coefficients against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from kinelake.llm.arrow import map_column

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A payload is a positive multiple of UNIT bytes, TILE x TILE samples.
UNIT, TILE = 576, 24
LEVEL = 3


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of the text padded with 255 to a positive multiple of UNIT; unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


@lru_cache(maxsize=4096)
def shape_of(size: int) -> tuple[int, int]:
    """Height and width: tiles of 24 x 24 in the squarest grid that their number allows."""
    tiles = size // UNIT
    across = next(a for a in range(int(tiles**0.5), 0, -1) if tiles % a == 0)
    return TILE * (tiles // across), TILE * across


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray) -> bytes:
    """Greyscale PNG of a (height, width) array of uint8."""
    height, width = samples.shape
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    tried = np.stack([samples, samples - left, samples - above])
    # Bytes taken as signed should be small; text, which zlib knows best as it is, stays
    # unfiltered unless a filter halves their sum.
    cost = np.minimum(tried, -tried).sum(axis=2, dtype=np.int64)
    cost[1:] *= 2
    pick = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), dtype=np.uint8)
    rows[:, 0] = pick
    rows[:, 1:] = tried[pick, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    width = out.shape[1]
    zero = np.zeros(width, dtype=np.uint8)
    for y in np.flatnonzero(kinds):
        above, row = out[y - 1] if y else zero, out[y]
        if kinds[y] == 1:
            np.cumsum(row, dtype=np.uint8, out=row)
        elif kinds[y] == 2:
            row += above
        elif kinds[y] == 3:
            left = 0
            for x in range(width):
                left = row[x] = (int(row[x]) + (left + int(above[x])) // 2) & 255
        elif kinds[y] == 4:
            left = corner = 0
            for x in range(width):
                up = int(above[x])
                a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                guess = left if a <= b and a <= c else up if b <= c else corner
                left = row[x] = (int(row[x]) + guess) & 255
                corner = up
        elif kinds[y]:
            raise ValueError(f"unknown row filter {kinds[y]}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG; ValueError if a chunk's checksum or the structure is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + size : at + 12 + size]:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only whole 8-bit greyscale images without interlace are read")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)
    return _unfilter(rows.reshape(header[1], header[0] + 1))


@lru_cache(maxsize=512)
def _cosines(size: int, waves: int = 8) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(waves), 2 * np.arange(size) + 1) / (2 * size)) / size


def cosine_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: bit i is 1 where low-frequency coefficient i is above the median."""
    low = _cosines(samples.shape[0]) @ samples.astype(np.float64) @ _cosines(samples.shape[1]).T
    flat = np.round(low.ravel(), 9)
    bits = np.packbits(flat > np.median(flat[1:]))
    return bits.tobytes().hex()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG in the binary column media, one row per input row.

    Null text counts as empty; its payload is 576 bytes of 255. Ids pass through,
    null and repeated ones too; other columns are ignored.
    """

    def run(texts: list) -> list:
        payloads = [payload_of(text) for text in texts]
        return [[n for _, n in payloads], [write_png(np.frombuffer(data, dtype=np.uint8).reshape(shape_of(len(data)))) for data, _ in payloads]]

    return map_column(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), ["doc_id"], "text", run, {"n_bytes": "long", "media": "binary"})


def read_media(media: DataFrame) -> DataFrame:
    """Features of stored images: what the stored bytes hold, read back."""

    def run(stored: list) -> list:
        columns: list[list] = [[] for _ in range(6)]
        for data in stored:
            samples = read_png(data)
            payload = samples.tobytes()
            found = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples))
            for values, value in zip(columns, found, strict=True):
                values.append(value)
        return columns

    out = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return map_column(media, ["doc_id", "n_bytes"], "media", run, out)


def op5_media(spark, sf_dir: str) -> DataFrame:
    return read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
