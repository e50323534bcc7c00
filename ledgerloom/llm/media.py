"""Media columns: payloads as 8-bit grey PNG files, read back with checksum tests, and cosine-transform hashes.

A text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, become the samples of an image 24 wide.
``write_png`` chooses the filter of the whole image by the smallest sum of absolute differences; ``read_png`` tests
every chunk's CRC-32, inflates the IDAT chunks and undoes all five filter types in numpy.  The feature is a 64-bit
hash: the samples averaged to 24 x 24, the 8 x 8 lowest frequencies of their cosine transform, each against their median.

Edge cases: null and empty texts are one 24 x 24 image of 255; very long texts are higher images, several IDAT chunks long;
a coefficient equal to the median is 0; equal texts give equal values; repeated rows each give their row; a null doc_id
stays null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, id_of, map_batches, materialise, text_of

WIDTH, TILE, FILL, LOW = 24, 576, 255, 8
#: Fixed value: the signature of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES, LEVEL = 1 << 16, 4

_K = np.arange(WIDTH)
DCT = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:LOW, None] / (2 * WIDTH))


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + bytes([FILL]) * ((-len(raw)) % TILE or (TILE if not raw else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, filter_type: int | None = None) -> bytes:
    """An 8-bit grey PNG of a (height, width) array; ``filter_type`` 0 to 2, by default the one with the smallest differences."""
    above = np.vstack([np.zeros((1, samples.shape[1]), np.uint8), samples[:-1]])
    before = np.hstack([np.zeros((samples.shape[0], 1), np.uint8), samples[:, :-1]])
    tried = {0: samples, 1: samples - before, 2: samples - above}
    if filter_type is None:
        filter_type = min(tried, key=lambda k: (int(np.abs(tried[k].view(np.int8).astype(np.int32)).sum()), k))
    rows = np.hstack([np.full((samples.shape[0], 1), filter_type, np.uint8), tried[filter_type]])
    body = zlib.compress(rows.tobytes(), LEVEL)
    header = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[at : at + IDAT_BYTES]) for at in range(0, len(body), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", header) + data + _chunk(b"IEND", b"")


def read_png(stored: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; damaged files raise ``ValueError``."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, header, ended = 8, [], None, False
    while at < len(stored) and not ended:
        (n,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if len(data) != n or stored[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    width, height = header[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if len(rows) != height * (width + 1):
        raise ValueError("the image data have another size than the header says")
    return unfilter(rows.reshape(height, width + 1))


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the filter type that stands before each row; runs of rows of one type are undone together."""
    kinds, data = rows[:, 0], rows[:, 1:]
    out = np.empty_like(data)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter type")
    borders = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    zero = np.zeros(data.shape[1], np.uint8)
    for start, end in zip(borders[:-1], borders[1:]):
        kind, part = int(kinds[start]) if end > start else 0, data[start:end]
        above = out[start - 1] if start else zero
        if kind == 0:
            out[start:end] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[start:end])
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[start:end])
            out[start:end] += above
        else:
            for y in range(start, end):
                out[y] = _unfilter_row(kind, data[y].tolist(), (out[y - 1] if y else zero).tolist())
    return out


def _unfilter_row(kind: int, row: list[int], above: list[int]) -> list[int]:
    left = corner = 0
    made = []
    for value, up in zip(row, above):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (value + guess) & 255, up
        made.append(left)
    return made


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits of the signs of the low frequencies."""
    square = samples.reshape(WIDTH, -1, samples.shape[1]).mean(axis=1)
    low = (DCT @ square @ DCT.T).ravel()
    return f"{int(np.packbits(low > np.median(low)).view('>u8')[0]):016x}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the PNG of every text in a binary column."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for text in part.column(1).to_pylist():
            payload = payload_of(text)
            sizes.append(len(text.encode("utf-8")))
            media.append(write_png(np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)))
        return batch_of(doc_id=part.column(0), n_bytes=pa.array(sizes, pa.int64()), media=pa.array(media, pa.binary()))

    return map_batches(docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Read the stored media back: digests of payload and media, and the cosine hash."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for stored in part.column(2).to_pylist():
            samples = read_png(stored)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
        size, sha, tail, n, media_sha, feature = map(list, zip(*rows))
        return batch_of(
            doc_id=part.column(0), n_bytes=part.column(1), payload_bytes=pa.array(size, pa.int64()), payload_sha256=pa.array(sha, pa.string()), tail_crc32=pa.array(tail, pa.int64()),
            media_bytes=pa.array(n, pa.int64()), media_sha256=pa.array(media_sha, pa.string()), feature=pa.array(feature, pa.string()),
        )

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark, sf_dir: str) -> DataFrame:
    return features(materialise(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
