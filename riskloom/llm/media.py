"""Media columns: lossless grey PNG images in a binary column, and perceptual hashes of them.

A payload becomes the 8-bit samples of an image 64 samples wide. ``write_png`` filters each row against the row above and
compresses with zlib; ``read_png`` walks the chunks, tests every checksum, inflates and undoes any of the five row filters
with numpy. The feature is the sign pattern of the 8 x 8 lowest-frequency cosine coefficients.

Defined results: null text is the empty text; the empty text is one row of zero bytes; equal texts give equal values; a
broken signature, chunk checksum, zlib stream or size raises ``ValueError``; texts of any length fit (height below 2**31).
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import in_parts, kind_of

WIDTH, SIGNATURE, LEVEL = 64, b"\x89PNG\r\n\x1a\n", 1


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of the payload; every row holds its difference from the row above."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.full((len(rows), WIDTH + 1), 2, np.uint8)
    lines[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=lines[1:, 1:])
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(image: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, rows by columns."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, b"", [], False
    while at < len(image) and not ended:
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if image[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"checksum of chunk {kind!r}")
        header = data if kind == b"IHDR" else header
        if kind == b"IDAT":
            packed.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    if not ended or len(header) != 13:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", header)
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only grey 8-bit images without interlace")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise ValueError("broken data") from error
    if lines.size != height * (width + 1):
        raise ValueError("size of the data")
    return unfilter(lines.reshape(height, width + 1))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the row filters; runs of rows that share filter 0, 1 or 2 are undone at once."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(kinds)) + 1):
        kind, first = int(kinds[own[0]]), int(own[0])
        if kind == 1:
            rows[own] = np.add.accumulate(rows[own], axis=1, dtype=np.uint8)
        elif kind == 2:
            if first:
                rows[first] += rows[first - 1]
            rows[own] = np.add.accumulate(rows[own], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for i in own:
                above = rows[i - 1].astype(int) if i else np.zeros(rows.shape[1], int)
                left = corner = 0
                for j, up in enumerate(above.tolist()):
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        near = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                        guess = (left, up, corner)[near.index(min(near))]
                    left = rows[i, j] = (int(rows[i, j]) + guess) & 255
                    corner = up
        elif kind:
            raise ValueError(f"row filter {kind}")
    return rows


@lru_cache(maxsize=256)
def _cosines(size: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(8), np.arange(size) + 0.5) / size)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hexadecimal: which of the lowest-frequency coefficients exceed their median."""
    low = (_cosines(samples.shape[0]) @ samples.astype(np.float64) @ _cosines(samples.shape[1]).T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def text_images(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ``n_bytes`` of the text, and ``media``: the image of its padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 1, 8_000_000):
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write_png(pad(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_of(docs, id_col)}, n_bytes bigint, media binary")


def media_features(images: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """Reads images back: payload size and hash, checksum of its last 64 bytes, image size and hash, cosine hash."""
    kept = [c for c in (id_col, "n_bytes") if c in images.columns]
    names = [*kept, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(len(kept)).to_pylist():
                samples = read_png(image)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = ", ".join(f"`{c}` {kind_of(images, c)}" for c in kept)
    return images.select(*kept, media_col).mapInArrow(run, f"{schema}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
