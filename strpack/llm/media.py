"""Media columns: texts carried as PNG images and perceptual hashes of those images.

The payload is the samples of an 8-bit greyscale PNG of 192 samples a row. Writing filters every row by whichever of
None, Sub and Up gives the smallest residue, compresses the rows into zlib data chunks and puts a CRC on every chunk;
reading tests signature, order and CRC of every chunk, inflates, and undoes all five filters with numpy. The feature is
a 64-bit hash of the image's low cosine frequencies, kept as a BINARY column.

Every step is in whole numbers, so that equal texts give equal features on any machine.

Edge cases: null text counts as empty, which is one row of blanks; equal texts, repeated rows among them, give equal files
and features; images of any height work, rows being filtered and compressed a block at a time; coefficients that tie with
the median count as below it; a damaged or truncated file is an error that names the chunk; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, text_of

SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
WIDTH = 192
#: Largest data chunk written; longer streams are several chunks.
CHUNK = 1 << 16
SIDE = 32


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


#: Rows that are filtered at a time.
BLOCK_ROWS = 4096


def filtered(samples: np.ndarray, above: np.ndarray | None) -> np.ndarray:
    """Rows with their filter number in front. above: the row before the first one, if there is one."""
    height, width = samples.shape
    ways = np.zeros((3, height, width), np.uint8)
    ways[0] = samples
    ways[1] = samples
    ways[1][:, 1:] -= samples[:, :-1]
    ways[2] = samples
    ways[2][1:] -= samples[:-1]
    if above is not None:
        ways[2][0] -= above
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = ways[best, np.arange(height)]
    return lines


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A greyscale PNG of a (height, width) uint8 array."""
    height, width = samples.shape
    z, out = zlib.compressobj(level), []
    for a in range(0, height, BLOCK_ROWS):
        out.append(z.compress(filtered(samples[a : a + BLOCK_ROWS], samples[a - 1] if a else None).tobytes()))
    data = b"".join([*out, z.flush()])
    parts = [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def read_png(file: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing, all chunks tested."""
    if file[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, data, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(file):
            raise ValueError(f"truncated at byte {at}")
        (n,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        body = file[at + 8 : at + 8 + n]
        if len(file) < at + 12 + n or struct.unpack_from(">I", file, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} at byte {at}: checksum or length is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError(f"only 8-bit greyscale is read, not {rest}")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if size is None:
        raise ValueError("no header chunk")
    height, width = size
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width + 1):
        raise ValueError(f"{len(raw)} bytes of rows, {height * (width + 1)} expected")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters. Runs of rows with one filter are single numpy operations, but for Average and Paeth."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)]):
        kind = kinds[a] if len(kinds) else 0
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                up = out[y - 1].tolist() if y else [0] * out.shape[1]
                left = corner = 0
                row = out[y].tolist()
                for x, v in enumerate(row):
                    if kind == 3:
                        left = (v + (left + up[x]) // 2) & 255
                    else:
                        p = left + up[x] - corner
                        d = abs(p - left), abs(p - up[x]), abs(p - corner)
                        corner_now = up[x]
                        left = (v + (left if d[0] <= d[1] and d[0] <= d[2] else up[x] if d[1] <= d[2] else corner)) & 255
                        corner = corner_now
                    row[x] = left
                out[y] = row
        elif kind > 4:
            raise ValueError(f"unknown row filter {kind}")
    return out


@lru_cache(256)
def _shrink(n: int) -> np.ndarray:
    """(SIDE, n): how much of each of n samples falls into each of SIDE cells, in units of 1 / SIDE of a sample; a row
    sums up to n."""
    return _weights(n, 0, n)


@lru_cache(1)
def _cosines() -> np.ndarray:
    """Cosines in units of 2^-16; every row but the constant one sums up to nothing, so that a flat image has no others."""
    k, x = np.arange(8)[:, None], np.arange(SIDE)[None]
    table = np.rint(np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE)) * 65536).astype(np.int64)
    rest = table.sum(1)
    rest[0] = 0
    table[:, 0] -= rest // 2
    table[:, -1] -= rest - rest // 2
    return table


def low_frequency_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients lie above their median (the constant term is left out)."""
    tall, wide = samples.shape
    if wide % SIDE == 0:
        rows = samples.reshape(tall, SIDE, wide // SIDE).sum(2, dtype=np.int64) * SIDE
    else:
        rows = samples.astype(np.int64) @ _shrink(wide).T
    small = np.zeros((SIDE, SIDE), np.int64)
    for a in range(0, tall, BLOCK_ROWS):
        part = rows[a : a + BLOCK_ROWS]
        # Of a tall image the weights are made block by block.
        small += (_shrink(tall) if tall <= BLOCK_ROWS else _weights(tall, a, a + len(part))) @ part
    small = small * 256 // (tall * wide)
    c = (_cosines() @ small @ _cosines().T + (1 << 35) >> 36).ravel()
    c[0] = 0
    return np.packbits(c > np.median(c[1:])).tobytes()


def _weights(n: int, a: int, b: int) -> np.ndarray:
    """Columns a to b of _shrink(n)."""
    low, high = np.arange(SIDE)[:, None] * n, (np.arange(SIDE)[:, None] + 1) * n
    cell = np.arange(a, b)[None] * SIDE
    return np.clip(np.minimum(high, cell + SIDE) - np.maximum(low, cell), 0, None)


def payload(text: bytes) -> bytes:
    """The text padded with blanks to a positive multiple of the row width."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH)


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media BINARY (the PNG), feature BINARY (8 bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, media, feature = [], [], []
        for t in batch.column(1):
            t = t.as_py() or b""
            samples = np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)
            n.append(len(t))
            media.append(write_png(samples))
            feature.append(low_frequency_hash(samples))
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(feature, pa.binary())], names=[key, "n_bytes", "media", "feature"])

    return by_batch(text_of(df, key, text=text), run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, media binary, feature binary")


def restore(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """key, text: the inverse of store. Null media stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if m is None else read_png(m).tobytes()[:n].decode("utf-8", "replace") for m, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return by_batch(df.select(key, media, n_bytes), run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store, read the stored bytes back, and reduce to digests in one pass."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1):
            t = t.as_py() or b""
            media = write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH))
            samples = read_png(media)
            back = samples.tobytes()
            rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), low_frequency_hash(samples).hex()))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    return by_batch(text_of(df, key, text=text), run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
