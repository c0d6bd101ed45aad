"""The binary archive format: named, length-framed sections, each with the smallest of several encodings."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from .config import TOP_ID_12, CorruptArchiveError

MAGIC = bytes.fromhex("4f504152")
VERSION = 2
MOST_SECTIONS = 64
MOST_BYTES = 1 << 30
MOST_TOKENS = 1 << 29
MOST_BOUNDARIES = 1 << 28
ESCAPE = 255
TOKENS, ROWS, DICTIONARY, BOUNDS = "compressed_data", "string_boundaries", "dictionary", "token_boundaries"
#: First parameter of the token section: 2..5 for 16-bit ids (raw, deflated, codebook, deflated codebook), 12..15 for 12.
RAW_16, RAW_12 = 2, 12
ROWS_DELTA, BOUNDS_RAW, BOUNDS_DELTA = 1, 4, 5


@dataclass
class Blob:
    """A decoded archive: all ids, row boundaries (n + 1), dictionary bytes, token boundaries, id width."""

    tokens: np.ndarray
    rows: list[int]
    dictionary: bytes
    bounds: list[int]
    bits: int = 16


def validate(b: Blob) -> None:
    """Raise CorruptArchiveError at the first contradiction. Tokens past the last row boundary are allowed."""
    if b.bits not in (0, 12, 16):
        raise CorruptArchiveError(f"id width {b.bits}")
    for name, bounds, limit in (("row", b.rows, len(b.tokens)), ("token", b.bounds, len(b.dictionary))):
        if not len(bounds):
            raise CorruptArchiveError(f"there is no {name} boundary")
        x = np.asarray(bounds, np.int64)
        if x[0] != 0:
            raise CorruptArchiveError(f"first {name} boundary is {x[0]}, not 0")
        back = np.flatnonzero(np.diff(x) < 0)
        if len(back):
            raise CorruptArchiveError(f"{name} boundary {back[0] + 1} is less than the one before")
        if x[-1] > limit:
            raise CorruptArchiveError(f"{name} boundary {x[-1]} lies beyond {limit}")
    ids = np.asarray(b.tokens)
    top = min(TOP_ID_12 if b.bits == 12 else 1 << 30, len(b.bounds) - 2)
    wrong = np.flatnonzero((ids > top) | (ids < 0))
    if len(wrong):
        raise CorruptArchiveError(f"token id {ids[wrong[0]]} at position {wrong[0]} is out of range (last: {top})")


def raw16(ids: np.ndarray) -> bytes:
    return struct.pack("<I", len(ids)) + np.asarray(ids).astype("<u2").tobytes()


def unraw16(data: bytes) -> np.ndarray:
    n = _count(data, MOST_TOKENS)
    if len(data) - 4 != 2 * n:
        raise CorruptArchiveError(f"{len(data) - 4} bytes of ids, {2 * n} expected")
    return np.frombuffer(data, "<u2", n, 4).astype(np.int64)


def packed12_size(n: int) -> int:
    return (12 * n + 7) // 8


def packed12(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.int64)
    if len(ids) and ids.max() > TOP_ID_12:
        raise CorruptArchiveError(f"id {ids.max()} does not fit 12 bits")
    pairs = np.append(ids, 0)[: len(ids) + len(ids) % 2].reshape(-1, 2)
    out = np.stack([pairs[:, 0] & 255, pairs[:, 0] >> 8 | (pairs[:, 1] & 15) << 4, pairs[:, 1] >> 4], 1).astype(np.uint8)
    return struct.pack("<I", len(ids)) + out.tobytes()[: packed12_size(len(ids))]


def unpacked12(data: bytes) -> np.ndarray:
    n = _count(data, MOST_TOKENS)
    if len(data) - 4 != packed12_size(n):
        raise CorruptArchiveError(f"{len(data) - 4} bytes of packed ids, {packed12_size(n)} expected")
    raw = np.zeros(-(-n // 2) * 3, np.int64)
    raw[: len(data) - 4] = np.frombuffer(data, np.uint8, offset=4)
    x = raw.reshape(-1, 3)
    ids = np.stack([x[:, 0] | (x[:, 1] & 15) << 8, x[:, 1] >> 4 | x[:, 2] << 4], 1).ravel()
    if n % 2 and ids[n]:
        raise CorruptArchiveError("padding bits are not zero")
    return ids[:n]


def codebook(ids: np.ndarray) -> list[int]:
    """The at most 255 most frequent ids: by falling count, then rising id."""
    counts = np.bincount(np.asarray(ids, np.int64), minlength=1)
    there = np.flatnonzero(counts)
    return there[np.argsort(-counts[there], kind="stable")][:ESCAPE].tolist()


def coded(ids: np.ndarray, bits: int) -> bytes:
    ids = np.asarray(ids, np.int64)
    if bits == 12 and len(ids) and ids.max() > TOP_ID_12:
        raise CorruptArchiveError(f"id {ids.max()} does not fit 12 bits")
    book = codebook(ids)
    code = np.full(65536, ESCAPE, np.int64)
    code[book] = np.arange(len(book))
    codes = code[ids]
    size = np.where(codes == ESCAPE, 3, 1)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = codes
    far = codes == ESCAPE
    out[at[far] + 1], out[at[far] + 2] = ids[far] & 255, ids[far] >> 8
    return struct.pack("<IH", len(ids), len(book)) + np.array(book, "<u2").tobytes() + out.tobytes()


def uncoded(data: bytes, bits: int) -> np.ndarray:
    if len(data) < 6:
        raise CorruptArchiveError(f"codebook section of {len(data)} bytes")
    n, k = _count(data, MOST_TOKENS), struct.unpack_from("<H", data, 4)[0]
    if k > ESCAPE:
        raise CorruptArchiveError(f"codebook of {k} entries")
    if len(data) < 6 + 2 * k:
        raise CorruptArchiveError("codebook is cut short")
    book, stream = np.frombuffer(data, "<u2", k, 6).tolist(), data[6 + 2 * k :]
    if n > len(stream):
        raise CorruptArchiveError(f"code stream ends before token {len(stream)}")
    out, at = [], 0
    for i in range(n):
        if at >= len(stream):
            raise CorruptArchiveError(f"code stream ends before token {i}")
        c = stream[at]
        at += 1
        if c == ESCAPE:
            if at + 2 > len(stream):
                raise CorruptArchiveError(f"escape at token {i} is cut short")
            out.append(stream[at] | stream[at + 1] << 8)
            at += 2
        elif c >= k:
            raise CorruptArchiveError(f"code {c} at token {i} is not in the codebook")
        else:
            out.append(book[c])
    if at != len(stream):
        raise CorruptArchiveError(f"{len(stream) - at} bytes after the last code")
    if bits == 12 and max([*book, *out], default=0) > TOP_ID_12:
        raise CorruptArchiveError("codebook section holds an id beyond 12 bits")
    return np.array(out, np.int64)


def deflated(data: bytes) -> bytes:
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def inflated(data: bytes) -> bytes:
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(data, MOST_BYTES + 1)
    except zlib.error as e:
        raise CorruptArchiveError(f"deflated section: {e}") from e
    if len(out) > MOST_BYTES:
        raise CorruptArchiveError("deflated section grows beyond the limit")
    if not z.eof:
        raise CorruptArchiveError("deflated section is cut short")
    return out


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def deltas(bounds: list[int]) -> bytes:
    steps = np.diff(np.asarray(bounds, np.int64))
    if len(steps) and steps.min() < 0:
        raise CorruptArchiveError(f"boundary {int(np.flatnonzero(steps < 0)[0]) + 1} is less than the one before")
    return b"".join(map(varint, steps.tolist()))


def undeltas(first: int, data: bytes, n: int, most: int) -> list[int]:
    if n - 1 > len(data):
        raise CorruptArchiveError(f"{len(data)} bytes for {n - 1} steps")
    out, at = [first], 0
    for i in range(1, n):
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise CorruptArchiveError(f"step {i} is cut short")
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        if out[-1] + value > most:
            raise CorruptArchiveError(f"boundary {i} exceeds {most}")
        out.append(out[-1] + value)
    if at != len(data):
        raise CorruptArchiveError(f"{len(data) - at} bytes after the last step")
    return out


def _count(data: bytes, most: int) -> int:
    if len(data) < 4:
        raise CorruptArchiveError(f"section of {len(data)} bytes has no count")
    (n,) = struct.unpack_from("<I", data)
    if n > most:
        raise CorruptArchiveError(f"count {n} exceeds {most}")
    return n


def token_candidates(ids: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(parameter, payload) of every encoding that can hold the ids, in the order that decides ties."""
    base = RAW_12 if bits == 12 else RAW_16
    raw = packed12(ids) if bits == 12 else raw16(ids)
    book = coded(ids, bits)
    return [(base, raw), (base + 1, deflated(raw)), (base + 2, book), (base + 3, deflated(book))]


def tokens_section(ids: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    param, data = min(token_candidates(ids, bits), key=lambda c: len(c[1]))
    return bytes([param]), data


def read_tokens(params: bytes, data: bytes) -> tuple[np.ndarray, int]:
    if len(params) != 1 or params[0] not in (2, 3, 4, 5, 12, 13, 14, 15):
        raise CorruptArchiveError(f"token encoding {list(params)}")
    bits, way = (12, params[0] - RAW_12) if params[0] >= RAW_12 else (16, params[0] - RAW_16)
    if way % 2:
        data = inflated(data)
    if way >= 2:
        return uncoded(data, bits), bits
    return (unpacked12(data) if bits == 12 else unraw16(data)), bits


def rows_section(rows: list[int]) -> bytes:
    if not rows:
        return struct.pack("<I", 0)
    if not 0 <= rows[0] <= MOST_TOKENS:
        raise CorruptArchiveError(f"first row boundary {rows[0]}")
    steps = deltas(rows)
    return struct.pack("<IQI", len(rows), rows[0], len(steps)) + steps


def read_rows(params: bytes, data: bytes) -> list[int]:
    if params != bytes([ROWS_DELTA]):
        raise CorruptArchiveError(f"row boundary encoding {list(params)}")
    n = _count(data, MOST_BOUNDARIES)
    if n == 0:
        if len(data) > 4:
            raise CorruptArchiveError(f"{len(data) - 4} bytes after an empty list")
        return []
    if len(data) < 16:
        raise CorruptArchiveError("row boundaries are cut short")
    first, size = struct.unpack_from("<QI", data, 4)
    if first > MOST_TOKENS:
        raise CorruptArchiveError(f"first row boundary {first}")
    if size != len(data) - 16:
        raise CorruptArchiveError(f"{len(data) - 16} bytes of steps, {size} declared")
    return undeltas(first, data[16:], n, MOST_TOKENS)


def bounds_section(bounds: list[int]) -> tuple[bytes, bytes]:
    raw = struct.pack("<I", len(bounds)) + np.array(bounds, "<u4").tobytes()
    steps = deltas(bounds)
    delta = struct.pack("<III", len(bounds), bounds[0], len(steps)) + steps if bounds else raw
    return (bytes([BOUNDS_DELTA]), delta) if bounds and len(delta) < len(raw) else (bytes([BOUNDS_RAW]), raw)


def read_bounds(params: bytes, data: bytes) -> list[int]:
    if len(params) != 1 or params[0] not in (BOUNDS_RAW, BOUNDS_DELTA):
        raise CorruptArchiveError(f"token boundary encoding {list(params)}")
    n = _count(data, MOST_BOUNDARIES)
    if params[0] == BOUNDS_RAW:
        if len(data) - 4 != 4 * n:
            raise CorruptArchiveError(f"{len(data) - 4} bytes of token boundaries, {4 * n} expected")
        return np.frombuffer(data, "<u4", n, 4).tolist()
    if n == 0:
        if len(data) > 4:
            raise CorruptArchiveError(f"{len(data) - 4} bytes after an empty list")
        return []
    if len(data) < 12:
        raise CorruptArchiveError("token boundaries are cut short")
    first, size = struct.unpack_from("<II", data, 4)
    if size != len(data) - 12:
        raise CorruptArchiveError(f"{len(data) - 12} bytes of steps, {size} declared")
    return undeltas(first, data[12:], n, (1 << 32) - 1)


def section(name: str, params: bytes, data: bytes) -> bytes:
    raw = name.encode()
    if not 0 < len(raw) < 256 or len(params) > 65535 or len(data) > MOST_BYTES:
        raise CorruptArchiveError(f"section {name!r} cannot be framed")
    return struct.pack("<BHI", len(raw), len(params), len(data)) + raw + params + data


def dumps(b: Blob) -> bytes:
    validate(b)
    bits = 12 if b.bits == 12 else 16
    parts = [
        section(TOKENS, *tokens_section(b.tokens, bits)),
        section(ROWS, bytes([ROWS_DELTA]), rows_section(list(b.rows))),
        section(DICTIONARY, b"", struct.pack("<I", len(b.dictionary)) + b.dictionary),
        section(BOUNDS, *bounds_section(list(b.bounds))),
    ]
    return MAGIC + struct.pack("<HH", VERSION, len(parts)) + b"".join(parts)


def row_count(data: bytes) -> int:
    """Rows of a serialized archive, by its frames and the count of its row boundaries; no payload is decoded."""
    at = 8
    if data[:4] != MAGIC or len(data) < at:
        raise CorruptArchiveError("magic at offset 0 is wrong")
    for i in range(struct.unpack_from("<H", data, 6)[0]):
        if at + 7 > len(data):
            raise CorruptArchiveError(f"at offset {at} header (stage index {i}): 7 bytes wanted, {len(data) - at} left")
        n_name, n_params, n_data = struct.unpack_from("<BHI", data, at)
        start = at + 7 + n_name + n_params
        if data[at + 7 : at + 7 + n_name] == ROWS.encode():
            return max(0, _count(data[start : start + 4], MOST_BOUNDARIES) - 1)
        at = start + n_data
    raise CorruptArchiveError(f"section {ROWS!r} is missing")


def loads(data: bytes) -> Blob:
    """The inverse of dumps. Sections may come in any order, unknown ones are skipped, and every error says where."""

    def take(at: int, n: int, what: str) -> bytes:
        if at + n > len(data):
            raise CorruptArchiveError(f"at offset {at} {what}: {n} bytes wanted, {len(data) - at} left")
        return data[at : at + n]

    if take(0, 4, "magic") != MAGIC:
        raise CorruptArchiveError("magic at offset 0 is wrong")
    version, count = struct.unpack("<HH", take(4, 4, "version and section count"))
    if version != VERSION:
        raise CorruptArchiveError(f"version {version} at offset 4 is not supported")
    if not 0 < count <= MOST_SECTIONS:
        raise CorruptArchiveError(f"section count {count} at offset 6 is not supported")
    at, found = 8, {}
    for i in range(count):
        where = f"stage index {i}"
        n_name, n_params, n_data = struct.unpack("<BHI", take(at, 7, f"header ({where})"))
        if not n_name or n_data > MOST_BYTES:
            raise CorruptArchiveError(f"header at offset {at} ({where}): name of {n_name}, payload of {n_data} bytes")
        name = take(at + 7, n_name, f"name ({where})").decode("utf-8", "replace")
        if name in found:
            raise CorruptArchiveError(f"section {name!r} comes twice ({where})")
        params = take(at + 7 + n_name, n_params, f"parameters of {name!r} ({where})")
        at += 7 + n_name + n_params
        payload = take(at, n_data, f"payload of {name!r} ({where})")
        try:
            if name == TOKENS:
                found[name] = read_tokens(params, payload)
            elif name == ROWS:
                found[name] = read_rows(params, payload)
            elif name == DICTIONARY:
                if params or len(payload) - 4 != _count(payload, MOST_BYTES):
                    raise CorruptArchiveError("dictionary length or parameters are wrong")
                found[name] = payload[4:]
            elif name == BOUNDS:
                found[name] = read_bounds(params, payload)
        except CorruptArchiveError as e:
            raise CorruptArchiveError(f"section {name!r} at offset {at} ({where}): {e}") from e
        at += n_data
    for name in (TOKENS, ROWS, DICTIONARY, BOUNDS):
        if name not in found:
            raise CorruptArchiveError(f"section {name!r} is missing")
    blob = Blob(found[TOKENS][0], found[ROWS], found[DICTIONARY], found[BOUNDS], found[TOKENS][1])
    validate(blob)
    return blob
