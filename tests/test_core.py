"""Matcher, trainer, sampling, template keys and wire format in plain Python."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strpack import wire
from strpack.archive import dump, load_rows
from strpack.config import Config, CorruptArchiveError, ShortBufferError, UntrainedModelError
from strpack.functions.templates import template_key
from strpack.matching import CROWD, Matcher, identity_tokens
from strpack.model import Model
from strpack.operators import sampling
from strpack.training import train_rows

CONFIGS = [Config(), Config(max_token_length=16), Config(max_token_id=4095), Config(token_bits=12)]


def parse(rows, config):
    tokens = train_rows(rows, config)
    m = Matcher(config.max_token_length, tokens)
    return tokens, [m.parse(r) for r in rows]


@pytest.mark.parametrize(
    "rows, options, new, ids",
    [
        ([], {}, [], []),
        ([b"aaaa"], {}, [b"aa"], [[256, 256]]),
        ([b"aaaa"], {"max_token_id": 255}, [], [[97] * 4]),
        ([b"aaaa"], {"threshold": 3}, [b"aa"], [[256, 256]]),
        ([b"ab"], {"threshold": 1}, [b"ab"], [[256]]),
        ([b"abab"], {}, [b"ab"], [[256, 256]]),
        ([b"ab" * 6], {}, [b"ab", b"abab"], [[257] * 3]),
        ([b"ab" * 6], {"max_token_length": 3}, [b"ab"], [[256] * 6]),
        ([b"ab" * 6], {"max_token_id": 256}, [b"ab"], [[256] * 6]),
        ([b"ab", b"ab"], {}, [b"ab"], [[256], [256]]),
        ([b"a", b"b", b"a", b"b"], {}, [], [[97], [98], [97], [98]]),
        (["éé".encode()], {}, [b"\xc3\xa9"], [[256, 256]]),
        (["世".encode()], {}, [], [[228, 184, 150]]),
    ],
)
def test_goldens(rows, options, new, ids):
    tokens, found = parse(rows, Config(**options))
    assert tokens[256:] == new and tokens[:256] == identity_tokens() and found == ids


def test_permutations():
    assert sampling.permutation(2) == [0, 1]
    assert sampling.permutation(3) == [1, 0, 2]
    assert sampling.permutation(5) == [1, 4, 2, 0, 3]
    assert sampling.permutation(6) == [4, 2, 1, 3, 0, 5]
    assert sampling.permutation(8) == [0, 3, 6, 7, 4, 5, 2, 1]


def test_template_keys():
    line = b"[2025-09-12T12:00:00Z] INFO client=10.1.2.3 req=550e8400-e29b-41d4-a716-446655440000 status=500"
    assert template_key(line) == b"2025-09-12t12:00:00z info client=<IP> req=<UUID> status=<NUM>"
    assert template_key(b"2025-09-12 20250912 [] a= =b x=[1] 1.2.3.256 0001.2.3.4 12:30") == b"<HEX> <HEX> <*> a= =b x=[1 <NUM> <IP> <NUM>"
    assert template_key(b"") == template_key(b" \t ") == b""
    assert template_key(b"a\xc2\xa0b c", 2) == b"a b"
    assert template_key(b"X" * 40) == b"x" * 32


def test_stratified_sample():
    rows = [f"INFO service=a status=20{i} dur={i}{i}" for i in range(3)] + [f"WARN service=b timeout={i}00 host=10.0.0.{i}" for i in range(3)]
    keys = [template_key(r.encode()) for r in rows]
    assert len(set(keys)) == 2
    assert sampling.stratified_order(keys, [32, 32, 32, 41, 41, 41], 73, 8) == [0, 3]
    assert sampling.quotas([5, 3, 2], 4) == [(0, 2), (2, 1), (1, 1)] or sum(q for _, q in sampling.quotas([5, 3, 2], 4)) == 4
    assert sampling.budget_prefix([5, 5, 5], 6) == 2


def test_config_rules():
    assert Config(max_token_id=10).last_id == 255 and Config().last_id == 65535 and Config(token_bits=12).last_id == 4095
    assert Config(token_bits=7).bits == 16 and Config(sample_bytes=-1).budget == 1 << 20 and Config(max_clusters=0).clusters == 2048
    assert Config().pair_threshold(1 << 20) == 2 and Config().pair_threshold(8 << 20) == 3 and Config(threshold=9).pair_threshold(1) == 9
    with pytest.raises(ValueError):
        Config(threshold=70000)
    with pytest.raises(UntrainedModelError):
        Model().encode_literal("x")
    assert issubclass(ShortBufferError, ValueError)


def test_crowded_bucket():
    m = Matcher(16)
    fits = [m.insert(b"abcdefgh" + struct.pack(">H", i), 256 + i) for i in range(CROWD + 2)]
    assert fits == [True] * CROWD + [False] * 2
    assert Matcher(0).insert(b"abcdefghi", 256)
    long = Matcher(0, [*identity_tokens(), b"abcdefgh1", b"abcdefgh12"])
    assert long.find(b"abcdefgh123", 0) == (257, 10) and long.find(b"abcdefgh", 0) == (97, 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.sampled_from(CONFIGS))
def test_round_trip_of_any_bytes(rows, config):
    rows = rows + [a + b for a, b in zip(rows, rows[1:])]
    tokens, ids = parse(rows, config)
    assert [b"".join(tokens[i] for i in x) for x in ids] == rows
    assert load_rows(dump(ids, tokens, config.bits)) == rows


def test_payloads():
    ids = np.array([256, 256])
    assert wire.raw16(ids).hex() == "0200000000010001"
    assert wire.packed12(ids).hex() == "02000000000110"
    assert wire.coded(ids, 16).hex() == "02000000010000010000"
    assert wire.rows_section([0, 2]).hex() == "0200000000000000000000000100000002"
    params, data = wire.bounds_section([*range(257), 258])
    assert params == bytes([wire.BOUNDS_DELTA]) and len(data) == 269
    assert wire.bounds_section([0, 1, 2, 3, 5, 8, 13, 21])[0] == bytes([5]) and wire.bounds_section([0, 4294967295])[0] == bytes([4])
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 100, 1001):
        ids = np.array([rng.randrange(4096) for _ in range(n)], np.int64)
        assert (wire.unpacked12(wire.packed12(ids)) == ids).all() and (wire.unraw16(wire.raw16(ids)) == ids).all()
        assert (wire.uncoded(wire.coded(ids, 12), 12) == ids).all()
    many = np.arange(60000) % 300 * 200
    assert (wire.uncoded(wire.coded(many, 16), 16) == many).all()


@pytest.mark.parametrize(
    "read, data",
    [
        (lambda d: wire.uncoded(d, 16), bytes.fromhex("010000000100070001")),
        (lambda d: wire.read_tokens(bytes([3]), d), bytes([0, 1, 2, 3])),
        (lambda d: wire.read_tokens(bytes([9]), d), b""),
        (lambda d: wire.unpacked12(d), bytes.fromhex("01000000ffff")),
        (lambda d: wire.unraw16(d), bytes.fromhex("0200000001")),
        (lambda d: wire.read_rows(bytes([1]), d), bytes.fromhex("02000000")),
        (lambda d: wire.read_bounds(bytes([5]), d), bytes.fromhex("0300000000000000010000000101")),
        (lambda d: wire.packed12(np.array([4096])), b""),
    ],
)
def test_bad_payloads(read, data):
    with pytest.raises(CorruptArchiveError):
        read(data)


def _archive():
    rows = [b"alpha", b"beta", b"gamma", b"delta"]
    tokens, ids = parse(rows, Config())
    return dump(ids, tokens, 16), rows


def test_damaged_archives_never_pass_silently_as_something_else():
    blob, rows = _archive()
    extra = wire.section("unknown.stage", b"\x42", b"\x01\x02\x03\x04")
    grown = blob[:6] + struct.pack("<H", 5) + blob[8:] + extra
    assert load_rows(grown) == rows and load_rows(blob + b"tail") == rows
    with pytest.raises(CorruptArchiveError, match=r"offset \d+ .*stage index 3"):
        wire.loads(blob[:-1])
    with pytest.raises(CorruptArchiveError, match="missing"):
        wire.loads(wire.MAGIC + struct.pack("<HH", 2, 1) + wire.section("unknown.only", b"", b""))
    with pytest.raises(CorruptArchiveError):
        wire.loads(wire.MAGIC + struct.pack("<HH", 2, 1) + struct.pack("<BHI", 1, 0, (1 << 30) + 1) + b"x")
    for at, value in ((0, 0), (4, 9), (6, 0), (6, 65)):
        with pytest.raises(CorruptArchiveError):
            wire.loads(blob[:at] + bytes([value]) + blob[at + 1 :])
    doubled = blob[:6] + struct.pack("<H", 5) + blob[8:] + wire.section("dictionary", b"", struct.pack("<I", 0))
    with pytest.raises(CorruptArchiveError, match="twice"):
        wire.loads(doubled)
    rng = random.Random(2)
    for _ in range(300):
        i = rng.randrange(len(blob))
        damaged = blob[:i] + bytes([blob[i] ^ 1 << rng.randrange(8)]) + blob[i + 1 :]
        try:
            load_rows(damaged)
        except CorruptArchiveError:
            pass


@pytest.mark.parametrize("name", ["tokens", "rows", "dictionary", "bounds", "bits", "params"])
def test_six_kinds_of_corruption(name):
    """One field of a sound archive changed, in memory and on the wire: never anything but rows or a clear error."""
    rng = random.Random(name)
    blob, rows = _archive()
    for _ in range(60):
        good = wire.loads(blob)
        if name == "tokens":
            good.tokens = good.tokens.copy()
            good.tokens[rng.randrange(len(good.tokens))] = rng.choice([-1, 300, 65535, 1 << 20])
        elif name == "rows":
            good.rows[rng.randrange(len(good.rows))] = rng.choice([0, 1, 1 << 28, -1])
        elif name == "dictionary":
            good.dictionary = good.dictionary[: rng.randrange(len(good.dictionary))]
        elif name == "bounds":
            good.bounds[rng.randrange(len(good.bounds))] = rng.choice([0, 1 << 30, 7])
        elif name == "bits":
            good.bits = rng.choice([1, 8, 13, 17])
        else:
            at = blob.index(wire.TOKENS.encode()) + len(wire.TOKENS)
            with pytest.raises(CorruptArchiveError):
                wire.loads(blob[:at] + bytes([rng.choice([0, 1, 6, 11, 16, 255])]) + blob[at + 1 :])
            continue
        try:
            assert len(load_rows(wire.dumps(good))) == len(rows)
        except CorruptArchiveError:
            pass


def test_smallest_encoding_wins():
    """Repetitive rows get a deflated codebook at either width, never the raw ids; ids without a pattern get raw ones."""
    for line, ways in (("GET /api/v1/users/42 HTTP/1.1", {5, 15}), ("GET /api/v1/users/{} HTTP/1.1", {3, 5, 13, 15})):
        rows = [line.format(i % 7).encode() for i in range(30_000)]
        for config in (Config(), Config(token_bits=12)):
            _, ids = parse(rows, config)
            flat = np.array([i for x in ids for i in x])
            sizes = {p: len(d) for p, d in wire.token_candidates(flat, config.bits)}
            assert wire.tokens_section(flat, config.bits)[0][0] == min(sizes, key=sizes.get) in ways
    noise = np.random.default_rng(1).permutation(65536)
    assert wire.tokens_section(noise, 16)[0][0] == wire.RAW_16


def test_contradictions():
    for change in ({"bits": 13}, {"rows": []}, {"rows": [1]}, {"rows": [0, 2, 1]}, {"rows": [0, 9]}, {"bounds": [1]}, {"bounds": [0, 3]}, {"tokens": np.array([5])}):
        good = {"tokens": np.array([0]), "rows": [0, 1], "dictionary": b"ab", "bounds": [0, 1, 2], "bits": 16}
        wire.validate(wire.Blob(**good))
        with pytest.raises(CorruptArchiveError):
            wire.validate(wire.Blob(**good | change))


def test_long_and_repetitive_rows():
    row = b"abcdefghijklmnopqrstuvwxyz0123456789"
    for config in CONFIGS:
        tokens, ids = parse([row] * 200, config)
        assert all(b"".join(tokens[i] for i in x) == row for x in ids)
        assert sum(map(len, ids)) < 200 * len(row) / 4
        if config.max_token_length:
            assert max(map(len, tokens)) <= config.max_token_length
