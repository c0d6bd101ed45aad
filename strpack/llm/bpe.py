"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

Every prefix of a word has exactly one BPE encoding, so one number per prefix - its last token - describes all of them.
A suffix automaton (Aho-Corasick over the vocabulary) lists the tokens that end at a prefix; the right one is the only
token ``t`` for which (last token of the prefix before ``t``, ``t``) is a pair that BPE would leave apart. Following the
back-pointers from the end gives the exact ids, in time linear in the word, without replaying merges.

Texts are worked off in pieces: the borders of all words of a piece come from the kinds of its characters in a few passes
over its bytes, each distinct word is encoded once, and Arrow gathers the ids.

Results for edge cases: null text counts as empty (no ids); an empty text has no ids and decodes to ''; special tokens
in a text are matched first, as the tokenizers library does; words of any length are one dynamic program; ties cannot
occur, as a prefix has one encoding; repeated rows get equal results; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.codec import lengths, pieces
from .common import by_batch, text_of

#: White space as the tokenizer's own regex engine sees it (the Unicode property), spelled out.
_WS = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Kinds of characters. A word is one of 's 't 're 've 'm 'll 'd at its start, a run of one kind other than white space with
#: the one space before it, or white space: without its last character where something else follows.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of texts that are split into words at one time; a single text may have more.
PIECE = 1 << 21
#: Words (of at most MEMO_BYTES) and pairs of tokens that each half of a task's memory holds; it only saves time.
MEMO_WORDS = 150_000
MEMO_BYTES = 40
MEMO_PAIRS = 300_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """The kind of each code point."""
    import regex

    out, every = np.full(0x110000, OTHER, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{_WS}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _joined(table: pa.Array, ids: np.ndarray, ends: np.ndarray, between: bytes) -> pa.Array:
    """What a table has for each list of ids, joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), table.take(pa.array(ids))), pa.scalar(between, pa.large_binary()))


class Bpe:
    """A vocabulary file (tokenizers JSON, byte level) with its automaton; encode and decode are exact inverses on UTF-8."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        of, vocab = _byte_of_char(), spec["model"]["vocab"]
        raw = {t: bytes(of[c] for c in t) for t in vocab}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in vocab.items()}
        # Ranks: single bytes first, then merges in order. The algorithm runs on ranks; ids are looked up at the end.
        singles = [raw[t] for t in vocab if len(raw[t]) == 1]
        self.rank: dict[bytes, int] = {b: k for k, b in enumerate(singles)}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(k, k) for k in range(len(singles))]
        self.token: list[bytes] = list(singles)
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = self.rank[raw[a]], self.rank[raw[b]], raw[a] + raw[b]
            if whole in self.rank:  # a second way to a known token never wins as such; it still merges
                self.pair[left, right] = self.rank[whole]
                continue
            self.pair[left, right] = self.rank[whole] = len(self.token)
            self.token.append(whole)
            self.split.append((left, right))
        ids = {raw[t]: i for t, i in vocab.items()}
        self.id_of = [ids[t] for t in self.token]
        self.size = [len(t) for t in self.token]
        self.single = {t[0]: k for k, t in enumerate(singles)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.fixed = {t.encode(): array("i", [i]).tobytes() for t, i in self.special.items()}
        self.special_in = re.compile(b"|".join(map(re.escape, sorted(self.fixed, key=len, reverse=True)))) if self.fixed else None
        texts = [self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)]
        self.texts = pa.array(texts, pa.large_binary())
        self.names = pa.array([str(i).encode() for i in range(len(texts))], pa.large_binary())
        self.kinds = _kinds()
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.token):
            if len(t) > 1 and self._apart(*self.split[k], limit=k):  # single bytes need no automaton
                self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.known: dict[int, bool] = {}

    def _apart(self, a: int, b: int, limit: int = 1 << 31) -> bool:
        """Whether BPE leaves tokens a and b side by side: undo merges on either side of the border, latest first, and
        look for an earlier merge that would have crossed it. limit: only merges before this one count."""
        pair, split = self.pair, self.split
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def forget(self) -> None:
        self.memo, self.old, self.known = {}, {}, {}

    def encode_word(self, word: bytes) -> bytes:
        """The ids of a word, four bytes each."""
        size, known, rank, last, done = self.size, self.known, self.single, [], 0
        for end, k in self.automaton.iter(word.decode("latin-1")):  # longest match first at every end
            if end < done:
                continue
            before = end - size[k]
            if before >= done:  # prefixes where no longer token ends: one way is left, the single byte
                last.extend([rank[x] for x in word[done : before + 1]])
                done = before + 1
            if before >= 0:
                p = last[before] << 20 | k
                ok = known.get(p)
                if ok is None:
                    if len(known) >= MEMO_PAIRS:
                        known.clear()
                    ok = known[p] = self._apart(last[before], k)
                if not ok:
                    continue
            if end > done:
                last.extend([rank[x] for x in word[done:end]])
            last.append(k)
            done = end + 1
        last.extend([rank[x] for x in word[done:]])
        out, i, id_of = [], len(word) - 1, self.id_of
        while i >= 0:
            k = last[i]
            out.append(id_of[k])
            i -= size[k]
        out.reverse()
        return array("i", out).tobytes()

    def _word(self, word: bytes) -> bytes:
        """By memory of the last words: a young and an old half, so that frequent words stay."""
        ids = self.old.get(word) or self.fixed.get(word)
        if ids is None:
            ids = self.encode_word(word)
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.old, self.memo = self.memo, {}
            self.memo[word] = ids
        return ids

    def starts(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where words start in valid UTF-8; heads: where texts start."""
        n, raw = len(data), memoryview(data)
        fixed: list[tuple[int, int]] = []
        if self.special_in and self.special_in.search(raw):
            ends = [*heads.tolist()[1:], n]
            fixed = [m.span() for x, y in zip(heads.tolist(), ends) for m in self.special_in.finditer(raw, x, y)]
        kind = self.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        size = np.searchsorted([0xE0, 0xF0], data[lead], "right") + 1
        for more in (1, 2, 3):
            at = lead[size == more]
            point = data[at].astype(np.int32) & (0x3F >> more)
            for j in range(1, more + 1):
                point = point << 6 | data[at + j] & 0x3F
            found = self.kinds[point]
            for j in range(more + 1):
                kind[at + j] = found
        cut = np.zeros(n + 1, bool)
        cut[heads] = cut[n] = True
        for x, y in fixed:
            cut[x] = cut[y] = True
        mark = cut.copy()
        mark[1:n] |= kind[1:] != kind[:-1]
        blank = kind == SPACE
        after = np.flatnonzero(blank[:-1] & ~blank[1:] & ~cut[1:n]) + 1  # white space ends here, the text goes on
        last = after - 1
        for _ in range(3):
            last -= data[last] >> 6 == 2  # to the first byte of a character
        mark[last] = True
        mark[after[data[last] == 0x20]] = False
        at = np.flatnonzero(data[:-1] == 0x27)
        at = at[mark[at] & ~cut[at + 1]]
        one = at[np.isin(data[at + 1], np.frombuffer(b"stmd", np.uint8))]
        at = at[at + 2 < n]
        at = at[~cut[at + 2]]
        two = at[np.isin(data[at + 1].astype(np.int32) << 8 | data[at + 2], [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
        for found, size in ((one, 2), (two, 3)):
            mark[found + 1] = False
            mark[found + size] = True
        for x, y in fixed:
            mark[x + 1 : y] = False
        return np.flatnonzero(mark[:n])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (binary; null counts as empty) one after the other, and where each text's begin and the last one's end."""
        try:
            texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([str(t or b"", "utf-8", "replace").encode() for t in texts.to_pylist()], pa.binary())
        ends = np.concatenate([[0], np.cumsum(lengths(texts))])
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts, b"")), b"")[0].as_buffer(), np.uint8)
        if not len(data):
            return np.empty(0, np.int32), ends
        starts = self.starts(data, ends[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        place = words.indices.to_numpy()
        ids = [self.memo.get(w) or self._word(w) for w in words.dictionary.to_pylist()]
        n = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        flat = known.take(words.indices).flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(n[place], dtype=np.int64)])
        return flat, total[np.searchsorted(starts, ends)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text.encode("utf-8", "replace")], pa.binary()))[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts behind the results of ``encode_all``."""
        return [str(t.as_buffer(), "utf-8", "replace") for t in _joined(self.texts, ids, ends, b"")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    """The vocabulary at a path. A task whose machine keeps the file elsewhere finds it by name in the installed package."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    gc.set_threshold(200_000, 20, 20)  # the memory holds no cycles; the default would scan it all the time
    return Bpe(path)


def _encoded(bpe: Bpe, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and borders of the texts of a batch, a piece at a time."""
    texts = texts.cast(pa.binary())
    for start, n in pieces(lengths(texts) + 8, PIECE):
        yield bpe.encode_all(texts.slice(start, n))


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([i for i, _ in parts])))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids ARRAY<INT> of every whole text; null text has no ids. Row-local: no exchange at any scale."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), _lists(list(_encoded(load(path), batch.column(1))))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return by_batch(text_of(df, key, text=text), run, f"`{key}` {kind}, ids array<int>", lambda: load(path).forget())


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the inverse of encode. A null list stays null; an id outside the vocabulary is an error."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(df.dtypes)[key]
    return by_batch(df.select(key, ids), run, f"`{key}` {kind}, text string")


def coded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: key, n_tokens, ids ARRAY<INT>, decoded_sha256 (of the decoded text in UTF-8)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, parts, sums = load(path), [], []
        for ids, ends in _encoded(bpe, batch.column(1)):
            parts.append((ids, ends))
            sums += [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode_all(ids, ends)]
        lists = _lists(parts)
        return pa.record_batch([batch.column(0), pc.list_value_length(lists).cast(pa.int64()), lists, pa.array(sums, pa.string())], names=[key, "n_tokens", "ids", "decoded_sha256"])

    kind = dict(df.dtypes)[key]
    return by_batch(text_of(df, key, text=text), run, f"`{key}` {kind}, n_tokens long, ids array<int>, decoded_sha256 string", lambda: load(path).forget())


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and reduce both to digests in the same pass: key, n_tokens, ids_sha256, decoded_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, a, b = load(path), [], [], []
        for ids, ends in _encoded(bpe, batch.column(1)):
            n += np.diff(ends).tolist()
            a += [hashlib.sha256(t.as_buffer()).hexdigest() for t in _joined(bpe.names, ids, ends, b",")]
            b += [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode_all(ids, ends)]
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[key]
    return by_batch(text_of(df, key, text=text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: load(path).forget())
