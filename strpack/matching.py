"""Longest-prefix matching against a token dictionary (plain Python: it runs inside Arrow tasks)."""

from __future__ import annotations

from collections.abc import Sequence

HEAD = 8
CROWD = 128


def _add(sizes: list[int], n: int) -> None:
    if n not in sizes:
        sizes.append(n)
        sizes.sort(reverse=True)


class Matcher:
    """Tokens of up to HEAD bytes are one dict, with the lengths that occur for each two-byte start. Longer ones form a
    tree whose edges are HEAD bytes; a node holds what is left of the tokens that end there (1 to HEAD bytes). So a
    match takes a few lookups for each HEAD bytes it covers, however many tokens share a start."""

    def __init__(self, max_token_length: int = 0, tokens: Sequence[bytes] = ()):
        self.crowd = CROWD if max_token_length == 16 else 0
        self.short: dict[bytes, int] = {}
        self.sizes: dict[bytes, list[int]] = {}  # by two-byte start: lengths of short tokens, longest first
        self.long: dict[bytes, tuple[list[int], dict[bytes, int], dict]] = {}  # nodes: lengths of ends, longest first; ends; nodes below
        self.starts: dict[bytes, int] = {}  # long tokens by start, counted only where their number is limited
        for i, t in enumerate(tokens):
            self.insert(t, i)

    def insert(self, token: bytes, token_id: int) -> bool:
        """False if the place for tokens with this start is full; the caller then gives the id to another token."""
        n = len(token)
        if n > HEAD:
            if self.crowd:
                there = self.starts.get(token[:HEAD], 0)
                if there >= self.crowd:
                    return False
                self.starts[token[:HEAD]] = there + 1
            at, below = 0, self.long
            while n - at > HEAD:
                node = below.setdefault(token[at : at + HEAD], ([], {}, {}))
                at, below = at + HEAD, node[2]
            node[1].setdefault(token[at:], token_id)
            _add(node[0], n - at)
        elif n > 1:
            self.short[token] = token_id
            _add(self.sizes.setdefault(token[:2], []), n)
        return True

    def _longer(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(token id, length) of the longest token of over HEAD bytes at this place."""
        node, end = self.long.get(data[at : at + HEAD]), at + HEAD
        path = []
        while node is not None:
            path.append(node)
            node, end = node[2].get(data[end : end + HEAD]) if node[2] else None, end + HEAD
        for sizes, ends, _ in reversed(path):
            end -= HEAD
            for n in sizes:
                token_id = ends.get(data[end : end + n])
                if token_id is not None:
                    return token_id, min(end + n, len(data)) - at  # a slice cut off by the row's end is a shorter token
        return None

    def find(self, data: bytes, at: int) -> tuple[int, int]:
        """(token id, length) of the longest token at this place; a single byte always matches."""
        left = len(data) - at
        if left > HEAD and data[at : at + HEAD] in self.long and (found := self._longer(data, at)):
            return found
        for n in self.sizes.get(data[at : at + 2], ()):
            token_id = self.short.get(data[at : at + n])  # a slice cut off by the row's end is shorter than any match
            if token_id is not None and n <= left:
                return token_id, n
        return data[at], 1

    def parse(self, data: bytes) -> list[int]:
        """Greedy parse of a whole row."""
        out, at, n = [], 0, len(data)
        long, longer, short, sizes = self.long, self._longer, self.short, self.sizes
        while at < n:
            if n - at > HEAD and data[at : at + HEAD] in long and (found := longer(data, at)):
                out.append(found[0])
                at += found[1]
                continue
            for size in sizes.get(data[at : at + 2], ()):
                piece = data[at : at + size]
                if piece in short and at + size <= n:
                    out.append(short[piece])
                    at += size
                    break
            else:
                out.append(data[at])
                at += 1
        return out


def identity_tokens() -> list[bytes]:
    return [bytes([i]) for i in range(256)]
