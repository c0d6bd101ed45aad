"""Secret scans with one deterministic automaton for all rules.

Each rule has a *trigger* (the shortest text that decides a match has begun) and a *whole* expression. All triggers are
compiled together - subset construction, minimisation, transition arrays - into one automaton that reads every byte
once. Where it accepts, the trigger's reversed automaton finds the start and the rule's own anchored automaton the
greedy end; both only run at hits. Matches are leftmost and non-overlapping per kind, and a match that fails its length
test still uses up its text, exactly as a search with that expression would.

Edge cases: null text counts as empty (no spans); offsets are code points, end exclusive; texts of any length are
scanned whole with constant extra memory; ties cannot occur within a kind, and across kinds the listed order decides;
repeated rows get equal results; an empty table gives an empty result; extra columns are not read. "In either case" means
A-Z only: letters that other engines fold onto them (U+017F, U+212A) do not match.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import automaton
from .common import by_batch, text_of


@dataclass(frozen=True)
class Rule:
    """trigger: a prefix of whole that ends at the first character of the part that may go on. least: characters that
    this last part (tail=True) or the whole match must have."""

    kind: str
    trigger: str
    whole: str
    least: int = 0
    tail: bool = False


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", _ASSIGN + _VALUE, _ASSIGN + _VALUE + "+", 6, True),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", 24),
)
#: What this method adds to the base kinds.
MORE = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9]", r"xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]*", 15),
    Rule("cloud", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", 39),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        triggers = [automaton.parse(r.trigger) for r in rules]
        self.scan = automaton.Dfa(triggers, anywhere=True)
        self.back = [automaton.Dfa([automaton.reverse(t)]) for t in triggers]
        self.whole = [automaton.Dfa([automaton.parse(r.whole)]) for r in rules]

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """Positions at which the one pass over the bytes accepts, with the state. A run of one accepting state (the
        middle of a long run of digits, say) is reported at its first byte only."""
        out: list[tuple[int, int]] = []
        s, table, accepting, was = self.scan.start, self.scan.table, self.scan.accepting, -1
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= accepting:
                if s != was:
                    out.append((i, s))
                was = s
            else:
                was = -1
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule."""
        used = [0] * len(self.rules)
        out = []
        for i, s in self.hits(data):
            mask = self.scan.rules[s]
            for r, rule in enumerate(self.rules):
                if not mask >> r & 1 or i < used[r]:
                    continue
                start = self._start(r, data, i, used[r])
                if start < 0:
                    continue
                end = used[r] = self.whole[r].longest(data, start)
                if (end - i if rule.tail else end - start) >= rule.least:
                    out.append((start, end, r))
        out.sort(key=lambda x: (x[0], x[2]))
        return out

    def _start(self, r: int, data: bytes, i: int, floor: int) -> int:
        """Leftmost start, not before floor, of a trigger match that ends with byte i."""
        dfa, start = self.back[r], -1
        s, table, accepting = dfa.start, dfa.table, dfa.accepting
        while i >= floor:
            s = table[s + data[i]]
            if not s:
                break
            if s >= accepting:
                start = i
            i -= 1
        return start


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if data.isascii():
        return spans
    edges = sorted({x for a, b, _ in spans for x in (a, b)})
    at, seen, to = 0, 0, {}
    for e in edges:
        piece = data[at:e]
        seen += len(piece) - sum(0x80 <= b < 0xC0 for b in piece) if not piece.isascii() else len(piece)
        at, to[e] = e, seen
    return [(to[a], to[b], r) for a, b, r in spans]


def find(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans ARRAY<STRUCT<kind, start, end>> of every whole text. Row-local: no exchange."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, out = scanner(rules), []
        for t in batch.column(1):
            data = t.as_py() or b""
            out.append([{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in _points(data, scan.spans(data))])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column(0), pa.array(out, kind)], names=[key, "spans"])

    return by_batch(text_of(df, key, text=text), run, f"`{key}` {dict(df.dtypes)[key]}, spans array<struct<kind:string,start:long,end:long>>")


def redact(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text (overlaps joined) replaced by ``mark``; all columns and rows stay, null stays null.
    The text column's name must be unique in df; other columns may be called anything."""
    names, at = df.columns, df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, out = scanner(rules), []
        for t in batch.column(at):
            data = t.as_py()
            if data is not None:
                data = data.encode("utf-8", "surrogatepass")
                spans = scan.spans(data)
                if spans:
                    parts, last = [], 0
                    for a, b, _ in spans:
                        if a >= last:
                            parts += [data[last:a], mark.encode()]
                        last = max(last, b)
                    data = b"".join([*parts, data[last:]])
                data = data.decode("utf-8", "replace")
            out.append(data)
        columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.record_batch(columns, names=names)

    return by_batch(df, run, df.schema)


def digests(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 (over the base kinds' kind:start:end), spans (all kinds)."""
    base = len(BASE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, n, sha, text_ = scanner(rules), [[], [], []], [], []
        for t in batch.column(1):
            data = t.as_py() or b""
            spans = scan.spans(data)
            spans = _points(data, spans) if spans else spans
            said = [f"{rules[r].kind}:{a}:{b}" for a, b, r in spans]
            for k in range(base):
                n[k].append(sum(r == k for _, _, r in spans))
            sha.append(hashlib.sha256(",".join(s for s, x in zip(said, spans) if x[2] < base).encode()).hexdigest())
            text_.append(",".join(said))
        return pa.record_batch([batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha), pa.array(text_)], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return by_batch(text_of(df, key, text=text), run, f"`{key}` {dict(df.dtypes)[key]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
