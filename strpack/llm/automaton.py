"""A small regular-expression compiler over bytes: parse, Thompson's NFA, subset construction, Hopcroft-style
minimisation, transition arrays. Syntax: literals, ``.``, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``,
``{m,}``, ``{m,n}``, ``\\xHH`` and escaped punctuation, and ``(?i:...)`` for letters in either case."""

from __future__ import annotations

ALL = frozenset(range(256))


class _Parser:
    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def parse(self):
        node = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def either(self):
        ways = [self.row()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            ways.append(self.row())
        return ways[0] if len(ways) == 1 else ("or", ways)

    def row(self):
        items = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            items.append(self.repeated())
        return ("row", items)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                m, n = int(low), (int(high) if high else None) if comma else int(low)
            else:
                m, n = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, m, n)
        return node

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            fold = self.fold
            self.i += 1
            if self.s.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.s.startswith("?:", self.i):
                self.i += 2
            node = self.either()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i, self.fold = self.i + 1, fold
            return node
        if c == "[":
            return ("set", self.char_class())
        self.i += 1
        if c == ".":
            return ("set", ALL)
        return ("set", self.folded({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def char_class(self) -> frozenset[int]:
        self.i += 1
        out: set[int] = set()
        negate = self.s[self.i] == "^"
        self.i += negate
        first = True
        while first or self.s[self.i] != "]":
            first = False
            c = self.s[self.i]
            self.i += 1
            low = self.escaped() if c == "\\" else ord(c)
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                d = self.s[self.i]
                self.i += 1
                out.update(range(low, (self.escaped() if d == "\\" else ord(d)) + 1))
            else:
                out.add(low)
        self.i += 1
        return ALL - out if negate else self.folded(out)

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {x ^ 32 for x in chars if chr(x).isascii() and chr(x).isalpha()}
        return frozenset(chars)


def reverse(node):
    """The tree that matches the same strings backwards."""
    kind = node[0]
    if kind == "row":
        return ("row", [reverse(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), node[2], node[3]) if kind == "rep" else node


def parse(pattern: str):
    return _Parser(pattern).parse()


class Dfa:
    """Minimal automaton of several rules. ``table[state + byte]`` is the next state; states are multiples of 256, 0 is
    dead, ``start`` starts; states from ``accepting`` on accept, and ``rules[state]`` is the bit mask of their rules."""

    def __init__(self, trees: list, anywhere: bool = False):
        eps: list[list[int]] = []
        step: list[tuple[frozenset[int], int] | None] = []

        def state() -> int:
            eps.append([])
            step.append(None)
            return len(eps) - 1

        def build(node, a: int) -> int:
            kind = node[0]
            if kind == "set":
                b = state()
                c = state()
                eps[a].append(c)
                step[c] = (node[1], b)
                return b
            if kind == "row":
                for x in node[1]:
                    a = build(x, a)
                return a
            if kind == "or":
                b = state()
                for x in node[1]:
                    c = state()
                    eps[a].append(c)
                    eps[build(x, c)].append(b)
                return b
            _, x, m, n = node
            for _ in range(m):
                a = build(x, a)
            if n is None:
                loop, b = state(), state()
                eps[a].append(loop)
                eps[build(x, loop)].append(loop)
                eps[loop].append(b)
                return b
            b = state()
            eps[a].append(b)
            for _ in range(n - m):
                a = build(x, a)
                eps[a].append(b)
            return b

        root = state()
        final: dict[int, int] = {}
        for r, tree in enumerate(trees):
            c = state()
            eps[root].append(c)
            final[build(tree, c)] = 1 << r

        def closure(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for y in eps[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return frozenset(x for x in seen if step[x] or x in final)

        first = closure([root])
        names, rows, masks = {frozenset(): 0, first: 1}, [[0] * 256, None], [0, 0]
        order = [frozenset(), first]
        if anywhere:
            rows[0] = None
            names, order, rows, masks = {first: 0}, [first], [None], [0]
        k = 0
        while k < len(order):
            if rows[k] is None:
                moves: list[set[int]] = [set() for _ in range(256)]
                for x in order[k]:
                    if step[x]:
                        for b in step[x][0]:
                            moves[b].add(step[x][1])
                row, known = [0] * 256, {}
                for b in range(256):
                    key = frozenset(moves[b])
                    if key not in known:
                        to = closure(key) | (first if anywhere else frozenset())
                        if to not in names:
                            names[to] = len(order)
                            order.append(to)
                            rows.append(None)
                            masks.append(0)
                        known[key] = names[to]
                    row[b] = known[key]
                rows[k] = row
            mask = 0
            for x in order[k]:
                mask |= final.get(x, 0)
            masks[k] = mask
            k += 1
        self._minimise(rows, masks, 0 if anywhere else 1)

    def _minimise(self, rows: list[list[int]], masks: list[int], start: int) -> None:
        """Partition refinement: blocks split until all members of a block agree on every byte."""
        block = {m: i for i, m in enumerate(dict.fromkeys(masks))}
        of = [block[m] for m in masks]
        count = len(block)
        while True:
            seen: dict[tuple, int] = {}
            new = [seen.setdefault((of[k], *[of[t] for t in row]), len(seen)) for k, row in enumerate(rows)]
            of = new
            if len(seen) == count:
                break
            count = len(seen)
        first_of: dict[int, int] = {}
        for k, b in enumerate(of):
            first_of.setdefault(b, k)
        # Order: the block of state 0 first (dead, or the start of an automaton that matches anywhere), accepting last.
        blocks = sorted(first_of, key=lambda b: (b != of[0], masks[first_of[b]] != 0, first_of[b]))
        place = {b: i * 256 for i, b in enumerate(blocks)}
        self.table = [place[of[t]] for b in blocks for t in rows[first_of[b]]]
        self.rules = {place[b]: masks[first_of[b]] for b in blocks}
        self.accepting = min((s for s, m in self.rules.items() if m), default=len(blocks) * 256)
        self.start = place[of[start]]
        self.states = len(blocks)

    def longest(self, data: bytes, at: int = 0) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        s, table, accepting, end = self.start, self.table, self.accepting, -1
        if s >= accepting:
            end = at
        for i in range(at, len(data)):
            s = table[s + data[i]]
            if not s:
                break
            if s >= accepting:
                end = i + 1
        return end
