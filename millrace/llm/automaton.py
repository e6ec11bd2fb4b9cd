"""Regular expressions over bytes compiled to one deterministic automaton.

A rule is parsed to a nondeterministic automaton; all rules together are turned by subset construction
into one deterministic automaton that looks for every rule at every position, and that is minimised
by partition refinement. Transitions lie in one flat list: next = table[state + byte], with states
already multiplied by 256 and accepting states numbered last, so the scan is one look-up and one
comparison a byte.

Supported syntax: literals, escapes (\\d \\w \\s \\. \\xHH), classes, groups, |, ?, *, +, {m}, {m,},
{m,n}. Matching is on bytes; a rule can be marked as case-insensitive in part with (?i:...).
"""

from __future__ import annotations

from collections import defaultdict

_SETS = {"d": b"0123456789", "s": b" \t\n\r\x0b\x0c", "w": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


class _Parser:
    """Recursive descent; each node is ('set', frozenset) | ('cat', [..]) | ('alt', [..]) | ('rep', node, low, high)."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        node = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} in {self.text!r}")
        return node

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                node = ("rep", node, int(low), int(high) if high else (None if "," in self.text[self.at : end] else int(low)))
                self.at = end + 1
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.fold = before
            return node
        if c == "[":
            return self.symbols(self.char_class())
        if c == "\\":
            return self.symbols(self.escape())
        return self.symbols({ord(c)})

    def symbols(self, found: set[int]):
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}
        if max(found) > 255:
            raise ValueError("rules are over bytes")
        return ("set", frozenset(found))

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return {int(self.text[self.at - 2 : self.at], 16)}
        if c in _SETS:
            return set(_SETS[c])
        return {ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))}

    def char_class(self) -> set[int]:
        negated, found = self.peek() == "^", set()
        self.at += negated
        first = True
        while self.peek() != "]" or first:
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.text[self.at + 1] != "]" and len(low) == 1:
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else {ord(c)}
                low = set(range(min(low), max(high) + 1))
            found |= low
        self.take()
        return set(range(256)) - found if negated else found


def _reversed(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    if kind == "rep":
        return ("rep", _reversed(node[1]), node[2], node[3])
    return node


def _shortest(node):
    """node without what it may repeat at its end: its matches end where those of node first do."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    if node[0] == "rep":
        return ("rep", node[1], node[2], node[2])
    return node


class _Nfa:
    def __init__(self):
        self.empty, self.moves, self.accepts = [], [], {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Builds node from start on; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(x, begin)].append(end)
            return end
        _, body, low, high = node
        for _ in range(low):
            start = self.add(body, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop, end]
            self.empty[self.add(body, loop)] += [loop, end]
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(body, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Dfa:
    """table: the flat transition list; accepts: state -> rules that end there; first_accept: the smallest accepting state."""

    def __init__(self, nodes: list, anywhere: bool, limit: int = 50_000):
        nfa = _Nfa()
        root = nfa.state()
        for rule, node in enumerate(nodes):
            begin = nfa.state()
            nfa.empty[root].append(begin)
            nfa.accepts[nfa.add(node, begin)] = rule
        first = nfa.closure({root})
        names, order, rows = {first: 0}, [first], []
        for states in order:  # grows while it is read
            targets = defaultdict(set)
            for s in states:
                for symbols, end in nfa.moves[s]:
                    for b in symbols:
                        targets[b].add(end)
            grouped: dict[frozenset, int] = {}
            row = [0] * 256
            for b in range(256):
                ends = frozenset(targets.get(b, ()))
                if ends not in grouped:
                    whole = nfa.closure(ends | ({root} if anywhere else set()))
                    if whole not in names:
                        if len(names) >= limit:
                            raise ValueError("these rules need too many states; split them")
                        names[whole] = len(names)
                        order.append(whole)
                    grouped[ends] = names[whole]
                row[b] = grouped[ends]
            rows.append(row)
        marks = [tuple(sorted({nfa.accepts[s] for s in states if s in nfa.accepts})) for states in order]
        self._minimise(rows, marks)

    def _minimise(self, rows: list[list[int]], marks: list[tuple]) -> None:
        """Partition refinement: states stay together while they accept alike and move to the same blocks."""
        kinds = {m: k for k, m in enumerate(sorted(set(marks)))}
        block = [kinds[m] for m in marks]
        count = len(kinds)
        while True:
            seen: dict[tuple, int] = {}
            block = [seen.setdefault((block[s], *map(block.__getitem__, rows[s])), len(seen)) for s in range(len(rows))]
            if len(seen) == count:
                break
            count = len(seen)
        member = {b: s for s, b in reversed(list(enumerate(block)))}
        by_accept = sorted(range(count), key=lambda b: (bool(marks[member[b]]), b != block[0], b))
        place = {b: 256 * k for k, b in enumerate(by_accept)}
        self.states = count
        self.start = place[block[0]]
        self.table = [place[block[t]] for b in by_accept for t in rows[member[b]]]
        self.accepts = {place[b]: marks[member[b]] for b in by_accept if marks[member[b]]}
        self.first_accept = min(self.accepts, default=256 * count)
        #: A state that can only stay where it is, or -1.
        self.dead = next((s for s in place.values() if s not in self.accepts and all(t == s for t in self.table[s : s + 256])), -1)

    def longest(self, data: bytes, at: int, step: int, stop: int) -> int | None:
        """From at on, in the direction of step, up to stop: where the longest match ends, if there is one."""
        table, state, dead, first, found = self.table, self.start, self.dead, self.first_accept, None
        while at != stop:
            state = table[state + data[at]]
            at += step
            if state >= first:
                found = at
            elif state == dead:
                break
        return found


class RuleScanner:
    """Finds, for every rule, the leftmost longest non-overlapping matches in one pass over the bytes.

    The combined automaton says where a match of a rule ends first, so what a rule may repeat at its
    end is left out of it; the rule's reversed automaton, run back from there, says where that match
    begins, and its forward automaton how far it reaches.
    A rule must not be able to finish a match strictly inside the first part of another, earlier
    begun match of its own that has not yet been accepted (no rule of the default set can).
    """

    def __init__(self, rules: list[str]):
        nodes = [_Parser(r).parse() for r in rules]
        self.combined = Dfa([_shortest(n) for n in nodes], anywhere=True)
        self.forward = [Dfa([n], anywhere=False) for n in nodes]
        self.backward = [Dfa([_reversed(n)], anywhere=False) for n in nodes]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        table, first, accepts = self.combined.table, self.combined.first_accept, self.combined.accepts
        state, total, found = self.combined.start, len(data), []
        reached = [0] * len(self.forward)
        rest = iter(data)
        left = rest.__length_hint__
        for byte in rest:
            state = table[state + byte]
            if state >= first:
                end = total - left()
                for rule in accepts[state]:
                    if end > reached[rule]:
                        back = self.backward[rule].longest(data, end - 1, -1, reached[rule] - 1)
                        if back is not None:
                            begin = back + 1
                            reached[rule] = self.forward[rule].longest(data, begin, 1, total)
                            found.append((begin, rule, reached[rule]))
        return sorted(found)
