"""Regular expressions over bytes as deterministic automata: parse, subset construction, minimisation.

Supported: literals, ``\\xNN`` and escaped literals, ``[...]`` with ranges and ``^``, groups, ``|``,
``?``, ``*``, ``+``, ``{n}``, ``{n,}`` and ``{n,m}``. Matching is leftmost-longest.
"""

from __future__ import annotations

from dataclasses import dataclass

ALL = frozenset(range(256))


class _Parser:
    """A recursive-descent parser to a tree of ('set', bytes), ('cat', ...), ('or', ...), ('rep', node, least, most)."""

    def __init__(self, text: str) -> None:
        self.text, self.i = text, 0

    def peek(self) -> str:
        return self.text[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.text[self.i - 1]

    def parse(self) -> tuple:
        node = self.choice()
        if self.i < len(self.text):
            raise ValueError(f"unbalanced at {self.i} in {self.text!r}")
        return node

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def repeated(self, node: tuple) -> tuple:
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
        if ord(c) > 127:
            raise ValueError("only ASCII literals")
        return ord(c)

    def atom(self) -> tuple:
        if self.peek() == "(":
            self.take()
            node = self.choice()
            if self.take() != ")":
                raise ValueError("unbalanced group")
            return node
        if self.peek() == "[":
            self.take()
            negated = self.peek() == "^"
            if negated:
                self.take()
            found: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.text[self.i + 1] != "]":
                    self.take()
                    found |= set(range(low, self.byte() + 1))
                else:
                    found.add(low)
            self.take()
            return ("set", ALL - found if negated else frozenset(found))
        return ("set", frozenset((self.byte(),)))


class _Nfa:
    """Thompson's construction; ``step`` has (bytes, target) of each state, ``skip`` its free moves."""

    def __init__(self) -> None:
        self.step: list[tuple[frozenset[int], int] | None] = []
        self.skip: list[list[int]] = []

    def state(self) -> int:
        self.step.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def add(self, node: tuple, start: int) -> int:
        """Adds what ``node`` reads after ``start``; the state where it ends."""
        kind = node[0]
        if kind == "set":
            own, end = self.state(), self.state()
            self.skip[start].append(own)
            self.step[own] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1:]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for option in node[1:]:
                self.skip[self.add(option, start)].append(end)
            return end
        _, body, least, most = node
        for _ in range(least):
            start = self.add(body, start)
        if most is None:
            hub = self.state()
            self.skip[start].append(hub)
            self.skip[self.add(body, hub)].append(hub)
            return hub
        end = self.state()
        self.skip[start].append(end)
        for _ in range(most - least):
            start = self.add(body, start)
            self.skip[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for target in self.skip[todo.pop()]:
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[state + class]`` is the next state; a state is its row's start, so no product is needed.

    Accepting states come last: a state has accepted if it is at least ``accepting``. ``labels`` has
    the bits of the rules that a state accepts; ``dead`` is the state without a way out, or -1.
    """

    classes: bytes
    table: list[int]
    start: int
    accepting: int
    labels: dict[int, int]
    dead: int


def reversed_tree(node: tuple) -> tuple:
    """The tree of what ``node`` matches, read backwards."""
    kind = node[0]
    if kind == "cat":
        return ("cat", *map(reversed_tree, node[:0:-1]))
    if kind == "or":
        return ("or", *map(reversed_tree, node[1:]))
    return ("rep", reversed_tree(node[1]), *node[2:]) if kind == "rep" else node


def compile_rules(patterns: list[str], anywhere: bool, backwards: bool = False) -> Dfa:
    """One minimal automaton for all patterns; with ``anywhere`` a match can begin at any byte. With
    ``backwards`` it reads bytes from the last to the first."""
    nfa = _Nfa()
    root = nfa.state()
    trees = [_Parser(p).parse() for p in patterns]
    ends = {nfa.add(reversed_tree(t) if backwards else t, root): 1 << i for i, t in enumerate(trees)}
    if anywhere:
        again = nfa.state()
        nfa.skip[root].append(again)
        nfa.step[again] = (ALL, root)
    # bytes that no set tells apart are one class
    sets = list({s[0] for s in nfa.step if s})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number: dict[tuple, int] = {}
    classes = bytes(number.setdefault(s, len(number)) for s in signature)
    member = [classes.index(c) for c in range(len(number))]
    width = len(member)
    # subset construction
    first = nfa.closure({root})
    index, rows, todo = {first: 0}, [], [first]
    for states in todo:
        row = []
        for byte in member:
            target = nfa.closure({nfa.step[s][1] for s in states if nfa.step[s] and byte in nfa.step[s][0]})
            if target not in index:
                index[target] = len(index)
                todo.append(target)
            row.append(index[target])
        rows.append(row)
    label = [0] * len(rows)
    for states, i in index.items():
        for s in states:
            label[i] |= ends.get(s, 0)
    # minimisation: split blocks until all states of a block move to the same blocks
    block = label
    count = len(set(block))
    while True:
        number = {}
        block = [number.setdefault((block[i], *(block[t] for t in rows[i])), len(number)) for i in range(len(rows))]
        if len(number) == count:
            break
        count = len(number)
    one = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(one, key=lambda b: (label[one[b]] != 0, b))
    place = {b: k * width for k, b in enumerate(order)}
    table = [place[block[t]] for b in order for t in rows[one[b]]]
    labels = {place[b]: label[one[b]] for b in order}
    accepting = min((s for s, bits in labels.items() if bits), default=len(table))
    dead = next((s for s, bits in labels.items() if not bits and set(table[s : s + width]) == {s}), -1)
    return Dfa(classes, table, place[block[0]], accepting, labels, dead)


def begins(dfa: Dfa, data: bytes) -> list[tuple[int, int]]:
    """(place, bits of the rules) where matches begin, from the last: one pass of a ``backwards`` automaton
    that is ``anywhere``."""
    table, accepting, state, labels = dfa.table, dfa.accepting, dfa.start, dfa.labels
    last = len(data) - 1
    out = []
    for i, c in enumerate(data.translate(dfa.classes)[::-1]):
        state = table[state + c]
        if state >= accepting:
            out.append((last - i, labels[state]))
    return out


def longest(dfa: Dfa, codes: bytes, begin: int) -> int:
    """The end of the longest match from ``begin`` on of an automaton that isn't ``anywhere``; ``begin`` if there is none.
    ``codes`` are the data's classes."""
    table, accepting, dead = dfa.table, dfa.accepting, dfa.dead
    state, end = dfa.start, begin
    for j in range(begin, len(codes)):
        state = table[state + codes[j]]
        if state >= accepting:
            end = j + 1
        elif state == dead:
            break
    return end


def matches_whole(dfa: Dfa, data: bytes) -> bool:
    """Whether an automaton that isn't ``anywhere`` matches all of ``data``."""
    state = dfa.start
    for c in data.translate(dfa.classes):
        state = dfa.table[state + c]
    return state >= dfa.accepting
