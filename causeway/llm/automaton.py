"""Regular expressions over bytes compiled to deterministic automata.

Supported: literals, escapes (``\\xHH`` and quoted punctuation), classes with ranges and negation,
groups, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``. Subset construction runs over
classes of bytes that no expression tells apart; Moore's partition refinement minimises the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

ALL = frozenset(range(256))
# Syntax trees: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)


class _Parser:
    def __init__(self, pattern: str, fold_case: bool):
        self.text, self.at, self.fold = pattern.encode("latin-1"), 0, fold_case

    def peek(self) -> bytes:
        return self.text[self.at : self.at + 1]

    def take(self) -> bytes:
        self.at += 1
        return self.text[self.at - 1 : self.at]

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == b"|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in (b"", b"|", b")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while (c := self.peek()) and c in b"?*+{":
            self.take()
            if c == b"{":
                end = self.text.index(b"}", self.at)
                low, comma, high = self.text[self.at : end].partition(b",")
                self.at = end + 1
                part = ("rep", part, int(low), (int(high) if high else None) if comma else int(low))
            else:
                part = ("rep", part, int(c == b"+"), 1 if c == b"?" else None)
        return part

    def atom(self):
        c = self.take()
        if c == b"(":
            tree = self.alternatives()
            if self.take() != b")":
                raise ValueError("unbalanced group")
            return tree
        if c == b"[":
            return ("set", self.members())
        return ("set", self.cased({self.escaped() if c == b"\\" else c[0]}))

    def escaped(self) -> int:
        c = self.take()
        if c == b"x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {b"n": 10, b"r": 13, b"t": 9}.get(c, c[0])

    def members(self) -> frozenset[int]:
        negate = self.peek() == b"^"
        if negate:
            self.take()
        out: set[int] = set()
        while (c := self.take()) != b"]":
            if not c:
                raise ValueError("unbalanced class")
            low = high = self.escaped() if c == b"\\" else c[0]
            if self.peek() == b"-" and self.text[self.at + 1 : self.at + 2] != b"]":
                self.take()
                c = self.take()
                high = self.escaped() if c == b"\\" else c[0]
            out |= set(range(low, high + 1))
        return ALL - self.cased(out) if negate else self.cased(out)

    def cased(self, members: set[int]) -> frozenset[int]:
        if self.fold:
            members = members | {b ^ 32 for b in members if 65 <= b & ~32 <= 90}
        return frozenset(members)


def parse(pattern: str, fold_case: bool = False):
    return _Parser(pattern, fold_case).parse()


def reverse(tree):
    """Tree of the reversed words."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    """Thompson's construction."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Adds ``tree`` from ``start``; returns the state that it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.step[start] = (tree[1], end)
            return end
        if kind == "cat":
            for x in tree[1]:
                fresh = self.state()
                self.free[start].append(fresh)
                start = self.add(x, fresh)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                fresh = self.state()
                self.free[start].append(fresh)
                self.free[self.add(x, fresh)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(("cat", [part]), start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start] += [loop, end]
            last = self.add(("cat", [part]), loop)
            self.free[last] += [loop, end]
            return end
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(("cat", [part]), start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """rows: next state by state and class of bytes; of_byte: each byte's class. masks: the rules, by state.

    ``start``, ``first_accept`` (states from it on accept) and ``dead`` (the state without a way out, or -1) are
    state numbers times 256, as in ``table``.
    """

    rows: np.ndarray
    of_byte: list[int]
    masks: list[int]
    start: int
    first_accept: int
    dead: int

    @cached_property
    def table(self) -> list[int]:
        """Flat: next state times 256 at state times 256 plus byte. Built where it is used, not shipped."""
        shared = [i * 256 for i in range(self.states)]  # one integer for each state: fewer cache misses
        return [shared[x] for x in self.rows[:, self.of_byte].ravel().tolist()]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @property
    def states(self) -> int:
        return len(self.masks)


def compile_dfa(trees: list, search: bool) -> Dfa:
    """One automaton for all expressions; with ``search`` a match may start at any byte."""
    nfa = _Nfa()
    first = nfa.state()
    ends = {}
    for i, tree in enumerate(trees):
        fresh = nfa.state()
        nfa.free[first].append(fresh)
        ends[nfa.add(tree, fresh)] = 1 << i
    sets = list({s[0] for s in nfa.step if s})
    signature: dict[tuple[bool, ...], int] = {}
    of_byte = [signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)]
    sample = [of_byte.index(k) for k in range(len(signature))]
    begin = nfa.closure([first])
    numbers, rows, todo = {begin: 0}, [], [begin]
    for states in todo:
        row = []
        for b in sample:
            moved = {s[1] for x in states if (s := nfa.step[x]) and b in s[0]}
            after = nfa.closure(moved) | (begin if search else frozenset())
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        rows.append(row)
    accept = np.array([sum({ends[x] for x in s if x in ends}) for s in todo], dtype=np.int64)
    return _minimise(np.array(rows, np.int64).reshape(len(todo), -1), accept, of_byte)


def _minimise(rows: np.ndarray, accept: np.ndarray, of_byte: list[int]) -> Dfa:
    _, block = np.unique(accept, return_inverse=True)
    count = block.max() + 1
    while True:
        _, block = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        block = block.ravel()
        if block.max() + 1 == count:
            break
        count = block.max() + 1
    _, chosen = np.unique(block, return_index=True)
    order = sorted(range(count), key=lambda k: (accept[chosen[k]] != 0, k))  # accepting states last
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    table = place[block[rows[chosen[order]]]]
    masks = [int(accept[chosen[k]]) for k in order]
    dead = [i for i in range(count) if not masks[i] and (table[i] == i).all()]
    return Dfa(table.astype(np.int32), of_byte, masks, int(place[block[0]]) * 256, next((i for i, m in enumerate(masks) if m), count) * 256, dead[0] * 256 if dead else -1)
