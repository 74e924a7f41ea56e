"""Word lattices: covers of a text by dictionary words and unknown words, the cheapest ones first.

A word costs its own cost and that of standing after the word before it, by their context ids; a text begins and ends in context 0. The N cheapest covers come from one pass
that keeps the N best beginnings for each place and context. It is exact: a cover's rest depends on nothing else.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

BEST = 4


@dataclass(frozen=True, order=True)
class Word:
    surface: str
    left: int
    right: int
    cost: int
    pos: str


@dataclass(frozen=True, order=True)
class Node:
    start: int
    end: int
    pos: str
    left: int
    right: int
    cost: int
    known: bool = True


@dataclass(frozen=True)
class Kind:
    """A class of characters: whether unknown words begin even where known ones do, whether a whole run is one, and up to which length parts of a run are."""

    name: str
    invoke: bool
    group: bool
    length: int


@dataclass
class Unknown:
    """Classes of characters and the unknown words that each class gives."""

    kinds: dict[str, Kind] = field(default_factory=dict)
    ranges: list[tuple[int, int, str]] = field(default_factory=list)
    words: dict[str, list[Word]] = field(default_factory=dict)

    def kind_of(self, c: str) -> Kind | None:
        """The class of the last range that holds a character, else the one named DEFAULT."""
        at = ord(c)
        name = next((k for a, b, k in reversed(self.ranges) if a <= at <= b), "DEFAULT")
        return self.kinds.get(name)

    def nodes(self, text: str, at: int, some_known: bool) -> list[Node]:
        kind = self.kind_of(text[at])
        if kind is None or (some_known and not kind.invoke):
            return []
        run = at + 1
        while run < len(text) and self.kind_of(text[run]) == kind:
            run += 1
        ends = {run} if kind.group else set()
        ends |= {at + n for n in range(1, kind.length + 1) if at + n <= run}
        return [Node(at, e, w.pos, w.left, w.right, w.cost, False) for e in sorted(ends or {at + 1}) for w in self.words.get(kind.name, [])]


@dataclass(frozen=True)
class Cover:
    cost: int
    nodes: tuple[Node, ...]


class Lattice:
    def __init__(self, words: Iterable[Word], costs: dict[tuple[int, int], int], unknown: Unknown | None = None) -> None:
        self.words: dict[str, list[Word]] = {}
        for w in words:
            if w.surface:
                self.words.setdefault(w.surface, []).append(w)
        self.costs, self.unknown = costs, unknown or Unknown()
        self.longest = max(map(len, self.words), default=0)

    def nodes(self, text: str) -> list[list[Node]]:
        """The words that begin at each place of a text."""
        out = []
        for at in range(len(text)):
            here = [Node(at, at + n, w.pos, w.left, w.right, w.cost) for n in range(1, min(self.longest, len(text) - at) + 1) for w in self.words.get(text[at : at + n], ())]
            out.append(here + self.unknown.nodes(text, at, bool(here)))
        return out

    def join(self, right: int, left: int) -> int | None:
        """What it costs that a word of context left follows one of context right; None where that cannot be."""
        return self.costs.get((right, left))

    def covers(self, text: str, best: int = BEST, allow=None) -> list[Cover]:  # noqa: ANN001
        """The cheapest covers, ties by their words. allow: which nodes may be used."""
        if not text:
            return []
        nodes = self.nodes(text)
        # place -> context -> the best beginnings: (cost, nodes)
        at: list[dict[int, list[tuple[int, tuple[Node, ...]]]]] = [{} for _ in range(len(text) + 1)]
        at[0][0] = [(0, ())]
        for k in range(len(text)):
            for right, begun in at[k].items():
                for node in nodes[k]:
                    if (allow is not None and not allow(node)) or (step := self.join(right, node.left)) is None:
                        continue
                    held = at[node.end].setdefault(node.right, [])
                    held += [(cost + step + node.cost, (*path, node)) for cost, path in begun]
                    if len(held) > best:
                        held[:] = heapq.nsmallest(best, held)
            if k:
                at[k] = {}
        done = [(cost + step, path) for right, begun in at[-1].items() if (step := self.join(right, 0)) is not None for cost, path in begun]
        return [Cover(c, p) for c, p in heapq.nsmallest(best, done)]

    def decide(self, text: str, start: int, end: int, kinds: set[str]) -> tuple[int | None, int | None]:
        """The cost of the cheapest cover with a word of one of kinds at start to end exactly, and of the cheapest without; None where there is none."""
        wanted = lambda n: n.start == start and n.end == end and n.pos in kinds
        apart = lambda n: wanted(n) or n.end <= start or n.start >= end
        cost = lambda allow: next((c.cost for c in self.covers(text, 1, allow)), None)
        return cost(apart) if 0 <= start < end <= len(text) else None, cost(lambda n: not wanted(n))

    def candidates(self, text: str, start: int, end: int) -> list[Node]:
        """The words, known and unknown, that stand at start to end exactly: for looking into a decision."""
        return sorted(n for n in self.nodes(text)[start] if n.end == end) if 0 <= start < end <= len(text) else []
