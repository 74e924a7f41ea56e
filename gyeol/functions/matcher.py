"""The matching kernel: a plan against one text at a time, in plain Python on the executors.

Texts are strings; bytes that are not UTF-8 arrive as lone surrogates (surrogateescape), which are boundaries and which no phrase crosses. Offsets
are characters here and become UTF-8 bytes in spans().
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

from gyeol.functions import hangul as H
from gyeol.functions.structure import Components
from gyeol.plans import grammar, particles
from gyeol.plans.compiler import Plan, Program
from gyeol.plans.predicates import continued

REACH = 256
MATCHES = 65_536
#: Anchors of an atom that are looked for one by one; of more, their first characters are.
ANCHORS = 2_000


class ComponentResourceRequired(ValueError):
    """The plan decides by the parts of tokens, and no component table was given."""


class MatchLimitExceeded(ValueError):
    pass


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    core_start: int
    core_end: int
    origins: tuple[tuple[int, tuple[str, ...]], ...]

    @property
    def rank(self) -> tuple[int, int, int, int]:
        return self.start, -self.end, self.core_start, -self.core_end


class Matcher:
    def __init__(self, plan: Plan, components: Components | None = None) -> None:
        if plan.structural and components is None:
            raise ComponentResourceRequired(plan.query)
        self.plan, self.components = plan, components
        self.by_atom: list[dict[str, list[tuple[str, Program]]]] = []
        self.looked_at: set[tuple[int, int]] | None = None  # tokens that decisions by structure have looked at, while they are counted
        self.starts: list[re.Pattern] = []
        self.single: list[str | None] = []  # the anchor of an atom that has one only
        for a in plan.atoms:
            first: dict[str, list[tuple[str, Program]]] = {}
            for p in a.programs:
                first.setdefault(p.anchor[0], []).append((p.anchor, p))
            self.by_atom.append(first)
            anchors = sorted({p.anchor for p in a.programs}, key=lambda x: (len(x), x))
            # an anchor that begins with another adds no place
            least = [x for k, x in enumerate(anchors) if not any(x.startswith(y) for y in anchors[:k])] if len(anchors) <= ANCHORS else sorted(first)
            self.single.append(least[0] if len(least) == 1 else None)
            self.starts.append(re.compile("|".join(map(re.escape, least))))

    # one program at one place

    def run(self, text: str, at: int, p: Program) -> Span | None:
        end = at + len(p.anchor)
        if not p.core or p.core > len(p.anchor):
            return None
        t, more = p.then, ()
        if t.kind == "continuation":
            if t.after_vowel and not self.contracted(text[max(0, at - REACH) : at]):
                return None
            got = self.normalized(p.anchor, text[end : end + REACH], lambda a, f: self.predicate(t, a, f))
            if got is None or not t.permits(tuple(r for r in got[1] if not t.nominal or not r.startswith("particle."))):
                return None
            end, more = end + got[0], got[1]
        elif t.kind in ("particles", "copula"):
            got = self.normalized(p.anchor, text[end : end + REACH], particles.chain)
            if got is None or not t.permits(got[1]):
                return None
            end, more = end + got[0], got[1]
        elif t.kind == "host" and not p.left and p.right and not self.hosted(text, at, p):
            return None
        elif t.kind == "ending":
            n = self.components.ending(text, at, p) if self.components else None
            if n is None:
                return None
            end, more = n, ("structural.ending-path",)
        if p.structural:
            if self.looked_at is not None:
                self.looked_at.add(self.token(text, at, end))
            if not self.components.accepts(text, at, end, p, more, self.plan):
                return None
        elif (p.left and self.inside_left(text, at)) or (p.right and self.inside_right(text, end)):
            return None
        return Span(at, end, at, at + p.core, tuple(sorted({(i, r + more) for i, r in p.origins})))

    @staticmethod
    def token(text: str, at: int, end: int) -> tuple[int, int]:
        """The token around a span."""
        while Matcher.inside_left(text, at):
            at -= 1
        while Matcher.inside_right(text, end):
            end += 1
        return at, end

    @staticmethod
    def inside_left(text: str, at: int) -> bool:
        return at > 0 and H.is_token_char(text[at - 1])

    @staticmethod
    def inside_right(text: str, end: int) -> bool:
        return end < len(text) and H.is_token_char(text[end])

    @staticmethod
    def predicate(t, anchor: str, following: str) -> tuple[int, tuple[str, ...]] | None:  # noqa: ANN001
        got = continued(t.state, t.action, following)
        if got is None or not t.nominal:
            return got
        n, rules = particles.chain(anchor, following[got[0] :])
        return got[0] + n, got[1] + rules

    @staticmethod
    def normalized(anchor: str, following: str, take) -> tuple[int, tuple[str, ...]] | None:  # noqa: ANN001
        """Consume composed text; decomposed text is composed first and the length mapped back."""
        composed = H.nfc(anchor)
        if composed == anchor:
            return take(anchor, following)
        f = H.nfc(following)
        got = take(composed, f)
        if got is None or got[0] == 0:
            return got
        want = f[: got[0]]
        return next(((k, got[1]) for k in range(1, len(following) + 1) if H.nfc(following[:k]) == want), None)

    @staticmethod
    def contracted(left: str) -> bool:
        left = H.nfc(left)
        if not left or H.has_final(left):
            return False
        return not (left.endswith("이") and len(left) > 1 and H.has_final(left[:-1]))

    @staticmethod
    def hosted(text: str, at: int, p: Program) -> bool:
        left, me = H.nfc(text[max(0, at - REACH) : at]), H.nfc(p.anchor)
        if not left or not H.is_token_char(left[-1]):
            return False
        forms = [f for f in grammar.particles()[0] if f.rule == p.then.rule]
        if any(len(f.form) > len(me) and f.form.endswith(me) and (left + me).endswith(f.form) for f in forms):
            return False
        return any(f.form == me and particles.accepts(f.needs, left[-1]) for f in forms)

    # spans of one atom

    def places(self, text: str, atom: int = 0, at: int = 0):  # noqa: ANN201
        """Where an anchor of an atom begins, from at on."""
        if (one := self.single[atom]) is not None:
            while (at := text.find(one, at)) >= 0:
                yield at
                at += 1
            return
        search = self.starts[atom].search
        while m := search(text, at):
            yield m.start()
            at = m.start() + 1

    def at(self, text: str, i: int, atom: int) -> list[Span]:
        """The accepted spans that start at i; equal ones with their origins together."""
        found: dict[tuple, Span] = {}
        for anchor, p in self.by_atom[atom].get(text[i], ()):
            if text.startswith(anchor, i) and (s := self.run(text, i, p)):
                old = found.get(s.rank)
                found[s.rank] = s if old is None else Span(*(s.start, s.end, s.core_start, s.core_end), tuple(sorted({*old.origins, *s.origins})))
        return [found[k] for k in sorted(found)]

    def all_spans(self, text: str, atom: int = 0) -> list[Span]:
        """Every accepted span, overlapping ones too."""
        return [s for i in self.places(text, atom) for s in self.at(text, i, atom)]

    def find_all(self, text: str, limit: int = MATCHES) -> list[list[Span]]:
        """Non-overlapping matches, leftmost first, of those the longest; a match is a span per atom."""
        out: list[list[Span]] = []
        found = self.singles(text) if len(self.plan.atoms) == 1 else self.phrases(text)
        for m in found:
            if len(out) == limit:
                raise MatchLimitExceeded(f"over {limit} matches")
            out.append(m)
        return out

    def singles(self, text: str):  # noqa: ANN201
        at = 0
        for i in self.places(text):
            if i >= at and (got := self.at(text, i, 0)):
                yield [got[0]]
                at = max(got[0].end, i + 1)

    def phrases(self, text: str):  # noqa: ANN201
        """Ordered atoms with at most max_gap characters and no line break between; prefixes hidden by an earlier match come back after it."""
        layers = [self.all_spans(text, k) for k in range(len(self.plan.atoms))]
        if not all(layers):
            return
        breaks = [i for i, c in enumerate(text) if c in "\r\n" or 0xDC80 <= ord(c) <= 0xDCFF]
        line = lambda i: len(breaks) if not breaks else bisect_left(breaks, i)
        follows = lambda a, b: a.end <= b.start <= a.end + self.plan.max_gap and line(a.end) == line(b.start)
        # from the end: the best final end that each span reaches, and the next span on the way
        best: list[dict[int, tuple[int, int | None]]] = [{} for _ in layers]
        best[-1] = {k: (s.end, None) for k, s in enumerate(layers[-1])}
        for n in range(len(layers) - 2, -1, -1):
            after = layers[n + 1]
            starts = [s.start for s in after]
            for k, s in enumerate(layers[n]):
                j = bisect_left(starts, s.end)
                while j < len(after) and after[j].start <= s.end + self.plan.max_gap:
                    if j in best[n + 1] and follows(s, after[j]) and (k not in best[n] or best[n + 1][j][0] > best[n][k][0]):
                        best[n][k] = (best[n + 1][j][0], j)
                    j += 1
        at, k, first = 0, 0, layers[0]
        while k < len(first):
            if first[k].start < at or k not in best[0]:
                k += 1
                continue
            same = [j for j in range(k, len(first)) if first[j].start == first[k].start and j in best[0]]
            j = max(same, key=lambda x: (best[0][x][0], -x))
            chain, n = [], 0
            while j is not None:
                chain.append(layers[n][j])
                j, n = best[n][j][1], n + 1
            yield chain
            at = chain[-1].end
            k += 1

    def exists(self, text: str) -> bool:
        return next(iter(self.singles(text) if len(self.plan.atoms) == 1 else self.phrases(text)), None) is not None

    def find_at(self, text: str, at: int) -> list[Span] | None:
        """The first match that starts at or after at."""
        if len(self.plan.atoms) > 1:
            sub = Matcher.phrases(self, text) if at == 0 else (m for m in self.phrases(text) if m[0].start >= at)
            return next(iter(sub), None)
        for i in self.places(text, 0, at):
            if got := self.at(text, i, 0):
                return [got[0]]
        return None

    def counters(self, text: str) -> dict[str, int]:
        """Of one text: anchor hits, programs that passed, those of them that a decision by structure let pass, and the tokens such decisions looked at."""
        hits = passed = structural = 0
        self.looked_at = set()
        for atom, first in enumerate(self.by_atom):
            for i in self.places(text, atom):
                here = [p for anchor, p in first.get(text[i], ()) if text.startswith(anchor, i)]
                hits += len({p.anchor for p in here})
                good = [p for p in here if self.run(text, i, p) is not None]
                passed += len(good)
                structural += sum(bool(p.structural) for p in good)
        windows, self.looked_at = len(self.looked_at), None
        return dict(zip(COUNTERS, (hits, passed, structural, windows), strict=True))


#: What is counted, in the order of counters().
COUNTERS = ("raw_anchor_hits", "verified_program_hits", "structural_hits", "structural_windows")


def byte_offsets(text: str, places: list[int]) -> dict[int, int]:
    """UTF-8 byte offsets of character offsets, in one pass."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(text[at:p].encode("utf-8", "surrogateescape"))
        out[p], at = n, p
    return out
