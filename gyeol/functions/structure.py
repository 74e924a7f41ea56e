"""Decisions by the parts of a token: a table of surfaces with their analyses, and paths over it.

A token is covered by entries end to end; each path is a sequence of parts of speech. Whether a core may stand in its token is read from
those paths: supported where a path has the core as a part of the wanted kind, contradicted where the whole token is a known word of another kind and no path supports it, else ambiguous.
Supported and ambiguous are accepted: recall comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from gyeol.functions import hangul as H

NODES = 4096
WINDOW_BYTES, WINDOW_CHARS = 256, 64
NOMINALS = {"NNG", "NNP", "NNB", "NNBC", "NR", "NP", "XPN", "XSN", "XR"}
CORE_NOMINALS = {"NNG", "NNP", "NNB", "NNBC", "NR", "NP"}
ENDINGS = {"EP", "EF", "EC", "ETN", "ETM"}
PREDICATES = {"VV", "VA", "VX", "VCP", "VCN", "XSV", "XSA"}
PARTICLES = {"J", "JX", "JC", "JKS", "JKB", "JKO", "JKG", "JKC", "JKV", "JKQ"}
PARENT = {"VV": {"VV", "VX", "XSV"}, "VA": {"VA", "XSA", "VX"}, "VCP": {"VCP"}, "VCN": {"VCN"}}


class Components:
    """surface -> list of part-of-speech sequences; a one-part sequence is a word of its own."""

    def __init__(self, rows: Iterable[tuple[str, str]], endings: Iterable[str] = ()) -> None:
        self.table: dict[str, list[tuple[str, ...]]] = {}
        for surface, pos in rows:
            self.table.setdefault(surface, []).append(tuple(pos.split("+")))
        self.longest = max(map(len, self.table), default=0)
        self.endings = frozenset(endings) or frozenset(s for s, p in self.table.items() if any(set(x) <= ENDINGS for x in p))

    def prefixes(self, text: str, at: int) -> list[tuple[int, tuple[str, ...]]]:
        """(end, analysis) of the entries that start at at."""
        return [(at + n, p) for n in range(1, min(self.longest, len(text) - at) + 1) for p in self.table.get(text[at : at + n], ())]

    def reaches(self, text: str, start: int, step: Callable[[str, str], str | None], state: str, final: Callable[[str], bool]) -> bool:
        """Whether some cover of text[start:] drives a small automaton over parts of speech to a final state."""
        todo, seen = [(start, state)], set()
        while todo:
            at, now = todo.pop()
            if (at, now) in seen:
                continue
            seen.add((at, now))
            if len(seen) > NODES:
                return False
            if at == len(text):
                if final(now):
                    return True
                continue
            for end, parts in self.prefixes(text, at):
                s: str | None = now
                for p in parts:
                    s = step(s, p) if s is not None else None
                if s is not None:
                    todo.append((end, s))
        return False

    # languages of part-of-speech sequences

    def ending_path(self, text: str, start: int) -> bool:
        return self.reaches(text, start, lambda s, p: "e" if p in ENDINGS else None, "", lambda s: s == "e")

    def ending_then_particles(self, text: str, start: int) -> bool:
        return self.reaches(text, start, lambda s, p: "e" if p in ENDINGS and s != "j" else "j" if p in PARTICLES and s else None, "", bool)

    def auxiliary_path(self, text: str, start: int) -> bool:
        return self.reaches(text, start, lambda s, p: "v" if p == "VX" else "e" if p in ENDINGS and s else None, "", lambda s: s == "e")

    def copula_path(self, text: str, start: int) -> bool:
        step = lambda s, p: "c" if p == "VCP" and s == "" else "e" if p in ENDINGS and s in ("c", "e") else "j" if p in PARTICLES and s in ("e", "j") else None
        return self.reaches(text, start, step, "", lambda s: s in ("e", "j"))

    def particle_path(self, text: str, start: int) -> bool:
        return start == len(text) or self.reaches(text, start, lambda s, p: "j" if p in PARTICLES else None, "", lambda s: s == "j")

    def nominal_host(self, text: str) -> bool:
        return bool(text) and self.reaches(text, 0, lambda s, p: "n" if p in CORE_NOMINALS else s or "x" if p in NOMINALS else None, "", lambda s: s == "n")

    def numeral_path(self, text: str) -> bool:
        step = lambda s, p: {"": "1", "1": "2", "2": "2"}.get(s) if p == "NR" else "u" if p in ("NNB", "NNBC") and s in ("1", "2") else "j" if p in PARTICLES and s in ("2", "u", "j") else None
        return self.reaches(text, 0, step, "", lambda s: s in ("2", "u", "j"))

    def whole(self, token: str, kinds: set[str]) -> bool:
        return any(p[0] in kinds if len(p) == 1 else False for p in self.table.get(token, ()))

    def paths_with(self, token: str, a: int, b: int, kinds: set[str]) -> bool:
        """A cover of the token that has text[a:b] as a part of one of the kinds."""
        before = a == 0 or self.reaches(token[:a], 0, lambda s, p: "x", "", bool)
        here = any(set(p) <= kinds for p in self.table.get(token[a:b], ()))
        after = b == len(token) or self.reaches(token, b, lambda s, p: "x", "", bool)
        return before and here and after

    # decisions

    @staticmethod
    def token_of(text: str, a: int, b: int) -> tuple[int, int]:
        while a > 0 and H.is_token_char(text[a - 1]):
            a -= 1
        while b < len(text) and H.is_token_char(text[b]):
            b += 1
        return a, b

    def ending(self, text: str, at: int, p) -> int | None:  # noqa: ANN001
        """The token's end, where the whole token is this stem and a catalogued ending."""
        a, b = self.token_of(text, at, at + len(p.anchor))
        if a != at or b <= at + len(p.anchor) or len(text[a:b].encode("utf-8", "surrogateescape")) > WINDOW_BYTES:
            return None
        token, anchor = H.nfc(text[a:b]), H.nfc(p.anchor)
        suffix = token[len(anchor) :]
        ok = suffix in self.endings and (not p.then.validate or self.ending_path(token, len(anchor)))
        ok = ok or (anchor[-1] in "아어여" and self.auxiliary_path(token, len(anchor)))
        return b if ok else None

    def accepts(self, text: str, at: int, end: int, p, rules: tuple[str, ...], plan) -> bool:  # noqa: ANN001
        a, b = self.token_of(text, at, end)
        if len(text[a:b].encode("utf-8", "surrogateescape")) > WINDOW_BYTES or b - a > WINDOW_CHARS:
            return False
        token, x, y = H.nfc(text[a:b]), at - a, end - a
        core = (x, x + p.core)
        kinds = {plan.atoms[k].analyses[i].pos for k in range(len(plan.atoms)) for i, _ in p.origins if i < len(plan.atoms[k].analyses)}
        if p.then.kind in ("continuation", "ending"):
            kinds = set().union(*(PARENT.get(k, {k}) for k in kinds))
            if kinds & {"VCP"}:
                host = token[:x]
                return y == len(token) and bool(host) and self.nominal_host(host) and not self.whole(token, {"MM", "MAG", "NNG", "NNP", "VV", "VA"} - kinds)
            if x or (p.right and y < len(token) and not self.ending_then_particles(token, y) and not self.auxiliary_path(token, y)):
                return False
            return not (self.whole(token, CORE_NOMINALS | {"MAG", "MM"}) and not self.whole(token, kinds))
        if y == len(token) and x == 0:
            whole_other = self.table.get(token) and not self.whole(token, kinds) and core == (0, len(token))
            conflict = self.whole(token, CORE_NOMINALS | PREDICATES | {"MAG", "MM"}) and core[1] < len(token) and not self.paths_with(token, *core, kinds)
            return not whole_other and not conflict
        if self.whole(token, CORE_NOMINALS | PREDICATES | {"MAG", "MM"}) and not self.paths_with(token, *core, kinds):
            return False
        if p.structural == "source":
            return self.paths_with(token, *core, kinds)
        rest = y == len(token) or self.copula_path(token, y) or self.particle_path(token, y) or self.nominal_host(token[y:])
        return rest and self.paths_with(token, *core, kinds)
