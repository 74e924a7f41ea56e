"""The query language: atoms separated by white space, quotes, escapes, part-of-speech tags and alternatives."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_GAP = 24
TAGS = {"n": "Noun", "pro": "Pronoun", "num": "Numeral", "v": "Verb", "adj": "Adjective", "det": "Determiner", "adv": "Adverb", "j": "Particle", "intj": "Interjection", "lit": "Literal"}


class QueryError(ValueError):
    """A query that cannot be read; kind names why, span is where (characters of the source)."""

    def __init__(self, kind: str, span: tuple[int, int]) -> None:
        super().__init__(f"{kind} at {span[0]}..{span[1]}")
        self.kind, self.span = kind, span


@dataclass(frozen=True)
class Limits:
    query_chars: int = 256
    atoms: int = 32
    analyses: int = 32
    programs: int = 4096
    matcher_bytes: int = 64 << 20
    depth: int = 4


@dataclass(frozen=True)
class Options:
    """expand: literal, inflection, derivation. boundary: smart, token, any. normalization: nfc, canonical, none."""

    expand: str = "inflection"
    boundary: str = "smart"
    normalization: str = "nfc"
    pos: str | None = None
    max_gap: int = MAX_GAP
    limits: Limits = field(default_factory=Limits)

    @staticmethod
    def literal(**given: object) -> Options:
        """Plain substrings: no inflection, no boundaries, the bytes as they are; contradicting options are refused."""
        fixed = {"expand": "literal", "boundary": "any", "normalization": "none", "pos": "Literal"}
        for k, v in given.items():
            if k in fixed and v != fixed[k]:
                raise ValueError(f"literal search contradicts {k}={v}")
        return Options(**(fixed | given))

    @property
    def needs_lexicon(self) -> bool:
        return self.pos != "Literal"


@dataclass(frozen=True)
class Atom:
    raw: str
    pos: str | None = None
    quoted: bool = False


@dataclass(frozen=True)
class Query:
    atoms: tuple[Atom, ...]
    disjunction: bool
    max_gap: int


def parse(source: str, options: Options | None = None) -> Query:
    o = options or Options()
    if len(source) > o.limits.query_chars:
        raise QueryError("QueryTooLong", (o.limits.query_chars, len(source)))
    tokens: list[tuple[Atom | None, tuple[int, int]]] = []  # None: a bar
    now: dict | None = None
    quote: tuple[str, int] | None = None

    def atom(at: int) -> dict:
        nonlocal now
        now = now or {"start": at, "value": "", "pos": None, "tag": None, "quoted": False, "plain": True}
        return now

    def finish(end: int) -> None:
        nonlocal now
        if now is None:
            return
        span = (now["start"], end)
        if not now["value"]:
            raise QueryError("EmptyAtom", span)
        if o.pos and now["pos"] and o.pos != now["pos"]:
            raise QueryError("ConflictingPos", now["tag"] or span)
        if sum(t is not None for t, _ in tokens) >= o.limits.atoms:
            raise QueryError("TooManyAtoms", span)
        tokens.append((Atom(now["value"], now["pos"], now["quoted"]), span))
        now = None

    chars = enumerate(source)
    for i, c in chars:
        if c == "\\":
            x = atom(i)
            if not quote:
                x["plain"] = False
            nxt = next(chars, None)
            if nxt is None:
                raise QueryError("DanglingEscape", (i, len(source)))
            x["value"] += nxt[1]
        elif quote:
            if c == quote[0]:
                quote = None
            else:
                atom(i)["value"] += c
        elif c in "'\"":
            x = atom(i)
            x["quoted"], x["plain"] = True, False
            quote = (c, i)
        elif c.isspace():
            finish(i)
        elif c == "|":
            finish(i)
            tokens.append((None, (i, i + 1)))
        elif c == ":" and (x := atom(i))["plain"] and x["pos"] is None and x["value"] in TAGS:
            x.update(pos=TAGS[x["value"]], tag=(x["start"], i + 1), value="", plain=False)
        else:
            atom(i)["value"] += c
    if quote:
        raise QueryError("UnterminatedQuote", (quote[1], len(source)))
    finish(len(source))
    if not tokens:
        raise QueryError("EmptyQuery", (0, len(source)))
    if all(t is not None for t, _ in tokens):
        return Query(tuple(t for t, _ in tokens), False, o.max_gap)
    for k, (t, span) in enumerate(tokens):
        if k % 2 == 0 and t is None:
            raise QueryError("MissingDisjunctionOperand", span)
        if k % 2 == 1 and t is not None:
            raise QueryError("MixedPhraseAndDisjunction", span)
    if tokens[-1][0] is None:
        raise QueryError("MissingDisjunctionOperand", tokens[-1][1])
    return Query(tuple(t for t, _ in tokens if t), True, o.max_gap)
