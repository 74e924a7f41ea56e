"""From a query to a bounded search plan: anchors, what may follow each, and the boundaries a match must have."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace

from gyeol.functions import hangul as H
from gyeol.plans import grammar, particles
from gyeol.plans.lexer import Options, Query, parse
from gyeol.plans.lexicon import Analysis, Lexicon, builtin
from gyeol.plans.predicates import Predicate, branches, fallback_stems

NOMINALIZERS = ("ending.nominalizer", "ending.nominalizer-gi")


class CompileError(ValueError):
    def __init__(self, kind: str, atom: int | None = None, detail: str = "") -> None:
        super().__init__(f"{kind}{'' if atom is None else f' in atom {atom}'}{': ' + detail if detail else ''}")
        self.kind, self.atom = kind, atom


@dataclass(frozen=True)
class Consumption:
    """What may follow an anchor. kind: anchor, continuation, particles, host (a particle's own host), copula (a nominal with the copula), ending (by the catalogue)."""

    kind: str = "anchor"
    state: str = "terminal"
    action: bool = False
    execution: str = ""
    nominal: bool = False  # particles may follow
    after_vowel: bool = False  # a contracted copula: the character before has no final consonant
    first: frozenset[str] | None = None
    allowed: frozenset[str] | None = None
    blocked: frozenset[str] = frozenset()
    rule: str = ""
    validate: bool = True

    def permits(self, rules: tuple[str, ...]) -> bool:
        if self.kind in ("anchor", "host"):
            return not rules
        if self.kind == "continuation":
            return all(r in grammar.known_rules() for r in rules)
        return not rules or (rules[0] in self.first and all(r in self.allowed and r not in self.blocked for r in rules))


@dataclass(frozen=True)
class Program:
    anchor: str
    core: int
    then: Consumption
    left: bool
    right: bool
    structural: str  # '' or how much of a token's parts may prove it: whole, source, runtime
    origins: tuple[tuple[int, tuple[str, ...]], ...]  # (analysis, rules)


@dataclass(frozen=True)
class AtomPlan:
    analyses: tuple[Analysis, ...]
    programs: tuple[Program, ...]


@dataclass(frozen=True)
class Plan:
    query: str
    atoms: tuple[AtomPlan, ...]
    disjunction: bool
    max_gap: int
    options: Options
    diagnostics: tuple[str, ...] = ()
    bytes: int = 0

    @property
    def anchors(self) -> list[list[str]]:
        """Of each atom."""
        return [sorted({p.anchor for p in a.programs}) for a in self.atoms]

    @property
    def structural(self) -> bool:
        return any(p.structural for a in self.atoms for p in a.programs)

    @property
    def line_local(self) -> bool:
        return not any("\n" in x for a in self.anchors for x in a)


def least(anchors: list[str]) -> list[str]:
    """The anchors that hold no other one: a text has one of these if it has any."""
    own, sizes = set(anchors), sorted({len(a) for a in anchors})
    return [a for a in dict.fromkeys(anchors) if not any(a[i : i + n] in own for n in sizes if n < len(a) for i in range(len(a) - n + 1))]


@dataclass
class Draft:
    anchor: str
    core: int
    then: Consumption
    origin: tuple[int, tuple[str, ...]]
    smart_left: bool = True
    structural: str = ""
    more: list[tuple[int, tuple[str, ...]]] = field(default_factory=list)


class Compiler:
    def __init__(self, options: Options, lexicon: Lexicon) -> None:
        self.o, self.lexicon = options, lexicon
        self.full = lexicon.full is not None
        self.excluded: set[str] = set()
        everything = particles.rules_of()
        self.noun = Consumption("particles", first=everything, allowed=everything)
        self.adverb = Consumption("particles", first=particles.rules_of("auxiliary", "adverb"), allowed=particles.rules_of("auxiliary"))

    def known(self, rules: tuple[str, ...]) -> bool:
        bad = [r for r in rules if r not in grammar.known_rules() and r not in grammar.INTERNAL]
        self.excluded.update(bad)
        return not bad

    def analysis(self, surface: str, i: int, a: Analysis) -> list[Draft]:
        whole = lambda s, then, rules=(), **k: Draft(s, len(s), then, (i, tuple(rules)), **k)
        if self.o.expand == "literal":
            return [whole(surface, Consumption())]
        if a.kind == "exact":
            s = "runtime" if a.coarse in ("Determiner", "Adverb") else ""
            return [whole(surface, self.adverb if a.coarse == "Adverb" else Consumption(), structural=s)]
        if a.kind == "predicate":
            out = self.predicate(a, a.predicate, i, (), self.o.boundary == "smart" and self.full)
            if self.o.boundary == "smart" and a.pos == "VCP":
                out += [whole(s, Consumption(), (rule,), structural="source") for s, rule in grammar.COPULA_HOST]
            return out
        if a.kind == "particle":
            wide = self.o.boundary != "smart" or a.source == "forced"
            forms = [v for v in a.variants if wide or v == surface]
            return [whole(v, Consumption("host", rule=a.rule), (a.rule,), smart_left=False) if a.rule else whole(v, Consumption()) for v in forms]
        blocked = frozenset(r for r, _ in a.overrides if r != "particle.genitive")
        out = [whole(a.lemma, replace(self.noun, blocked=blocked), structural="runtime")]
        out += [whole(s, Consumption(), (rule,)) for rule, s in a.overrides]
        if a.coarse == "Pronoun":
            out += [whole(a.lemma[: -len(end)] + new, Consumption(), (rule,)) for end, new, rule in grammar.PRONOUN_PARTICLE if a.lemma.endswith(end)]
            out += [whole(new, replace(self.noun, kind="copula"), (rule,), structural="source") for lemma, new, rule in grammar.PRONOUN_COPULA if a.lemma == lemma]
        if self.o.expand == "derivation" and a.pos in ("NNG", "NNP"):
            for suffix, pos, alt, name in grammar.DERIVATIONS:
                lemma, rule = a.lemma + suffix, (f"derivation.{name}",)
                if alt:
                    out += self.predicate(replace(a, source="productive"), Predicate(lemma, pos, alt), i, rule, False)
                else:
                    out.append(whole(lemma, self.noun, rule, structural="runtime"))
        return out

    def predicate(self, a: Analysis, p: Predicate, i: int, prefix: tuple[str, ...], fallback: bool) -> list[Draft]:
        out: list[Draft] = []
        for lemma, pos, rule in p.derivations:
            out += self.predicate(replace(a, source="enriched"), Predicate(lemma, pos), i, (*prefix, rule), fallback)
        execution = {"VX": "VV", "VXA": "VA"}.get(p.pos, p.pos)
        copula = p.alternation == "Copula"
        made = branches(p)
        for b in made:
            rules = prefix + b.rules
            if not self.known(rules):
                continue
            then = Consumption("continuation", state=b.state, action=execution == "VV", execution=execution, nominal=bool(rules) and rules[-1] in NOMINALIZERS, after_vowel=copula and b.anchor in ("다", "였", "여서"))
            left = not copula and not (a.source == "forced" and rules[-1:] == ("ending.connective-ji",))
            strict = copula or self.full or (fallback and "ending.future-adnominal" in rules)
            out.append(Draft(b.anchor, b.core, then, (i, rules), left, "runtime" if strict else ""))
        if fallback:
            stems = [(b, True) for b in fallback_stems(p)]
            stems += [(b, False) for b in made if b.state != "terminal" or b.rules[-1:] in (("ending.future-adnominal",), ("ending.connective-go",))]
            for b, check in stems:
                if self.known(prefix + b.rules):
                    out.append(Draft(b.anchor, b.core, Consumption("ending", state=b.state, action=execution == "VV", execution=execution, validate=check), (i, prefix + b.rules), True, "runtime"))
        return out

    def forms(self, d: Draft) -> list[tuple[str, int]]:
        if self.o.normalization == "none":
            return [(d.anchor, d.core)]
        out = []
        for f in ("NFC", "NFD") if self.o.normalization == "canonical" else ("NFC",):
            x = (unicodedata.normalize(f, d.anchor), len(unicodedata.normalize(f, d.anchor[: d.core])))
            if x not in out:
                out.append(x)
        return out

    def boundary(self, d: Draft, one: bool) -> tuple[bool, bool]:
        if self.o.boundary == "any":
            return False, False
        if self.o.boundary == "token":
            return True, True
        return d.smart_left or (one and d.then.kind != "host"), True

    def merged(self, drafts: list[Draft], one: bool) -> tuple[Program, ...]:
        """One program per anchor, consumption, core, boundary and decision; its origins together."""
        found: dict[tuple, set] = {}
        for d in drafts:
            s = d.structural if self.o.boundary == "smart" else ""
            for anchor, core in self.forms(d):
                found.setdefault((anchor, core, d.then, *self.boundary(d, one), s), set()).update([d.origin, *d.more])
        return tuple(Program(*k, tuple(sorted(v))) for k, v in found.items())


def same_but_pos(a: Analysis, b: Analysis) -> bool:
    """Auxiliary and main verbs that inflect alike share programs."""
    fold = {"VX": "VV", "VXA": "VA"}
    return bool(a.predicate and b.predicate and a.lemma == b.lemma and a.coarse == b.coarse and a.source == b.source and fold.get(a.pos, a.pos) == fold.get(b.pos, b.pos) and replace(a.predicate, pos="") == replace(b.predicate, pos=""))


def compile_query(source: str, options: Options | None = None, lexicon: Lexicon | None = None) -> Plan:
    o, lexicon = options or Options(), lexicon or builtin()
    q: Query = parse(source, o)
    if grammar.MAX_DEPTH > o.limits.depth:
        raise CompileError("ContinuationDepthExceeded")
    c = Compiler(o, lexicon)
    diagnostics = [] if not o.needs_lexicon or c.full else ["FullPosLexiconUnavailable"]
    atoms, total, size = [], 0, 0
    for k, atom in enumerate(q.atoms):
        one = len(atom.raw) == 1
        raw = atom.raw if o.normalization == "none" else H.nfc(atom.raw)
        atom = replace(atom, raw=raw, pos=atom.pos or o.pos)
        analyses = lexicon.analyze(atom)
        if len(analyses) > o.limits.analyses:
            raise CompileError("TooManyAnalyses", k)
        if atom.pos is None and raw.endswith("다") and len(analyses) == 1 and analyses[0].source == "heuristic":
            diagnostics.append(f"UnregisteredDaLiteralOnly {0 if q.disjunction else k} {raw}")
        drafts: list[Draft] = []
        ranges: list[tuple[int, int]] = []
        for i, a in enumerate(analyses):
            again = next((j for j in range(i) if same_but_pos(a, analyses[j])), None)
            if again is None:
                ranges.append((len(drafts), len(drafts) + len(got := c.analysis(raw, i, a))))
                drafts += got
            else:
                ranges.append(ranges[again])
                for d in drafts[slice(*ranges[again])]:
                    d.more.append((i, d.origin[1]))
        programs = c.merged(drafts, one)
        if not programs:
            raise CompileError("NoSearchablePrograms", k)
        total += len(programs)
        if total > o.limits.programs:
            raise CompileError("TooManyPrograms", k)
        size += sum(64 + len(p.anchor.encode()) + sum(24 + sum(map(len, r)) for _, r in p.origins) for p in programs)
        if size > o.limits.matcher_bytes:
            raise CompileError("MatcherMemoryExceeded", k)
        atoms.append(AtomPlan(tuple(analyses), programs))
    if c.excluded:
        diagnostics.append("RuleVocabularyRestricted " + " ".join(sorted(c.excluded)))
    if q.disjunction:
        analyses, programs = [], []
        for a in atoms:
            programs += [replace(p, origins=tuple((i + len(analyses), r) for i, r in p.origins)) for p in a.programs]
            analyses += a.analyses
        atoms = [AtomPlan(tuple(analyses), tuple(programs))]
    return Plan(source, tuple(atoms), q.disjunction, q.max_gap, o, tuple(diagnostics), size)
