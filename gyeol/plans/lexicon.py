"""Layers of dictionaries, and what an atom may be."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace
from functools import cache

from gyeol.functions import hangul as H
from gyeol.plans import grammar, tables
from gyeol.plans.lexer import Atom
from gyeol.plans.predicates import GenerateError, Predicate, branches
from gyeol.plans.tables import DataError

COARSE = {
    "NNG": "Noun", "NNP": "Noun", "NNB": "Noun", "NP": "Pronoun", "NR": "Numeral", "VV": "Verb", "VX": "Verb", "VCP": "Adjective", "VCN": "Adjective", "VA": "Adjective", "VXA": "Adjective",
    "MM": "Determiner", "MAG": "Adverb", "MAJ": "Adverb", "IC": "Interjection", "J": "Particle", "LIT": "Literal",
}
FINE = {"Noun": ["NNG", "NNP", "NNB"], "Pronoun": ["NP"], "Numeral": ["NR"], "Determiner": ["MM"], "Adverb": ["MAG"], "Particle": ["J"], "Interjection": ["IC"], "Literal": ["LIT"], "Verb": ["VV"], "Adjective": ["VA"]}
NOMINAL = {"Noun", "Pronoun", "Numeral"}


class AnalyzeError(ValueError):
    pass


@dataclass(frozen=True)
class Analysis:
    """What an atom may be. kind: predicate, nominal, particle, exact. source: builtin, enriched, full-pos, user, productive, heuristic, forced."""

    lemma: str
    pos: str
    kind: str
    source: str
    predicate: Predicate | None = None
    overrides: tuple[tuple[str, str], ...] = ()
    variants: tuple[str, ...] = ()
    rule: str | None = None

    @property
    def coarse(self) -> str:
        return COARSE[self.pos]


def shape(lemma: str, coarse: str) -> str | None:
    if lemma.endswith("하다"):
        return "Ha"
    return "BToWo" if coarse == "Adjective" and lemma.endswith(("스럽다", "답다", "롭다")) else None


def exact(lemma: str, coarse: str, source: str) -> Analysis:
    return Analysis(lemma, FINE[coarse][0], "exact", source)


def productive(lemma: str) -> Analysis | None:
    fits = [d for d in grammar.DERIVATIONS if d[2] and lemma.endswith(d[0]) and len(lemma) > len(d[0])]
    if not fits:
        return None
    d = max(fits, key=lambda d: len(d[0]))
    return Analysis(lemma, d[1], "predicate", "productive", Predicate(lemma, d[1], d[2]))


def plain(lemma: str, pos: str, source: str) -> Analysis:
    """An analysis from a part of speech alone."""
    coarse = COARSE[pos]
    if coarse in ("Verb", "Adjective"):
        p = productive(lemma)
        alt = p.predicate.alternation if p and p.coarse == coarse else shape(lemma, coarse) or ("Copula" if pos == "VCP" else "Regular")
        return Analysis(lemma, pos, "predicate", source, Predicate(lemma, pos, alt))
    if coarse in NOMINAL:
        return Analysis(lemma, pos, "nominal", source)
    if coarse == "Particle":
        return Analysis(lemma, pos, "particle", source, variants=(lemma,))
    return Analysis(lemma, pos, "exact", source)


def predicates_of(rows: list[dict[str, str]]) -> list[Predicate]:
    """Rows of a table of predicates: lemma, pos, alternation, flags, overrides."""
    return [Predicate(r["lemma"], r["pos"], r["alternation"], frozenset(filter(None, r["flags"].split("|"))), tables.pairs(r["overrides"])) for r in rows]


class Lexicon:
    """Built-in entries, with an enriched layer, a part-of-speech list and the user's entries on top."""

    def __init__(self) -> None:
        self.entries: dict[str, list[Analysis]] = {}
        self.full: dict[str, list[str]] | None = None
        self.replaced: set[tuple[str, str]] = set()
        for p in predicates_of(grammar.TABLES["predicates"]):
            self.put(p.lemma, Analysis(p.lemma, p.pos, "predicate", "builtin", p))
        for r in grammar.TABLES["nominals"]:
            self.put(r["lemma"], Analysis(r["lemma"], r["pos"], "nominal", "builtin", overrides=tables.pairs(r["overrides"])))
        for r in grammar.TABLES["modifiers"]:
            self.put(r["lemma"], Analysis(r["lemma"], r["pos"], "exact", "builtin"))
        forms: dict[str, list[str]] = {}
        for f in grammar.particles()[0]:
            forms.setdefault(f.rule, []).append(f.form)
        for r in grammar.TABLES["particle_lemmas"]:
            lemma, rule = r["lemma"], r["rule"]
            for v in forms[rule]:
                self.put(v, Analysis(lemma, "J", "particle", "builtin", variants=tuple(forms[rule]), rule=rule))

    def put(self, key: str, a: Analysis) -> None:
        if a not in self.entries.setdefault(key, []):
            self.entries[key].append(a)

    def load_enriched(self, predicates: list[Predicate]) -> None:
        """Predicates of a larger dictionary; an entry that is there already stays as it is."""
        for p in predicates:
            validate(p)
            if not any(a.predicate == p and a.pos == p.pos for a in self.entries.get(p.lemma, [])):
                self.put(p.lemma, Analysis(p.lemma, p.pos, "predicate", "enriched", p))

    def load_full(self, rows: list[tuple[str, str]]) -> None:
        """(lemma, part of speech) of a whole dictionary."""
        self.full = {}
        for lemma, pos in sorted(set(rows)):
            self.full.setdefault(lemma, []).append({"JX": "J", "JC": "J", "JKS": "J", "JKB": "J", "JKO": "J", "JKG": "J", "JKC": "J", "JKV": "J", "JKQ": "J"}.get(pos, pos))

    def load_user(self, text: str) -> None:
        """TOML: [[predicate]] lemma pos alternation flags override replace; [[nominal]] surface pos override replace."""
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise DataError(str(e)) from e
        for kind, key in (("predicate", "lemma"), ("nominal", "surface")):
            for row in data.get(kind, []):
                if unknown := set(row) - {key, "pos", "alternation", "flags", "override", "replace"}:
                    raise DataError(f"{kind}: unknown {sorted(unknown)}")
                lemma = row.get(key) or ""
                if not lemma or lemma != H.nfc(lemma):
                    raise DataError(f"{kind}: {key} must be non-empty NFC")
                fixed = tuple((o["rule"], o["surface"]) for o in row.get("override", []))
                if row.get("replace"):
                    self.entries[lemma] = [a for a in self.entries.get(lemma, []) if a.kind != kind]
                    self.replaced.add((kind, lemma))
                if kind == "predicate":
                    p = Predicate(lemma, row["pos"], row.get("alternation", "Regular"), frozenset(row.get("flags", [])), fixed)
                    validate(p)
                    self.put(lemma, Analysis(lemma, p.pos, kind, "user", p))
                else:
                    self.put(lemma, Analysis(lemma, row["pos"], kind, "user", overrides=fixed))

    def lookup(self, surface: str) -> list[Analysis]:
        own = self.entries.get(surface, [])
        extra = (self.full or {}).get(surface, [])
        if not extra:
            return list(own)
        out = [a for a in own if a.source != "user"]
        for pos in extra:
            coarse = COARSE[pos]
            verb = coarse in ("Verb", "Adjective")
            if (verb and ("predicate", surface) in self.replaced) or (coarse in NOMINAL and ("nominal", surface) in self.replaced):
                continue
            if any(a.source in ("builtin", "enriched") and ((a.coarse == coarse and a.predicate and a.predicate.alternation != "SurfaceOnly") if verb else a.pos == pos) for a in out):
                continue
            if (a := plain(surface, pos, "full-pos")) not in out:
                out.append(a)
        return out + [a for a in own if a.source == "user"]

    def found(self, lemma: str) -> list[Analysis]:
        """lookup, and for a predicate known by fixed forms alone also an inflecting analysis."""
        out = self.lookup(lemma)
        only = sorted({a.pos for a in out if a.predicate and a.predicate.alternation == "SurfaceOnly"})
        for pos in only:
            if not any(a.pos == pos and a.predicate and a.predicate.alternation != "SurfaceOnly" for a in out):
                p = productive(lemma)
                out.append(replace(p, source="enriched") if p and p.coarse == COARSE[pos] else Analysis(lemma, pos, "predicate", "enriched", Predicate(lemma, pos, shape(lemma, COARSE[pos]) or "Regular")))
        return out

    def analyze(self, atom: Atom) -> list[Analysis]:
        if atom.quoted:
            return [exact(atom.raw, atom.pos or "Literal", "forced")]
        if atom.pos:
            return self.forced(atom.raw, atom.pos)
        if got := self.found(atom.raw):
            return got
        if p := productive(atom.raw):
            return [p]
        literal = exact(atom.raw, "Literal", "heuristic")
        if H.is_hangul(atom.raw) and not atom.raw.endswith("다"):
            return [Analysis(atom.raw, "NNG", "nominal", "heuristic"), literal]
        return [literal]

    def forced(self, lemma: str, coarse: str) -> list[Analysis]:
        got = [a for a in self.found(lemma) if a.coarse == coarse]
        out = [replace(a, source="forced") for a in got]
        if out:
            if coarse == "Noun" and any(a.source == "full-pos" for a in got):
                out += [plain(lemma, pos, "forced") for pos in FINE["Noun"] if all(a.pos != pos for a in out)]
        elif coarse in ("Verb", "Adjective"):
            p = productive(lemma)
            if p and p.coarse == coarse:
                out = [replace(p, source="forced")]
            elif len(lemma) < 2 or not lemma.endswith("다"):
                raise AnalyzeError(f"a forced {coarse} must end in 다: {lemma}")
            else:
                pos = FINE[coarse][0]
                out = [Analysis(lemma, pos, "predicate", "forced", Predicate(lemma, pos, shape(lemma, coarse) or "Regular"))]
        else:
            return [plain(lemma, pos, "forced") for pos in FINE[coarse]]
        if coarse == "Verb" and all(a.pos != "VX" for a in out) and (main := next((a for a in out if a.pos == "VV"), None)):
            out.append(replace(main, pos="VX", predicate=replace(main.predicate, pos="VX")))
        return out


def validate(p: Predicate) -> None:
    if p.alternation not in grammar.ALTERNATIONS:
        raise DataError(f"{p.lemma}: unknown alternation {p.alternation}")
    if p.pos not in ("VV", "VA", "VX", "VXA", "VCP", "VCN"):
        raise DataError(f"{p.lemma}: {p.pos} is no predicate")
    for rule, surface in p.overrides:
        if rule not in grammar.known_rules() or not surface:
            raise DataError(f"{p.lemma}: bad override {rule}={surface}")
    try:
        branches(p)
    except GenerateError as e:
        raise DataError(str(e)) from e


@cache
def builtin() -> Lexicon:
    return Lexicon()


def check_data(given: dict[str, str] | None = None) -> dict[str, int | str]:
    """Counts of the grammar and the small lexicon, and what is wrong with them: one row of a report. given: text of tables that stand in for the package's."""
    out: dict[str, int | str] = {}
    rows, wrong = dict(grammar.TABLES), []
    for name, text in (given or {}).items():
        try:
            rows[name] = tables.parse(name, text)
        except DataError as e:
            wrong.append(str(e))
    wrong += tables.problems(rows)
    alternations = {r["name"] for r in rows["alternations"]}
    for r in rows["predicates"]:
        try:
            if r["alternation"] in alternations:
                validate(predicates_of([r])[0])
        except DataError as e:
            wrong.append(str(e))
    for name in tables.COLUMNS:
        out[f"n_{name}"] = len(rows[name])
    out["n_problems"], out["problems"] = len(wrong), "\n".join(wrong)
    return out


def pos_stats(rows: list[tuple[str, str]]) -> dict[str, int]:
    """Of a part-of-speech list: entries, different lemmas, lemmas of several parts of speech."""
    by: dict[str, set[str]] = {}
    for lemma, pos in rows:
        by.setdefault(lemma, set()).add(pos)
    return {"entries": sum(map(len, by.values())), "lemmas": len(by), "ambiguous": sum(len(x) > 1 for x in by.values())}
