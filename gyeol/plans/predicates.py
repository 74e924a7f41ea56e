"""Inflection of predicates: from a dictionary form to anchors and the states in which their endings continue."""

from __future__ import annotations

from dataclasses import dataclass, field

from gyeol.functions import hangul as H
from gyeol.plans import grammar

ACTION = {"VV", "VX"}
ADJECTIVE = {"VA", "VXA"}


class GenerateError(ValueError):
    pass


@dataclass(frozen=True)
class Predicate:
    lemma: str
    pos: str  # VV, VA, VX (auxiliary verb), VXA (auxiliary adjective), VCP, VCN
    alternation: str = "Regular"
    flags: frozenset[str] = frozenset()
    overrides: tuple[tuple[str, str], ...] = ()  # (rule, surface)
    derivations: tuple[tuple[str, str, str], ...] = ()  # (target lemma, part of speech, rule)

    @property
    def stem(self) -> str:
        if len(self.lemma) < 2 or not self.lemma.endswith("다") or H.split(self.lemma[-2]) is None:
            raise GenerateError(f"not a predicate lemma: {self.lemma}")
        return self.lemma[:-1]

    @property
    def action(self) -> bool:
        return self.pos in ACTION


@dataclass(frozen=True)
class Branch:
    anchor: str
    core: int  # characters of the anchor that are the stem's
    state: str  # terminal, aoeo, past, future, declarative, eu
    rules: tuple[str, ...] = field(default=())


E = lambda *names: tuple(f"ending.{n}" for n in names)


class Inflector:
    def __init__(self, p: Predicate) -> None:
        self.p, self.stem, self.alt = p, p.stem, p.alternation
        self.lexical = () if self.alt == "Regular" else (f"lexical.{grammar.ALTERNATIONS[self.alt]}",)
        self.out: list[Branch] = []

    def put(self, anchor: str, core: int, rules: tuple[str, ...], state: str = "terminal") -> None:
        self.out.append(Branch(anchor, core, state, rules))

    def changed(self, old: str, new: str | None) -> str:
        """The stem with its final consonant replaced (None: dropped)."""
        if H.final_of(self.stem) != H.T[old]:
            raise GenerateError(f"{self.p.lemma}: {self.alt} needs a stem in {old}")
        return H.with_final(self.stem, H.T[new] if new else 0)

    def b_stem(self) -> str:
        return self.changed("ㅂ", None) + "우"

    def before_reu(self) -> str:
        if len(self.stem) < 2 or self.stem[-1] != "르":
            raise GenerateError(f"{self.p.lemma}: {self.alt} needs a stem in 르")
        return self.stem[:-1]

    def vowel_stem(self) -> tuple[str, bool, tuple[str, ...]]:
        """The stem before endings in a vowel, whether they keep their full form, and the rules so far."""
        if self.alt == "DToL":
            return self.changed("ㄷ", "ㄹ"), True, self.lexical
        if self.alt == "DropS":
            return self.changed("ㅅ", None), True, self.lexical
        if self.alt in ("BToWa", "BToWo"):
            return self.b_stem(), False, self.lexical
        if self.alt == "DropH":
            return self.changed("ㅎ", None), False, self.lexical
        return self.stem, False, ()

    def merged(self, final: str, full: str, rieul: str | None, rules: tuple[str, ...]) -> tuple[str, int, tuple[str, ...]]:
        """An ending that is one consonant after a vowel, a syllable after other consonants."""
        base, keep, first = self.vowel_stem()
        t = H.final_of(base)
        if keep or (t and t != H.T["ㄹ"]):
            s = base + full
        elif t:
            s = H.with_final(base, H.T[rieul]) if rieul else base
        else:
            s = H.with_final(base, H.T[final])
        return s, len(base), first + rules

    def fused(self, final: str, tail: str, full: str) -> tuple[str, int]:
        """The plain stem with a consonant before tail, or full after it."""
        t = H.final_of(self.stem)
        return (self.stem + full, len(self.stem)) if t and t != H.T["ㄹ"] else (H.with_final(self.stem, H.T[final]) + tail, len(self.stem))

    def aoeo(self) -> list[tuple[str, int, tuple[str, ...]]]:
        """The stem joined with 아 or 어: (surface, core, rules)."""
        a, s, lex = self.alt, self.stem, self.lexical
        ah = lambda v: "아" if v in H.LIGHT else "어"
        if a in ("Copula", "Suppletive", "SurfaceOnly"):
            return []
        if a == "DropS":
            base = self.changed("ㅅ", None)
            return [(base + ah(H.split(base[-1])[1]), len(base), lex)]
        if a in ("BToWa", "BToWo"):
            out = H.with_vowel(self.b_stem(), H.V["ㅘ" if a == "BToWa" else "ㅝ"])
            return [(out, len(out), lex)]
        if a == "DropH":
            base = self.changed("ㅎ", None)
            out = H.with_vowel(base, {H.V["ㅑ"]: H.V["ㅒ"], H.V["ㅕ"]: H.V["ㅖ"]}.get(H.split(base[-1])[1], H.V["ㅐ"]))
            return [(out, len(out), (*lex, "contraction.h-irregular"))]
        if a == "ReuDoubleL":
            base = self.before_reu()
            t = H.final_of(base)
            if t not in (0, H.T["ㄹ"]):
                raise GenerateError(f"{self.p.lemma}: ㄹ cannot double after another consonant")
            out = H.with_final(base, H.T["ㄹ"]) + ("라" if H.split(base[-1])[1] in H.LIGHT else "러")
            return [(out, len(out), lex)]
        if a == "Reo":
            self.before_reu()
            return [(s + "러", len(s), lex)]
        if a == "Ha":
            if s[-1] != "하":
                raise GenerateError(f"{self.p.lemma}: Ha needs a stem in 하")
            return [(s + "여", len(s), lex), (H.with_vowel(s, H.V["ㅐ"]), len(s), (*lex, "contraction.ha-yeo"))]
        if a == "UToEo":
            if H.split(s[-1])[1:] != (H.V["ㅜ"], 0):
                raise GenerateError(f"{self.p.lemma}: UToEo needs a stem in ㅜ")
            return [(H.with_vowel(s, H.V["ㅓ"]), len(s), lex)]
        if a == "DToL":
            s = self.changed("ㄷ", "ㄹ")
        _, v, t = H.split(s[-1])
        n = len(s)
        if t:
            return [(s + ah(v), n, lex)]
        if v in (H.V["ㅏ"], H.V["ㅓ"]):
            return [(s, n, lex)]
        if v == H.V["ㅡ"]:
            before = next((x[1] for c in reversed(s[:-1]) if (x := H.split(c))), H.V["ㅓ"])
            return [(H.with_vowel(s, H.V["ㅏ" if before in H.LIGHT else "ㅓ"]), n, (*lex, "contraction.eu-drop"))]
        short = {"ㅗ": ("ㅘ", "o-a"), "ㅜ": ("ㅝ", "u-eo"), "ㅚ": ("ㅙ", "oe-eo"), "ㅣ": ("ㅕ", "i-eo"), "ㅐ": ("ㅐ", "identical-vowel"), "ㅔ": ("ㅔ", "identical-vowel"), "ㅕ": ("ㅕ", "yeo-eo")}
        out = [(s + ah(v), n, lex)]
        for old, (new, rule) in short.items():
            if v == H.V[old] and not (old == "ㅣ" and "NO_I_EO_CONTRACTION" in self.p.flags):
                out.append((H.with_vowel(s, H.V[new]), n, (*lex, f"contraction.{rule}")))
        return out

    def eu(self) -> tuple[str, int, tuple[str, ...]] | None:
        """The stem with 으 where it takes one."""
        if self.alt in ("DToL", "DropS"):
            base = self.vowel_stem()[0]
            return base + "으", len(base), self.lexical
        if self.alt == "Regular" and H.final_of(self.stem) not in (0, H.T["ㄹ"]):
            return self.stem + "으", len(self.stem), ()
        return None

    def soft(self) -> tuple[str, tuple[str, ...]] | None:
        """The stem before 면, 며, 려고 where it takes no 으."""
        if self.alt in ("BToWa", "BToWo"):
            return self.b_stem(), self.lexical
        if self.alt == "DropH":
            return self.changed("ㅎ", None), self.lexical
        return None if self.alt in ("Suppletive", "SurfaceOnly") else (self.stem, ())

    def branches(self) -> list[Branch]:
        s, n, p = self.stem, len(self.stem), self.p
        goes_on = p.pos in ADJECTIVE and "NO_DECLARATIVE_CONTINUATION" not in p.flags
        self.put(p.lemma, n, E("final-da"), "declarative" if goes_on else "terminal")
        if self.alt not in ("Suppletive", "SurfaceOnly"):
            self.put(s + "기", n, E("nominalizer-gi"))
            self.put(*self.merged("ㅁ", "음", "ㄻ", E("nominalizer")))
            self.copula() if self.alt == "Copula" else self.productive()
        for rule, surface in p.overrides:
            self.put(surface, len(surface), (rule,))
        return self.out

    def productive(self) -> None:
        s, n = self.stem, len(self.stem)
        for suffix, rule in zip("고 지 게 던 더니 더라도 도록".split(), "connective-go connective-ji adverbial-ge retrospective-adnominal retrospective-connective concessive-deorado purpose-dorok".split(), strict=True):
            self.put(s + suffix, n, E(rule))
        self.put(s + "겠", n, E("future"), "future")
        for surface, core, rules in self.aoeo():
            self.put(surface, core, rules + E("aoeo"), "aoeo")
            if H.final_of(surface) != 0:
                raise GenerateError(f"{self.p.lemma}: no past of {surface}")
            self.put(H.with_final(surface, H.T["ㅆ"]), core, rules + E("past"), "past")
        eu, soft = self.eu(), self.soft()
        rieul = self.alt == "Regular" and H.final_of(s) == H.T["ㄹ"]
        if eu:
            self.put(eu[0], eu[1], eu[2], "eu")
        elif soft:
            base, rules = soft
            self.put(base + "면", len(base), rules + E("conditional"))
            self.put(base + "며", len(base), rules + E("coordinate-myeo"))
            if rieul:
                self.rieul()
            else:
                self.put(base, len(base), rules, "eu")
        if self.p.action:
            for suffix, rules in (("자", E("propositive-ja")), ("자고", E("propositive-ja", "quotative-go")), ("느냐", E("interrogative-neunya")), ("곤", (*E("connective-go"), "particle.topic")), ("거라", E("imperative-geora"))):
                self.put(s + suffix, n, rules)
            if s.endswith("오"):
                self.put(s + "너라", n, E("imperative-neora"))
            base, core, rules = eu or (soft[0], len(soft[0]), soft[1])
            self.put(base + "려고", core, rules + E("intentive-ryeogo"))
            self.put(base + "려는", core, rules + E("intentive-adnominal"))
            t = H.final_of(base)
            self.put((H.with_final(base, H.T["ㅂ"]) if t in (0, H.T["ㄹ"]) else base + "읍") + "시다", core, rules + E("propositive"))
            self.put((H.with_final(s, 0) if H.final_of(s) == H.T["ㄹ"] else s) + "는", n, E("present-adnominal"))
            self.put(*self.fused("ㄴ", "다", "는다"), E("declarative"), "declarative")
        self.put(*self.merged("ㄴ", "은", "ㄴ", E("past-adnominal")))
        future, core, rules = self.merged("ㄹ", "을", None, ())
        self.put(future, core, rules + E("future-adnominal"))
        self.put(future + "세", core, rules + E("final-rieulse"))
        self.put(*self.fused("ㅂ", "니다", "습니다"), E("polite-declarative"))

    def rieul(self) -> None:
        s, base, n = self.stem, H.with_final(self.stem, 0), len(self.stem)
        for x in ("니", "니까", "니깐", "니까는"):
            self.put(base + x, n, E("connective-ni"))
        self.put(s + "리라", n, E("prospective-final"))
        self.put(s + "리라고", n, E("prospective-quotative"))
        self.put(base + "셨", n, ("ending.honorific", "contraction.si-past", "ending.past"), "past")
        for x, rule in (("시다", "final-da"), ("시면", "conditional"), ("신", "past-adnominal"), ("실", "future-adnominal"), ("십니다", "polite-declarative")):
            self.put(base + x, n, E("honorific", rule))

    def copula(self) -> None:
        if self.stem != "이":
            raise GenerateError(f"{self.p.lemma}: only 이다 is the copula")
        for surface, rule in zip("다 여서 인 일 이고 이며 이므로 이지 이라고 이라는".split(), "final-da aoeo-seo past-adnominal future-adnominal connective-go coordinate-myeo connective-meuro connective-ji copula-quotative-go copula-quotative-adnominal".split(), strict=True):
            self.put(surface, 1, ("lexical.copula", f"ending.{rule}"))
        self.put("이어", 1, ("lexical.copula", "ending.aoeo"), "aoeo")
        self.put("입니다", 1, ("lexical.copula", "ending.polite-declarative"))
        self.put("이었", 1, ("lexical.copula", "ending.past"), "past")
        self.put("였", 1, ("lexical.copula", "ending.past"), "past")


def branches(p: Predicate) -> list[Branch]:
    return Inflector(p).branches()


def fallback_stems(p: Predicate) -> list[Branch]:
    """The stems before endings that only a catalogue lists."""
    x = Inflector(p)
    found = {Branch(x.stem, len(x.stem), "terminal")}
    if eu := x.eu():
        found.add(Branch(eu[0], eu[1], "terminal", eu[2]))
    if (soft := x.soft()) and soft[0] != x.stem:
        found.add(Branch(soft[0], len(soft[0]), "terminal", soft[1]))
    return sorted(found, key=lambda b: b.anchor)


def continued(state: str, action: bool, following: str) -> tuple[int, tuple[str, ...]] | None:
    """(characters consumed, rules) of the longest ending in this state; None where one is needed and there is none."""
    for suffix, rules in grammar.continuations(state):
        if following.startswith(suffix) and (action or rules != ("ending.imperative-ra",)):
            return len(suffix), rules
    return None if state == "eu" else (0, ())
