"""Chains of particles after a nominal."""

from __future__ import annotations

from gyeol.functions import hangul as H
from gyeol.plans import grammar

LIMIT = 4


def accepts(needs: str, previous: str) -> bool:
    t = H.final_of(previous)
    if needs == "any":
        return True
    if t is None:
        return False
    rieul = H.T["ㄹ"]
    return {"consonant": t != 0, "vowel": t == 0, "vowel-or-rieul": t in (0, rieul), "consonant-not-rieul": t not in (0, rieul)}[needs]


def chain(core: str, following: str, plural: bool = True) -> tuple[int, tuple[str, ...]]:
    """(characters consumed, rules): an optional plural, then the longest particle each time, never taken back."""
    forms, follows = grammar.particles()
    at, rules, last = 0, [], core[-1:]
    if plural and following.startswith("들"):
        at, last = 1, "들"
        rules.append("particle.plural")
    while last and len(rules) < LIMIT:
        fits = [f for f in forms if following.startswith(f.form, at) and accepts(f.needs, last) and (not rules or f.rule in follows[rules[-1]])]
        if not fits:
            break
        best = max(fits, key=lambda f: len(f.form))
        at, last = at + len(best.form), best.form[-1]
        rules.append(best.rule)
    return at, tuple(rules)


def exact(core: str, following: str) -> tuple[str, ...] | None:
    n, rules = chain(core, following)
    return rules if n == len(following) else None


def auxiliary_exact(core: str, following: str) -> tuple[str, ...] | None:
    rules = exact(core, following)
    aux = {f.rule for f in grammar.particles()[0] if f.role == "auxiliary"}
    return rules if rules and all(r in aux for r in rules) else None


def rules_of(role: str | None = None, host: str | None = None) -> frozenset[str]:
    forms, follows = grammar.particles()
    if role is None:
        return frozenset(follows)
    return frozenset(f.rule for f in forms if f.role == role and (host is None or host in f.hosts))
