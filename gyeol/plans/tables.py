"""Grammar and lexicon tables: tab-separated text with a header line, read and checked as a whole.

The tables are plain rows in gyeol/data. A caller's own rows are read by the same functions, from text of the same form. Tables are read when the package is imported, on the
driver; what tasks need of them goes along with the functions that they run.
"""

from __future__ import annotations

from pathlib import Path

from gyeol.functions import hangul as H

DATA = Path(__file__).resolve().parent.parent / "data"
#: Columns of each table; the first ones, up to the number given, tell a row from all others.
COLUMNS: dict[str, tuple[int, tuple[str, ...]]] = {
    "particles": (1, ("id", "role", "hosts", "selection", "forms", "next")),
    "continuations": (2, ("state", "suffix", "rules")),
    "endings": (1, ("id",)),
    "alternations": (1, ("name", "id")),
    "contractions": (1, ("id", "kind", "left", "result")),
    "derivations": (1, ("id", "suffix", "pos", "alternation")),
    "predicates": (3, ("lemma", "pos", "alternation", "flags", "overrides")),
    "nominals": (2, ("lemma", "pos", "overrides")),
    "modifiers": (2, ("lemma", "pos")),
    "particle_lemmas": (1, ("lemma", "rule")),
}
#: Labelled sentences for measuring; they are no part of the grammar.
CASES = ("feature", "query", "expand", "boundary", "text", "surface")
SELECTIONS = {"literal": ("any",), "final-pair": ("consonant", "vowel"), "direction": ("consonant-not-rieul", "vowel-or-rieul")}
ROLES, HOSTS = {"plural", "case", "auxiliary"}, {"nominal", "adverb", "predicate-ending"}
FLAGS = {"RIEUL_DROP", "EU_DROP", "NO_I_EO_CONTRACTION", "NO_DECLARATIVE_CONTINUATION"}


class DataError(ValueError):
    pass


def parse(name: str, text: str) -> list[dict[str, str]]:
    """The rows of one table. Lines that begin with # and empty ones are passed over; every error names its line."""
    key, columns = COLUMNS[name] if name in COLUMNS else (len(CASES), CASES)
    rows, seen, head = [], set(), None
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("#"):
            continue
        cells = line.split("\t")
        if head is None:
            head = tuple(cells)
            if head != columns:
                raise DataError(f"{name}, line {n}: columns {', '.join(head)} where {', '.join(columns)} are due")
            continue
        if len(cells) != len(columns):
            raise DataError(f"{name}, line {n}: {len(cells)} cells for {len(columns)} columns")
        if not cells[0] or any(c != H.nfc(c) for c in cells):
            raise DataError(f"{name}, line {n}: text must be NFC, and the first cell not empty")
        if (k := tuple(cells[:key])) in seen:
            raise DataError(f"{name}, line {n}: {' '.join(k)} is there already")
        seen.add(k)
        rows.append(dict(zip(columns, cells, strict=True)))
    if head is None:
        raise DataError(f"{name}: no header")
    return rows


def load(name: str, folder: Path = DATA) -> list[dict[str, str]]:
    return parse(name, (folder / f"{name}.tsv").read_text(encoding="utf-8"))


def pairs(cell: str) -> tuple[tuple[str, str], ...]:
    """rule=surface;rule=surface"""
    out = []
    for x in filter(None, cell.split(";")):
        rule, eq, surface = x.partition("=")
        if not eq or not rule or not surface:
            raise DataError(f"override {x}")
        out.append((rule, surface))
    return tuple(out)


def problems(tables: dict[str, list[dict[str, str]]]) -> list[str]:
    """What is wrong between the rows of all tables: unknown names, rules that lead nowhere, forms that do not fit their selection."""
    out: list[str] = []
    t = {name: tables.get(name, []) for name in COLUMNS}
    particles, endings = {r["id"] for r in t["particles"]}, {r["id"] for r in t["endings"]}
    alternations = {r["name"] for r in t["alternations"]}
    rules = particles | endings | {r["id"] for name in ("contractions", "derivations", "alternations") for r in t[name]}
    say = lambda name, row, what: out.append(f"{name} {next(iter(row.values()))}: {what}")
    for r in t["particles"]:
        forms, selection = r["forms"].split(), r["selection"]
        if r["role"] not in ROLES or not set(r["hosts"].split()) <= HOSTS or not r["hosts"]:
            say("particles", r, f"role {r['role']}, hosts {r['hosts']}")
        if selection not in SELECTIONS or not forms or (selection != "literal" and len(forms) != 2):
            say("particles", r, f"{len(forms)} forms for selection {selection}")
        for x in set(r["next"].split()) - particles:
            say("particles", r, f"unknown next {x}")
    for r in t["continuations"]:
        for x in set(r["rules"].split()) - particles - endings:
            say("continuations", r, f"unknown rule {x}")
        if not r["suffix"] or not r["rules"]:
            say("continuations", r, "no suffix or no rule")
    for r in t["derivations"]:
        if r["alternation"] and r["alternation"] not in alternations:
            say("derivations", r, f"unknown alternation {r['alternation']}")
    for r in t["predicates"]:
        if r["alternation"] not in alternations:
            say("predicates", r, f"unknown alternation {r['alternation']}")
        for x in set(filter(None, r["flags"].split("|"))) - FLAGS:
            say("predicates", r, f"unknown flag {x}")
    for name in ("predicates", "nominals"):
        for r in t[name]:
            try:
                for rule, _ in pairs(r["overrides"]):
                    if rule not in rules:
                        say(name, r, f"unknown rule {rule}")
            except DataError as e:
                say(name, r, str(e))
    for r in t["particle_lemmas"]:
        if r["rule"] not in particles:
            say("particle_lemmas", r, f"unknown rule {r['rule']}")
    return out
