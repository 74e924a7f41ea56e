"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates come from one regular expression per kind. Five labelers vote on each (-1, 0, 1): the strict form, a gazetteer, the words
before, the neighbours, and the variety of characters. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; its posteriors are the soft labels of a naive Bayes span classifier over kind, form and context, which decides.
Counts come from all documents, as one table of (kind, votes, features) whose size is bounded by the ranges of its columns
(8 kinds x 3^5 votes x 432 features), whatever the input. The four base kinds keep every valid match; the classifier
adds spans of the other kinds.

Defined cases: a null text is empty; an empty table gives no rows; without candidates the classifier adds nothing; repeated rows give
repeated rows; other columns, of any name, are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.llm.common import spans_sql, sql_text

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "person", "secret", "ssn"]
#: The local part and runs of digits are possessive and start at their first character or at the last match's end: one
#: reading of the text suffices, and the matches are those of the plain pattern.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+(?<=[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?|Sr|Sra)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that every match of the kind passes.
GATES = {"email": "contains(text, '@')", "phone": "contains(text, '+')", "ssn": "contains(text, '-')"}
CUES = {
    "email": "mail|contact|write|kontakt|courriel|correo", "ip": "ip|server|host|address|login", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf|appel", "iban": "iban|account|bank|konto|compte|cuenta", "person": "name|by|from|dear|hello|contact",
    "secret": "token|secret|key|password|passwd|auth|bearer|api", "ssn": "ssn|social|security|tax",
}
COUNTER = "version|isbn|issn|doi|page|chapter|example|sample|section"
GAZETTEER = {
    "email": r"\.(?:com|net|org|edu|gov|io|de|fr|es|uk)$", "ip": r"^(?!0|10\.|127\.|192\.168\.|255)", "card": r"^[3-6]", "phone": r"^\+(?:1|33|34|44|49|39|31|41|43|7|81|82|86|91)",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT|PL)", "person": r" (?:Anna|Maria|John|James|Mary|Peter|Paul|Michael|Thomas|David|Sarah|Laura|Marie|Pierre|Jean|Carlos|Juan|Hans|Klaus|Elena|Sofia|Daniel|Martin|Robert)",
    "secret": r"^(?:sk_|pk_|ghp_|gho_|xox|AKIA|eyJ|AIza|[0-9a-f]{32,}$)", "ssn": r"^(?!000|666|9)",
}
FEATURES = ["len", "digits", "left", "right", "cue"]

_digits = "regexp_replace(x.m, '[^0-9]', '')"
_luhn = f"""aggregate(sequence(1, char_length({_digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring({_digits}, -i, 1) AS int)
    ELSE 2 * cast(substring({_digits}, -i, 1) AS int) - if(cast(substring({_digits}, -i, 1) AS int) > 4, 9, 0) END) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": r"forall(split(x.m, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND cast(concat('0', ltrim('0', p)) AS decimal(20, 0)) <= 255)",
    "card": f"if(char_length({_digits}) BETWEEN 16 AND 19, {_luhn}, false)",
    "phone": f"char_length({_digits}) BETWEEN 8 AND 15",
    "iban": "char_length(regexp_replace(x.m, ' ', '')) BETWEEN 15 AND 34",
    "person": "true",
    "secret": "x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]'",
    "ssn": "NOT x.m RLIKE '-0000$|-00-'",
}


def candidates(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, c: array of (kind, s, e, valid, votes, feats), by kind as listed, then start; with keep also every other column."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    cols = docs.columns
    for k in KINDS:
        found = spans_sql("text", sql_text(PATTERNS[k]))
        df = df.withColumn(f"__{k}", F.expr(f"CASE WHEN {GATES.get(k, 'true')} THEN {found} ELSE cast(array() AS array<struct<s:int,e:int,m:string>>) END"))
    for k in KINDS:
        before = "lower(substring(text, greatest(x.s - 39, 1), least(x.s, 40)))"
        left, right = "if(x.s = 0, '', substring(text, x.s, 1))", "substring(text, x.e + 1, 1)"
        kind_of = lambda c: f"CASE WHEN {c} = '' THEN 'e' WHEN {c} RLIKE '[\\\\s]' THEN 's' WHEN {c} RLIKE '[\\\\p{{L}}\\\\p{{N}}_]' THEN 'w' ELSE 'p' END"
        cue = f"CASE WHEN {before} RLIKE '(?:{COUNTER})' THEN -1 WHEN {before} RLIKE '(?:{CUES[k]})' THEN 1 ELSE 0 END"
        variety = "size(array_distinct(split(x.m, '')))"
        votes = [
            f"if({VALID[k]}, 1, -1)",
            f"if(x.m RLIKE {sql_text(GAZETTEER[k])}, 1, {0 if k == 'person' else -1})",
            cue,
            f"if({left} RLIKE '[\\\\p{{L}}\\\\p{{N}}_]' OR {right} RLIKE '[\\\\p{{L}}\\\\p{{N}}_]', -1, 1)",
            f"CASE WHEN {variety} <= 3 THEN -1 WHEN {variety} >= 6 THEN 1 ELSE 0 END",
        ]
        feats = [
            "cast(least(floor(log2(greatest(x.e - x.s, 1))), 7) AS string)",
            f"cast(floor(3.0 * char_length({_digits}) / greatest(x.e - x.s, 1)) AS string)",
            kind_of(left), kind_of(right), f"cast({cue} AS string)",
        ]
        df = df.withColumn(f"__{k}", F.expr(f"transform(__{k}, x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e, 'valid', {VALID[k]}, 'votes', array({', '.join(votes)}), 'feats', array({', '.join(feats)})))"))
    return df.select(*(cols if keep else ["doc_id"]), F.concat(*[f"__{k}" for k in KINDS]).alias("__c"))


def fit(docs: DataFrame, rounds: int = 30) -> dict[str, float]:
    """Log odds of the span classifier by 'kind|feature|value', and of each kind by 'kind'. One pass over docs."""
    x = candidates(docs).select(F.explode("__c").alias("x")).select("x.kind", "x.votes", "x.feats")
    table = [(r.kind, tuple(r.votes), tuple(r.feats), r.n) for r in x.groupBy("kind", "votes", "feats").agg(F.count("*").alias("n")).collect()]
    counts: dict = {}
    for kind, votes, _, n in table:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    # two classes, the labelers independent given the class; started from the majority
    post = {key: 1 / (1 + math.exp(-1.5 * sum(key[1]))) for key in counts}
    for _ in range(rounds):
        prior = {k: [1.0, 1.0] for k in KINDS}
        lik = {(j, v): [0.5, 0.5] for j in range(5) for v in (-1, 0, 1)}
        for (kind, votes), n in counts.items():
            p = post[kind, votes]
            for c, w in ((1, n * p), (0, n * (1 - p))):
                prior[kind][c] += w
                for j, v in enumerate(votes):
                    lik[j, v][c] += w
        tot = [[sum(lik[j, v][c] for v in (-1, 0, 1)) for c in (0, 1)] for j in range(5)]
        for kind, votes in counts:
            odds = math.log(prior[kind][1] / prior[kind][0]) + sum(math.log(lik[j, v][1] / tot[j][1] * tot[j][0] / lik[j, v][0]) for j, v in enumerate(votes))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    soft: dict[str, list[float]] = {}
    for kind, votes, feats, n in table:
        p = post[kind, votes]
        for key in (kind, *(f"{kind}|{f}|{v}" for f, v in zip(FEATURES, feats, strict=True))):
            s = soft.setdefault(key, [0.5, 0.5])
            s[1] += n * p
            s[0] += n * (1 - p)
    out = {}
    for key, (no, yes) in soft.items():
        kind = key.split("|")[0]
        out[key] = math.log(yes / no) if key == kind else math.log(yes / no) - math.log(soft[kind][1] / soft[kind][0])
    return out


def _odds(model: dict[str, float]) -> str:
    if not model:
        return "-1.0"
    m = "map(" + ", ".join(f"'{k}', {v:.6f}D" for k, v in sorted(model.items())) + ")"
    return f"aggregate(sequence(0, 4), coalesce(element_at({m}, x.kind), -9.0D), (a, i) -> a + coalesce(element_at({m}, concat(x.kind, '|', array({', '.join(repr(f) for f in FEATURES)})[i], '|', x.feats[i])), 0.0D))"


def detect(docs: DataFrame, model: dict[str, float] | None = None, keep: bool = False) -> DataFrame:
    """doc_id (with keep: all columns), __base and __all: arrays of (kind, s, e), by kind as listed, then start."""
    model = fit(docs) if model is None else model
    df = candidates(docs, keep)
    names = ", ".join(f"'{k}'" for k in BASE)
    thin = "x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)"
    base = f"transform(filter(__c, x -> x.kind IN ({names}) AND x.valid), {thin})"
    own = f"transform(filter(__c, x -> x.kind NOT IN ({names}) AND x.valid AND {_odds(model)} >= 0), {thin})"
    return df.withColumn("__base", F.expr(base)).withColumn("__all", F.concat("__base", F.expr(own))).drop("__c")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    df = detect(docs)
    counts = [F.expr(f"cast(size(filter(__base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__all").alias("spans"), F.size("__all").cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets, n_chars renewed; overlapping spans become one, named by the first."""
    df = detect(docs, model, keep=True)
    order = "array_sort(transform(__all, x -> named_struct('s', x.s, 'e', -x.e, 'kind', x.kind)))"
    text = f"""aggregate({order}, named_struct('at', 0, 'out', ''), (a, x) -> CASE
        WHEN x.s >= a.at THEN named_struct('at', -x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), '[', upper(x.kind), ']'))
        ELSE named_struct('at', greatest(a.at, -x.e), 'out', a.out) END, a -> concat(a.out, substring(text, a.at + 1)))"""
    df = df.withColumn("text", F.when(F.size("__all") > 0, F.expr(text)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select(*docs.columns)
