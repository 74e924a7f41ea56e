"""What a query was compiled to, and why a span matched, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.plans.compiler import Plan


def explain_query(spark: SparkSession, plan: Plan) -> DataFrame:
    """A row per analysis: atom, analysis, lemma, pos, source, alternation, programs, anchors, states; and the plan's gap, normalization, bytes, diagnostics."""
    rows = []
    for k, a in enumerate(plan.atoms):
        for i, x in enumerate(a.analyses):
            own = [p for p in a.programs if any(j == i for j, _ in p.origins)]
            rows.append((k, i, x.lemma, x.pos, x.source, x.predicate.alternation if x.predicate else None, len(own), len({p.anchor for p in own}), sorted({p.then.state if p.then.kind == "continuation" else p.then.kind for p in own}), plan.max_gap, plan.options.normalization, plan.bytes, list(plan.diagnostics)))
    return spark.createDataFrame(rows, "atom int, analysis int, lemma string, pos string, source string, alternation string, programs int, anchors int, states array<string>, max_gap int, normalization string, bytes bigint, diagnostics array<string>")


def programs(spark: SparkSession, plan: Plan) -> DataFrame:
    """A row per candidate program."""
    rows = [(k, p.anchor, len(p.anchor[: p.core].encode()), p.then.kind, p.then.state, p.left, p.right, p.structural, [{"analysis": i, "rules": list(r)} for i, r in p.origins]) for k, a in enumerate(plan.atoms) for p in a.programs]
    return spark.createDataFrame(rows, "atom int, anchor string, core_bytes int, consumption string, state string, left boolean, right boolean, structural string, origins array<struct<analysis:int,rules:array<string>>>")


def explain_match(found: DataFrame) -> DataFrame:
    """A row per origin of each atom of each match."""
    rest = [c for c in found.columns if c not in ("atoms", "line", "surface", "start", "end", "column")]
    df = found.select(*rest, F.posexplode("atoms").alias("atom", "a"))
    return df.select(*rest, "atom", "a.start", "a.end", "a.core_start", "a.core_end", "a.surface", F.explode("a.origins").alias("o")).select("*", "o.analysis", "o.lemma", "o.pos", "o.rules").drop("o")
