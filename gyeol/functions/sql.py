"""Functions for SQL: search and normalization as Arrow functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.matcher import Matcher, byte_offsets
from gyeol.functions.structure import Components
from gyeol.plans.compiler import compile_query, least
from gyeol.plans.lexer import Options

SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(query: str, options: Options | None = None, components: Components | None = None):  # noqa: ANN201
    """A function of a text column: the byte spans of all matches; null for null."""
    plan = compile_query(query, options)
    Matcher(plan, components)

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        m = Matcher(plan, components)
        needed = [least(anchors) for anchors in plan.anchors]

        def one(t: str | None) -> list[dict] | None:
            if t is None:
                return None
            if not all(any(a in t for a in anchors) for anchors in needed):
                return []
            got = m.find_all(t)
            off = byte_offsets(t, [x for s in got for x in (s[0].start, s[-1].end)])
            return [{"start": off[s[0].start], "end": off[s[-1].end]} for s in got]

        return texts.map(one, na_action=None)

    return found


def nfc():  # noqa: ANN201
    """A function of a text column: its composed form, for which Spark has no function of its own."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return composed


def token_boundary(c: Column, literal: str) -> Column:
    """Whether a literal stands between token boundaries, natively."""
    from gyeol.operators.search import TOKEN

    return c.rlike(f"(?<!{TOKEN}){literal}(?!{TOKEN})")


def register(spark: SparkSession, name: str, query: str, options: Options | None = None, components: Components | None = None) -> None:
    """SELECT name(text) in SQL gives the byte spans of query."""
    spark.udf.register(name, spans(query, options, components))
    spark.udf.register("nfc", nfc())
