"""The same search over streams: stateless, line by line, with the prefilters of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.operators import search
from gyeol.plans.lexer import Options


def find_all_stream(stream: DataFrame, query: str, options: Options | None = None, text: str = "text", keep: list[str] | None = None, **more: object) -> DataFrame:
    """find_all over readStream; each micro-batch is independent."""
    return search.find_all(stream, query, options, text, keep, **more)


def windowed_counts(found: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Matches per window of event time; windows close when the watermark passes them."""
    return found.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("matches")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "matches")
