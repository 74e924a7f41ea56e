"""Output forms of matches: text lines, JSON lines, highlighting, other offset units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B-\x1F\x7F\u0080-\u009F]"


def content(line: Column) -> Column:
    """A line without its line end."""
    return F.regexp_replace(line, r"[\r\n]+\z", "")


def safe(c: Column) -> Column:
    """Control characters of untrusted text made visible."""
    return F.regexp_replace(c, CONTROL, "�")


def text_lines(df: DataFrame, key: str, with_key: bool = True, column: bool = True) -> DataFrame:
    """One column, output: key:line:column: content; lines of context have - between."""
    kind = F.col("kind") if "kind" in df.columns else F.lit("match")
    d = F.when(kind == "context", "-").otherwise(":")
    parts = [F.concat(F.col(key).cast("string"), d)] if with_key else []
    parts.append(F.concat(F.col("line_number").cast("string"), d))
    if column and "column" in df.columns:
        parts.append(F.concat(F.col("column").cast("string"), d))
    return df.select(F.concat(*parts, F.lit(" "), safe(content(F.col("line")))).alias("output"))


def highlighted(line: Column, start: Column, end: Column, on: str = "\x1b[1;31m", off: str = "\x1b[0m") -> Column:
    """A line with the bytes start to end marked."""
    raw = F.encode(line, "UTF-8")
    cut = lambda a, n: F.decode(F.substring(raw, a, n), "UTF-8")
    return F.concat(cut(F.lit(1), start.cast("int")), F.lit(on), cut(start.cast("int") + 1, (end - start).cast("int")), F.lit(off), cut(end.cast("int") + 1, F.lit(2**31 - 1)))


def utf16(line: Column, byte: Column) -> Column:
    """A UTF-8 byte offset in UTF-16 units."""
    return F.expr("1") * (F.octet_length(F.encode(F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte.cast("int")), "UTF-8"), "UTF-16LE")) / 2).cast("long")


def lossless(raw: Column) -> Column:
    """struct<text, bytes>: UTF-8 as text, anything else as base64."""
    ok = F.is_valid_utf8(raw.cast("string"))
    return F.struct(F.when(ok, raw.cast("string")).alias("text"), F.when(~ok, F.base64(raw)).alias("bytes"))


def json_lines(found: DataFrame, key: str, around: DataFrame | None = None) -> DataFrame:
    """One column, json: a record per matching line with its spans and their atoms. around, the rows of search.context(), adds a record per line of context
    and a context_break before each gap; then order (the key, line and kind that records are sorted by) comes first."""
    spans = F.array_sort(F.collect_list(F.struct("match_index", "start", "end", "column", "surface", "atoms")))
    df = found.groupBy(key, "line_number", "byte_offset", "line").agg(spans.alias("matches"))
    path = F.struct(F.col(key).cast("string").alias("text"))
    lines = F.struct(content(F.col("line")).alias("text")).alias("lines")
    record = F.to_json(F.struct(F.lit("match").alias("type"), path.alias("path"), "line_number", F.col("byte_offset").alias("absolute_offset"), lines, "matches")).alias("json")
    if around is None:
        return df.select(record)
    order = lambda rank: F.struct(key, "line_number", F.lit(rank).alias("rank")).alias("order")
    near = around.where("kind = 'context'").select(order(1), F.to_json(F.struct(F.lit("context").alias("type"), path.alias("path"), "line_number", lines)).alias("json"))
    gaps = around.where("break_before").select(order(0), F.to_json(F.struct(F.lit("context_break").alias("type"), path.alias("path"))).alias("json"))
    return df.select(order(1), record).unionByName(near).unionByName(gaps)


def exit_status(has_match: bool, errors: int = 0) -> int:
    return 2 if errors else 0 if has_match else 1
