"""Helpers shared by the corpus operators: tables, durable cuts of lineage, spans by native regular expressions."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.batches import in_batches  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the cluster's shared checkpoint folder; a lost executor costs no recomputation.

    The folder comes from the session (spark.checkpoint.dir). Only where none is set in local mode, as in tests, a temporary one is used: on a cluster executors would not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def once(key: tuple, make: Callable[[], object]) -> object:
    """One object per worker process and key, whatever tasks come; only the last of each kind (key[0]) is kept."""
    kept = sys.__dict__.setdefault("_gyeol_kept", {})
    if kept.get(key[0], (None,))[0] != key:
        kept[key[0]] = (key, make())
    return kept[key[0]][1]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def spans_sql(text: str, pattern: str) -> str:
    """SQL for array<struct<s:int,e:int,m:string>>: the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches (split) and the matches (regexp_extract_all) come from the same left-to-right search, so their
    lengths add up to offsets. text and pattern are SQL expressions; the pattern must not match the empty string.
    """
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    pieces = f"split({text}, {pattern}, -1)"
    return f"""CASE WHEN {text} RLIKE {pattern} THEN aggregate(
        zip_with({found}, slice({pieces}, 1, size({found})), (f, p) -> named_struct('f', f, 'p', p)),
        named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int,m:string>>)),
        (a, x) -> named_struct('at', a.at + char_length(x.p) + char_length(x.f),
            'out', array_append(a.out, named_struct('s', a.at + char_length(x.p), 'e', a.at + char_length(x.p) + char_length(x.f), 'm', x.f))),
        a -> a.out) ELSE cast(array() AS array<struct<s:int,e:int,m:string>>) END"""


def sql_text(s: str) -> str:
    """A Spark SQL literal (raw: backslashes stay as they are)."""
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'
