"""Dictionaries as tables: part-of-speech lists in Parquet, their statistics, and the report on the grammar's own data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.lattice import BEST, Lattice
from gyeol.plans import grammar, lexicon

COVERS = "array<struct<cost:bigint,nodes:array<struct<start:int,end:int,surface:string,pos:string,known:boolean>>>>"


def encode_pos(rows: DataFrame, path: str) -> None:
    """Write (lemma, pos) once each, in order; empty and null lemmas are no entries."""
    entries = rows.select("lemma", "pos").where("lemma <> '' AND pos IS NOT NULL").distinct()
    entries.repartitionByRange("lemma", "pos").sortWithinPartitions("lemma", "pos").write.mode("errorifexists").parquet(path)


def decode_pos(spark: SparkSession, path: str) -> DataFrame:
    """lemma, pos of a list that encode_pos() wrote; unknown parts of speech are an error."""
    rows = spark.read.schema("lemma string, pos string").parquet(path)
    bad = rows.where(~F.col("pos").isin([*lexicon.COARSE, "JX", "JC", "JKS", "JKB", "JKO", "JKG", "JKC", "JKV", "JKQ"])).select("pos").distinct().limit(5).collect()
    if bad:
        raise lexicon.DataError(f"{path}: unknown parts of speech {', '.join(sorted(r.pos for r in bad))}")
    return rows


def pos_stats(rows: DataFrame) -> DataFrame:
    """entries, lemmas, ambiguous (lemmas of several parts of speech), and distinct parts of speech, of (lemma, pos)."""
    per = rows.select("lemma", "pos").distinct().groupBy("lemma").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count("*").alias("lemmas"), F.count_if(F.col("n") > 1).alias("ambiguous"))


def builtin_pos(spark: SparkSession) -> DataFrame:
    """lemma, pos of the small lexicon."""
    rows = [(r["lemma"], r["pos"]) for name in ("predicates", "nominals", "modifiers") for r in grammar.TABLES[name]]
    return spark.createDataFrame(rows, "lemma string, pos string")


def data_report(spark: SparkSession, given: dict[str, str] | None = None) -> DataFrame:
    """One row: how many rows each table has, and what is wrong with them."""
    row = lexicon.check_data(given)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'problems' else 'long'}" for k in row))


def covers(df: DataFrame, lattice: Lattice, best: int = BEST, text: str = "text") -> DataFrame:
    """The columns of df and covers: the cheapest covers of each text by the words of a lattice, cheapest first; none for null, empty and uncoverable texts.

    A text is covered as a whole, so it should be a token or a sentence; the lattice goes along with the tasks once."""
    shared = df.sparkSession.sparkContext.broadcast(lattice)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b[text].to_pylist():
                found = shared.value.covers(t, best) if t else []
                out.append([{"cost": c.cost, "nodes": [{"start": n.start, "end": n.end, "surface": t[n.start : n.end], "pos": n.pos, "known": n.known} for n in c.nodes]} for c in found])
            node = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("pos", pa.string()), ("known", pa.bool_())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.struct([("cost", pa.int64()), ("nodes", pa.list_(node))])))], [*b.schema.names, "covers"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(rows, f"{names}, covers {COVERS}")
