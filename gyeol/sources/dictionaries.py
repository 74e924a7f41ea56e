"""Morphological dictionaries in their usual text forms, as tables: words and costs in CSV, a matrix of connection costs, classes of characters, unknown words.

Tables are read and written by Spark; what a lattice needs on the executors is sent to them behind a count of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.lattice import Kind, Lattice, Unknown, Word
from gyeol.plans.tables import DataError

COLUMNS = ["surface", "left", "right", "cost", "pos", "semantic", "final", "reading", "type", "first_pos", "last_pos", "expression"]
#: Rows of words and of the matrix that may be sent to every executor.
WORDS, CELLS = 2_000_000, 20_000_000


def words(spark: SparkSession, path: str) -> DataFrame:
    """surface, left, right, cost, pos, type, first_pos, last_pos, expression of a dictionary's CSV files; * is null. Rows whose numbers are none are an error."""
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("escape", '"').csv(path)
    star = lambda c: F.when(F.col(c) != "*", F.col(c)).alias(c)
    out = rows.select("surface", *[F.col(c).cast("int").alias(c) for c in ("left", "right", "cost")], "pos", star("type"), star("first_pos"), star("last_pos"), star("expression"))
    return out.where("surface IS NOT NULL AND surface <> ''").dropDuplicates()


def pos_entries(rows: DataFrame) -> DataFrame:
    """lemma, pos, once each, of the words of a dictionary: simple words, and of the others those with one part of speech. Predicates get their ending 다."""
    one = rows.where(~F.contains("pos", F.lit("+")))
    lemma = F.when(F.col("pos").isin("VV", "VA", "VX", "VCP", "VCN"), F.concat("surface", F.lit("다"))).otherwise(F.col("surface"))
    return one.select(lemma.alias("lemma"), "pos").distinct()


def components(rows: DataFrame) -> DataFrame:
    """surface, pos: parts of speech joined by +, as decisions by the parts of tokens take them."""
    return rows.select("surface", "pos").distinct()


def parts(expression: Column) -> Column:
    """array<struct<surface,pos>> of an expression such as 하/XSV/*+았/EP/*; null for null."""
    one = lambda x: F.struct(F.element_at(F.split(x, "/"), 1).alias("surface"), F.element_at(F.split(x, "/"), 2).alias("pos"))
    return F.transform(F.split(expression, r"\+(?=[^/+]+/)"), one)


def aligned(surface: str, wanted: list[tuple[str, str]]) -> list[tuple[int, int, str]] | None:
    """(start, end, pos) of an expression's parts in a surface, in characters: each part lies where it stands as it is, in order, and parts that are contracted share what is left
    between those. None where the parts' order does not fit the surface."""
    out: list[tuple[int, int, str]] = []
    at, k = 0, 0
    while k < len(wanted):
        text, pos = wanted[k]
        if surface.startswith(text, at) and at < len(surface):
            out.append((at, at + len(text), pos))
            at, k = at + len(text), k + 1
            continue
        # contracted: up to the next part that stands as it is, or to the end
        later = next(((j, i) for j in range(k + 1, len(wanted)) for i in [surface.find(wanted[j][0], at + 1)] if i > 0), (len(wanted), len(surface)))
        if later[1] <= at:
            return None
        out += [(at, later[1], p) for _, p in wanted[k : later[0]]]
        at, k = later[1], later[0]
    return out if at == len(surface) else None


def connections(spark: SparkSession, path: str) -> DataFrame:
    """right, left, cost: a file of lines of three numbers after one that gives the two sizes. Places outside the sizes are an error when read."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where("size(v) >= 2 AND v[0] <> ''")
    sizes = rows.where("size(v) = 2").select(F.col("v")[0].cast("int").alias("rights"), F.col("v")[1].cast("int").alias("lefts")).first()
    if sizes is None:
        raise DataError(f"{path}: no line of sizes")
    out = rows.where("size(v) = 3").select(F.col("v")[0].cast("int").alias("right"), F.col("v")[1].cast("int").alias("left"), F.col("v")[2].cast("int").alias("cost"))
    if not out.where(f"right < 0 OR left < 0 OR right >= {sizes.rights} OR left >= {sizes.lefts}").isEmpty():
        raise DataError(f"{path}: a cell outside {sizes.rights} x {sizes.lefts}")
    return out


def unknown_words(char_def: str, unk_def: str) -> Unknown:
    """Classes of characters (NAME invoke group length, then 0xFROM..0xTO NAME) and the unknown words of each (NAME,left,right,cost,pos)."""
    out = Unknown()
    for n, line in enumerate(char_def.splitlines(), 1):
        cells = line.partition("#")[0].split()
        if not cells:
            continue
        try:
            if cells[0].startswith("0x"):
                a, _, b = cells[0].partition("..")
                out.ranges.append((int(a, 16), int(b or a, 16), cells[1]))
            else:
                out.kinds[cells[0]] = Kind(cells[0], cells[1] == "1", cells[2] == "1", int(cells[3]))
        except (IndexError, ValueError) as e:
            raise DataError(f"classes of characters, line {n}: {line}") from e
    for n, line in enumerate(unk_def.splitlines(), 1):
        if not line.strip():
            continue
        try:
            name, left, right, cost, pos = line.split(",")[:5]
            out.words.setdefault(name, []).append(Word(name, int(left), int(right), int(cost), pos))
        except ValueError as e:
            raise DataError(f"unknown words, line {n}: {line}") from e
    if wrong := ({k for *_, k in out.ranges} | set(out.words)) - set(out.kinds):
        raise DataError(f"unknown classes {sorted(wrong)}")
    return out


def digest(rows: DataFrame) -> str:
    """A hash of a table's rows whatever their order: equal tables have equal ones."""
    cells = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(rows.columns)])
    got = rows.select(F.xxhash64(cells).alias("a"), F.xxhash64(F.lit("second"), cells).alias("b"))
    got = got.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"))
    return got.select(F.sha2(F.concat_ws(":", "n", "a", "b"), 256)).first()[0]


def encode(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write a resource's tables as Parquet, each with its digest beside it; the digests."""
    out = {}
    for name, rows in tables.items():
        out[name] = digest(rows)
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(out.items()), "name string, digest string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")
    return out


def decode(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a resource; one whose rows are not those that were written is an error."""
    out = {}
    for r in spark.read.parquet(f"{path}/digests").collect():
        out[r.name] = spark.read.parquet(f"{path}/{r.name}")
        if digest(out[r.name]) != r.digest:
            raise DataError(f"{path}/{r.name}: not the rows that were written")
    return out


def lattice(rows: DataFrame, matrix: DataFrame, unknown: Unknown | None = None) -> Lattice:
    """A lattice on the driver, to be sent along with tasks; tables over WORDS or CELLS rows are refused."""
    for df, most in ((rows, WORDS), (matrix, CELLS)):
        if df.limit(most + 1).count() > most:
            raise DataError(f"over {most} rows")
    cells = {(r.right, r.left): r.cost for r in matrix.toLocalIterator()}
    return Lattice((Word(r.surface, r.left, r.right, r.cost, r.pos) for r in rows.select("surface", "left", "right", "cost", "pos").toLocalIterator()), cells, unknown)


