"""Search over DataFrames: lines, prefilters, matches and their summaries.

A plan is compiled once on the driver. Its anchors become substring tests that Catalyst pushes into the scan, first on whole texts, then
on lines; what is left is verified. Plain literals are verified by native expressions, other plans by the kernel on Arrow batches.
Every function returns an ordinary DataFrame, none of them shuffles unless it groups or sorts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.batches import in_batches
from gyeol.functions.matcher import COUNTERS, MATCHES, Matcher, byte_offsets
from gyeol.functions.structure import Components
from gyeol.plans.compiler import Plan, compile_query, least
from gyeol.plans.lexer import Options
from gyeol.plans.lexicon import Lexicon

#: Anchors up to which substring tests are used; more become one alternation for each first character, or one for all.
CONTAINS = 48
#: Compiled queries that a task of first_by_row() keeps.
PLANS = 1_000
#: Matches after which a batch of found lines goes out.
FOUND = 4_096
#: A character of a token, as Java's regular expressions put it.
TOKEN = r"[\p{IsAlphabetic}\p{Nd}\p{Nl}\p{No}\p{M}_]"
ORIGIN = "array<struct<analysis:int,lemma:string,pos:string,rules:array<string>>>"
ATOM = f"struct<start:bigint,end:bigint,core_start:bigint,core_end:bigint,surface:string,origins:{ORIGIN}>"
#: The column of a line's matches between the kernel and their rows.
HELD = "__matches"
ARRAY = f"array<struct<match_index:int,start:bigint,end:bigint,column:bigint,surface:string,atoms:array<{ATOM}>>>"


def plan_of(query: str | Plan, options: Options | None = None, lexicon: Lexicon | None = None) -> Plan:
    return query if isinstance(query, Plan) else compile_query(query, options, lexicon)


def any_anchor(c: Column, anchors: list[str]) -> Column:
    """Whether a text has one of the anchors. Those that begin alike are looked for only where their common beginning stands: most texts take one search for each first character."""
    anchors, alike, tests = least(anchors), {}, []
    for a in anchors:
        alike.setdefault(a[0], []).append(a)
    if len(alike) > CONTAINS:
        return c.rlike(alternation(anchors))
    for same in alike.values():
        one = reduce(lambda a, b: a | b, [F.contains(c, F.lit(a)) for a in same]) if len(anchors) <= CONTAINS or len(same) == 1 else c.rlike(alternation(same))
        tests.append(one if len(same) == 1 else F.contains(c, F.lit(os.path.commonprefix(same))) & one)
    return reduce(lambda a, b: a | b, tests)


def alternation(anchors: list[str]) -> str:
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", a) for a in anchors)


def candidate(c: Column, plan: Plan) -> Column:
    """Whether a text has an anchor of every atom: what each match needs."""
    out = any_anchor(c, plan.anchors[0])
    for a in plan.anchors[1:]:
        out = out & any_anchor(c, a)
    return out


def lines(df: DataFrame, text: str = "text", keep: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The kept columns, line_number (from 1), byte_offset and line. A line end at the end of a text begins no line. where: which whole texts are split at all."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    src = df.where(F.col(text).isNotNull())
    src = src if where is None else src.where(where)
    # splitting would turn bytes that are no UTF-8 into others: a text with such bytes is split as one of single bytes, and its lines become what they were
    src = src.select(*keep, F.col(text).alias("__text"), F.is_valid_utf8(text).alias("__ok"))
    src = src.select(*keep, "__text", "__ok", F.posexplode(F.split(F.when(F.col("__ok"), F.col("__text")).otherwise(F.decode(F.col("__text").cast("binary"), "ISO-8859-1")), "\n", -1)).alias("__n", "__l"))
    src = src.withColumn("line", F.when(F.col("__ok"), F.col("__l")).otherwise(F.encode("__l", "ISO-8859-1").cast("string")))
    src = src.where((F.col("line") != "") | (F.col("__n") < F.expr(r"octet_length(__text) - octet_length(replace(__text, '\n', ''))")))
    before = F.when(F.col("__n") == 0, F.lit(0)).otherwise(F.expr(r"octet_length(substring_index(__text, '\n', __n)) + 1"))
    return src.select(*keep, (F.col("__n") + 1).cast("long").alias("line_number"), before.cast("long").alias("byte_offset"), "line")


def candidate_lines(df: DataFrame, plan: Plan, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The lines that may match. The test stands before the split as well, so that it reaches the scan."""
    if not plan.line_local:
        keep = [c for c in df.columns if c != text] if keep is None else keep
        return df.where(candidate(F.col(text), plan)).select(*keep, F.lit(1).cast("long").alias("line_number"), F.lit(0).cast("long").alias("byte_offset"), F.col(text).alias("line"))
    return lines(df, text, keep, candidate(F.col(text), plan)).where(candidate(F.col("line"), plan))


def decoded(column: pa.Array) -> Iterator[str | None]:
    """The lines of a batch, one at a time. Bytes that are no UTF-8 become surrogates: they match nothing, and no phrase goes across them."""
    raw = (x.as_py() for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()))
    return (None if x is None else x.decode("utf-8", "surrogateescape") for x in raw)


def shown(text: str) -> str:
    """What goes out as text: a byte that is no UTF-8 is U+FFFD there; offsets still count it as one byte."""
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _kernel(plan: Plan, components: Components | None, mode: str, limit: int):  # noqa: ANN202
    """spans: a row per line with its matches as one array, so that a line goes out once however many it has; exists: the lines that match."""
    origin = pa.list_(pa.struct([("analysis", pa.int32()), ("lemma", pa.string()), ("pos", pa.string()), ("rules", pa.list_(pa.string()))]))
    atom = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "core_start", "core_end")] + [("surface", pa.string()), ("origins", origin)]))
    match = pa.struct([("match_index", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("column", pa.int64()), ("surface", pa.string()), ("atoms", atom)])

    def of_line(t: str, m: Matcher, kinds: list[tuple[str, str]] | None) -> list[dict]:
        every = m.find_all(t, limit)
        off = byte_offsets(t, [x for spans in every for s in spans for x in (s.start, s.end, s.core_start, s.core_end)])
        found = []
        for k, spans in enumerate(every):
            atoms = []
            for n, s in enumerate(spans):
                names = kinds or [(a.lemma, a.pos) for a in plan.atoms[n].analyses]
                atoms.append({
                    "start": off[s.start], "end": off[s.end], "core_start": off[s.core_start], "core_end": off[s.core_end], "surface": shown(t[s.start : s.end]),
                    "origins": [{"analysis": i, "lemma": names[i][0], "pos": names[i][1], "rules": list(r)} for i, r in s.origins],
                })
            a, b = spans[0].start, spans[-1].end
            found.append({"match_index": k, "start": off[a], "end": off[b], "column": a + 1, "surface": shown(t[a:b]), "atoms": atoms})
        return found

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(plan, components)
        kinds = [(a.lemma, a.pos) for p in plan.atoms for a in p.analyses] if len(plan.atoms) == 1 else None
        for b in batches:
            if mode == "exists":
                yield b.filter(pa.array([t is not None and m.exists(t) for t in decoded(b["line"])], pa.bool_()))
                continue

            def held(take: list[int], found: list[list[dict]], b: pa.RecordBatch = b) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*b.take(pa.array(take, pa.int64())).columns, pa.array(found, pa.list_(match))], [*b.schema.names, HELD])

            take, found, n = [], [], 0
            for i, t in enumerate(decoded(b["line"])):
                if t and (got := of_line(t, m, kinds)):
                    take.append(i)
                    found.append(got)
                    n += len(got)
                if n >= FOUND:
                    yield held(take, found)
                    take, found, n = [], [], 0
            if take:
                yield held(take, found)

    return rows


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def find_all(df: DataFrame, query: str | Plan, options: Options | None = None, text: str = "text", keep: list[str] | None = None, components: Components | None = None, lexicon: Lexicon | None = None, limit: int = MATCHES) -> DataFrame:
    """A row per match: the kept columns, line_number, byte_offset, line, match_index, start and end (bytes of the line), column (characters, from 1), surface, atoms."""
    plan = plan_of(query, options, lexicon)
    Matcher(plan, components)
    src = candidate_lines(df, plan, text, keep)
    found = in_batches(src).mapInArrow(_kernel(plan, components, "spans", limit), f"{schema_of(src)}, {HELD} {ARRAY}")
    return found.select(*src.columns, F.inline(HELD))


def matching_lines(df: DataFrame, query: str | Plan, options: Options | None = None, text: str = "text", keep: list[str] | None = None, components: Components | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """The lines that match, without spans: existence alone is computed."""
    plan = plan_of(query, options, lexicon)
    src = candidate_lines(df, plan, text, keep)
    if literal_of(plan) is not None:
        return src
    Matcher(plan, components)
    return in_batches(src).mapInArrow(_kernel(plan, components, "exists", 1), src.schema)


def literal_of(plan: Plan) -> list[str] | None:
    """The plain strings a plan searches for, where that is all it does; then no kernel is needed."""
    one = len(plan.atoms) == 1 and all(p.then.kind == "anchor" and not p.left and not p.right and not p.structural for p in plan.atoms[0].programs)
    return plan.anchors[0] if one else None


def literal_spans(df: DataFrame, literal: str, text: str = "text", keep: list[str] | None = None, token: bool = False) -> DataFrame:
    """Non-overlapping places of one literal (with token: between token boundaries), natively: line_number, byte_offset, match_index, start, end, column."""
    rx = re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", literal)
    rx = f"(?<!{TOKEN}){rx}(?!{TOKEN})" if token else rx
    has = F.contains(F.col(text), F.lit(literal))
    src = lines(df, text, keep, has).where(F.contains("line", F.lit(literal)))
    names = [c for c in src.columns if c != "line"]
    src = src.select(*names, "line", F.split("line", rx, -1).alias("p")).where(F.size("p") > 1)
    # a match stands after each piece but the last; what lies before it are the pieces and the matches so far
    src = src.select(*names, "line", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    prefix = F.concat(F.array_join(F.slice("p", F.lit(1), F.col("k")), literal))
    start = F.octet_length(prefix)
    return src.select(*names, (F.col("k") - 1).alias("match_index"), start.cast("long").alias("start"), (start + len(literal.encode())).cast("long").alias("end"), (F.char_length(prefix) + 1).cast("long").alias("column"))


def first_by_row(df: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """The columns of df and the first match of each row's own query in its own text: start, end (bytes), surface; null without one.

    df has query, expand, boundary and text. A query is compiled once a task, so rows of few different queries are cheap; labelled cases are measured this way."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple[str, str, str], Matcher] = {}
        for b in batches:
            out = []
            for q, e, k, t in zip(b["query"].to_pylist(), b["expand"].to_pylist(), b["boundary"].to_pylist(), decoded(b["text"]), strict=True):
                if (q, e, k) not in plans:
                    if len(plans) >= PLANS:
                        plans.clear()
                    plans[q, e, k] = Matcher(compile_query(q, Options(expand=e, boundary=k), lexicon))
                m = plans[q, e, k]
                got = m.find_at(t, 0) if t else None
                off = byte_offsets(t, [got[0].start, got[-1].end]) if got else {}
                out.append((off[got[0].start], off[got[-1].end], shown(t[got[0].start : got[-1].end])) if got else (None, None, None))
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "start", "end", "surface"])

    return in_batches(df).mapInArrow(rows, f"{schema_of(df)}, start bigint, end bigint, surface string")


# summaries


def count_lines(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, matching_lines: of every row of df, zero too. A line counts once however many matches it has."""
    n = found.select(key, "line_number").distinct().groupBy(key).agg(F.count("*").alias("matching_lines"))
    return df.select(key).join(n, key, "left").select(key, F.coalesce("matching_lines", F.lit(0)).alias("matching_lines"))


def files_with_matches(found: DataFrame, key: str) -> DataFrame:
    return found.select(key).distinct()


def exists(found: DataFrame) -> bool:
    """Whether anything matches; stops at the first."""
    return not found.limit(1).isEmpty()


def first_of_each(found: DataFrame, key: str) -> DataFrame:
    """The first match of each text, without sorting the others: one is kept per key on the map side."""
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("line_number", "start")).alias("m")).select(key, "m.*")


def summary(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: searched_files, files_with_matches, matching_lines, matched_spans, has_match."""
    per = found.groupBy(key, "line_number").agg(F.count("*").alias("n"))
    got = per.groupBy(key).agg(F.count("*").alias("l"), F.sum("n").alias("n")).agg(F.count("*").alias("files_with_matches"), F.coalesce(F.sum("l"), F.lit(0)).alias("matching_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_spans"))
    return df.agg(F.count("*").alias("searched_files")).crossJoin(got).withColumn("has_match", F.col("matching_lines") > 0)  # one row each


def around(both: int | None = None, before: int | None = None, after: int | None = None) -> tuple[int, int]:
    """(lines before, lines after) from a number for both sides and one for either, which comes first."""
    return tuple(next((x for x in (own, both) if x is not None), 0) for own in (before, after))


def context(df: DataFrame, found: DataFrame, key: str, before: int = 0, after: int = 0, text: str = "text") -> DataFrame:
    """The matching lines and their neighbours: key, line_number, kind (match or context), line, break_before (a gap lies before the line).

    Only texts with a match are split again, and windows are per text.
    """
    hit = found.select(key, "line_number").distinct().withColumn("hit", F.lit(True))
    all_lines = lines(df.join(hit.select(key).distinct(), key, "left_semi"), text, [key])
    w = Window.partitionBy(key).orderBy("line_number")
    marked = all_lines.join(hit, [key, "line_number"], "left").withColumn("near", F.max(F.coalesce("hit", F.lit(False))).over(w.rowsBetween(-after, before)))
    kept = marked.where("near").withColumn("kind", F.when(F.col("hit"), "match").otherwise("context"))
    return kept.select(key, "line_number", "kind", "line", F.coalesce(F.col("line_number") - F.lag("line_number").over(w) > 1, F.lit(False)).alias("break_before"))


def phrase_join(spans: list[DataFrame], key: list[str], max_gap: int) -> DataFrame:
    """All ordered combinations of one span per atom on a line with gaps of at most max_gap characters: start, end and the places of each atom.

    spans: per atom the key columns, start, end (characters) and line_number. Joined on the line, so no pair of different lines meets.
    """
    on = [*key, "line_number"]
    out = spans[0].select(*on, F.col("start"), F.col("end"), F.array(F.struct("start", "end")).alias("atoms"))
    for s in spans[1:]:
        nxt = s.select(*on, F.col("start").alias("b"), F.col("end").alias("e"))
        out = out.join(nxt, on).where((F.col("b") >= F.col("end")) & (F.col("b") - F.col("end") <= max_gap))
        out = out.select(*on, "start", F.col("e").alias("end"), F.concat("atoms", F.array(F.struct(F.col("b").alias("start"), F.col("e").alias("end")))).alias("atoms"))
    return out.dropDuplicates([*on, "atoms"])


def ordered(found: DataFrame, key: str) -> DataFrame:
    """By text, line and place."""
    return found.orderBy(key, "line_number", "match_index")


def many(df: DataFrame, queries: dict[str, str | Plan], options: Options | None = None, text: str = "text", keep: list[str] | None = None, components: Components | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """Several queries over one scan: the columns of find_all and query."""
    plans = {k: plan_of(q, options, lexicon) for k, q in queries.items()}
    keep = [c for c in df.columns if c != text] if keep is None else keep
    test = lambda c: reduce(lambda a, b: a | b, [candidate(c, p) for p in plans.values()])
    src = lines(df, text, keep, test(F.col(text))).where(test(F.col("line")))
    kernels = {k: _kernel(p, components, "spans", MATCHES) for k, p in plans.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, f in kernels.items():
                for out in f(iter([b])):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([k] * out.num_rows, pa.string())], [*out.schema.names, "query"])

    found = in_batches(src).mapInArrow(rows, f"{schema_of(src)}, {HELD} {ARRAY}, query string")
    return found.select(*src.columns, F.inline(HELD), "query")


def verification_counters(df: DataFrame, query: str | Plan, options: Options | None = None, text: str = "text", components: Components | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """One row: raw_anchor_hits, verified_program_hits, structural_hits, structural_windows over all texts."""
    plan = plan_of(query, options, lexicon)
    src = candidate_lines(df, plan, text, [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(plan, components)
        for b in batches:
            got = [m.counters(t) for t in decoded(b["line"])]
            yield pa.RecordBatch.from_arrays([pa.array([sum(g[n] for g in got)], pa.int64()) for n in COUNTERS], list(COUNTERS))

    out = in_batches(src).mapInArrow(rows, ", ".join(f"{n} bigint" for n in COUNTERS))
    return out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in out.columns])


def quality(cases: DataFrame, got: str = "got", expected: str = "expected") -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 of boolean columns."""
    n = lambda a, b: F.count_if((F.col(got) == a) & (F.col(expected) == b))
    df = cases.agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, False).alias("tn"), n(False, True).alias("fn"))
    df = df.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return df.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
