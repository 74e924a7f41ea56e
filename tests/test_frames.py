"""Search over DataFrames: against SQL on the small tables, plans, sources, sinks and streams."""

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gyeol.functions import sql as functions
from gyeol.operators import queries, search, sinks
from gyeol.plans.compiler import compile_query
from gyeol.plans.lexer import Options
from gyeol.sources import files
from gyeol.streaming.search import find_all_stream, windowed_counts

D = "/root/testdata/sf0.001"
LITERAL = Options.literal()


def rows(df, cols):
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    a, b = queries.Q[name](spark, D).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefilters_reach_the_scan(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    p = plan_text(search.literal_spans(docs.select("doc_id", "text"), "ering"))
    assert "StringContains(text,ering)" in p and "Exchange" not in p and "Python" not in p
    p = plan_text(search.matching_lines(docs, "a1 | b2", LITERAL, keep=["doc_id"]))
    assert "Or(StringContains(text,a1),StringContains(text,b2))" in p and "lang" not in p.split("ReadSchema")[1]


def test_anchors_are_tested_by_their_beginnings(spark):
    """Anchors that hold another one are not looked for at all, the others by one alternation only where their beginning stands."""
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = compile_query("n:검증", Options(expand="derivation", boundary="token"))
    p = plan_text(search.find_all(df, plan))
    assert len(plan.anchors[0]) > search.CONTAINS and "RLIKE" not in p and "Contains(text" in p and "검증하" not in p
    alike, apart = [f"q{k}z" for k in range(60)], [chr(0xAC00 + k) + "a" for k in range(60)]
    texts = ["", None, "ab", "xa", "bxc", "b.c", "b(", "q", "q59", "q59z", "q5z", "길", apart[59], apart[59][0], apart[7] + "b", "aq7z", "q가a", "r1z", "r1"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for anchors in (["ab", "xabc", "b.c", "b(", "b(c"], alike, apart, alike[:30] + ["r" + x[1:] for x in alike[:30]], [*apart[:20], *alike, "ab"], ["q", *alike]):
        got = [r[0] for r in frame.select(search.any_anchor(F.col("t"), anchors)).collect()]
        assert got == [None if t is None else any(a in t for a in anchors) for t in texts]


def test_native_and_kernel_agree(spark):
    df = spark.createDataFrame([(1, "aXbXX\nX\n\nüX길X"), (2, None), (3, ""), (4, "X")], "id int, text string")
    cols = ["id", "line_number", "byte_offset", "match_index", "start", "end", "column"]
    a = search.literal_spans(df, "X").select(cols).collect()
    b = search.find_all(df, "X", LITERAL).select(cols).collect()
    assert sorted(a) == sorted(b) and len(a) == 7


def test_a_line_goes_out_once(spark):
    """What the kernel returns grows with the lines and with the matches, not with their product."""
    line = "é X " * 2_000
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "line": [line, "-", line]})
    out = list(search._kernel(compile_query("X", LITERAL), None, "spans", 65_536)(iter([batch])))
    assert sum(len(x) for b in out for x in b["line"].to_pylist()) == 2 * len(line)
    df = spark.createDataFrame([(k, line + "\n-\n" + line) for k in range(3)], "id int, text string")
    cols = ["id", "line_number", "byte_offset", "match_index", "start", "end", "column"]
    got = search.find_all(df, "X", LITERAL)
    assert sorted(got.select(cols).collect()) == sorted(search.literal_spans(df, "X").select(cols).collect()) and got.count() == 12_000
    assert got.where(F.col("line") != line).isEmpty() and got.select(F.sum(F.size("atoms"))).first()[0] == 12_000
    q = search.many(df, {"a": "X", "b": "é"}, LITERAL)
    assert q.columns == [*got.columns, "query"] and q.groupBy("query").count().orderBy("query").collect() == [("a", 12_000), ("b", 12_000)]


def test_long_lines_go_in_small_batches(spark):
    """The rows that reach the kernel at once are bounded by their bytes, unless the session has a limit of its own."""
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    df = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("X "), 250_000).alias("text"))
    before = spark.conf.get(key)
    try:
        for own in ("67108864b", "2m"):
            spark.conf.set(key, own)
            found = search.matching_lines(df, "v:걷다 | X")
            sizes.append(spark.conf.get(key))
            assert found.count() == 40
            spark.conf.set(key, own)
            assert search.find_all(df, "zzz", LITERAL).isEmpty() and spark.conf.get(key) == sizes[-1]
    finally:
        spark.conf.set(key, before)
    assert sizes == ["4m", "2m"]


def test_lines_and_offsets(spark):
    df = spark.createDataFrame([(1, "é\n\nb\n"), (2, "x\r\ny")], "id int, text string")
    assert [tuple(r) for r in search.lines(df).orderBy("id", "line_number").collect()] == [(1, 1, 0, "é"), (1, 2, 3, ""), (1, 3, 4, "b"), (2, 1, 0, "x\r"), (2, 2, 3, "y")]


def test_anchor_with_a_line_end(spark):
    df = spark.createDataFrame([(1, "a\nb")], "id int, text string")
    assert search.find_all(df, "'a\nb'", LITERAL).select("start", "end").collect() == [(0, 3)]


def test_context_and_breaks(spark):
    df = spark.createDataFrame([("f", "\n".join("x" if i in (2, 9) else str(i) for i in range(12)))], "path string, text string")
    got = search.context(df, search.matching_lines(df, "x", LITERAL), "path", 1, 1).orderBy("line_number").collect()
    assert [(r.line_number, r.kind[0], r.break_before) for r in got] == [(2, "c", False), (3, "m", False), (4, "c", False), (9, "c", True), (10, "m", False), (11, "c", False)]


def test_sinks(spark):
    df = spark.createDataFrame([("f", "길a X\x07\r", 5, 6)], "path string, line string, start int, end int").withColumn("line_number", F.lit(3)).withColumn("column", F.lit(4))
    assert sinks.text_lines(df, "path").first()[0] == "f:3:4: 길a X�"
    assert df.select(sinks.highlighted(F.col("line"), F.col("start"), F.col("end"), "<", ">")).first()[0] == "길a <X>\x07\r"
    assert df.select(sinks.utf16(F.col("line"), F.col("start"))).first()[0] == 3
    raw = spark.createDataFrame([(b"\xff",), (b"a",)], "b binary").select(sinks.lossless(F.col("b")).alias("x")).collect()
    assert [(r.x.text, r.x.bytes) for r in raw] == [(None, "/w=="), ("a", None)]
    assert [sinks.exit_status(True), sinks.exit_status(False), sinks.exit_status(True, 1)] == [0, 1, 2]


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"one X", "b.md": b"X\0X", ".hidden.txt": b"X", "sub/c.txt": "X\n".encode("utf-16"), "sub/skip/d.txt": b"X", "log.log": b"X", ".gitignore": b"*.log\nskip/\n", "k.txt": "길".encode("euc-kr")}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    root = str(tmp_path)
    paths = lambda **k: sorted(os.path.relpath(r.path, root) if r.path.startswith("/") else r.path for r in files.read_files(spark, [root], **k).collect())
    assert paths() == ["a.txt", "b.md", "k.txt", "sub/c.txt"]
    assert paths(no_ignore=True, hidden=True)[:2] == [".gitignore", ".hidden.txt"]
    assert paths(globs=["*.txt", "!k*"]) == ["a.txt", "sub/c.txt"] and paths(types=["md"]) == ["b.md"] and paths(types=["mine"], define=["mine:a.*"]) == ["a.txt"]
    assert "log.log" in paths(explicit=[f"{root}/log.log"])
    got = {r.path.rpartition("/")[2]: r for r in files.decoded(files.read_files(spark, [root])).collect()}
    assert got["b.md"].text == "X" and got["b.md"].binary_byte_offset == 1 and got["c.txt"].text == "X\n" and not got["k.txt"].valid_utf8
    assert files.decoded(files.read_files(spark, [root], globs=["k.txt"]), "euc-kr").first().text == "길"
    with pytest.raises(ValueError):
        files.decoded(files.read_files(spark, [root]), "latin-9")


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "걸어 갔다"), (2, "없다")], "id long, text string").withColumn("ts", F.timestamp_seconds("id")).write.parquet(str(src))
    stream = spark.readStream.schema("id long, text string, ts timestamp").parquet(str(src))
    q = find_all_stream(stream, "v:걷다").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT id, surface FROM found").collect() == [(1, "걸어")]
    found = find_all_stream(stream, "걷다 | 없다", Options(boundary="any"), keep=["id", "ts"])
    assert windowed_counts(found, "ts", "1 minute", "1 minute").columns == ["start", "end", "matches"]


def test_functions(spark):
    df = spark.createDataFrame([("길을 걸어",), (None,), ("",)], "text string")
    got = df.select(functions.spans("v:걷다")("text").alias("s")).collect()
    assert [None if r.s is None else [(x.start, x.end) for x in r.s] for r in got] == [[(7, 13)], None, []]
    assert df.select(functions.token_boundary(F.col("text"), "길을")).first()[0]


def test_summaries_of_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    none = search.find_all(df, "zzz", LITERAL)
    assert not search.exists(none) and search.count_lines(df, none, "id").collect() == [(1, 0)]
    s = search.summary(df, none, "id").first()
    assert (s.searched_files, s.files_with_matches, s.matching_lines, s.has_match) == (1, 0, 0, False)


def test_plans_travel(spark):
    """A compiled plan is an ordinary value: made once, used by many DataFrames."""
    p = compile_query("v:듣다")
    df = spark.createDataFrame([(1, "음악을 들었다")], "id int, text string")
    assert search.find_all(df, p).select("surface").collect() == search.find_all(df.repartition(3), p).select("surface").collect()
