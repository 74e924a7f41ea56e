"""Queries over the test tables, one per operator of the search engine, and the SQL that gives the same rows.

Korean operators search whole documents, to each of which a sentence is added as its last line, by the document's id (the tables hold no Hangul of their own);
the SQL knows the expected surfaces by enumeration, not through this engine's grammar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import sql as functions
from gyeol.functions.lattice import Lattice, Word
from gyeol.functions.structure import Components
from gyeol.operators import explain, lexicons, search, sinks
from gyeol.plans import grammar, tables
from gyeol.plans.compiler import compile_query
from gyeol.plans.lexer import Options

SENTENCES = [
    "길을 걸어 학교에 갔다.",
    "어제는 음악을 들었다. 노래를 듣고 잤다",
    "사용자들에게 권한을 주었다",
    "그 물을 마시고 길로 나갔다",
    "아이가 예쁘고 착하다",
    "나는 학생이다. 여기는 학교다",
    "검증을 했고 권한도 검증했다",
    "친구를 불러 문을 열었다",
    "하늘이 푸르러 좋았다",
    "길은 멀고 걷기는 힘들다",
    "",
    "글을 쓰는 사용자가 많다 | 끝",
]
N = len(SENTENCES)
ANY, TOKEN, LITERAL = Options(boundary="any"), Options(boundary="token"), Options.literal()
#: A hand-made table of parts for decisions by structure.
PARTS = Components([("길", "NNG"), ("권한", "NNG"), ("사용자", "NNG"), ("학교", "NNG"), ("학생", "NNG"), ("물", "NNG"), ("을", "JKO"), ("은", "JX"), ("는", "JX"), ("도", "JX"), ("로", "JKB"), ("가", "JKS"), ("들", "XSN"), ("에게", "JKB"), ("에", "JKB"), ("이", "VCP"), ("다", "EF"), ("매일", "MAG"), ("매", "NNG"), ("일", "NNG")])


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def korean(spark: SparkSession, d: str, alone: bool = False, sentences: list[str] = SENTENCES) -> DataFrame:
    """doc_id and text: each document and, as its last line, its sentence (alone: the sentence only); a native lookup, no join."""
    line = F.element_at(F.array(*[F.lit(s) for s in sentences]), (F.col("doc_id") % len(sentences) + 1).cast("int"))
    return docs(spark, d).select("doc_id", line.alias("text") if alone else F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))


def spans(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "line_number", "match_index", "start", "end", "surface")


KO = "ko AS (SELECT doc_id, ([" + ", ".join(f"'{s}'" for s in SENTENCES) + f"])[doc_id % {N} + 1] AS line, concat(coalesce(text, ''), chr(10), line) AS text FROM documents)"
LINES = """lines AS (SELECT doc_id, k AS line_number, l[k] AS line, CAST(coalesce(list_sum([octet_length(encode(x)) + 1 for x in l[1:k - 1]]), 0) AS BIGINT) AS byte_offset
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE NOT (k = len(l) AND l[k] = ''))"""
TOKENS = r"[\p{L}\p{N}\p{M}_]"


def ko_spans(*rows: tuple[int, str], alone: bool = False) -> str:
    """SQL for expected matches: (sentence, surface) in order; places by position in the sentence, of the first place after the one before."""
    out, seen = [], {}
    for k, s in rows:
        at = SENTENCES[k].index(s, seen.get(k, (0, 0))[1])
        n = seen[k][0] + 1 if k in seen else 0
        seen[k] = (n, at + len(s))
        out.append(f"({k}, {n}, {len(SENTENCES[k][:at].encode())}, {len(SENTENCES[k][: at + len(s)].encode())}, '{s}')")
    line = "1" if alone else "len(string_split(coalesce(d.text, ''), chr(10))) + 1"
    return f"""SELECT d.doc_id, CAST({line} AS BIGINT) AS line_number, CAST(v.n AS INTEGER) AS match_index, CAST(v.a AS BIGINT) AS start, CAST(v.b AS BIGINT) AS "end", v.s AS surface
FROM documents d JOIN (VALUES {", ".join(out)}) v(k, n, a, b, s) ON d.doc_id % {N} = v.k"""


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("literal_lines", f"WITH {LINES} SELECT doc_id, line_number, byte_offset, line FROM lines WHERE contains(line, 'ering')")
def literal_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(docs(spark, d), "ering", LITERAL)


@query("literal_spans", f"""WITH {LINES}, p AS (SELECT *, string_split(line, 'ering') AS s FROM lines WHERE contains(line, 'ering')),
k AS (SELECT *, unnest(range(1, len(s))) AS k FROM p)
SELECT doc_id, line_number, byte_offset, CAST(k - 1 AS INTEGER) AS match_index, CAST(octet_length(encode(array_to_string(s[1:k], 'ering'))) AS BIGINT) AS start, CAST(octet_length(encode(array_to_string(s[1:k], 'ering'))) + 5 AS BIGINT) AS "end",
  CAST(length(array_to_string(s[1:k], 'ering')) + 1 AS BIGINT) AS "column" FROM k""")
def literal_spans(spark: SparkSession, d: str) -> DataFrame:
    return search.literal_spans(docs(spark, d), "ering")


@query("kernel_spans", SQL["literal_spans"].replace("byte_offset, CAST", "CAST"))
def kernel_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same spans through the kernel."""
    return search.find_all(docs(spark, d), "ering", LITERAL).select("doc_id", "line_number", "match_index", "start", "end", "column")


@query("literal_token_lines", f"WITH {LINES} SELECT doc_id, line_number FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])the($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')")
def literal_token_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(docs(spark, d), "'the'", TOKEN).select("doc_id", "line_number")


@query("literal_token_native", SQL["literal_token_lines"])
def literal_token_native(spark: SparkSession, d: str) -> DataFrame:
    return search.literal_spans(docs(spark, d), "the", token=True).select("doc_id", "line_number").distinct()


@query("disjunction_lines", f"WITH {LINES} SELECT doc_id, line_number FROM lines WHERE contains(line, 'idiot') OR contains(line, 'example.com')")
def disjunction_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(docs(spark, d), "idiot | example.com", LITERAL).select("doc_id", "line_number")


@query("phrase_lines", f"WITH {LINES} SELECT doc_id, line_number FROM lines WHERE regexp_matches(line, 'with[^\\r\\n]{{0,24}}that')")
def phrase_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(docs(spark, d), "'with' 'that'", Options(expand="literal", boundary="any", normalization="none")).select("doc_id", "line_number")


def places(name: str, w: str) -> str:
    return f"""{name} AS (SELECT doc_id, line_number, CAST(length(array_to_string(p[1:k], '{w}')) AS BIGINT) AS a FROM (SELECT doc_id, line_number, string_split(line, '{w}') AS p, unnest(range(1, len(string_split(line, '{w}')))) AS k FROM lines))"""


@query("phrase_join", f"""WITH {LINES}, {places("x", "token")}, {places("y", "=")}
SELECT doc_id, line_number, x.a AS start, y.a + 1 AS "end" FROM x JOIN y USING (doc_id, line_number) WHERE y.a BETWEEN x.a + 5 AND x.a + 29""")
def phrase_join(spark: SparkSession, d: str) -> DataFrame:
    one = lambda w: search.literal_spans(docs(spark, d), w).select("doc_id", "line_number", (F.col("column") - 1).alias("start"), (F.col("column") - 1 + len(w)).alias("end"))
    return search.phrase_join([one("token"), one("=")], ["doc_id"], 24).select("doc_id", "line_number", "start", "end")


@query("count_per_doc", f"WITH {LINES} SELECT d.doc_id, count(l.line_number) AS matching_lines FROM documents d LEFT JOIN (SELECT * FROM lines WHERE contains(line, 'tion')) l USING (doc_id) GROUP BY d.doc_id")
def count_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return search.count_lines(docs(spark, d), search.matching_lines(docs(spark, d), "tion", LITERAL), "doc_id")


@query("docs_with_match", "SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'worthless')")
def docs_with_match(spark: SparkSession, d: str) -> DataFrame:
    return search.files_with_matches(search.matching_lines(docs(spark, d), "worthless", LITERAL), "doc_id")


@query("exists", "SELECT count(*) > 0 AS has_match FROM documents WHERE contains(text, 'worthless')")
def exists(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(docs(spark, d), "worthless", LITERAL).limit(1).agg((F.count("*") > 0).alias("has_match"))


@query("first_match", f"WITH {LINES} SELECT doc_id, min(line_number) AS line_number FROM lines WHERE contains(line, 'tion') GROUP BY doc_id")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    return search.first_of_each(search.literal_spans(docs(spark, d), "tion"), "doc_id").select("doc_id", "line_number")


@query("context_lines", f"""WITH {LINES}, h AS (SELECT *, contains(line, 'idiot') AS hit FROM lines), n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM h),
k AS (SELECT * FROM n WHERE near) SELECT doc_id, line_number, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, line, coalesce(line_number - lag(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) > 1, false) AS break_before FROM k""")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.context(docs(spark, d), search.matching_lines(docs(spark, d), "idiot", LITERAL), "doc_id", before=2, after=1)


@query("summary", f"""WITH {LINES}, m AS (SELECT doc_id, line_number, len(string_split(line, 'the ')) - 1 AS n FROM lines WHERE contains(line, 'the '))
SELECT (SELECT count(*) FROM documents) AS searched_files, count(DISTINCT doc_id) AS files_with_matches, count(*) AS matching_lines, CAST(sum(n) AS BIGINT) AS matched_spans, count(*) > 0 AS has_match FROM m""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(docs(spark, d), search.literal_spans(docs(spark, d), "the "), "doc_id")


@query("match_column", f"WITH {LINES} SELECT doc_id, line_number, CAST(strpos(line, 'token') AS BIGINT) AS \"column\" FROM lines WHERE contains(line, 'token')")
def match_column(spark: SparkSession, d: str) -> DataFrame:
    return search.literal_spans(docs(spark, d), "token").where("match_index = 0").select("doc_id", "line_number", "column")


@query("utf16_offsets", f"""WITH {LINES} SELECT doc_id, line_number, CAST(length(string_split(line, 'token')[1]) AS BIGINT) AS utf16 FROM lines WHERE contains(line, 'token')""")
def utf16_offsets(spark: SparkSession, d: str) -> DataFrame:
    found = search.find_all(docs(spark, d), "token", LITERAL).where("match_index = 0")
    return found.select("doc_id", "line_number", sinks.utf16(F.col("line"), F.col("start")).alias("utf16"))


@query("text_output", f"WITH {LINES} SELECT doc_id || ':' || line_number || ': ' || regexp_replace(line, '[\\r\\n]+$', '') AS output FROM lines WHERE contains(line, 'License')")
def text_output(spark: SparkSession, d: str) -> DataFrame:
    return sinks.text_lines(search.matching_lines(docs(spark, d), "License", LITERAL), "doc_id")


@query("json_output", rf"""WITH {LINES}, p AS (SELECT *, string_split(line, 'License') AS p FROM lines WHERE contains(line, 'License')),
m AS (SELECT doc_id, line_number, byte_offset, line, k, array_to_string(p[1:k], 'License') AS before FROM (SELECT *, unnest(range(1, len(p))) AS k FROM p)),
s AS (SELECT *, octet_length(encode(before)) AS a, octet_length(encode(before)) + 7 AS e FROM m)
SELECT CAST(to_json(struct_pack("type" := 'match', "path" := struct_pack("text" := CAST(doc_id AS VARCHAR)), line_number := line_number, absolute_offset := byte_offset, lines := struct_pack("text" := regexp_replace(line, '[\r\n]+$', '')),
  matches := list(struct_pack(match_index := k - 1, "start" := a, "end" := e, "column" := length(before) + 1, surface := 'License', atoms := [struct_pack("start" := a, "end" := e, core_start := a, core_end := e, surface := 'License',
    origins := [struct_pack(analysis := 0, lemma := 'License', pos := 'LIT', rules := CAST([] AS VARCHAR[]))])]) ORDER BY k))) AS VARCHAR) AS json
FROM s GROUP BY doc_id, line_number, byte_offset, line""")
def json_output(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(search.find_all(docs(spark, d), "License", LITERAL), "doc_id")


@query("html_literal", "SELECT page_id FROM pages WHERE contains(html, 'class=\"ad\"')")
def html_literal(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    return search.files_with_matches(search.matching_lines(pages, "'class=\"ad\"'", Options(expand="literal", boundary="any", normalization="none"), text="html"), "page_id")


@query("conversation_role_counts", "SELECT role, CAST(sum(len(string_split(text, 'tion')) - 1) AS BIGINT) AS matches FROM conversations WHERE contains(text, 'tion') GROUP BY role")
def conversation_role_counts(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("role", "text")
    return search.literal_spans(turns, "tion").groupBy("role").agg(F.count("*").alias("matches"))


@query("many_queries", f"""WITH {LINES} SELECT q AS query, count(*) AS matching_lines FROM lines, (VALUES ('idiot'), ('clown'), ('License')) v(q) WHERE contains(line, q) GROUP BY q""")
def many_queries(spark: SparkSession, d: str) -> DataFrame:
    found = search.many(docs(spark, d), {"idiot": "idiot", "clown": "clown", "License": "License"}, LITERAL)
    return found.groupBy("query").agg(F.count_distinct("doc_id", "line_number").alias("matching_lines"))


@query("ko_noun_particles", ko_spans((0, "길을"), (3, "길로"), (9, "길은")))
def ko_noun_particles(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "n:길", TOKEN))


@query("ko_plural_chain", ko_spans((2, "사용자들에게"), (11, "사용자가")))
def ko_plural_chain(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "사용자", TOKEN))


@query("ko_verb_d_irregular", ko_spans((0, "걸어"), (9, "걷기는")))
def ko_verb_d_irregular(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "v:걷다"))


@query("ko_verb_listen", ko_spans((1, "들었다"), (1, "듣고")))
def ko_verb_listen(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "v:듣다"))


@query("ko_copula", ko_spans((5, "이다"), (5, "다")))
def ko_copula(spark: SparkSession, d: str) -> DataFrame:
    """Both forms of the copula, where the table of parts has its host."""
    return spans(search.find_all(korean(spark, d), "이다", components=PARTS))


@query("ko_reu_and_reo", ko_spans((7, "불러"), (8, "푸르러")))
def ko_reu_and_reo(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "v:부르다 | adj:푸르다"))


@query("ko_adjective", ko_spans((4, "예쁘고")))
def ko_adjective(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "예쁘다"))


@query("ko_derivation", ko_spans((6, "검증을"), (6, "검증했다")))
def ko_derivation(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "n:검증", Options(expand="derivation", boundary="token")))


@query("ko_phrase", ko_spans((0, "길을 걸어"), (9, "길은 멀고 걷기는")))
def ko_phrase(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "n:길 v:걷다", TOKEN))


@query("ko_disjunction", ko_spans((0, "걸어"), (2, "사용자들에게"), (9, "걷기는"), (11, "사용자가")))
def ko_disjunction(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "v:걷다 | 사용자", TOKEN))


@query("ko_bar_literal", ko_spans((11, "|"), alone=True))
def ko_bar_literal(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d, alone=True), '"|"', ANY))


@query("ko_particle_host", ko_spans((0, "을"), (1, "을"), (1, "를"), (2, "을"), (3, "을"), (6, "을"), (7, "를"), (7, "을"), (11, "을")))
def ko_particle_host(spark: SparkSession, d: str) -> DataFrame:
    return spans(search.find_all(korean(spark, d), "j:을"))


@query("ko_structural", ko_spans((2, "권한을"), (6, "권한도")))
def ko_structural(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by the parts of tokens, over a small table."""
    return spans(search.find_all(korean(spark, d), "n:권한", components=PARTS))


@query("ko_origins", f"SELECT doc_id, CAST(0 AS INTEGER) AS atom, '걷다' AS lemma, 'VV' AS pos, CASE WHEN doc_id % {N} = 0 THEN 'lexical.d-to-l,ending.aoeo' ELSE 'ending.nominalizer-gi,particle.topic' END AS rules FROM documents WHERE doc_id % {N} IN (0, 9)")
def ko_origins(spark: SparkSession, d: str) -> DataFrame:
    found = explain.explain_match(search.find_all(korean(spark, d), "v:걷다")).where("pos = 'VV'")
    return found.select("doc_id", "atom", "lemma", "pos", F.array_join("rules", ",").alias("rules")).distinct()


@query("nfd_canonical", f"SELECT doc_id, count(*) AS matches FROM documents WHERE doc_id % {N} IN (0, 3, 9) GROUP BY doc_id")
def nfd_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Decomposed text, found through canonical anchors."""
    import unicodedata

    src = korean(spark, d, sentences=[unicodedata.normalize("NFD", s) for s in SENTENCES])
    return search.find_all(src, "n:길", Options(boundary="token", normalization="canonical")).groupBy("doc_id").agg(F.count("*").alias("matches"))


@query("nfc_equality", "SELECT doc_id, nfc_normalize(text) = text AS composed FROM documents")
def nfc_equality(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", (functions.nfc()("text") == F.col("text")).alias("composed"))


@query("sql_function", "SELECT doc_id, CAST(len(string_split(text, 'tion')) - 1 AS BIGINT) AS n FROM documents")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    functions.register(spark, "spans_of_tion", "tion", LITERAL)
    docs(spark, d).createOrReplaceTempView("searched")
    return spark.sql("SELECT doc_id, CAST(size(spans_of_tion(text)) AS BIGINT) AS n FROM searched")


@query("verification_counters", "SELECT CAST(sum(len(string_split(text, 'clown')) - 1) AS BIGINT) AS raw_anchor_hits, CAST(sum(len(string_split(text, 'clown')) - 1) AS BIGINT) AS verified_program_hits, CAST(0 AS BIGINT) AS structural_hits, CAST(0 AS BIGINT) AS structural_windows FROM documents")
def verification_counters(spark: SparkSession, d: str) -> DataFrame:
    return search.verification_counters(docs(spark, d), "clown", LITERAL)


@query("structural_counters", f"""SELECT count(*) AS raw_anchor_hits, count(*) AS structural_hits, count(*) AS structural_windows FROM documents WHERE doc_id % {N} IN (2, 6)""")
def structural_counters(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by the parts of tokens: one token in each of two sentences holds the anchor once, and is let pass."""
    got = search.verification_counters(korean(spark, d), "n:권한", components=PARTS)
    return got.select("raw_anchor_hits", "structural_hits", "structural_windows")


@query("quality_metrics", f"""WITH {KO}, c AS (SELECT contains(text, '길') AS got, doc_id % {N} IN (0, 3) AS expected FROM ko)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) FILTER (got AND expected) AS tp, count(*) FILTER (got AND NOT expected) AS fp, count(*) FILTER (NOT got AND NOT expected) AS tn, count(*) FILTER (NOT got AND expected) AS fn FROM c)""")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    cases = korean(spark, d)
    hit = search.matching_lines(cases, "길", LITERAL).select("doc_id").distinct().withColumn("hit", F.lit(True))
    return search.quality(cases.join(hit, "doc_id", "left").select(F.coalesce("hit", F.lit(False)).alias("got"), (F.col("doc_id") % N).isin(0, 3).alias("expected")))


@query("explain_query", "SELECT * FROM (VALUES (CAST(0 AS INTEGER), CAST(0 AS INTEGER), '걷다', 'VV', 'forced', 'DToL'), (0, 1, '걷다', 'VV', 'forced', 'Regular'), (0, 2, '걷다', 'VX', 'forced', 'DToL')) v(atom, analysis, lemma, pos, source, alternation)")
def explain_query(spark: SparkSession, d: str) -> DataFrame:
    df = explain.explain_query(spark, compile_query("v:걷다"))
    return df.select("atom", "analysis", "lemma", "pos", "source", "alternation").orderBy("analysis")


@query("plan_programs")
def plan_programs(spark: SparkSession, d: str) -> DataFrame:
    return explain.programs(spark, compile_query("v:걷다 n:길", ANY))


CASES = [r | {"text": r["text"].replace("\\n", "\n")} for r in tables.load("cases")]


def case_sql() -> str:
    """The expected matches: places by position of the surface in the sentence, after the document before it."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = []
    for k, r in enumerate(CASES):
        at = len(r["text"][: r["text"].index(r["surface"])].encode()) if r["surface"] else None
        rows.append(f"({k}, '{r['feature']}', " + (f"{at}, {at + len(r['surface'].encode())}, {quoted(r['surface'])})" if r["surface"] else "NULL, NULL, NULL)"))
    return f"""SELECT doc_id, feature, CAST(coalesce(octet_length(encode(coalesce(text, ''))) + 1 + a, -1) AS BIGINT) AS start, CAST(coalesce(octet_length(encode(coalesce(text, ''))) + 1 + b, -1) AS BIGINT) AS "end", coalesce(s, '') AS surface
FROM documents JOIN (VALUES {", ".join(rows)}) v(k, feature, a, b, s) ON doc_id % {len(CASES)} = k"""


@query("ko_cases", case_sql())
def ko_cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled sentences, each with its own query, at the ends of whole documents."""
    row = F.element_at(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("feature", "query", "expand", "boundary")]) for r in CASES]), (F.col("doc_id") % len(CASES) + 1).cast("int"))
    src = korean(spark, d, sentences=[r["text"] for r in CASES]).select("doc_id", row.alias("c"), "text").select("doc_id", "c.*", "text")
    got = search.first_by_row(src)
    return got.select("doc_id", "feature", F.coalesce("start", F.lit(-1).cast("long")).alias("start"), F.coalesce("end", F.lit(-1).cast("long")).alias("end"), F.coalesce("surface", F.lit("")).alias("surface"))


#: Tokens that a small dictionary covers in several ways, its words (context and cost by their number), and what it costs to stand next to one another.
TOKENS_ = ["매일매일", "사용자들에게는", "권한도", "길로", "학교에", "학생이다", "매일이다", "없는말"]
WORDS_ = [(surface, pos, k % 5 + 1, 10 * len(surface) + k) for k, (surface, parts) in enumerate((s, x) for s, p in PARTS.table.items() for x in p) for pos in parts]


@query("lattice_covers", f"""WITH RECURSIVE w AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{p}', {c}, {n})" for s, p, c, n in WORDS_)}) v(s, pos, c, cost)),
t AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(TOKENS_))}) v(k, t)),
r AS (SELECT k, t, 0 AS p, 0 AS c, CAST(0 AS BIGINT) AS cost FROM t UNION ALL
  SELECT r.k, r.t, r.p + length(w.s), w.c, r.cost + w.cost + (r.c * 7 + w.c * 13) % 50 FROM r JOIN w ON r.p < length(r.t) AND substr(r.t, r.p + 1, length(w.s)) = w.s AND r.c <> w.c),
e AS (SELECT k, cost + (c * 7) % 50 AS cost FROM r WHERE p = length(t)),
b AS (SELECT k, array_to_string(list(cost ORDER BY cost)[1:4], ',') AS costs FROM e GROUP BY k)
SELECT doc_id, t.t AS token, coalesce(b.costs, '') AS costs FROM documents JOIN t ON doc_id % {len(TOKENS_)} = t.k LEFT JOIN b ON b.k = t.k""")
def lattice_covers(spark: SparkSession, d: str) -> DataFrame:
    """The costs of the four cheapest covers of tokens by the words of a small dictionary."""
    costs = {(a, b): (a * 7 + b * 13) % 50 for a in range(6) for b in range(6) if a != b}
    small = Lattice([Word(s, c, c, n, p) for s, p, c, n in WORDS_], costs)
    src = korean(spark, d, alone=True, sentences=TOKENS_).withColumnRenamed("text", "token")
    got = lexicons.covers(src, small, text="token")
    return got.select("doc_id", "token", F.array_join(F.transform("covers", lambda c: c["cost"].cast("string")), ",").alias("costs"))


POS_VALUES = ", ".join(f"('{r['lemma']}', '{r['pos']}')" for name in ("predicates", "nominals", "modifiers") for r in grammar.TABLES[name])


@query("lexicon_stats", f"""WITH l AS (SELECT DISTINCT lemma, pos FROM (VALUES {POS_VALUES}) v(lemma, pos))
SELECT count(*) AS entries, count(DISTINCT lemma) AS lemmas, (SELECT count(*) FROM (SELECT lemma FROM l GROUP BY lemma HAVING count(*) > 1)) AS ambiguous FROM l""")
def lexicon_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the small lexicon's parts of speech."""
    return lexicons.pos_stats(lexicons.builtin_pos(spark))


@query("check_data", f"""SELECT count(*) FILTER (name = 'predicates') AS n_predicates, count(*) FILTER (name = 'nominals') AS n_nominals, count(*) FILTER (name = 'modifiers') AS n_modifiers, CAST(0 AS BIGINT) AS n_problems
FROM (VALUES {", ".join(f"('{name}')" for name in ("predicates", "nominals", "modifiers") for _ in grammar.TABLES[name])}) v(name)""")
def check_data(spark: SparkSession, d: str) -> DataFrame:
    """The report on the grammar's and the lexicon's own tables."""
    return lexicons.data_report(spark).select("n_predicates", "n_nominals", "n_modifiers", "n_problems")


#: A byte that is no UTF-8 stands between the halves of each text; what crosses it is no match.
@query("broken_bytes", r"""SELECT doc_id, (length(a) - length(replace(a, 'tion', '')) + length(b) - length(replace(b, 'tion', ''))) // 4 AS n, octet_length(encode(a)) + 1 + octet_length(encode(b)) AS n_bytes FROM (SELECT doc_id,
  replace(replace(left(text, length(text) // 2), chr(10), ' '), chr(13), ' ') AS a, replace(replace(substr(text, length(text) // 2 + 1), chr(10), ' '), chr(13), ' ') AS b FROM documents) WHERE contains(a, 'tion') OR contains(b, 'tion')""")
def broken_bytes(spark: SparkSession, d: str) -> DataFrame:
    one_line = F.translate("text", "\r\n", "  ")
    half = F.floor(F.char_length("text") / 2).cast("int")
    raw = F.concat(F.encode(F.substring(one_line, F.lit(1), half), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.substring(one_line, half + 1, F.char_length("text")), "UTF-8"))
    broken = docs(spark, d).select("doc_id", raw.cast("string").alias("text"))
    found = search.find_all(broken, "tion", LITERAL)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("line")).cast("long").alias("n_bytes"))
