"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.llm import chat, decontamination, fingerprints, html, licenses, neardup, pieces, pii, suffixes, toxicity
from gyeol.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.expand(rows))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_fingerprints": op1_fingerprints, "op2_neardup": op2_neardup, "op3_pii": op3_pii, "op4_licenses": op4_licenses, "op5_html": op5_html, "op6_chat": op6_chat, "op7_suffixes": op7_suffixes, "op8_toxicity": op8_toxicity, "op9_decontamination": op9_decontamination, "op10_sentencepiece": op10_sentencepiece}

ORACLES: dict[str, str] = {
    "op7_suffixes": r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT r, k, md5_number(x[2 * k + 1:2 * k + 800]) AS h FROM (SELECT r, x, unnest(range(0, greatest(len(x) // 2 - 399, 0))) AS k FROM b)),
d AS (SELECT r, k FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 400 THEN 0 ELSE 1 END AS f FROM d),
i AS (SELECT r, s, min(k) AS a, max(k) + 400 AS e FROM (SELECT r, k, sum(f) OVER (PARTITION BY r ORDER BY k) AS s FROM g) GROUP BY r, s),
p AS (SELECT r, s, e, a, x[2 * coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) + 1:2 * a] AS before, lead(e) OVER (PARTITION BY r ORDER BY s) IS NULL AS last, x FROM i JOIN b USING (r)),
t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS l FROM (SELECT DISTINCT doc_id, text FROM documents)),
v AS (SELECT doc_id, text, md5_number(array_to_string(l[k:k + 50], ' ')) AS h FROM (SELECT doc_id, text, l, unnest(range(1, greatest(len(l) - 49, 1))) AS k FROM t)),
u AS (SELECT DISTINCT doc_id, text FROM v WHERE h IN (SELECT h FROM (SELECT DISTINCT h, doc_id, text FROM v) GROUP BY h HAVING count(*) > 1)),
q AS (SELECT r, string_agg(before || CASE WHEN last THEN x[2 * e + 1:] ELSE '' END, '' ORDER BY s) AS kept, sum(e - a) AS n, count(*) AS c FROM p GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256,
  EXISTS (SELECT 1 FROM u WHERE u.doc_id IS NOT DISTINCT FROM b.doc_id AND lower(hex(encode(coalesce(u.text, '')))) = b.x) AS repeats
FROM b LEFT JOIN q USING (r)""",
    "op2_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 4 THEN array_to_string(l, ' ') ELSE array_to_string(l[k:k + 3], ' ') END AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, CASE WHEN len(l) > 0 THEN 1 ELSE 0 END) + 1)) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id, d.doc_id = m.b AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op6_chat": r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS r, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS b FROM src),
u AS (SELECT *, 3 + length(r) + 6 + length(b) + 7 + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END AS n,
  max(k) OVER (PARTITION BY conv_id) AS last FROM t),
v AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM u)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM v GROUP BY conv_id""",
}
