"""Corpus operators against brute force, and the cases their docstrings define."""

import hashlib
import random
import re
import unicodedata
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gyeol.llm import chat, decontamination, fingerprints, html, licenses, neardup, pieces, pii, queries, suffixes, toxicity

D = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"
#: Nulls, empty, repeated rows and columns whose names clash with the operators' own.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "x " * 3000), (None, "b c d e f"), (6, "é" * 700), (7, "é" * 700)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "k", 1, 2.0, True) for i, t in ODD], f"{DOCS}, block string, n int, fp double, kept boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, D).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    text = lambda df: sorted(map(str, df[cols].astype(object).itertuples(index=False, name=None)))
    assert text(a) == text(b)


def test_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, text string")
    n = len(ODD)
    for run, rows in (
        (fingerprints.compared, n), (neardup.near_duplicates, n), (pii.report, n), (licenses.report, n), (suffixes.deduplicated, n), (lambda d: toxicity.report(d, labels), n),
        (lambda d: decontamination.overlaps(d, bench), 0), (pieces.encode, n),
    ):
        assert run(odd).count() == rows
        assert run(empty).count() == 0
    for keep in (lambda d: toxicity.clean(d, labels), neardup.one_of_each, lambda d: decontamination.clean(d, bench), pii.redact):
        assert keep(odd).columns == odd.columns and keep(empty).count() == 0


# fingerprints


def canonical(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()


def test_fingerprints(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    ids = sorted(texts)
    first = {}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        assert got[i].edited_sha256 == sha(t[: len(t) - h] + nxt[:h]) and got[i].n_chars == len(t)
        assert got[i].class_id == first.setdefault(canonical(t), i)
    assert len({r.fingerprint for r in got.values()}) == len(first)


def test_canonical_forms(spark):
    df = spark.createDataFrame([("ＡB  ß É",), ("ab ss é ",), (None,)], "text string")
    a, b, c = (r.c for r in df.select(fingerprints.canonical(F.col("text")).alias("c")).collect())
    assert a == b == "ab ss é" and c == ""


def test_successors_across_blocks(spark):
    ids = [3, 70, 71, 5_000, 70_000_000, -9, -(2**63), 2**63 - 1, 2**62, *range(10**15, 10**15 + 300)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], DOCS)
    got = {r.text: r.next_text for r in fingerprints.successors(df).collect()}
    o = sorted(ids)
    block = df.select(fingerprints.blocks(df, F.col("doc_id"), F.xxhash64("text")).alias("b"), "doc_id").orderBy("doc_id").collect()
    assert [r.b for r in block] == sorted(r.b for r in block) and len({r.b for r in block}) > 50
    none = spark.createDataFrame([(None, f"n{i}") for i in range(200)], DOCS)
    assert fingerprints.successors(none).select("next_text").distinct().count() == 200
    assert got == {f"t{a}": f"t{b}" for a, b in zip(o, o[1:] + o[:1])}


# near-duplicates


def shingles(t, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
    return frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset()


def groups(texts, size=4):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    rnd = random.Random(size)
    base = [[f"w{rnd.randrange(900)}" for _ in range(rnd.choice([3, 6, 40, 90]))] for _ in range(25)]
    texts = {}
    for i in range(260):  # groups over LIST, so pivots count
        w = list(base[0] if i % 3 == 0 else base[i % 25])
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = f"u{rnd.randrange(10**6)}"
        texts[i] = " ".join(w).upper() if i % 7 == 0 else "\n".join(w)
    df = spark.createDataFrame(list(texts.items()), DOCS)
    comp, n = groups(texts, size)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, size).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == comp
    assert {r.doc_id for r in neardup.one_of_each(df, size).collect()} == {i for i, c in comp.items() if i == c}


def test_links_at_the_threshold_in_a_large_group(spark):
    """Copies that are alike to few others of their group: some are reached through no pivot."""
    rnd = random.Random(77)
    base, texts = [f"w{i}" for i in range(70)], {}
    for i in range(170):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3, 4, 5, 6])):
            w[rnd.randrange(70)] = f"u{rnd.randrange(10**6)}"
        texts[i] = " ".join(w)
    comp, _ = groups(texts, 4)
    df = spark.createDataFrame(list(texts.items()), DOCS)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == comp
    # without any pivot, members of long lists find one another all the same
    reps = neardup.sketches(df).select(F.col("doc_id").alias("rep"), "n", "sketch")
    none = spark.createDataFrame([], "id long, component long")
    links = neardup.components(neardup.verified(neardup.across(reps, none, df), df)).collect()
    assert {i: i for i in texts} | {r.id: r.component for r in links} == comp


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (103, 105), (100, 104)], "a long, b long")
    assert {r.id: r.component for r in neardup.components(links).collect()} == {i: 0 for i in range(1, 41)} | {105: 100, 103: 100, 104: 100}


def test_one_row_of_a_repeated_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand here now")], DOCS)
    assert sorted(r.doc_id for r in neardup.one_of_each(df).collect()) == [1, 3]


def test_null_and_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c + " z"), (None, "quite other words stand here"), (None, "and others once more here"), (None, ""), (None, None), (3, a + " y"), (4, "its own words here")]
    df = spark.createDataFrame(rows, DOCS)
    left = sorted((r.doc_id or 0, r.text or "") for r in neardup.one_of_each(df).collect())
    either = [x for x in left if x[1] in (c, c + " z")]
    assert len(either) == 1
    assert [x for x in left if x not in either] == sorted([(1, a), (1, b), (0, "quite other words stand here"), (0, "and others once more here"), (0, ""), (0, ""), (4, "its own words here")])
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (2, 3)} == {1} and sum(r.kept for r in got) == 9


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, t) if valid(k, m.group())]


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(3)
    parts = ["a", "b1", "@", ".", "_", "-", " ", "+", "1", "22", "255", "300", "0", "é", "\n", "4111 1111 1111 1111", "(", ")", "😀", "a@b.c", "1.2.3.4", "+1 (555) 010-9999"]
    texts = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for i in range(1500)] + [(9000, "7" * 30000 + " " + "1 " * 20000 + "a" * 60000 + "." * 30000)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(texts, DOCS)).collect()}
    for i, t in texts:
        b = base_spans(t)
        assert got[i].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in b)), t
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in b) for k, _ in BASE]


def test_the_method_adds_and_redacts(spark):
    rows = [(i, f"api token = 'deadbeef0123456789abcdef0123456{i}' by Mr. John Smith, ssn 123-45-6789, mail a{i}@b.com") for i in range(9)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.char_length("text").cast("long"))
    assert {x.split(":")[0] for x in pii.report(df).first().spans.split(",")} == {"email", "person", "secret", "ssn"}
    r = pii.redact(df).first()
    assert r.text == "api token = '[SECRET]' by [PERSON], ssn [SSN], mail [EMAIL]" and r.n_chars == len(r.text)


# licences


def test_licenses(spark, docs, texts):
    assert len(licenses.rules()) >= 300 and all(re.search(r["rx"].replace(r"[\p{L}\p{N}]", r"\w").replace(r"[\p{L}]", r"\w"), "x") is None for r in licenses.rules())
    phrases = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
    own = {9001: "Released under the MIT License. GNU General Public License version 3, and the MIT license again", 9002: "General  public, license; apache-license x", 9003: "SPDX-License-Identifier: GPL-2.0-only"}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(own.items()), DOCS))
    got = {r.doc_id: r for r in licenses.report(df).collect()}
    for i, t in (texts | own).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        at = [(k, label) for k in range(len(w)) for p, label in phrases if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[9001].n_detections == 3 and got[9003].labels == "gpl" and got[9003].score > 0.9


def test_short_names_of_creative_commons(spark):
    own = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Text is CC-BY-SA 3.0": "cc-by-sa", "released under CC BY 4.0": "cc-by", "CC BY-NC-ND": "cc-by-nc-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa",
        "License: CC BY": "cc-by", "under a CC BY-ND 2.5 license": "cc-by-nd", "Creative Commons BY-SA 4.0": "cc-by-sa", "sent with cc by mail": "", "acc by-ncx": "",
    }
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(own)), DOCS)).collect()}
    assert [got[i].labels for i in range(len(own))] == list(own.values())
    assert got[0].score == 0.9 and got[0].n_detections == 1


def test_license_names_and_wrapped_lines(spark):
    own = {
        "Expat License": "mit", "the X11 license": "mit", "Internet Systems Consortium License": "isc", "Open Data Commons Database License": "odbl", "Permission is hereby granted, free\nof charge,  to any person\r\n obtaining a copy": "mit",
        "redistribution  and\nuse in source and binary forms, with or\nwithout modification": "bsd", "placed into\nthe public\ndomain": "public-domain", "all rights\nreserved": "proprietary", "Licensed under CC\nBY-NC\t4.0.": "cc-by-nc",
        "in no event will the authors be held liable for any damages arising\nfrom the use of this software": "zlib", "Mozilla\n Public   License, version\n2.0": "mpl", "neither the\nname of X nor the names of its contributors": "bsd",
    }
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(own)), DOCS)).collect()}
    assert [got[i].labels for i in range(len(own))] == list(own.values())
    [hit] = licenses.scan(spark.createDataFrame([(1, "see:  the\n\nExpat\n  License.")], DOCS)).first().hits
    assert (hit.s, hit.e) == (6, 26)


# pages


def test_pages_keep_the_article():
    page = """<html><head><title>no</title></head><body><header>no</header><nav>no</nav><div class="cookie-notice">no</div><main><article><h1>T &amp; x</h1><p>One <b>tw</b>o<p>three<br>four
      <ul><li>a<li>b</ul><script>if (a < b) { "</p>" }</script><aside>no</aside><form>no</form><div class="comments"><article class="comment">no</article></div></article></main><footer>no</footer></body></html>"""
    assert html.extract(page) == "T & x One two three four a b"
    assert html.extract('<div class="ad">no<article>kept</article>') == "kept"
    assert [html.extract(x) for x in (None, "", "a &lt;b&gt;", "<p>a<p>b<!-- c -->d")] == ["", "", "a <b>", "a bd"]


@pytest.mark.parametrize("limit", [html.BROADCAST_TEMPLATES, 0])
def test_site_templates_go(spark, monkeypatch, limit):
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", limit)
    rows = [(i, f"https://a.example/{i}", f"<body><div>Our site, est. 1999</div><p>text {chr(97 + i)} here</p></body>") for i in range(12)] + [(99, "https://b.example/1", "<body><div>Our site, est. 1999</div><p>x</p></body>"), (100, None, None)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "text a here" and got[99] == "Our site, est. 1999 x" and got[100] == ""


@pytest.mark.parametrize("limit", [html.BROADCAST_TEMPLATES, 0])
def test_templates_inside_articles_go(spark, monkeypatch, limit):
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", limit)
    page = lambda x: f'<body><article><p>start {x}</p><div class="box-a"><p>Read our offer</p></div><p>end {x}</p></article></body>'
    rows = [(i, f"https://a.example/{i}", page(chr(97 + i))) for i in range(12)] + [(20 + i, f"https://b.example/{i}", page("same")) for i in range(12)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "start a end a" and got[11] == "start l end l"
    assert got[20] == "start same Read our offer end same"  # copies of one page aren't a template


def test_numbers_and_teasers_stay(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><p>text {chr(97 + i)} here</p><table><tr><td>{i}</td><td>{i * 7}</td></tr></table><p>{1990 + i}</p></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {chr(97 + i)} here {i} {i * 7} {1990 + i}" for i in range(12)}
    assert html.extract("<body><p>The main text of the page is here and long</p><article>Teaser</article><p>and it ends</p></body>") == "The main text of the page is here and long Teaser and it ends"
    assert html.extract("<body>x<main><p>The main text of the page</p><article>Teaser</article></main></body>") == "The main text of the page Teaser"
    assert html.extract("<body><p>short</p><article>An article of many more words</article></body>") == "An article of many more words"


def plainly(page):
    """Main text by another way, for pages as the test tables have them: what lies in articles, without marked elements, as a run of regular expressions."""
    from html import unescape

    page = re.sub(r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", "", page or "")
    inner = " ".join(re.findall(r"(?is)<article\b[^>]*>(.*?)</article>", page))
    inner = re.sub(r"(?is)<(nav|aside|footer|form|button)\b.*?</\1\s*>", " ", inner)
    bad = "|".join(sorted(html.BAD_WORDS, key=len, reverse=True))
    inner = re.sub(rf"(?is)<(div|section|ul|ol|p|span)\b[^>]*\b(?:class|id)=[\"'][^\"']*\b(?:{bad})\b[^\"']*[\"'][^>]*>.*?</\1\s*>", " ", inner)
    inner = re.sub(r"(?i)</?(?:a|b|i|em|strong|span|code|small|u|sub|sup|abbr|mark)\b[^>]*>", "", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_main_text_equals_a_plainer_way(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plainly(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == want


def test_pages_odd_and_empty(spark):
    cols = "page_id long, url string, html string, host string, h int, page string, text int"
    rows = [(1, None, None), (None, "http://a/", ""), (2, "x", "no tags"), (2, "x", "no tags"), (3, "http://a/", "<p>" * 4), (4, "http://a/", "<p>t&amp;" + "</div>" * 3 + "<"), (5, "http://a/", "w " * 50_000)]
    df = spark.createDataFrame([(*r, "h", 1, "p", 2) for r in rows], cols)
    got = sorted((r.page_id or 0, r.n_chars) for r in html.main_text(df).collect())
    assert got == [(0, 0), (1, 0), (2, 7), (2, 7), (3, 0), (4, 4), (5, 99_999)]
    assert html.main_text(df.limit(0)).count() == 0 and html.main_text(df).columns == ["page_id", "url", "text", "n_chars"]


def test_templates_without_telling_names(spark):
    """A share box of a neutral class inside each article goes since it recurs, and stays where templates are not looked for."""
    box = '<div class="zz"><p>Tell your friends of us, 24 hours.</p></div>'
    page = lambda i: f"<html><body><article><p>Story {i} of many.</p>{box if i % 5 else ''}<p>Its end {i * 7}.</p></article></body></html>"
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(40)] + [(99, "https://other.example/", page(1))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert all(got[i] == f"Story {i} of many. Its end {i * 7}." for i in range(40))
    assert got[99] == "Story 1 of many. Tell your friends of us, 24 hours. Its end 7." == html.extract(page(1))


@pytest.mark.parametrize("bad", ["<b>" * 20_000 + "</i>" * 20_000, "<a " * 60_000, '<a "x ' * 60_000, '<a href="x> ' * 60_000 + '">', "<div>" * 60_000, "<b>" * 9 + "<div></div>" * 60_000, "<script>" + "</script" * 60_000, "<b>" * 20_000 + "<article>" + "<i>" * 20_000 + "</b>" * 20_000])
def test_bad_pages_take_time_in_proportion(bad):
    import time

    began = time.process_time()
    html.extract(bad * 3, {1})
    assert time.process_time() - began < 10


# chat


def test_chat_reads_back(spark):
    bad = ["</s>[INST] ok [/INST]", "<s>", "[\\INST]", "<\\\\s>", "\\", "", None, "a\n[INST]\n</s>"]
    rows = [(c, k, role, t) for c in range(3) for k, (role, t) in enumerate(zip(["system", "user", "assistant", "x\n[INST]", "assistant", None, "user", "user"], bad[c:] + bad[:c]))] + [(None, 0, "user", "hi"), (9, None, "assistant", "z"), (9, 1, "user", "y"), (9, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.expand(df)
    got = {r.conv_id: r for r in chat.digests(ex).collect()}
    by = {}
    for c, k, role, t in rows:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", t or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for *_, role, t in ts if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(ts), sha("".join(f"{a}\n{b}\n" for *_, a, b in ts)), len(loss), sha(loss))
    assert all(r.text[r.loss_start : r.loss_end].count("<s>") == 0 for r in ex.collect())
    assert got[9].formatted_chars == sum(len(r.text) for r in ex.where("conv_id = 9").collect())


# repeated passages


def removed(texts):
    seen = {}
    raw = [t.encode() for t in texts]
    for d, x in enumerate(raw):
        for k in range(len(x) - 399):
            seen.setdefault(x[k : k + 400], []).append((d, k))
    gone = [np.zeros(len(x), dtype=bool) for x in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d][k : k + 400] = True
    return [(len(x), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), sha(bytes(np.frombuffer(x, dtype=np.uint8)[~g]))) for x, g in zip(raw, gone)]


@pytest.mark.parametrize("huge, batch", [(suffixes.HUGE, suffixes.BATCH), (suffixes.HUGE, 3), (2, suffixes.BATCH)])
def test_repeats_equal_every_window(spark, monkeypatch, huge, batch):
    monkeypatch.setattr(suffixes, "HUGE", huge)
    monkeypatch.setattr(suffixes, "BATCH", batch)
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgé ") for _ in range(n))
    passages = [word(n) for n in (399, 400, 401, 520, 900)]
    texts = [word(rnd.randrange(500)) + rnd.choice(passages)[rnd.randrange(3) :] + word(rnd.randrange(300)) + rnd.choice(["", rnd.choice(passages)]) for _ in range(30)]
    texts += ["a" * 1200, "ab" * 500, "", "x" * 399, texts[0], word(800)]
    got = {r.doc_id: r for r in suffixes.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == removed(texts)


@pytest.mark.parametrize("huge", [suffixes.HUGE, 1])
def test_passages_of_other_documents_equal_every_window(spark, monkeypatch, huge):
    """Passages of 49 to 70 words, some of them under 400 bytes, some repeated in one document only; white space differs."""
    monkeypatch.setattr(suffixes, "HUGE", huge)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 5)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 50, 51, 51, 52, 60, 70)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(90))]
        w[rnd.randrange(len(w) + 1) :] = rnd.choice([[], passages[i % 8]]) + [word() for _ in range(rnd.randrange(60))]
        rows.append((i, rnd.choice([" ", "\n"]).join(w)))
    once = " ".join(word() for _ in range(55))
    rows += [(100, f"{once} {once}"), (101, rows[3][1]), (102, None), (103, "a " * 50), (104, "a " * 51), (105, "a " * 51), (105, "a " * 51), (None, " ".join(passages[-1])), (107, once[: len(once) // 2])]
    seen = {}
    lists = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for who, w in lists.items():
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), set()).add(who)
    want = {who for x in seen.values() if len(x) > 1 for who in x}
    got = suffixes.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.n_bytes, r.repeats) for r in got) == sorted((i or -1, len((t or "").encode()), (i, t) in want) for i, t in rows)


def test_windows_of_words_take_no_copies_of_texts(monkeypatch):
    """A long document has a row for each of its grams; with its text in each, Arrow held 328 MB for this batch of 0.18 MB."""
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (30_000, 20, 300)]
    docs = SimpleNamespace(mapInArrow=lambda rows, _: rows, select=lambda *_: docs)
    monkeypatch.setattr(suffixes, "in_batches", lambda df: df)
    rows = suffixes.windows_of_words(docs, SimpleNamespace(value=np.full(suffixes.SLOTS // 8, 255, dtype=np.uint8)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8, None], "d": [1, 2, 3], "text": texts})
    own = pa.default_memory_pool()
    pa.set_memory_pool(pool := pa.proxy_memory_pool(own))
    try:
        got = pa.Table.from_batches(rows(iter([batch]))).to_pylist()
    finally:
        pa.set_memory_pool(own)
    assert {(r["doc_id"], r["d"]) for r in got} == {(7, 1), (None, 3)}
    for doc, text in ((7, texts[0]), (None, texts[2])):
        low, w = suffixes.Anchors().passages(text.encode())
        mine = [r for r in got if r["doc_id"] == doc]
        assert [h for r in mine for h in [r["h"]] * len(r["w"])] == low.tolist() and [x for r in mine for x in r["w"]] == w.tolist()
    assert pool.max_memory() < 4 * batch.nbytes


def test_words_in_pieces(monkeypatch):
    rnd = random.Random(2)
    x = bytes(rnd.choice(b"abcd \n") for _ in range(5000)) + b"y" * 900 + b" z"
    whole = suffixes.Anchors().words(x)
    assert len(whole) == len(x.split())
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    assert suffixes.Anchors().words(x).tolist() == whole.tolist()


def test_long_documents_in_pieces(monkeypatch):
    rnd = random.Random(1)
    x = bytes(rnd.choice(b"abcd ") for _ in range(9000))
    whole = suffixes.Anchors().of(x)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    cut = suffixes.Anchors().of(x)
    assert set(whole[0].tolist()) == set(cut[0].tolist()) and dict(zip(*map(np.ndarray.tolist, whole))) == dict(zip(*map(np.ndarray.tolist, cut)))


# toxicity


def test_a_pair_of_terms_is_learned_that_are_neutral_alone(spark):
    """An insult and a group stand as often in either label's texts; only together they are toxic, as other texts are by a slur of their own."""
    rnd = random.Random(18)
    filler = [f"word{k}" for k in range(300)]

    def row(i):
        w = rnd.choices(filler, k=30)
        kind = i % 10
        toxic = kind < 5
        w += {0: ["zonker", "blorps"], 1: ["slurry"], 2: ["slurry"], 3: ["slurry"], 4: ["slurry"], 5: ["zonker"], 6: ["blorps"]}.get(kind, [])
        rnd.shuffle(w)
        return i, " ".join(w), toxic, kind

    data = [row(i) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in data], DOCS)
    labels = spark.createDataFrame([(i, 0, int(x)) for i, _, x, _ in data], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    right = {k: [(got[i].predicted == 1) == x for i, _, x, kind in data if kind == k and got[i].held_out] for k in range(10)}
    assert all(np.mean(right[k]) > 0.95 for k in right), {k: np.mean(v) for k, v in right.items()}
    machine = toxicity.fit(docs, labels)
    alone = toxicity.Machine(machine.index, machine.bias, machine.w, machine.v * 0)
    assert machine.score("zonker blorps") > 0.7 > max(machine.score("zonker"), machine.score("blorps"), alone.score("zonker blorps"))


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [f"w{rnd.randrange(300)}" for _ in range(40)] + (["you", rnd.choice(["grotka", "grotmi", "groteu"]) + rnd.choice("xyz")] * 3 if toxic else ["you"])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(df, lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    out = [(r.predicted, dict(labels)[i]) for i, r in got.items() if r.held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.98 and all((r.score >= 0.7) == bool(r.predicted) for r in got.values())
    assert {r.doc_id for r in toxicity.clean(df, lab).collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.fit(df, lab.where("toxic = 0")) is None


def test_pairs_of_terms_count():
    m = toxicity.Machine({}, -1.0, np.array([0.5, 0.5]), np.array([[2.0], [2.0]]))
    assert m.logit([0]) == -0.5 and m.logit([0, 1]) == 4.0 and m.logit([]) == -1.0


# decontamination


def test_contamination(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([5, 8, 15, 30])))) for k in range(40)] + [(90, "the of and")]
    docs, holds = [], set()
    for i in range(120):
        w = [word() for _ in range(80)]
        if i % 3 == 0:
            k, t = items[i % 40]
            p = t.split()
            if i % 2 and len(p) >= 15:  # one word in seven replaced
                p = [f"z{rnd.randrange(10**9)}" if j % 7 == 3 else x for j, x in enumerate(p)]
            w[20:20] = p
            holds.add((i, k))
        docs.append((i, (" " if i % 5 else ", ").join(w).upper() if i % 4 == 0 else " ".join(w)))
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(df, bench).collect()}
    assert got == holds
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in holds}


def test_masks_hit_every_choice_of_replaced_words():
    from itertools import combinations

    for size in range(decontamination.LEAST_WORDS, decontamination.WINDOW + 1):
        masks = decontamination.MASKS if size == decontamination.WINDOW else decontamination.SHORT_MASKS
        for n in range(size // 5 + 1):
            for gone in combinations(range(size), n):
                assert any(all(c == "0" or s + i not in gone for i, c in enumerate(m)) for m in masks for s in range(size - len(m) + 1)), (size, gone)


@pytest.mark.parametrize("hits", [decontamination.HITS, 7])
def test_overlaps_equal_all_windows(spark, monkeypatch, hits):
    """Few different words, so chance overlaps at every length and at both ends of documents; items share a passage."""
    monkeypatch.setattr(decontamination, "HITS", hits)
    rnd = random.Random(10)
    word = lambda: rnd.choice("abcdefghi")
    common = [word() for _ in range(14)]
    items = [[word() for _ in range(rnd.randrange(1, 20))] for _ in range(25)] + [common + [word() for _ in range(9)] for _ in range(8)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(30))]
        if i % 3 == 0:
            p = [x if rnd.random() > 0.15 else "z" for x in rnd.choice(items)]
            w = [p[rnd.randrange(3) :] + w, w + p[: len(p) - rnd.randrange(3)], p, w + common][i // 3 % 4]
        docs.append(w)
    want = set()
    for k, t in enumerate(items):
        size = min(len(t), 13)
        for d, w in enumerate(docs):
            for at in range(-size, len(w)):  # the place of the window's first word
                if len(t) >= 5 and any(5 * sum(0 <= at + i < len(w) and w[at + i] == t[j + i] for i in range(size)) >= 4 * size for j in range(len(t) - size + 1)):
                    want.add((d, k))
                    break
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(df, bench).collect()} == want and len(want) > 60
    none = bench.limit(0)
    assert decontamination.overlaps(df, none).count() == 0 and decontamination.clean(df, none).count() == len(docs)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 10)
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k}") for k in range(12)], "item_id long, text string")
    df = spark.createDataFrame([(k, f"so alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k} it ends") for k in range(14)], DOCS)
    assert {r.doc_id for r in decontamination.overlaps(df, bench).collect()} == set(range(12))
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == {12, 13}


# pieces


def test_pieces_equal_the_original_library(spark, docs, texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rnd = random.Random(1)
    odd = ["", "  ", " a  b ", "\n\n\t x", "日本語 한국어 é é 😀", "a" * 3000, "▁x ▁▁ y", "<s> </s> <0x0A> <unk>", "a\0b"] + ["".join(rnd.choice(["a", "the", "  ", " ", "\n", "é", "漢", "ing", "\t", "😀", "0", "▁"]) for _ in range(60)) for _ in range(200)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 10**6)), DOCS))
    all_texts = texts | dict(enumerate(odd, 10**6))
    model = pieces.parse(pieces.read_model(pieces.DEFAULT_MODEL))
    pipeline = pieces.build(model)
    for r in pieces.encode(df).collect():
        t = all_texts[r.doc_id]
        assert r.ids == sp.encode(t) and r.n_tokens == len(r.ids) and r.n_chars == len(t) and r.round_trip, t
        assert pieces.decode(model, r.ids) == pipeline.decode(r.ids, skip_special_tokens=False)
        assert pieces.decode(model, r.ids) == t or "▁" in t


def test_unigram_models():
    """A small model of the other kind, as bytes of its protobuf."""
    import struct

    f = lambda n, kind, data: bytes([n << 3 | kind]) + data
    ld = lambda n, data: f(n, 2, bytes([len(data)]) + data)
    piece = lambda s, score, t: ld(1, ld(1, s.encode()) + f(2, 5, struct.pack("<f", score)) + f(3, 0, bytes([t])))
    data = b"".join([piece("<unk>", 0, 2), piece("▁", -3, 1), piece("a", -2, 1), piece("b", -2.5, 1), piece("▁ab", -1, 1)]) + ld(2, f(3, 0, b"\x01"))
    m = pieces.parse(data)
    assert m.kind == 1 and len(m.pieces) == 5
    tok = pieces.build(m)
    assert tok.encode(" ab  a ", add_special_tokens=False).ids == [4, 1, 2]
    assert pieces.decode(m, [4, 1, 2]) == "ab a"


def test_words_in_one_sequence_have_their_own_ids():
    enc = pieces.Encoder(pieces.parse(pieces.read_model(pieces.DEFAULT_MODEL)))
    words = [" a", " größer,", "\n", "\n\n", "  ", " x\0y", " 🙂", "b" * 300] * 90
    alone = [e.ids for e in enc.words.encode_batch_fast([w.replace(" ", pieces.MARK) for w in words], add_special_tokens=False)]
    assert [np.frombuffer(x, dtype=np.int32).tolist() for x in enc.each(words)] == alone
    enc.table[enc.words.encode("▁a", add_special_tokens=False).ids[0]] = b"?"  # a word that no longer decodes to itself
    assert enc.checked(["b a b", "b b", ""])[1] == [False, True, True]
