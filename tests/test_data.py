"""Tables of the grammar, dictionaries as tables, files that cannot be read, and bytes that are no text."""

import json
import os

import pytest

from gyeol.operators import lexicons, search, sinks
from gyeol.plans import grammar, tables
from gyeol.plans.lexer import Options
from gyeol.plans.lexicon import check_data
from gyeol.sources import files

LITERAL = Options.literal()


def test_tables_are_sound():
    report = check_data()
    assert report["n_problems"] == 0 and report["n_particles"] == len(grammar.TABLES["particles"]) > 30


@pytest.mark.parametrize("text", ["", "lemma\tpos\n", "id\trole\nx\tcase", "id\nending.a\nending.a", "id\n한"])
def test_broken_tables(text):
    with pytest.raises(tables.DataError):
        tables.parse("endings" if text.startswith("id\n") else "particles", text)


def test_problems_between_tables():
    head = "\t".join(tables.COLUMNS["particles"][1])
    row = "particle.x\tcase\tnominal\tfinal-pair\t이\tparticle.none"
    wrong = check_data({"particles": f"{head}\n{row}", "predicates": "lemma\tpos\talternation\tflags\toverrides\n가다\tVV\tNone\tODD\tbad"})["problems"].split("\n")
    for part in ("unknown next particle.none", "1 forms for selection final-pair", "unknown alternation None", "unknown flag ODD", "override bad"):
        assert any(part in w for w in wrong), part
    assert "columns a where" in check_data({"endings": "a\nb"})["problems"]


def test_part_of_speech_list_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("b", "NNG"), ("a", "VV"), ("a", "NNG"), ("a", "NNG"), (None, "NNG"), ("", "VV")], "lemma string, pos string")
    lexicons.encode_pos(rows, str(tmp_path / "pos"))
    back = lexicons.decode_pos(spark, str(tmp_path / "pos"))
    assert sorted(map(tuple, back.collect())) == [("a", "NNG"), ("a", "VV"), ("b", "NNG")]
    assert tuple(lexicons.pos_stats(back).first()) == (3, 2, 1) and tuple(lexicons.pos_stats(back.limit(0)).first()) == (0, 0, 0)
    lexicons.encode_pos(spark.createDataFrame([("a", "??")], "lemma string, pos string"), str(tmp_path / "bad"))
    with pytest.raises(tables.DataError):
        lexicons.decode_pos(spark, str(tmp_path / "bad"))


def test_a_search_goes_on_without_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.txt").write_text("one lion\n", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"a li\xffon\nxx\xff lion\n")
    issues = []
    found = files.read_files(spark, [str(tmp_path), str(tmp_path / "none")], issues=issues, explicit=[str(tmp_path / "gone.txt")])
    hits = search.find_all(files.decoded(found).select("path", "text"), "lion", LITERAL).select("path", "line_number", "byte_offset", "start", "end").collect()
    assert sorted(map(tuple, hits)) == [("bad.txt", 2, 8, 4, 8), ("good.txt", 1, 0, 4, 8)]
    rows = sorted((os.path.basename(r.path), r.kind) for r in files.issue_rows(spark, issues, found).collect())
    assert rows == [("bad.txt", "input"), ("gone.txt", "walk"), ("none", "walk")]
    with pytest.raises(Exception):  # noqa: B017
        files.read_files(spark, [str(tmp_path / "none")]).count()


def test_no_phrase_goes_across_a_broken_byte(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab \xff cd")), (2, bytearray(b"ab cd \xff"))], "id int, raw binary").selectExpr("id", "cast(raw AS string) AS text")
    assert [r.id for r in search.find_all(df, '"ab" "cd"', Options(boundary="any")).collect()] == [2]


def test_context_records(spark):
    df = spark.createDataFrame([(1, "a\nhit\nb\nc\nd\ne\nhit\nf")], "doc_id int, text string")
    found = search.find_all(df, "hit", LITERAL)
    out = sinks.json_lines(found, "doc_id", search.context(df, found, "doc_id", 1, 1)).orderBy("order").collect()
    kinds = [(r["type"], r.get("line_number")) for r in (json.loads(x.json) for x in out)]
    assert kinds == [("context", 1), ("match", 2), ("context", 3), ("context_break", None), ("context", 6), ("match", 7), ("context", 8)]


def test_links_outer_rules_and_standard_input(spark, tmp_path, monkeypatch):
    import io

    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    (tmp_path / "config" / "git").mkdir(parents=True)
    (tmp_path / "config" / "git" / "ignore").write_text("*.own\n")
    top = tmp_path / "repo"
    (top / ".git" / "info").mkdir(parents=True)
    (top / ".git" / "info" / "exclude").write_text("secret.*\n")
    (top / ".gitignore").write_text("*.log\n/sub/rooted.txt\n")
    sub = top / "sub"
    (sub / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.log", "c.own", "secret.txt", "rooted.txt", "deep/rooted.txt", "deep/kept.log"):
        (sub / name).write_text("x")
    (sub / "deep" / ".gitignore").write_text("!kept.log\n")
    (sub / "link.txt").symlink_to(sub / "a.txt")
    (sub / "linked").symlink_to(sub / "deep")
    names = lambda **given: sorted(r.path for r in files.read_files(spark, [str(sub)], **given).select("path").collect())
    assert names() == ["a.txt", "deep/kept.log", "deep/rooted.txt"]
    assert "link.txt" in names(follow=True) and {"b.log", "c.own", "secret.txt", "rooted.txt"} <= set(names(no_ignore=True))
    data = io.BytesIO(b"piped lion")
    both = files.read_files(spark, ["-", str(sub), "-"], stdin=data).collect()
    assert [bytes(r.content) for r in both if r.path == "-"] == [b"piped lion"] and len(both) == 4
    assert files.default_paths([], piped=True) == ["-"] and files.default_paths([], piped=False) == ["."] and files.default_paths(["x"], piped=True) == ["x"]


def test_numbers_of_context_lines():
    assert [search.around(*x) for x in [(), (3,), (3, 1), (3, None, 0), (None, None, 2)]] == [(0, 0), (3, 3), (1, 3), (3, 0), (0, 2)]
