"""Lattices against every cover there is, and dictionaries in their text forms."""

import itertools
import random

import pytest

from gyeol.functions.lattice import Kind, Lattice, Unknown, Word
from gyeol.operators import lexicons
from gyeol.plans.tables import DataError
from gyeol.sources import dictionaries


def every(lat, text):
    """(cost, nodes) of all covers, by trying all words everywhere."""
    nodes = lat.nodes(text)

    def go(at, right, cost, path):
        if at == len(text):
            if (step := lat.join(right, 0)) is not None:
                yield cost + step, tuple(path)
            return
        for n in nodes[at]:
            if (step := lat.join(right, n.left)) is not None:
                yield from go(n.end, n.right, cost + step + n.cost, [*path, n])

    return sorted(go(0, 0, 0, []))


def test_covers_equal_all_covers():
    rnd = random.Random(4)
    words = [Word(s, rnd.randrange(1, 4), rnd.randrange(1, 4), rnd.randrange(-5, 40), rnd.choice(["N", "V", "J"])) for s in ["a", "b", "ab", "ba", "aba", "bb", "a", "ab", "c"]]
    costs = {(r, left): rnd.randrange(-9, 30) for r, left in itertools.product(range(4), range(4)) if rnd.random() < 0.85}
    unknown = Unknown({"DEFAULT": Kind("DEFAULT", False, True, 0), "B": Kind("B", True, False, 2)}, [(ord("b"), ord("b"), "B")], {"DEFAULT": [Word("DEFAULT", 1, 2, 60, "U")], "B": [Word("B", 3, 3, 25, "U")]})
    lat = Lattice(words, costs, unknown)
    for text in ["", "a", "ab", "abab", "babbab", "abxxba", "x", "ccab", "bbbb"]:
        want = every(lat, text) if text else []
        assert [(c.cost, c.nodes) for c in lat.covers(text)] == want[:4]
        for start, end, kinds in [(0, 1, {"N"}), (1, 3, {"V", "J"}), (0, 2, {"N", "V", "J", "U"})]:
            has = lambda p: any(n.start == start and n.end == end and n.pos in kinds for n in p)
            low = lambda xs: min(xs, default=None)
            assert lat.decide(text, start, end, kinds) == (low([c for c, p in want if has(p)]), low([c for c, p in want if not has(p)]))
    assert lat.candidates("abab", 0, 2) and lat.candidates("abab", 3, 9) == []


def test_unknown_words():
    u = dictionaries.unknown_words("DEFAULT 0 1 0 # rest\nNUM 1 1 2\n0x30..0x39 NUM\n0x35 DEFAULT\n", "NUM,1,1,5,SN,*\nDEFAULT,2,2,9,UNK,*\n")
    lat = Lattice([Word("1", 1, 1, 0, "NR")], {}, u)
    assert [(n.end, n.pos) for n in lat.nodes("123x")[0]] == [(1, "NR"), (1, "SN"), (2, "SN"), (3, "SN")]
    assert u.kind_of("5").name == "DEFAULT" and [(n.end, n.known) for n in lat.nodes("xy1")[0]] == [(2, False)]
    for bad in (("X 1 1", ""), ("0x30 NONE", ""), ("", "NONE,1,1,1,N"), ("", "a,b")):
        with pytest.raises(DataError):
            dictionaries.unknown_words(*bad)


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "Noun.csv").write_text('길,1,2,300,NNG,*,T,길,*,*,*,*\n길,1,2,300,NNG,*,T,길,*,*,*,*\n"a,b",1,2,9,SL,*,F,*,*,*,*,*\n', encoding="utf-8")
    (tmp_path / "x" / "Inflect.csv").write_text("했,3,4,-20,XSV+EP,*,T,했,Inflect,XSV,EP,하/XSV/*+았/EP/*\n걷,3,3,7,VV,*,T,걷,*,*,*,*\n", encoding="utf-8")
    rows = dictionaries.words(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, rows.select("surface", "cost", "pos", "type").collect())) == [("a,b", 9, "SL", None), ("걷", 7, "VV", None), ("길", 300, "NNG", None), ("했", -20, "XSV+EP", "Inflect")]
    assert sorted(map(tuple, dictionaries.pos_entries(rows).collect())) == [("a,b", "SL"), ("걷다", "VV"), ("길", "NNG")]
    got = rows.where("surface = '했'").select(dictionaries.parts(rows["expression"]).alias("p")).first().p
    assert [(x.surface, x.pos) for x in got] == [("하", "XSV"), ("았", "EP")]
    (tmp_path / "matrix.def").write_text("2 2\n0 0 1\n0 1 -5\n1 1 7\n")
    matrix = dictionaries.connections(spark, str(tmp_path / "matrix.def"))
    assert sorted(map(tuple, matrix.collect())) == [(0, 0, 1), (0, 1, -5), (1, 1, 7)]
    (tmp_path / "bad.def").write_text("2 2\n2 0 1\n")
    with pytest.raises(DataError):
        dictionaries.connections(spark, str(tmp_path / "bad.def"))
    dictionaries.encode({"words": rows, "matrix": matrix}, str(tmp_path / "res"))
    back = dictionaries.decode(spark, str(tmp_path / "res"))
    assert back["words"].count() == 4 and back["matrix"].count() == 3
    spark.createDataFrame([(0, 0, 2)], matrix.schema).write.mode("append").parquet(str(tmp_path / "res" / "matrix"))
    with pytest.raises(DataError):
        dictionaries.decode(spark, str(tmp_path / "res"))
    lat = dictionaries.lattice(rows, matrix)
    out = lexicons.covers(spark.createDataFrame([(1, "길"), (2, None), (3, "")], "id int, text string"), lat).collect()
    assert [len(r.covers) for r in sorted(out)] == [0, 0, 0]  # context 2 of the noun has no cell


@pytest.mark.parametrize(
    "surface, wanted, spans",
    [
        ("길을", [("길", "NNG"), ("을", "JKO")], [(0, 1, "NNG"), (1, 2, "JKO")]),
        ("했다", [("하", "XSV"), ("았", "EP"), ("다", "EF")], [(0, 1, "XSV"), (0, 1, "EP"), (1, 2, "EF")]),
        ("공부했다", [("공부", "NNG"), ("하", "XSV"), ("았", "EP"), ("다", "EF")], [(0, 2, "NNG"), (2, 3, "XSV"), (2, 3, "EP"), (3, 4, "EF")]),
        ("길", [("길", "NNG"), ("을", "JKO")], None),
        ("길은", [("길", "NNG")], None),
    ],
)
def test_expressions_in_surfaces(surface, wanted, spans):
    assert dictionaries.aligned(surface, wanted) == spans
