"""The kernel, against golden forms and a naive search."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gyeol.functions.matcher import ComponentResourceRequired, Matcher, MatchLimitExceeded, byte_offsets
from gyeol.functions.structure import Components
from gyeol.plans.compiler import compile_query
from gyeol.plans.lexer import Options

PARTS = Components([("매일", "MAG"), ("매", "NNG"), ("길", "NNG"), ("학생", "NNG"), ("을", "JKO"), ("이", "VCP"), ("다", "EF"), ("빨리", "MAG"), ("도", "JX"), ("셋", "NR"), ("둘", "NR")])


def found(query, text, components=None, **options):
    return [text[m[0].start : m[-1].end] for m in Matcher(compile_query(query, Options(**options)), components).find_all(text)]


@pytest.mark.parametrize(
    "query, text, expected",
    [
        ("v:걷다", "걸어 걸었 걸으면 걸으셨다", "걸어 걸었 걸으면 걸으셨다"), ("v:듣다", "들어 들었 들으면 걸어", "들어 들었 들으면"), ("묻다", "물어 묻어", "물어 묻어"), ("예쁘다", "예뻐 예뻤다 예쁜 예쁠 예쁘어", "예뻐 예뻤다 예쁜 예쁠"),
        ("좋다", "좋아요 좋았어요", "좋아요 좋았어요"), ("아니다", "아니고 아니라 아닌 아닐", "아니고 아니라 아닌 아닐"), ("부르다", "불러", "불러"), ("푸르다", "푸르러", "푸르러"), ("보다", "보아 봐", "보아 봐"), ("되다", "되어 돼", "되어 돼"),
        ("살다", "사는 삽니다 살고", "사는 삽니다 살고"), ("사용자", "사용자들에게", "사용자들에게"), ("n:길", "길로 길을 길으로", "길로 길을"),
    ],
)
def test_required_forms(query, text, expected):
    assert " ".join(found(query, text, boundary="token")) == expected


def test_boundaries():
    assert found("길", "산길 길 길가", boundary="any") == ["길", "길", "길"]  # 가 follows a vowel only, so it is no particle of 길
    assert found("n:길", "산길 길", boundary="token") == ["길"]
    assert found("v:걷다", "전화를 걸어 봤다. 길을 걸어갔다", boundary="smart") == ["걸어"]
    with pytest.raises(ComponentResourceRequired):
        Matcher(compile_query("n:길"))


def test_particles_by_their_host():
    assert found("j:을", "길을 길를 나를 나을") == ["을", "를"]


def test_structure():
    assert found("n:매", "매일 보고 싶어", PARTS) == []
    assert found("adv:매일", "매일 본다", PARTS) == ["매일"]
    assert found("이다", "학생이다", PARTS) == ["이다"]
    assert PARTS.numeral_path("둘셋") and not PARTS.numeral_path("둘") and PARTS.copula_path("이다", 0) and not PARTS.ending_path("이다", 0)


def test_provenance():
    m = Matcher(compile_query("v:걷다")).find_all("걸었다")[0][0]
    assert any(r == ("lexical.d-to-l", "ending.past", "ending.final-da") for _, r in m.origins)


def test_decomposed_text():
    t = unicodedata.normalize("NFD", "길을 걸어 갔다")
    assert found("n:길", t, boundary="token", normalization="canonical") == [unicodedata.normalize("NFD", "길을")]
    assert found("n:길", t, boundary="any", normalization="nfc") == []


def test_limits_and_find_at():
    m = Matcher(compile_query("a", Options.literal()))
    with pytest.raises(MatchLimitExceeded):
        m.find_all("aaa", 2)
    assert m.find_at("xaxa", 2)[0].start == 3 and m.find_at("x", 0) is None
    assert m.counters("aa") == {"raw_anchor_hits": 2, "verified_program_hits": 2, "structural_hits": 0, "structural_windows": 0}
    assert byte_offsets("é길a", [0, 1, 2, 3]) == {0: 0, 1: 2, 2: 5, 3: 6}


def test_bytes_that_are_no_text():
    t = b"\xff\xfe a\xff b".decode("utf-8", "surrogateescape")
    m = Matcher(compile_query("'a' 'b'", Options(boundary="token")))
    assert m.find_all(t) == [] and [s.start for s in m.all_spans(t, 0)] == [3]


words = st.lists(st.sampled_from(["a", "b", "ab", "x", " ", "\n", "가"]), max_size=24).map("".join)


def naive_phrase(text, atoms, gap):
    """All leftmost-longest combinations by trying everything."""
    occ = [[(i, i + len(a)) for i in range(len(text)) if text.startswith(a, i)] for a in atoms]
    combos = [[x] for x in occ[0]]
    for layer in occ[1:]:
        combos = [c + [y] for c in combos for y in layer if c[-1][1] <= y[0] <= c[-1][1] + gap and "\n" not in text[c[-1][1] : y[0]]]
    out, at = [], 0
    while rest := [c for c in combos if c[0][0] >= at]:
        s = min(c[0][0] for c in rest)
        e = max(c[-1][1] for c in rest if c[0][0] == s)
        out.append((s, e))
        at = e
    return out


@given(words, st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_phrases_equal_exhaustive_search(text, gap):
    m = Matcher(compile_query("'a' 'b' 'ab'", Options(expand="literal", boundary="any", normalization="none", max_gap=gap)))
    assert [(x[0].start, x[-1].end) for x in m.find_all(text)] == naive_phrase(text, ["a", "b", "ab"], gap)


@given(st.lists(st.sampled_from(["길", "을", "를", "로", "걸", "어", "었", "다", "걷", "기", " ", "들", "에게", "."]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_matches_equal_trying_every_place(text):
    m = Matcher(compile_query("v:걷다 | n:길", Options(boundary="token")))
    out, at = [], 0
    while at < len(text):
        spans = sorted((s for p in m.plan.atoms[0].programs if text.startswith(p.anchor, at) and (s := m.run(text, at, p))), key=lambda s: s.rank)
        if spans:
            out.append((spans[0].start, spans[0].end))
            at = spans[0].end
        else:
            at += 1
    got = m.find_all(text)
    assert [(x[0].start, x[0].end) for x in got] == out
    assert all(x[0].start <= x[0].core_start < x[0].core_end <= x[0].end for x in got)
