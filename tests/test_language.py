"""The query language, the lexicon and inflection."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gyeol.functions import hangul as H
from gyeol.plans import particles
from gyeol.plans.compiler import CompileError, compile_query
from gyeol.plans.lexer import Atom, Limits, Options, QueryError, parse
from gyeol.plans.lexicon import AnalyzeError, DataError, Lexicon, pos_stats
from gyeol.plans.predicates import GenerateError, Predicate, branches


@given(st.integers(0xAC00, 0xD7A3))
def test_syllables_come_apart_and_together(n):
    assert H.join(*H.split(chr(n))) == chr(n)


@pytest.mark.parametrize("c, inside", [("_", True), ("a", True), ("가", True), ("́", True), ("é", True), ("½", True), (" ", False), ("-", False), ("\udc80", False)])
def test_token_characters(c, inside):
    assert H.is_token_char(c) is inside


def test_atoms_tags_quotes_and_escapes():
    assert parse("v:걷다 'a b' x\\ y").atoms == (Atom("걷다", "Verb"), Atom("a b", None, True), Atom("x y"))
    assert parse("zz:걷다").atoms == (Atom("zz:걷다"),)
    assert parse("\\v:걷다").atoms == (Atom("v:걷다"),)
    assert parse("v'x':y").atoms == (Atom("vx:y", None, True),)
    assert parse("a|b | c").disjunction and len(parse("a|b | c").atoms) == 3
    assert parse('"|"').atoms == (Atom("|", None, True),) and parse("\\|").atoms == (Atom("|"),)


@pytest.mark.parametrize(
    "source, kind, span",
    [("", "EmptyQuery", (0, 0)), ("''", "EmptyAtom", (0, 2)), ("v:", "EmptyAtom", (0, 2)), ("'a", "UnterminatedQuote", (0, 2)), ("a\\", "DanglingEscape", (1, 2)), ("a|", "MissingDisjunctionOperand", (1, 2)),
     ("|a", "MissingDisjunctionOperand", (0, 1)), ("a b|c", "MixedPhraseAndDisjunction", (2, 3)), ("a" * 257, "QueryTooLong", (256, 257))],
)
def test_errors_say_where(source, kind, span):
    with pytest.raises(QueryError) as e:
        parse(source)
    assert (e.value.kind, e.value.span) == (kind, span)


def test_conflicts_and_limits():
    with pytest.raises(QueryError, match="ConflictingPos"):
        parse("v:걷다", Options(pos="Noun"))
    with pytest.raises(QueryError, match="TooManyAtoms"):
        parse("a b c", Options(limits=Limits(atoms=2)))
    with pytest.raises(CompileError, match="TooManyPrograms"):
        compile_query("v:걷다", Options(limits=Limits(programs=3)))
    with pytest.raises(CompileError, match="MatcherMemory"):
        compile_query("v:걷다", Options(limits=Limits(matcher_bytes=100)))
    with pytest.raises(CompileError, match="Depth"):
        compile_query("a", Options(limits=Limits(depth=3)))
    with pytest.raises(ValueError):
        Options.literal(boundary="token")


@given(st.text(max_size=40))
@settings(max_examples=200)
def test_any_text_is_a_query_or_an_error(source):
    try:
        assert parse(source).atoms
    except QueryError as e:
        assert 0 <= e.span[0] <= e.span[1] <= len(source)


FORMS = {
    ("걷다", "DToL"): "걸어 걸었 걸으 걷는 걷는다 걸은 걸을 걸을세 걷습니다 걸음 걷기 걷자 걷느냐 걸읍시다 걸으려고",
    ("짓다", "DropS"): "지어 지었 지으 짓는 지은 지을 지음",
    ("돕다", "BToWa"): "도와 도왔 도우면 도우며 도운 도울 도움 돕는",
    ("눕다", "BToWo"): "누워 누웠 누운 누울",
    ("파랗다", "DropH"): "파래 파랬 파란 파랄 파라면",
    ("부르다", "ReuDoubleL"): "불러 불렀 부른 부를 부릅니다",
    ("푸르다", "Reo"): "푸르러 푸르렀",
    ("하다", "Ha"): "하여 해 했 하였 한다 합니다 할 한 함",
    ("푸다", "UToEo"): "퍼 펐 푼",
    ("보다", "Regular"): "보아 봐 봤 보았 본다",
    ("주다", "Regular"): "주어 줘 줬",
    ("되다", "Regular"): "되어 돼 됐",
    ("마시다", "Regular"): "마시어 마셔 마셨",
    ("쓰다", "Regular"): "써 썼",
    ("바쁘다", "Regular"): "바빠 바빴",
    ("살다", "Regular"): "살아 사는 산다 삽니다 살 산 삶 사니 사시다 살면 삽시다 사셨",
    ("먹다", "Regular"): "먹어 먹는다 먹은 먹을 먹습니다 먹음 먹읍시다",
    ("이다", "Copula"): "다 이고 이어 인 일 였 이었 입니다 이라고",
}


@pytest.mark.parametrize("entry", FORMS, ids=lambda e: e[0])
def test_inflection(entry):
    pos = "VCP" if entry[1] == "Copula" else "VA" if entry[0] in ("파랗다", "푸르다", "바쁘다") else "VV"
    made = {b.anchor for b in branches(Predicate(entry[0], pos, entry[1]))}
    action = {"파래": 1}
    assert action and {f for f in FORMS[entry].split() if f not in made} == set()


def test_wrong_alternations_are_refused():
    for lemma, alt in (("가다", "DToL"), ("가다", "ReuDoubleL"), ("가다", "Ha"), ("가", "Regular"), ("abc다", "Regular")):
        with pytest.raises(GenerateError):
            branches(Predicate(lemma, "VV", alt))


@pytest.mark.parametrize(
    "core, following, taken", [("길", "을", "을"), ("길", "를", ""), ("길", "로", "로"), ("길", "으로", ""), ("사용자", "들에게는 x", "들에게는"), ("집", "에서부터도", "에서부터도"), ("길", "도도", "도"), ("나", "가만", "가만"), ("집", "으로서", "으로서")]
)
def test_particle_chains(core, following, taken):
    assert following[: particles.chain(core, following)[0]] == taken


def test_auxiliary_chains():
    assert particles.auxiliary_exact("빨리", "도") == ("particle.additive",)
    assert particles.auxiliary_exact("길", "을") is None and particles.auxiliary_exact("길", "") is None


def test_analyses():
    lex = Lexicon()
    kinds = lambda raw, pos=None: [(a.pos, a.source, a.predicate.alternation if a.predicate else None) for a in lex.analyze(Atom(raw, pos))]
    assert kinds("걷다") == [("VV", "builtin", "DToL"), ("VV", "builtin", "Regular")]
    assert kinds("걷다", "Verb")[-1] == ("VX", "forced", "DToL")
    assert kinds("공부하다") == [("VV", "productive", "Ha")]
    assert kinds("멋지다") == [("LIT", "heuristic", None)]
    assert kinds("하늘") == [("NNG", "heuristic", None), ("LIT", "heuristic", None)]
    assert [k[0] for k in kinds("하늘", "Noun")] == ["NNG", "NNP", "NNB"]
    assert kinds("자연스럽다", "Adjective") == [("VA", "forced", "BToWo")]
    with pytest.raises(AnalyzeError):
        lex.analyze(Atom("걷", "Verb"))


def test_layers():
    lex = Lexicon()
    lex.load_full([("걷다", "VV"), ("하늘", "NNG"), ("하늘", "NNP"), ("예쁘다", "VV")])
    assert [a.source for a in lex.lookup("걷다")] == ["builtin", "builtin"]
    assert [a.pos for a in lex.lookup("하늘")] == ["NNG", "NNP"]
    assert [a.pos for a in lex.analyze(Atom("하늘", "Noun"))] == ["NNG", "NNP", "NNB"]
    assert [(a.pos, a.source) for a in lex.lookup("예쁘다")] == [("VA", "builtin"), ("VV", "full-pos")]
    lex.load_user('[[predicate]]\nlemma = "걷다"\npos = "VV"\nreplace = true\n[[nominal]]\nsurface = "새벽"\npos = "NNG"')
    assert [(a.source, a.predicate.alternation) for a in lex.lookup("걷다")] == [("user", "Regular")]
    for bad in ("x = [", '[[predicate]]\nlemma = "가다"\npos = "VV"\nalternation = "Nope"', '[[nominal]]\nsurface = ""\npos = "NNG"', '[[nominal]]\nsurface = "a"\npos = "NNG"\nzz = 1'):
        with pytest.raises(DataError):
            lex.load_user(bad)
    assert pos_stats([("a", "NNG"), ("a", "VV"), ("b", "NNG")]) == {"entries": 3, "lemmas": 2, "ambiguous": 1}


def test_diagnostics_and_plans():
    p = compile_query("멋지다")
    assert any(d.startswith("UnregisteredDa") for d in p.diagnostics) and "FullPosLexiconUnavailable" in p.diagnostics
    assert not compile_query("abc", Options.literal()).diagnostics
    p = compile_query("v:걷다", Options(normalization="canonical"))
    assert any(H.nfc(a) != a for a in p.anchors[0])
    p = compile_query("걷다 | 길")
    assert p.disjunction and len(p.atoms) == 1 and {i for x in p.atoms[0].programs for i, _ in x.origins} == set(range(len(p.atoms[0].analyses)))
