"""Arithmetic on Hangul syllables: a syllable is (initial, vowel, final), final 0 meaning none."""

from __future__ import annotations

import unicodedata

FIRST, VOWELS, FINALS = 0xAC00, 21, 28
V = {c: i for i, c in enumerate("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")}
T = {c: i + 1 for i, c in enumerate("ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ")}
LIGHT = {V[c] for c in "ㅏㅑㅗㅘ"}


def split(c: str) -> tuple[int, int, int] | None:
    n = ord(c) - FIRST
    return (n // (VOWELS * FINALS), n // FINALS % VOWELS, n % FINALS) if 0 <= n < 19 * VOWELS * FINALS else None


def join(initial: int, vowel: int, final: int = 0) -> str:
    return chr(FIRST + (initial * VOWELS + vowel) * FINALS + final)


def final_of(text: str) -> int | None:
    """The last syllable's final consonant, None if the text doesn't end in a syllable."""
    s = split(text[-1]) if text else None
    return None if s is None else s[2]


def has_final(text: str) -> bool:
    return bool(final_of(text))


def with_final(text: str, final: int) -> str:
    i, v, _ = split(text[-1])
    return text[:-1] + join(i, v, final)


def with_vowel(text: str, vowel: int) -> str:
    i, _, t = split(text[-1])
    return text[:-1] + join(i, vowel, t)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def is_token_char(c: str) -> bool:
    """Letters, digits, marks and the underscore: what a token is made of."""
    if c.isascii():
        return c.isalnum() or c == "_"
    return c.isalnum() or unicodedata.category(c)[0] in "M" or unicodedata.category(c) in ("Nl", "No")


def is_hangul(text: str) -> bool:
    inside = ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF))
    return bool(text) and all(any(a <= ord(c) <= b for a, b in inside) for c in text)
