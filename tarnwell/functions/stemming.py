"""The suffix stripping algorithm of M. F. Porter (1980) for English words, for ROUGE with stems."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes of steps 2 to 4 of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# End of fixed values.


_LONGEST = [sorted(s, key=len, reverse=True) for s in (STEP_2, STEP_3, STEP_4)]


@lru_cache(maxsize=100_000)
def shape(word: str) -> str:
    """The word as v (vowels) and c: y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("v+c+", shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], longest: list[str]) -> str:
    for end in longest:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + endings[end] if measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-cased word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and present participles
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    # 1c: y after a stem with a vowel
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, _LONGEST[0]), STEP_3, _LONGEST[1])
    for end in _LONGEST[2]:
        if word.endswith(end):
            stem = word[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    # 5: a final e, and a double l
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
