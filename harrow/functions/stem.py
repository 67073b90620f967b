"""English stems by the published Snowball rules ("Porter2"), as an Arrow function over arrays of words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# fixed values: the exceptions and suffix tables of the published algorithm
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _after_syllable(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _short_syllable(word: str) -> bool:
    """Does the word end in one: vowel between consonants (the last no w, x or Y), or a vowel and consonant alone?"""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a word in small letters."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.lstrip("'")
    word = "".join("Y" if c == "y" and (k == 0 or word[k - 1] in VOWELS) else c for k, c in enumerate(word))
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) if prefix else _after_syllable(word, 0)
    r2 = _after_syllable(word, r1)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURALS:
        return word
    # participles
    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), "")
    if ending.startswith("ee"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and any(c in VOWELS for c in word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    def longest(table) -> str:
        return max((e for e in table if word.endswith(e)), key=len, default="")

    ending = longest([*SECOND, "ogi", "li"])
    if ending and len(word) - len(ending) >= r1:
        if ending == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif ending == "li":
            word = word[:-2] if len(word) > 2 and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(ending)] + SECOND[ending]
    ending = longest([*THIRD, "ative"])
    if ending and len(word) - len(ending) >= r1:
        if ending != "ative":
            word = word[: -len(ending)] + THIRD[ending]
        elif len(word) - 5 >= r2:
            word = word[:-5]
    ending = longest([*FOURTH, "ion"])
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stems(words: Column) -> Column:
    """Stems of an array of words."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
