"""Stems of English words: the suffix rules of Porter (1980) and the plural rules of Harman (1991)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import ship_package

# The published suffix rules, step by step.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _form(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _form(stem).count("vc")


def _closed(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant other than w, x and y."""
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _mapped(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    if suffix is None or _measure(word[: -len(suffix)]) == 0:
        return word
    return word[: -len(suffix)] + rules[suffix]


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    if suffix is None or "v" not in _form(word[: -len(suffix)]):
        return word
    stem = word[: -len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _form(stem)[-1] == "c" and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem


def porter_stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and anything but letters a to z, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    for suffix, other in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + other
            break
    word = _past(word)
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, _STEP_2), _STEP_3)
    suffix = _longest(word, _STEP_4)
    if suffix is not None and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _closed(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def porter(c: Column) -> Column:
    """``porter_stem`` by Arrow batches, each distinct word of a batch once."""
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        known = {w: porter_stem(w) for w in words.dropna().unique()}
        return words.map(known)

    return stems(c)


def plural(c: Column) -> Column:
    """The singular by the three plural rules, of which the first that fits applies: (i)es, es, s."""
    return (
        F.when(c.rlike("[^ea]ies$") & (F.length(c) > 4), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("[^aeo]es$"), F.regexp_replace(c, "s$", ""))
        .when(c.rlike("[^us]s$") & (F.length(c) > 3), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )
