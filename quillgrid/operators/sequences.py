"""Sequence measures of long texts, by Arrow batches: a longest common subsequence costs one integer step for each word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import ship_package

_SEPARATORS = re.compile(r"[^a-z0-9]+")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_words(text: str | None) -> list[str]:
    return _SEPARATORS.sub(" ", (text or "").lower()).split()


def _rouge(gold: str | None, pred: str | None) -> float:
    g, p = rouge_words(gold), rouge_words(pred)
    if not g or not p:
        return 0.0
    n = lcs(g, p)
    return 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) if n else 0.0


def rouge_l(gold: Column, pred: Column) -> Column:
    """ROUGE-L F of two texts of any length (``metrics.rouge_l`` is the same for short ones, without Python)."""
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def measure(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_rouge(a, b) for a, b in zip(g, p)])

    return measure(gold, pred)
