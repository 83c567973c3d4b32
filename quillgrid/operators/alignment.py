"""METEOR: words of two texts aligned in stages (equal words, then equal stems), scored with a penalty for fragments.

An alignment matches as many words as it can in each stage. Which of several equal words are matched is a
matter of the alignment: ``last_first`` pairs a word's last places with each other, which is what the
usual toolkit does, and needs aggregations only, for texts of any length; ``fewest_crossings`` is the
published rule, a search that is exact while its beam holds all open choices (texts of some dozens of
words), and otherwise keeps the best ``beam`` of them after each word.

Texts without words (null, blank) score zero. Keys tell pairs apart and must not repeat.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import stems
from quillgrid.functions.text import let
from quillgrid.session import ship_package

#: A number with its inner points and commas, a word, or any other character but white space.
WORD = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*|[^\p{L}\p{M}\p{N}_\s\x0B]"
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
BEAM = 40

#: From the class of a word in the stage before (at first the word) to its class in this one.
Stage = Callable[[Column], Column]
STAGES: tuple[Stage, ...] = (lambda c: c, stems.porter)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def meteor_scores(df: DataFrame, keys: list[str], gold: str, pred: str, stages: tuple[Stage, ...] = STAGES, align: str = "last_first", alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA, beam: int = BEAM) -> DataFrame:
    """(keys, matches, chunks, gold_words, pred_words, meteor) of each pair of texts."""
    aligned = {"last_first": _last_first, "fewest_crossings": _fewest}[align](df, keys, gold, pred, stages, beam)
    precision, recall = F.col("matches") / F.nullif(F.col("pred_words"), F.lit(0)), F.col("matches") / F.nullif(F.col("gold_words"), F.lit(0))
    mean = precision * recall / F.nullif(alpha * precision + (1 - alpha) * recall, F.lit(0.0))
    penalty = gamma * F.pow(F.col("chunks") / F.nullif(F.col("matches"), F.lit(0)), F.lit(beta))
    return aligned.withColumn("meteor", F.coalesce(mean * (1 - penalty), F.lit(0.0)))


def _chunks(pairs: Column) -> Column:
    """Stretches of pairs, sorted by their place in the one text, that are neighbours in both."""
    new = lambda p: F.transform(p, lambda x, i: F.when((i == 0) | (x["p"] != F.get(p, i - 1)["p"] + 1) | (x["g"] != F.get(p, i - 1)["g"] + 1), 1).otherwise(0))
    return F.aggregate(let(pairs, new), F.lit(0), lambda a, x: a + x)


def _last_first(df: DataFrame, keys: list[str], gold: str, pred: str, stages: tuple[Stage, ...], beam: int) -> DataFrame:
    """Words by pair and class with their places on either side; each stage matches what the one before has left.

    A stage is one aggregation by pair and class, so that neither a common word nor a long text is one
    task's work; the pairs of places of one pair of texts come together at the end only.
    """
    side = lambda c, name: F.transform(words(F.col(c)), lambda w, i: F.struct(w.alias("class"), F.lit(name).alias("side"), i.alias("at")))
    both = df.select(*keys, side(gold, "g").alias("_g"), side(pred, "p").alias("_p"))
    each = both.select(*keys, F.size("_g").alias("gold_words"), F.size("_p").alias("pred_words"), F.explode_outer(F.concat("_g", "_p")).alias("_x"))
    fixed = [*keys, "gold_words", "pred_words"]
    now = each.select(
        *fixed, F.col("_x.class").alias("_class"), F.array().cast("array<struct<p: int, g: int>>").alias("_met"),
        *(F.when(F.col("_x.side") == s, F.array("_x.at")).otherwise(F.array().cast("array<int>")).alias(f"_{s}") for s in "gp"),
    )
    for stage in stages:
        now = now.withColumn("_class", stage(F.col("_class"))).groupBy(*fixed, "_class").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_met", "_g", "_p")))
        now = now.withColumns({c: F.sort_array(c, asc=False) for c in ("_g", "_p")}).withColumn("_n", F.least(F.size("_g"), F.size("_p")))
        head = lambda c: F.slice(c, F.lit(1), F.col("_n"))
        rest = lambda c: F.slice(c, F.col("_n") + 1, F.size(c))
        pairs = F.zip_with(head("_p"), head("_g"), lambda p, g: F.struct(p.alias("p"), g.alias("g")))
        now = now.select(*fixed, "_class", F.concat("_met", pairs).alias("_met"), rest("_g").alias("_g"), rest("_p").alias("_p"))
    met = now.groupBy(*fixed).agg(F.array_sort(F.flatten(F.collect_list("_met"))).alias("_met"))
    return met.select(*keys, F.size("_met").alias("matches"), _chunks(F.col("_met")).alias("chunks"), "gold_words", "pred_words")


def crossing_pairs(pairs: list[tuple[int, int]]) -> int:
    return sum((p - q) * (g - h) < 0 for k, (p, g) in enumerate(pairs) for q, h in pairs[:k])


def fewest_crossings(pred: list[list], gold: list[list], beam: int = BEAM) -> list[tuple[int, int]]:
    """(place in pred, place in gold) pairs, sorted. ``pred`` and ``gold`` hold the classes of their words for each stage.

    Within a class pairs never cross, as crossing ones could be exchanged without harm; a choice is
    told from others by the places in gold that it has used.
    """
    met: list[tuple[int, int]] = []
    for of_pred, of_gold in zip(pred, gold):
        busy_p, busy_g = {p for p, _ in met}, {g for _, g in met}
        places: dict = {}
        for g, c in enumerate(of_gold):
            if g not in busy_g:
                places.setdefault(c, []).append(g)
        left = Counter(c for p, c in enumerate(of_pred) if p not in busy_p)
        quota = {c: min(left[c], len(own)) for c, own in places.items()}
        open_: dict[tuple, tuple] = {(): (0, ())}
        for p, c in enumerate(of_pred):
            if p in busy_p or c not in places:
                continue
            left[c] -= 1
            grown: dict[tuple, tuple] = {}
            for crossed, own in open_.values():
                mine = [g for q, g in own if of_pred[q] == c]
                wanted = quota[c] - len(mine)
                free = [g for g in places[c] if not mine or g > mine[-1]]
                options = [None] if left[c] >= wanted else []
                options += free[: len(free) - wanted + 1] if wanted else []
                for g in options:
                    cost, pairs = crossed, own
                    if g is not None:
                        cost += sum((p - q) * (g - h) < 0 for q, h in (*met, *own))
                        pairs = (*own, (p, g))
                    used = tuple(sorted(h for _, h in pairs))
                    if used not in grown or (cost, pairs) < grown[used]:
                        grown[used] = (cost, pairs)
            open_ = dict(sorted(grown.items(), key=lambda x: x[1])[:beam])
        met += min(open_.values())[1]
    return sorted(met)


def chunk_count(pairs: list[tuple[int, int]]) -> int:
    return sum(b != (a[0] + 1, a[1] + 1) for a, b in pairwise(pairs)) + bool(pairs)


def _fewest(df: DataFrame, keys: list[str], gold: str, pred: str, stages: tuple[Stage, ...], beam: int) -> DataFrame:
    """The search over one pair of texts at a time; the classes of distinct words come from the stages as columns."""
    ship_package(df.sparkSession)
    told = df.select(*keys, words(F.col(gold)).alias("_g"), words(F.col(pred)).alias("_p"))
    distinct = told.select(F.explode(F.array_distinct(F.concat("_g", "_p"))).alias("_w")).distinct()
    classes = [F.col("_w")]
    for stage in stages:
        classes.append(stage(classes[-1]))
    known = distinct.select("_w", F.array(*classes[1:]).alias("_c"))
    placed = lambda c, side: F.transform(c, lambda w, i: F.struct(F.lit(side).alias("s"), i.alias("at"), w.alias("w")))
    each = told.select(*keys, F.size("_g").alias("gold_words"), F.size("_p").alias("pred_words"), F.explode_outer(F.concat(placed("_g", 0), placed("_p", 1))).alias("_x"))
    met = each.select(*keys, "gold_words", "pred_words", "_x.s", "_x.at", F.col("_x.w").alias("_w")).join(known, "_w", "left")
    rows = met.groupBy(*keys, "gold_words", "pred_words").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "at", "_c")))).alias("_x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for xs in f["_x"]:
                sides = [[x["_c"] for x in xs if x["s"] == s] for s in (0, 1)]
                by_stage = [[[c[k] for c in side] for k in range(len(stages))] for side in sides]
                pairs = fewest_crossings(by_stage[1], by_stage[0], beam)
                found.append((len(pairs), chunk_count(pairs)))
            out = f.drop(columns="_x")
            out["matches"], out["chunks"] = [m for m, _ in found], [c for _, c in found]
            yield out

    kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("_x").dtypes)
    return rows.mapInPandas(run, f"{kinds}, matches int, chunks int").select(*keys, "matches", "chunks", "gold_words", "pred_words")

