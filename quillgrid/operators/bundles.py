"""Bundles of consecutive chunks: building, merging of weak pairs, assembly, and the interval join of questions to their text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import tables as H
from quillgrid.session import ship_package

SMALLEST = 4
WEAK = (8, 10)
#: Places of a stretch in the interval join.
STRETCH = 64
#: Places that one task folds at a time when bundles are built.
FOLDED = 4096


def _starts(turns: np.ndarray, held: int, smallest: int) -> list[int]:
    """Places where a bundle begins, if the open one has ``held`` chunks before place 0; ``turns`` are the places with a new section."""
    first, out = -held, []
    for k in turns.tolist():
        if k - first >= smallest:
            out.append(k)
            first = k
    return out


def _turns(names: pd.Series) -> np.ndarray:
    own = names.to_numpy()
    return np.flatnonzero(own[1:] != own[:-1]) + 1


def build(chunks: DataFrame, key: str, pos: str = "pos", section: str = "section", smallest: int = SMALLEST, stretch: int = FOLDED) -> DataFrame:
    """The chunks with their bundle's number: a bundle closes at a section's end once it has ``smallest`` chunks.

    Bundling is a fold whose state is how many chunks the open bundle has, which matters up to
    ``smallest`` only. So a stretch of places folds to a map of those few states, with the bundles it
    closes from each; the maps of a key are composed in order, one short row for each stretch; then
    every stretch numbers its chunks from the state it begins with. A key of any size is spread over as
    many tasks as it has stretches.
    """
    ship_package(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()
    place = F.col(pos).cast("bigint")
    name = F.when(F.coalesce(F.col(section), F.lit("")) == "", "root").otherwise(F.col(section))
    slim = chunks.select(F.col(key).alias("key"), place.alias("pos"), name.alias("name"), F.floor(place / stretch).alias("stretch"))

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame.sort_values("pos")["name"]
        turns, closed, held = _turns(names), [], []
        for state in range(smallest + 1):
            begun = _starts(turns, state, smallest)
            closed.append(len(begun))
            held.append(min(smallest, len(names) - (begun[-1] if begun else -state)))
        return pd.DataFrame([[frame["key"].iloc[0], frame["stretch"].iloc[0], names.iloc[0], names.iloc[-1], closed, held]], columns=["key", "stretch", "first", "last", "closed", "held"])

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("stretch")
        number, state, before, out = 0, 0, None, []
        for first, last, closed, held in zip(frame["first"], frame["last"], frame["closed"], frame["held"]):
            if before is not None and first != before and state >= smallest:
                number, state = number + 1, 0
            out.append((number, state))
            number, state, before = number + int(closed[state]), int(held[state]), last
        return pd.DataFrame({"key": frame["key"], "stretch": frame["stretch"], "number": [n for n, _ in out], "state": [s for _, s in out]})

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        begun = _starts(_turns(frame["name"]), int(frame["state"].iloc[0]), smallest)
        own = int(frame["number"].iloc[0]) + np.searchsorted(np.asarray(begun, np.int64), np.arange(len(frame)), "right")
        return pd.DataFrame({"key": frame["key"], "pos": frame["pos"], "bundle": own.astype(np.int32)})

    maps = slim.groupBy("key", "stretch").applyInPandas(folded, f"key {kind}, stretch bigint, first string, last string, closed array<int>, held array<int>")
    starts = maps.groupBy("key").applyInPandas(composed, f"key {kind}, stretch bigint, number bigint, state int")
    made = slim.join(starts, ["key", "stretch"]).groupBy("key", "stretch").applyInPandas(numbered, f"key {kind}, pos bigint, bundle int")
    return chunks.join(made.select(F.col("key").alias(key), F.col("pos").alias(pos), "bundle"), [key, pos])


def assemble(numbered: DataFrame, key: str, pos: str = "pos", bundle: str = "bundle", id_col: str = "chunk_id") -> DataFrame:
    """One row per bundle from chunk_id, score, section, text, pages and has_table."""
    parts = F.array_sort(F.collect_list(F.struct(pos, id_col, "section", "text", "pages")))
    return (
        numbered.groupBy(key, bundle)
        .agg(F.count("*").alias("chunk_count"), F.sum("score").alias("score"), F.bool_or("has_table").alias("has_table"), parts.alias("parts"))
        .select(
            key,
            bundle,
            F.concat(F.element_at("parts", 1)[id_col], F.lit("_to_"), F.element_at("parts", -1)[id_col]).alias("bundle_id"),
            "chunk_count",
            "score",
            "has_table",
            F.array_join(F.array_distinct(F.filter(F.transform("parts", lambda p: p["section"]), lambda s: s.isNotNull() & (s != ""))), " | ").alias("section"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["pages"])))).alias("pages"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n---\n\n").alias("text"),
        )
    )


def merge_weak(bundles: DataFrame, key: str, order: str = "bundle", weak: tuple[int, int] = WEAK) -> DataFrame:
    """(key, order, merged_bundle, merged): weak neighbours are paired from the left within each unbroken run of weak ones."""
    w = Window.partitionBy(key).orderBy(order)
    is_weak = F.col("score").between(*weak)
    runs = bundles.withColumn("weak", is_weak).withColumn("run", F.row_number().over(w) - F.sum(is_weak.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "run", "weak").orderBy(order)
    pairs = runs.withColumn("pair", F.floor((F.row_number().over(inside) - 1) / 2))
    same = Window.partitionBy(key, "run", "weak", "pair")
    return pairs.select(
        *bundles.columns,
        F.when(F.col("weak"), F.min(order).over(same)).otherwise(F.col(order)).alias("merged_bundle"),
        (F.col("weak") & (F.count("*").over(same) == 2)).alias("merged"),
    )


def strong(merged: DataFrame, key: str, least: int = 8) -> DataFrame:
    """Scores and counts of the merged bundles that reach the least score."""
    return merged.groupBy(key, "merged_bundle").agg(F.sum("score").alias("score"), F.sum("chunk_count").alias("chunk_count"), F.bool_or("merged").alias("merged")).where(F.col("score") >= least)


def interval(bundle_id: Column) -> Column:
    """Struct of the first and last chunk id of a bundle id; nulls if it has another form."""
    pattern = r"^(.+:\d+)_to_(.+:\d+)"
    return F.struct(F.nullif(F.regexp_extract(bundle_id, pattern, 1), F.lit("")).alias("first"), F.nullif(F.regexp_extract(bundle_id, pattern, 2), F.lit("")).alias("last"))


def bundle_text(questions: DataFrame, chunks: DataFrame, keys: list[str], bundle_col: str = "bundle_id", pos: str = "pos", id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The questions with ``context``: texts of the chunks from the bundle's first to its last, in file order.

    An unknown first chunk or another form of id gives the empty text; an unknown last one reads to
    the end. Spans and chunks are dealt to stretches of places, so that the join is on keys and stretch
    with a range left over, and a key with very many chunks is met span by span, not whole. A bundle
    is resolved once, however many questions it has.
    """
    wanted = questions.select(*keys, bundle_col).distinct().withColumn("i", interval(F.col(bundle_col)))
    places = chunks.groupBy(*keys, F.col(id_col).alias("place_id")).agg(F.min(pos).alias("place"))
    ends = wanted.select(*keys, bundle_col, F.col("i.first").alias("first"), F.col("i.last").alias("last"))
    first = places.withColumnRenamed("place_id", "first").withColumnRenamed("place", "low")
    last = places.withColumnRenamed("place_id", "last").withColumnRenamed("place", "high")
    spans = ends.join(first, [*keys, "first"]).join(last, [*keys, "last"], "left").select(*keys, bundle_col, "low", F.when(F.col("high") >= F.col("low"), F.col("high")).alias("high"))
    tops = chunks.groupBy(*keys).agg(F.max(pos).alias("top"))
    whole = spans.join(tops, keys).select(*keys, bundle_col, "low", F.coalesce("high", "top").alias("high"))
    stretch = lambda c: F.floor(c / STRETCH)
    dealt = whole.withColumn("stretch", F.explode(F.sequence(stretch(F.col("low")), stretch(F.col("high")))))
    texts_of = chunks.select(*keys, F.col(pos).alias("p"), F.col(text_col).alias("t"), stretch(F.col(pos)).alias("stretch"))
    hit = dealt.join(texts_of, [*keys, "stretch"]).where(F.col("p").between(F.col("low"), F.col("high")))
    texts = hit.groupBy(*keys, bundle_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "\n\n").alias("context"))
    return questions.join(texts, [*keys, bundle_col], "left").withColumn("context", F.coalesce("context", F.lit("")))


def with_context(questions: DataFrame, chunks: DataFrame, keys: list[str], form: str = "html", evidence: str = "evidence", **options) -> DataFrame:
    """As ``bundle_text``, with tables in the form named, and the evidence where no text is found."""
    found = bundle_text(questions, chunks, keys, **options)
    return found.withColumn("context", F.coalesce(F.nullif(H.serialize(F.col("context"), form), F.lit("")), F.col(evidence)))
