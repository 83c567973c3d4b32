"""BERTScore from a table of token embeddings: each token meets the most similar one of the other text.

Pairs of texts are dealt to blocks of about ``BLOCK_PAIRS``. What a block needs of the embedding table is
joined once for each of its distinct tokens, and comes together with the block's tokens in one task, which
makes a product of normalised matrices for each pair. Neither the table nor a common token is ever in
one place: the table may be of any size.

A token is as similar to itself as can be (1), also without an embedding; one without an embedding (none
in the table, null, zero or not finite) has nothing in common with others. Tokens weigh by their inverse
document frequency over the gold texts, log((N + 1) / (df + 1)), or equally where ``idf`` is False or all
weights of a text are zero. Of repeated tokens in the table the least vector counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators.alignment import words
from quillgrid.session import ship_package

BLOCK_PAIRS = 64
NAMES = ("bertscore_p", "bertscore_r", "bertscore_f1")


def shown(c: Column, limit: int | None = T.CAPS["similarity"]) -> Column:
    """What of a text is compared; n/a where that is blank, so that every text has a token."""
    whole = F.coalesce(c, F.lit(""))
    cut = whole if limit is None else F.left(whole, F.lit(limit))
    return F.when(T.strip(cut) == "", "n/a").otherwise(cut)


def embedding_scores(df: DataFrame, keys: list[str], gold: str, pred: str, vectors: DataFrame, token: str = "token", vector: str = "vector", idf: bool = True, limit: int | None = T.CAPS["similarity"], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(keys, bertscore_p, bertscore_r, bertscore_f1) of each pair of texts; keys tell pairs apart and must not repeat."""
    ship_package(df.sparkSession)
    total = df.count()
    blocks = max(1, math.ceil(total / block_pairs))
    each = df.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.array(*(F.struct(F.lit(s).alias("gold"), words(shown(F.col(c), limit)).alias("ws")) for s, c in ((True, gold), (False, pred)))).alias("sides"),
    )
    marks = [f"k{i}" for i in range(len(keys))]
    flat = each.select(*marks, F.pmod(F.xxhash64(*marks), F.lit(blocks)).alias("block"), F.explode("sides").alias("s"))
    tokens = flat.select("block", *marks, "s.gold", F.explode("s.ws").alias("token")).groupBy("block", *marks, "gold", "token").agg(F.count("*").alias("n"))
    known = vectors.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.min(F.col(vector).cast("array<double>")).alias("vector"))
    common = tokens.where("gold").groupBy("token").agg(F.count("*").alias("df"))
    wanted = tokens.select("block", "token").distinct().join(known, "token", "left").join(common, "token", "left")
    weight = F.log((total + 1) / (F.coalesce("df", F.lit(0)) + 1))
    table = wanted.select(F.col("block").alias("b"), F.col("token").alias("t"), "vector", weight.alias("weight"))  # new names: both sides come from the same tokens
    kinds = ", ".join(f"{m} {df.schema[k].dataType.simpleString()}" for m, k in zip(marks, keys))
    found = tokens.groupBy("block").cogroup(table.groupBy("b")).applyInArrow(_block(marks, idf), f"{kinds}, {', '.join(f'{n} double' for n in NAMES)}")
    return found.withColumnsRenamed(dict(zip(marks, keys)))


def _matrix(vectors: list) -> np.ndarray:
    """Rows of unit length; zeros for what has no direction."""
    size = max((len(v) for v in vectors if v is not None), default=1)
    rows = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        if v is not None:
            rows[k] = [np.nan if x is None else x for x in v]
    rows[~np.isfinite(rows).all(1)] = 0.0
    length = np.linalg.norm(rows, axis=1)
    return rows / np.where(length > 0, length, 1.0)[:, None]


def pair_scores(unit: np.ndarray, weights: np.ndarray, gold: np.ndarray, pred: np.ndarray, n_gold: np.ndarray, n_pred: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and their harmonic mean; ``gold`` and ``pred`` are the places of distinct tokens, with their counts."""
    if not len(gold) or not len(pred):
        return 0.0, 0.0, 0.0
    alike = unit[gold] @ unit[pred].T
    alike[gold[:, None] == pred[None, :]] = 1.0

    def mean(best: np.ndarray, own: np.ndarray, n: np.ndarray) -> float:
        w = weights[own] * n
        return float(best @ w / w.sum()) if w.sum() > 0 else float(best @ n / n.sum())

    r, p = mean(alike.max(1), gold, n_gold), mean(alike.max(0), pred, n_pred)
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def _block(marks: list[str], idf: bool):
    def run(tokens: pa.Table, table: pa.Table) -> pa.Table:
        place = {t: k for k, t in enumerate(table.column("t").to_pylist())}
        unit = _matrix(table.column("vector").to_pylist())
        weights = table.column("weight").to_numpy() if idf else np.ones(len(place))
        held: dict[tuple, tuple] = {}
        columns = [tokens.column(m).to_pylist() for m in marks]
        for key, is_gold, t, n in zip(zip(*columns), tokens.column("gold").to_pylist(), tokens.column("token").to_pylist(), tokens.column("n").to_pylist()):
            held.setdefault(key, ([], [], [], []))
            own = held[key]
            own[0 if is_gold else 1].append(place[t])
            own[2 if is_gold else 3].append(n)
        scores = [pair_scores(unit, weights, *(np.asarray(x, np.int64) for x in own)) for own in held.values()]
        out = {m: pa.array(c, tokens.schema.field(m).type) for m, c in zip(marks, zip(*held))}
        return pa.table(out | {n: pa.array(c, pa.float64()) for n, c in zip(NAMES, zip(*scores))})

    return run
