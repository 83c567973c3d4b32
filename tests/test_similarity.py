import math
import random

import numpy as np
import pytest

from quillgrid.operators import similarity as V


def plain(rows, vectors, idf=True):
    """Token by token: every occurrence meets its most similar one."""
    tokens = lambda t: t.lower().split() if t and t.strip() else ["n", "/", "a"]
    golds = [set(tokens(g)) for _, g, _ in rows]
    weight = lambda t: math.log((len(rows) + 1) / (sum(t in g for g in golds) + 1)) if idf else 1.0

    def alike(x, y):
        if x == y:
            return 1.0
        a, b = vectors.get(x), vectors.get(y)
        if a is None or b is None or not np.isfinite(a).all() or not np.isfinite(b).all() or not np.any(a) or not np.any(b):
            return 0.0
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    def mean(own, other):
        ws, best = [weight(t) for t in own], [max(alike(t, o) for o in other) for t in own]
        return sum(w * b for w, b in zip(ws, best)) / sum(ws) if sum(ws) > 0 else sum(best) / len(best)

    out = {}
    for k, g, p in rows:
        r, q = mean(tokens(g), tokens(p)), mean(tokens(p), tokens(g))
        out[k] = (q, r, 2 * q * r / (q + r) if q + r > 0 else 0.0)
    return out


@pytest.mark.parametrize("idf", [True, False])
@pytest.mark.parametrize("block_pairs", [3, 64])
def test_against_all_pairs_of_tokens(spark, idf, block_pairs):
    r = random.Random(8)
    names = [f"t{k}" for k in range(30)]
    vectors = {n: [r.gauss(0, 1) for _ in range(7)] for n in names[:22]}
    vectors |= {"t3": [0.0] * 7, "t4": [math.nan] + [1.0] * 6}
    table = [(n, [float(x) for x in v]) for n, v in vectors.items()] + [("t9", None), (None, [1.0] * 7), ("unused", [2.0] * 7), ("t29", [None] + [1.0] * 6)]
    text = lambda: r.choice([None, "", "  "]) if r.random() < 0.1 else " ".join(r.choice(names) for _ in range(r.randint(1, 15)))
    rows = [(k, text(), text()) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, gold string, pred string")
    held = spark.createDataFrame(table, "token string, vector array<double>")
    got = {x["k"]: tuple(x)[1:] for x in V.embedding_scores(df, ["k"], "gold", "pred", held, idf=idf, block_pairs=block_pairs).collect()}
    want = plain(rows, {n: np.asarray(v) for n, v in vectors.items()}, idf)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_equal_texts_and_unknown_tokens(spark):
    df = spark.createDataFrame([("a", 1, "the board met", "the board met"), ("a", 2, "one", "two"), (None, 3, "x" * 2000 + " y", "x" * 2000 + " z")], "c string, k int, gold string, pred string")
    none = spark.createDataFrame([], "token string, vector array<double>")
    got = {x["k"]: (x["c"], round(x["bertscore_f1"], 6)) for x in V.embedding_scores(df, ["c", "k"], "gold", "pred", none).collect()}
    assert got == {1: ("a", 1.0), 2: ("a", 0.0), 3: (None, 1.0)}  # the last pair differs after the characters that count
    assert V.embedding_scores(df.where("false"), ["c", "k"], "gold", "pred", none).count() == 0
