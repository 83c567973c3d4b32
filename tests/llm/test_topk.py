import random

import numpy as np
import pytest

from quillgrid.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, low bigint, v int"


def _brute(rows, k, chosen):
    fine = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fine.append((i, tuple(int(np.floor(256.0 * np.float64(np.float32(x)))) for x in v)))
    out = []
    for q in sorted({i for i, _ in fine if chosen(i)}):
        own = min(v for i, v in fine if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q and len(v) == len(own))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("sent", [1 << 25, 400])
def test_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(topk, "SENT_BYTES", sent)
    r = random.Random(11)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(k, [r.uniform(-1, 1) for _ in range(4)], 0, 7, 7) for k in range(120)]
    rows += [(200 + k, same, 0, 7, 7) for k in range(30)]  # one vector many times: ties
    rows += [(300, None, 0, 7, 7), (301, [], 0, 7, 7), (302, [None, 1.0, 1.0, 1.0], 0, 7, 7), (303, [float("nan"), 1.0, 1.0, 1.0], 0, 7, 7), (310, [float("inf"), 1.0, 1.0, 1.0], 0, 7, 7), (None, same, 0, 7, 7), (305, [1.0], 0, 7, 7), (320, [0.5], 0, 7, 7), (330, [0.25, 1.0], 0, 7, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    for k, block, bins in ((5, 1024, 1024), (3, 16, 64)) if sent > 400 else ((5, 50, 1024),):
        got = topk.top_k(vectors.where("id % 10 = 0"), vectors, k, block, bins)
        assert sorted(map(tuple, got.collect())) == sorted(_brute(rows, k, lambda i: i % 10 == 0))


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    assert [tuple(r) for r in topk.top_k(v.where("id = 0"), v, 5).orderBy("rank").collect()] == [(0, 1, 1, 256 * 128), (0, 2, 2, 0)]
    assert topk.top_k(v.where("id = 0"), v.where("id = 0"), 5).count() == 0
    assert topk.top_k(v.where("false"), v, 5).count() == 0 and topk.top_k(v.where("false"), v.where("false"), 5).count() == 0


def test_large_numbers_are_exact():
    q = np.asarray([[2**40, 1]])
    assert topk._scores(q, np.asarray([[2**20, 3]])).tolist() == [[2**60 + 3]]
