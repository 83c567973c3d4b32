import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import recurrent_lm as L
from quillgrid.llm import toxicity as X


def _crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for k in range(1200):
        words, bad = [word() for _ in range(r.randint(30, 90))], r.random() < 0.15
        if bad:  # insults, or words of a made-up beginning that only labels tell
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum"]) if k % 2 else "zzkw" + word())
        rows.append((k, " ".join(words), "en", "s", 0))
        if r.random() < 0.8:
            labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in X.score(docs, X.train(docs, labels)).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (_crc(k) % 4 == 2) for k, r in got.items())
    held = [k for k in truth if got[k]["held_out"]]
    hits = [got[k]["predicted"] for k in held if truth[k]]
    wrong = [got[k]["predicted"] for k in held if not truth[k]]
    assert np.mean(hits) > 0.95 and np.mean(wrong) < 0.02
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_edges(spark, messy, nothing, labelled):
    docs, labels = labelled
    model = X.train(docs, labels)
    got = X.score(messy, model).collect()
    assert len(got) == messy.count() and X.score(nothing, model).count() == 0
    assert X.keep_clean(messy, model).columns == messy.columns
    alone = X.train(nothing, labels)
    assert alone.score("you idiot") > 0.3 > alone.score("fine day") and alone.score("") == X.Model().score("")


def test_held_out_labels_are_not_read(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.train(docs, labels), X.train(docs, turned)
    assert a.weights == b.weights and a.bias == b.bias


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good, copy, noise = y ^ (rng.random(4000) < 0.05), None, rng.random(4000) < 0.3
    copy = good.copy()
    posterior, voters = X.label_model(np.stack([good, copy, noise, y ^ (rng.random(4000) < 0.02)], 1), 0.2)
    assert ((posterior > 0.5) == y).mean() > 0.97
    assert voters[0, 2] > 1 and abs(voters[2, 2]) < 0.3
    single, own = X.label_model(np.stack([good, noise, y ^ (rng.random(4000) < 0.02)], 1), 0.2)
    assert voters[0, 2] < own[0, 2]  # two that say the same count less each


def test_language_model(spark, messy, nothing):
    r = random.Random(13)
    langs = [["".join(r.choice(a) for _ in range(4)) for _ in range(60)] for a in ("abcd", "wxyz")]
    rows = [(k, " ".join(r.choice(langs[k % 2]) for _ in range(r.randint(20, 60)))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(messy.select("doc_id", "text").where("doc_id IS NULL OR doc_id < 0 OR doc_id > 5").selectExpr("doc_id + 1000 AS doc_id", "text"))
    got = L.score(docs).collect()
    every = [(x["doc_id"], x["text"] or "") for x in docs.collect()]
    counts = Counter()
    for i, t in every:
        if _crc(i) % 5 != 1:
            counts.update(t.encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in every:
        words = [*t.encode().lower().split(), b""]
        want.append((i, _crc(i) % 5 == 1, len(words), sum(w in counts for w in words), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    for a, b in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 600]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    assert L.score(nothing).count() == 0


def test_rare_words_are_scored_by_the_join(spark, monkeypatch):
    rows = [(k, f"the common words {'rare%d' % (k % 40)} here") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    full = {r["doc_id"]: r for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "HEAD", 3)
    monkeypatch.setattr(L, "SHORTLIST", 2)
    small = {r["doc_id"]: r for r in L.score(docs).collect()}
    for k in full:
        assert small[k]["base_score"] == pytest.approx(full[k]["base_score"]) and small[k]["n_known"] == full[k]["n_known"]


def test_probabilities_add_up_to_one():
    counts = np.asarray([50, 40, 30, 20, 10, 5, 3, 2, 1], float)
    net = L.Network(counts, hidden=4)
    h = np.random.default_rng(2).standard_normal((3, 4)).astype(np.float32)
    total = np.zeros(3)
    for k in range(len(counts)):
        total += np.exp(net.log_probs(h, np.full(3, k)))
    assert total == pytest.approx(np.ones(3), abs=1e-5)


def test_state_is_carried_through_long_documents():
    net = L.Network(np.arange(30, 0, -1).astype(float), hidden=6)
    r = np.random.default_rng(3)
    docs = [np.append(r.integers(1, 30, n), 0) for n in (0, 5, 700, 64, 65)]
    one = []
    for d in docs:
        h, total, last = np.zeros((1, 6), np.float32), 0.0, 0
        for t in d:
            h = net.step(np.asarray([last]), h)[0]
            total += net.log_probs(h, np.asarray([t]))[0]
            last = t
        one.append(total)
    assert net.score(docs) == pytest.approx(np.asarray(one), rel=1e-4)


def test_gradients():
    net = L.Network(np.asarray([9.0, 5, 4, 3, 2]), hidden=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    h, target = np.random.default_rng(4).standard_normal((6, 3)), np.asarray([0, 1, 2, 3, 4, 1])
    g = {k: np.zeros_like(x) for k, x in net.p.items()}
    loss, dh = net._output_gradients(h, target, g)
    assert loss == pytest.approx(-net.log_probs(h, target).sum())
    for name in ("wc", "ww"):
        at = np.unravel_index(3, net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = -net.log_probs(h, target).sum()
        net.p[name][at] = old - 1e-5
        down = -net.log_probs(h, target).sum()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)
    first = L.Network(np.asarray([5.0, 9, 9, 9]), hidden=8)
    squares = first.squares()
    losses = [first.train(np.asarray(([1, 2, 3] * 20 + [0]) * 60), squares, steps=8, streams=8) for _ in range(6)]
    assert losses[-1] < 0.5 * losses[0]  # a fixed order is learnt
