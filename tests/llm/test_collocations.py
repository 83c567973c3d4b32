import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import collocations as K


def plain(rows, min_count, longest=5, top=2000, within=100):
    """The contract by counting every phrase in Python."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    kept = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= min_count}
    out = {}
    for (lang, words), a in kept.items():
        inside = any(
            own == lang and len(other) > len(words) and 100 * c >= within * a and any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1)) for (own, other), c in kept.items()
        )
        if inside:
            continue
        score, k, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


@pytest.fixture(scope="module")
def talk(spark):
    r = random.Random(4)
    common = ["the", "of", "Ünd", "és", "a", "to", "w" * 70, "w" * 69 + "x", "x\x01", "x", "y\x1cz"]
    fixed = ["new york city", "x y z x y z", "of the", "ha ha ha ha ha ha ha"]
    rows = []
    for k in range(160):
        parts = []
        for _ in range(r.randint(0, 25)):
            parts.append(r.choice(fixed) if r.random() < 0.3 else r.choice(common) if r.random() < 0.7 else f"rare{r.randrange(10**6)}")
            if r.random() < 0.15:
                parts.append(r.choice([",", ". ", "\n", "\r\n", "!?", "\t", "\x0b", ":"]))
        text = " ".join(parts)
        rows.append((r.choice(["en", "de", None, "und"]), text.upper() if k % 7 == 0 else text))
    rows += [("en", None), (None, ""), ("fr", "solo"), *[("en", "same old line here")] * 30]
    return rows, spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS f", "2 AS n", "3 AS id", "4 AS key", "5 AS word", "6 AS range", "7 AS score")


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"top": 5}, {"longest": 2}, {"longest": 3, "within": 60}, {"within": 50}])
def test_against_counting(spark, talk, options):
    rows, docs = talk
    got = listed(K.mine(docs, min_count=8, **options))
    assert got == plain(rows, 8, **options) and len(got) > 8


def test_numbers_in_several_passes_and_narrow_ranges(spark, talk, monkeypatch):
    rows, docs = talk
    want = plain(rows, 4)
    assert listed(K.mine(docs, min_count=4, sent_words=3, range_keys=40)) == want
    monkeypatch.setattr(K, "SORTED_KEYS", 7)  # only this process: cuts are tested below
    assert listed(K.mine(docs, min_count=4)) == want


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(K, "SORTED_KEYS", 10)
    r = np.random.default_rng(1)
    ids = [r.integers(0, 4, n) for n in (0, 3, 55, 9, 10, 11, 200)]
    whole = K.windows(np.concatenate([x for i in ids for x in (i, [0])]), 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([""] * len(ids))] * 2 + [pa.array([i.astype(np.int64).tobytes() for i in ids], pa.binary())], names=["lang", "text", "ids"])
    cut = [K.windows(x, 5, 10) for x in K._ids_of(iter([batch]), 5)]
    assert np.concatenate(cut).tolist() == whole.tolist()


@pytest.mark.parametrize("bits", [3, 16, 17, 40])
def test_radix_order(bits):
    keys = np.random.default_rng(bits).integers(0, min(2**bits, 50), (500, 3)) << max(0, bits - 6)
    assert keys[K.sorted_keys(keys, bits)].tolist() == sorted(keys.tolist())
    bounds = np.asarray(sorted(keys[:20].tolist()))
    ordered = sorted(keys.tolist())
    assert K._cuts(np.asarray(ordered), bounds).tolist() == [sum(k < b for k in ordered) for b in bounds.tolist()]


def test_products_beyond_64_bits(spark):
    df = spark.sql("SELECT 9000000000000 AS a, 70000000000000 AS n, 9000000000001 AS l, 9000000000007 AS r")
    got = df.select(K._score(df["a"], df["n"], df["l"], df["r"]).alias("s")).first()["s"]
    assert got == 1000 * 9000000000000 * 70000000000000 // (9000000000001 * 9000000000007)


def test_edges(spark, messy, nothing):
    assert K.mine(nothing).collect() == [] and K.mine(nothing).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert listed(K.mine(messy, min_count=2)) == plain([(r["lang"], r["text"]) for r in messy.select("lang", "text").collect()], 2)
    assert K.mine(messy, min_count=10**6).count() == 0
