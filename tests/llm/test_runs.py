import hashlib
import random
import re
import zlib

import pytest

from quillgrid.llm import runs as R
from quillgrid.llm.queries import QUERIES


def plain_runs(words, min_length=6, min_exponent=4):
    """Every period in turn: maximal stretches of equal words at that distance whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            own = words[a : i + q]
            smaller = any(all(own[k] == own[k + r] for k in range(len(own) - r)) for r in range(1, q))
            if len(own) >= max(min_length, min_exponent * q) and not smaller:
                out.append((a, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_runs_of_small_words(bounds):
    r = random.Random(sum(bounds))
    for _ in range(600):
        n, kinds = r.randint(0, 50), r.randint(1, 4)
        words = [r.randint(0, kinds) for _ in range(n)]
        if n > 5 and r.random() < 0.6:
            a, p = r.randrange(n), r.randint(1, 9)
            words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
        assert R.runs_of(words, *bounds) == plain_runs(words, *bounds), words


def test_runs_meet_and_nest():
    words = "x a a a a a a a b a a a a a a a b a a a a a a a b a a a a a a a b a a y".split()
    assert R.runs_of(words) == plain_runs(words)
    assert {q for _, _, q in R.runs_of(words)} == {1, 8}


def test_long_periods_and_large_sets():
    r = random.Random(3)
    base = [r.randrange(10**6) for _ in range(3000)]
    words = base[:500] + [base[500 + i % 700] for i in range(3100)]
    assert R.runs_of(words) == [(500, 3100, 700)]
    assert R.runs_of([7] * 5000) == [(0, 5000, 1)]
    assert R.runs_of([1, 2] * 3000) == [(0, 6000, 2)]


def test_ends_in_blocks():
    r, held = random.Random(9), R.Ends(500_000)
    have = {500_000}
    for _ in range(6000):
        x = r.randrange(10**6)
        if x not in have:
            have.add(x)
            held.add(x)
    order = sorted(have)
    assert list(held) == order and len(held.blocks) > 3
    for k in [0, 1, 1023, 1024, 2048, len(order) - 1]:
        assert held.neighbours(order[k]) == (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None)


def test_parts_lose_no_run():
    r = random.Random(11)
    for _ in range(300):
        words = [r.randint(0, 2) for _ in range(80)]
        codes = R.np.asarray(words)
        parts = R.repeating_parts(codes)
        assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in plain_runs(words))


def test_query_rows(spark, messy, nothing, tmp_path):
    line = "the cat sat on a mat "
    more = [(100 + k, t) for k, t in enumerate([line * 9, "go " * 40 + "x " + "go\tgo\x0bno " * 30, "a b " * 3, "w\x1cw " * 8, None, " ".join(f"v{i % 90}" for i in range(600))])]
    more += [(200 + k, " ".join(f"t{i}" for i in range(k, k + 120))) for k in range(40)]  # some of them have planted ids
    extra = spark.createDataFrame(more, "doc_id bigint, text string").selectExpr("doc_id", "text", *[f"cast(null as {t}) AS {c}" for c, t in messy.dtypes[2:]])
    docs = messy.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert got == want and sum(r[1] > 0 for r in want) > 8
    assert R.digests(R.find(nothing)).count() == 0
    assert [t for _, t in R.digests(R.find(nothing)).dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_general_interface(spark):
    docs = spark.createDataFrame([("k", "b b b c d c d c d e")], "key string, body string")
    got = R.find(docs, "key", "body", min_length=3, min_exponent=3).collect()
    assert [(r["start"], r["length"], r["period"]) for r in got[0]["runs"]] == [(0, 3, 1), (3, 6, 2)]
    assert got[0]["n_words"] == 10 and got[0]["collapsed"] == "b c d e"
    with pytest.raises(ValueError):
        R.find(docs, "key", "body", min_exponent=1)
