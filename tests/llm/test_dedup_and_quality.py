import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillgrid.llm import components, quality, simhash
from quillgrid.llm.components import connected_components


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = _components({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_pair_within_the_radius_meets(radius):
    masks, r = simhash.covering_masks(radius), random.Random(5)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        x = r.getrandbits(64)
        y = x
        for k in r.sample(range(64), r.randint(0, radius)):
            y ^= 1 << k
        assert any(x & m == y & m for m in masks)


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if parts else 0


@pytest.mark.parametrize("bucket", [1024, 2])
def test_near_duplicates(spark, messy, nothing, bucket):
    docs = messy.where("doc_id IS NOT NULL").unionByName(messy.where("doc_id = 8").selectExpr("100 AS doc_id", *[c for c in messy.columns if c != "doc_id"]))
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, bucket=bucket).collect())
    rows = [(r["doc_id"], _fingerprint(r["text"])) for r in docs.collect()]
    assert [(i, f) for i, f, _ in got] == sorted(rows)
    fps = sorted({f for _, f in rows})
    groups = _components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in rows:
        least[groups[f]] = min(i, least.get(groups[f], i))
    assert all(c == least[groups[f]] for _, f, c in got)
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_of_close_fingerprints(spark):
    r = random.Random(6)
    fps = []
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(6):
            y = x
            for k in r.sample(range(64), r.randint(0, 3)):
                y ^= 1 << k
            fps.append(y)
    fps = sorted(set(fps))
    want = _components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    nodes = spark.createDataFrame([(simhash.signed(f), 0, simhash.signed(f)) for f in fps], "node bigint, seed int, fp bigint")
    for bucket in (1024, 3):
        edges = [(e["a"] % 2**64, e["b"] % 2**64) for e in simhash.links(nodes, 4, bucket).collect()]
        assert all((a ^ b).bit_count() <= 4 or bucket == 3 for a, b in edges)
        assert _components(fps, edges) == want


def test_links_leave_no_python_stage_to_the_next(spark):
    nodes = spark.createDataFrame([(k, 0, k >> 1) for k in range(8)], "node bigint, seed int, fp bigint")
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # two in one task would take two Python workers


def _plans(monkeypatch):
    """The plans, before any shuffle has run, of what ``simhash`` keeps from now on."""
    seen, kept = [], simhash.cut

    def cut(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(simhash, "cut", cut)
    return seen


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as few as they were before."""
    seen = _plans(monkeypatch)
    simhash.links(spark.range(40).selectExpr("id AS node", "0 AS seed", "id AS fp"))
    assert "SortMergeJoin" in seen[0] and "BroadcastExchange" not in seen[0]


def test_points_and_bands_are_never_broadcast(spark):
    """Nor are the 2,081 points of each fingerprint in a large bucket, or the keys of bands."""
    far = simhash.links(spark.range(40).selectExpr("id AS node", "0 AS seed", "id AS fp"), bucket=2)
    bands = simhash.band_links(spark.range(40).selectExpr("id AS node", "array(id % 3, id % 5) AS bands"))
    for df in (far, bands):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def _similarity(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("family", "shingles"), [(5_000, 2_000_000), (3, 2_000_000), (5_000, 700)])
def test_one_of_each_group_stays(spark, monkeypatch, family, shingles):
    monkeypatch.setattr(simhash, "FAMILY", family)
    monkeypatch.setattr(simhash, "FAMILY_SHINGLES", shingles)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    docs = []
    for _ in range(12):
        words = [r.choice(vocabulary) for _ in range(300)]
        docs.append(" ".join(words))
        for _ in range(r.randint(0, 8)):
            copy = list(words)
            for k in r.sample(range(300), r.randint(0, 4)):
                copy[k] = r.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [docs[0], None, ""]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id bigint, text string, root string")
    kept = {x["doc_id"] for x in simhash.keep_first(df).collect()}
    sets = [frozenset(simhash.shingle_hashes(t or "").tolist()) for t in docs]
    for k, s in enumerate(sets):
        best = max((_similarity(s, sets[j]) for j in kept if j < k), default=0)
        assert (k in kept) == (best < 0.8 if s else min(j for j, x in enumerate(docs) if not x) == k), (k, best)


def _block_edits(r, vocabulary, words, similarity):
    """The words with a block appended, put in the middle or cut off, so that the shingles' similarity is about as given, not less."""
    word, n = lambda k: [r.choice(vocabulary) for _ in range(k)], len(words)
    more = int(n * (1 / similarity - 1)) - 12
    yield words + word(more)
    at = r.randrange(n // 4, n // 2)
    yield words[:at] + word(more) + words[at:]
    yield words[: n - int(n * (1 - similarity)) + 2]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_block_edits_are_found(spark, similarity):
    r = random.Random(int(100 * similarity))
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    docs = []
    for _ in range(60):
        words = [vocabulary[min(2999, int(r.paretovariate(0.6)))] for _ in range(300)]
        docs += [" ".join(x) for x in (words, *_block_edits(r, vocabulary, words, similarity))]
    sets = [frozenset(simhash.shingle_hashes(t).tolist()) for t in docs]
    kept = {x["doc_id"] for x in simhash.keep_first(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()}
    want = set()
    for k, s in enumerate(sets):
        if all(_similarity(s, sets[j]) < 0.8 for j in want):
            want.add(k)
    assert len(want) < 80 and kept == want


def _kept_by_plain_rule(rows):
    """(id, text) of the rows that stay: of each text the row with the least id, nulls last, unless a similar text before it stays."""
    least = {}
    for key, text in rows:
        order = (key is None, key if key is not None else 0)
        text = text or ""
        least[text] = min(least.get(text, order), order)
    stay = []
    for text, order in sorted(least.items(), key=lambda x: (x[1], hashlib.md5(x[0].encode()).hexdigest())):
        own = frozenset(simhash.shingle_hashes(text).tolist())
        if all(_similarity(own, other) < 0.8 for _, _, other in stay):
            stay.append((order, text, own))
    return sorted(((None if none else key), text) for (none, key), text, _ in stay if not none), [text for (none, _), text, _ in stay if none]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rows_of_repeated_null_and_text_ids(spark, kind):
    r = random.Random(31)
    line = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    a, b, c, d, e = (line(60) for _ in range(5))
    key = (lambda k: k) if kind == "bigint" else (lambda k: None if k is None else f"id-{k:03d}")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, d), (None, d), (2, d + " tail"), (9, e), (8, e + " end"), (8, a + " more"), (1, None), (4, ""), (None, " "), (6, line(40)), (6, line(40)), (6, line(40))]
    rows = [(key(k), t) for k, t in rows]
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], f"doc_id {kind}, text string, n int")
    named = df.selectExpr("doc_id", "text", *[f"n AS {c}" for c in ("_mark", "_own", "_first", "_times", "_lost", "_host", "mark", "id", "node", "root")])
    got = simhash.keep_first(named.repartition(4))
    assert got.columns == named.columns
    found = [(x["doc_id"], x["text"] or "") for x in got.collect()]
    with_id, without = _kept_by_plain_rule(rows)
    assert sorted(x for x in found if x[0] is not None) == with_id
    assert sorted(t for k, t in found if k is None) == sorted(without)
    for text in {t for _, t in rows if t}:  # no text is lost that has no like, and one row of each copy is left
        assert sum(t == text for _, t in found) <= 1
    assert {(key(5), b), (key(7), c)} <= set(found) and sum(k == key(6) for k, _ in found) == 3


def test_families_in_rounds(spark, monkeypatch):
    """A chain of unlike neighbours beside small families: rounds go on with large families only."""
    monkeypatch.setattr(simhash, "FAMILY", 12)
    monkeypatch.setattr(simhash, "LEADERS", 4)
    r = random.Random(33)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    chain = words(160)
    docs = []
    for _ in range(40):  # each shares most, but not four fifths, with the next
        docs.append(" ".join(chain))
        chain = chain[18:] + words(18)
    for _ in range(6):
        own = words(60)
        docs += [" ".join(own), " ".join([*own, "tail"])]
    sets = [frozenset(simhash.shingle_hashes(t).tolist()) for t in docs]
    want = set()
    for k, s in enumerate(sets):
        if all(_similarity(s, sets[j]) < 0.8 for j in want):
            want.add(k)
    got = {x["doc_id"] for x in simhash.keep_first(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()}
    assert got == want and len(want) == 46


@pytest.mark.parametrize("sent", [200_000, -1])
def test_quality_with_clashing_names(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT_LINES", sent)
    r = random.Random(35)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(70))
    df = spark.createDataFrame([(k, text(), "h", 1) for k in range(20)], "doc_id bigint, text string, source string, n_chars int")
    df = df.selectExpr("*", *[f"doc_id AS {c}" for c in ("_host", "_row", "_gone", "_kept", "_Lost", "host", "row", "gone", "kept")])
    got = quality.keep_good(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_components_that_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    monkeypatch.setattr(components, "TASK_EDGES", 1)
    path = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint").repartition(16)
    with pytest.raises(RuntimeError):
        components.connected_components(path)


def test_repeated_words():
    def brute(words):
        found = Counter(zip(words, words[1:], words[2:]))
        return len({k + j for k in range(len(words) - 2) if found[tuple(words[k : k + 3])] > 1 for j in range(3)})

    r = random.Random(8)
    for _ in range(300):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(20))]
        assert quality.repeated_words(words) == brute(words)


def test_quality_counts(spark, messy, nothing):
    got = sorted((tuple(r)[:1] + tuple(r)[2:8] for r in quality.judge(messy).collect()), key=repr)
    want = []
    for r in messy.collect():
        text = r["text"] or ""
        words = text.encode().split()
        chars = sum(c not in " \t\n\x0b\x0c\r" for c in text)
        lines = [x for x in text.split("\n") if x.encode().split()]
        repeats = quality.repeated_words(words)
        want.append((r["doc_id"], len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words)))
    assert got == sorted(want, key=repr)
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


@pytest.mark.parametrize("sent", [200_000, -1])
def test_template_lines(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT_LINES", sent)
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    banner = words(60)
    docs = [(k, f"{banner}\n{words(20)}", "h") for k in range(40)]  # mostly a line that the whole host has
    docs += [(100 + k, "\n".join(words(15) for _ in range(5)), "h") for k in range(60)]  # clean
    copied = "\n".join(words(15) for _ in range(5))
    docs += [(200 + k, copied, "h") for k in range(50)]  # copies of one clean document
    docs += [(300 + k, f"{banner}\n{words(20)}", "other") for k in range(3)]  # the same line is rare on another host
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    kept = {x["doc_id"] for x in quality.judge(df).where("kept").collect()}
    assert kept == {k for k, *_ in docs if k >= 100}
    assert {x["doc_id"] for x in quality.keep_good(df).collect()} == kept
    removed = {x["doc_id"]: x["n_removed_words"] for x in quality.judge(df).collect()}
    assert removed[0] == 60 and removed[150] == 0


@pytest.mark.parametrize("shared", [1, 2, 12])
@pytest.mark.parametrize("own", [1, 4])
def test_verdicts_by_brute_force(spark, shared, own):
    r = random.Random(100 * shared + own)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    template = [words(12) for _ in range(shared)]
    docs = [(k, "\n".join([*template, *(words(r.randint(5, 30)) for _ in range(own))]), "a") for k in range(60)]
    docs += [(100 + k, "\n".join(words(20) for _ in range(4)), r.choice("ab")) for k in range(60)] + [(200 + k, docs[0][1], "a") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    holders = {}
    for _, text, host in docs:
        for line in {None, *text.split("\n")}:
            holders.setdefault((host, line), set()).add(text)
    common = {k for k, x in holders.items() if k[1] and len(x) >= 20 and len(x) > 0.02 * len(holders[k[0], None])}
    for x in quality.judge(df).collect():
        _, text, host = next(d for d in docs if d[0] == x["doc_id"])
        lines, n = text.split("\n"), len(text.split())
        gone = sum(len(y.split()) for y in lines if (host, y) in common)
        assert x["n_removed_words"] == gone and x["kept"] == (n >= 50 and n - gone >= n / 2)


def test_templates_of_many_lines(spark):
    r = random.Random(19)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    docs, depleted = [], {}
    for host, n, shared, own in (("a", 200, 30, 2), ("b", 40, 2, 1), ("c", 100, 10, 3)):
        template = [words(20) for _ in range(shared)]
        for _ in range(n):
            lines = template + [words(15) for _ in range(own)]
            r.shuffle(lines)
            depleted[len(docs)] = 20 * shared
            docs.append((len(docs), "\n".join(lines), host))
    clean = "\n".join(words(15) for _ in range(5))
    docs += [(1000 + k, clean, "a") for k in range(60)]  # copies are one document
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = {x["doc_id"]: x for x in quality.judge(df).collect()}
    assert {k: x["n_removed_words"] for k, x in got.items() if x["n_removed_words"]} == depleted
    assert {k for k, x in got.items() if x["kept"]} == {k for k, *_ in docs if k >= 1000}


def test_common_lines_of_a_hot_host(spark):
    r = random.Random(20)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    banner = words(60)
    docs = [(k, f"{banner}\n{words(20)}" if k < 30 else words(70), "hot") for k in range(3000)]  # the banner is on 1 % of the host
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert quality.judge(df).where("kept").count() == 3000
    assert {x["doc_id"] for x in quality.judge(df, max_docs=25).where("NOT kept").collect()} == set(range(30))


@pytest.mark.parametrize("sent", [200_000, -1])
def test_common_lines_go_from_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT_LINES", sent)
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    banner, own = words(10), [[words(40), "", words(40)] for _ in range(40)]
    docs = [(k, "\n".join([f"{banner} {10 + k}", *x, f"  {banner.upper()} {10 + k} "]), "h", 7) for k, x in enumerate(own)]
    docs += [(100, "\n".join([banner + " 1", words(60)]), "other", 7)]
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string, source string, n_chars int")
    got = [tuple(x) for x in quality.keep_good(df).collect()]
    want = [(k, "\n".join(x), "h", len("\n".join(x))) for k, x in enumerate(own)]
    assert sorted(got) == sorted(want + want[:1] + docs[-1:])
    removed = {x["doc_id"]: x["n_removed_words"] for x in quality.judge(df).collect()}
    assert all(removed[k] == len(t.split()) - len(x.split()) for (k, t, *_), (_, x, *_) in zip(docs, want))
