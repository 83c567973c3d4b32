import random
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillgrid.llm import packing, token_counts
from quillgrid.llm.queries import tokenizer_file

BYTES, WORDS, PIECES = (tokenizer_file(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def test_spliced_counts_equal_whole_counts():
    tokenizer, r = token_counts.library(BYTES), random.Random(1)
    texts = ["".join(r.choice(["a", "b", " ", "  ", "\n", "é", "<|endoftext|>", " 12", "!!", "日"]) for _ in range(2000)) for _ in range(20)]
    texts += ["".join(r.choice(["a", "'s", "'", "9", "'re", "。", "日", "!", "|>", "<|endoftext|>", "<|", "endoftext", "\x85", "é9"]) for _ in range(2000)) for _ in range(20)]
    texts += ["x" * 3000, "x" * 900 + " y" * 20 + "z" * 2000, " " * 2000, "a " + " " * 900 + "b" * 20, "日本語" * 500]
    for t in texts:
        whole = len(tokenizer.encode(t, add_special_tokens=False))
        for chunk, overlap in ((300, 8), (97, 3), (1000, 256)):
            if len(t) > chunk:
                assert token_counts.spliced_count(tokenizer, t, chunk, overlap) == whole


@pytest.mark.parametrize("unit", ["日本語文字", "word and more ", "日本語，文字。", "aé9"])
def test_long_texts_take_time_in_proportion(unit):
    tokenizer, text = token_counts.library(BYTES), unit * (4_000_000 // len(unit))
    began = time.process_time()
    got = token_counts.spliced_count(tokenizer, text)
    took = time.process_time() - began
    began = time.process_time()
    assert got == len(tokenizer.encode(text, add_special_tokens=False))
    assert took < 3 * (time.process_time() - began) + 2


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_counts(spark, messy, nothing, path):
    tokenizer = token_counts.library(path)
    count = (lambda t: len(tokenizer.encode(t))) if path.endswith(".model") else (lambda t: len(tokenizer.encode(t, add_special_tokens=False)))
    got = token_counts.count_tokens(messy, path, chunk=400, overlap=16).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in messy.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_word_ids_equal_the_librarys():
    encoder, r = packing.WordEncoder(WORDS), random.Random(2)
    pool = ["a", "B", " ", "  ", "\n", "é", "É", "İ", "Σ", "ß", "\xa0", "\x85", "\x1c", "'s", "'S", "12", "<|endoftext|>", "don't", "!!", "_", "²", "ª", "ﬁ", "日", "ſ", "ŉ"]
    plain = [c for c in map(chr, range(0x20, 0x2100)) if packing._PLAIN.fullmatch(c)] + [" "] * 60 + list("etaoin") * 10
    texts = ["".join(r.choice(pool) for _ in range(40)) for _ in range(500)] + ["".join(r.choice(plain) for _ in range(60)) for _ in range(3000)] + [""]
    ids, counts = encoder.encode(texts)
    for t, own, e in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), token_counts.library(WORDS).encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == e.ids, t


def test_schedule_fills_windows_and_keeps_proportions():
    r = random.Random(3)
    for t in range(150):
        totals = [r.choice([1, 2, 50, 777, 30_000]) for _ in range(r.randint(1, 8))]
        weights = None if t % 2 else [r.choice([0, 1, 2, 0.5]) for _ in totals]
        window = r.choice([16, 128, 2048])
        s = packing.Schedule(totals, weights, window)
        n = -(-sum(totals) // window)
        served = s.served(np.arange(n + 1))
        assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == totals).all()
        assert (served.sum(1) == np.minimum(np.arange(n + 1) * window, sum(totals))).all()
        if weights is None:
            share = np.arange(n + 1)[:-1, None] * window * np.asarray(totals) / sum(totals)
            assert (np.abs(served[:-1] - share) <= len(totals)).all()


def _plain_windows(schedule, queue, first, stop):
    """Of all windows, those that hold tokens first to stop of a queue."""
    n = -(-sum(schedule.totals) // schedule.window)
    served = schedule.served(np.arange(n + 1))[:, queue]
    return [w for w in range(n) if max(served[w], first) < min(served[w + 1], stop)]


def test_windows_of_spans():
    r = random.Random(13)
    for t in range(200):
        totals = [r.choice([1, 3, 40, 900, 20_000]) for _ in range(r.randint(1, 7))]
        weights = None if t % 2 else [r.choice([0, 1, 2, 0.25]) for _ in totals]
        s = packing.Schedule(totals, weights, r.choice([8, 64, 512]))
        for queue, n in enumerate(totals):
            first = r.randrange(n)
            spans = [(first, r.randint(first + 1, n)), (0, 1)]
            for a, b in spans:
                windows, lows, highs, offsets = packing._edges(s, {}, (queue, None), [(a, b)])
                inside = [(w, x, y) for w, x, y in zip(windows.tolist(), lows.tolist(), highs.tolist()) if x < b and y > a]
                assert [w for w, *_ in inside] == _plain_windows(s, queue, a, b)
                assert all(y == x for (_, _, y), (_, x, _) in zip(inside, inside[1:])) and inside[0][1] <= a and inside[-1][2] >= b
            assert set(packing._edges(s, {}, (queue, None), spans)[0].tolist()) >= {w for a, b in spans for w in _plain_windows(s, queue, a, b)}


def test_a_rare_source_of_a_large_corpus():
    """Work and memory follow the tokens that are placed, not the windows between them."""
    s = packing.Schedule([10**10] * 20 + [500])
    tracemalloc.start()
    began = time.process_time()
    windows, lows, highs, offsets = packing._edges(s, {}, (20, None), [(0, 500)])
    assert time.process_time() - began < 2 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert len(windows) == 500 and lows.tolist() == list(range(500)) and highs.tolist() == list(range(1, 501)) and (offsets < 2048).all()
    assert np.allclose(windows * 2048 / s.total, (np.arange(500) + 0.5) / 500, atol=1e-6)


@pytest.mark.parametrize("queues", [1024, 1])
@pytest.mark.parametrize("targets", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing(spark, monkeypatch, messy, nothing, targets, queues):
    monkeypatch.setattr(packing, "MAX_QUEUES", queues)
    tokenizer = token_counts.library(WORDS)
    got = packing.pack(messy, WORDS, window=128, targets=targets).collect()
    whole = defaultdict(list)
    for r in messy.collect():
        whole[r["doc_id"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(pieces) == set(whole)
    for doc, texts in whole.items():
        assert sum(p["length"] for p in pieces[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p["start"]):
                part = texts[0][p["start"] : p["start"] + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(texts[0]) and p["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
                at += p["length"]
    sizes = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(windows) == list(range(len(windows))) and sum(s < 128 for s in sizes) <= 1 and max(sizes) == 128
    assert packing.pack(nothing, WORDS).count() == 0


@pytest.mark.parametrize("queues", [1024, 2])
def test_every_window_keeps_the_sources_shares(spark, monkeypatch, queues):
    monkeypatch.setattr(packing, "MAX_QUEUES", queues)
    monkeypatch.setattr(packing, "POOL", 4)
    r = random.Random(40)
    rows = [(k, " ".join(r.choice(["one", "two", "three"]) for _ in range(r.randint(0, 60))), r.choice([None, *"aaabbcdefgh"])) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    source = {k: s for k, _, s in rows}
    sizes, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in packing.pack(df, WORDS, window=512).collect():
        sizes[source[p["doc_id"]]] += p["length"]
        windows[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
    total = sum(sizes.values())
    for k, found in windows.items():
        if k < len(windows) - 1:
            assert sum(found.values()) == 512
            assert all(abs(found[s] - 512 * n / total) <= 4 for s, n in sizes.items())
