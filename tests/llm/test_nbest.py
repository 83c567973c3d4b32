import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import nbest
from quillgrid.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def _every(lat, text):
    """All paths of a short text, best first."""
    if not text:
        return [(0.0, ())]
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
            return
        for j in range(at + 1, min(len(text), at + 16) + 1):
            found = lat.pieces.get(text[at:j])
            if found:
                go(j, score + found[1], ids + found[0])
        if text[at] not in lat.pieces:
            go(at + 1, score + lat.unknown, ids + tuple(lat.bytes[b] for b in text[at].encode()))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_paths_against_all_paths():
    lat, r = nbest.lattice(PATH), random.Random(20)
    for _ in range(150):
        text = "".join(r.choice("▁theinao☃é1,") for _ in range(r.randint(1, 9)))
        want = _every(lat, text)
        got = lat.paths(text, 6)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]])
        assert all((pytest.approx(s), i) in [(pytest.approx(a), b) for a, b in want] for s, i in got) and len({i for _, i in got}) == len(got)


def test_texts_against_all_paths():
    lat, r = nbest.lattice(PATH), random.Random(21)
    for _ in range(60):
        text = "".join(r.choice(["th", "e", " ", "in", "☃", "é", ",", "\n"]) for _ in range(r.randint(0, 6)))
        want = _every(lat, lat.model.normalize(text) if text else "")
        got = nbest.encode(text, PATH, 4)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:4]])
        assert all(nbest.decode(ids, PATH) == text for _, ids in got)


def test_cuts_part_no_piece():
    lat, r = nbest.lattice(PATH), random.Random(22)
    values = ["".join(r.choice("▁abcé☃1.,\n日") for _ in range(r.randint(0, 40))) for _ in range(50)]
    stretches, counts = lat.cut(values)
    parts, at = stretches.to_pylist(), 0
    for v, n in zip(values, counts):
        assert "".join(parts[at : at + n]) == v
        at += n
    assert at == len(parts)


def test_combine():
    r = random.Random(23)
    for _ in range(100):
        lists = [sorted(r.choice([1.0, 2.0, 2.5, 7.0]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 5))]
        sums = [0.0]
        for costs in lists:
            sums = [s + c for s in sums for c in (0.0, *costs)]
        got = nbest.combine([(c[0], k, c) for k, c in enumerate(lists)], 4)
        assert [s for s, _ in got] == pytest.approx(sorted(sums)[:4])


def test_long_stretches_take_time_in_proportion():
    lat, text = nbest.lattice(PATH), "thein" * 40_000
    began = time.process_time()
    got = lat.paths(text, 4)
    assert time.process_time() - began < 15 and len(got) == 4
    assert all(lat.decode(np.asarray(ids)).decode() == text for _, ids in got)


def test_query(spark, messy, nothing):
    got = sorted(map(tuple, nbest.segment(messy, PATH).collect()), key=repr)
    want = []
    for row in messy.collect():
        ways = [(s, len(i), zlib.crc32(np.asarray(i, "<u4").tobytes()), i) for s, i in nbest.encode(row["text"] or "", PATH)]
        want.append((row["doc_id"], ways, True))
    for a, b in zip(sorted(got, key=lambda r: (repr(r[0]), r[1][0]["ids_crc32"])), sorted(want, key=lambda r: (repr(r[0]), r[1][0][2]))):
        assert (a[0], a[2]) == (b[0], b[2]) and [tuple(w)[1:] for w in a[1]] == [w[1:] for w in b[1]]
        assert [w["score"] for w in a[1]] == pytest.approx([w[0] for w in b[1]])
    short = nbest.segment(messy, PATH, keep_ids=False).collect()
    assert sorted((repr(r["doc_id"]), [tuple(w)[1:] for w in r["nbest"]]) for r in short) == sorted((repr(r[0]), [tuple(w)[1:3] for w in r[1]]) for r in got)
    assert nbest.segment(nothing, PATH).count() == 0


def test_decoded(spark, messy, nothing):
    ways = nbest.segment(messy, PATH).select("doc_id", F.posexplode("nbest").alias("k", "w")).select("doc_id", "k", "w.ids")
    got = sorted(map(repr, map(tuple, nbest.decoded(ways, PATH).collect())))
    model = nbest.lattice(PATH).model
    normal = lambda t: model.normalize(t).replace("▁", " ").removeprefix(" ") if t else ""
    want = [repr((r["doc_id"], normal(r["text"]))) for r in messy.collect() for _ in nbest.encode(r["text"] or "", PATH)]
    assert got == sorted(want)
    assert nbest.decoded(ways.where("false"), PATH).count() == 0
