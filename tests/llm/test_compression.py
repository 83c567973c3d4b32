import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import compression as C
from quillgrid.llm.queries import QUERIES


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(21)
    stems = ["".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 5))) for _ in range(60)]
    word = lambda: "".join(r.choice(stems) for _ in range(r.randint(1, 2)))
    rows, labels = [], []
    for k in range(900):
        words, bad = [word() for _ in range(r.randint(20, 90))], r.random() < 0.2
        if bad:
            words = [w + r.choice(["###", "$$$", "&&"]) for w in words] if k % 2 else [w for w in words[:9] for _ in range(6)]
        rows.append((k, " ".join(words), "en", "s", 0))
        if r.random() < 0.8:
            labels.append((k, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return C.train(*labelled)


def test_held_out(spark, labelled, model):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in C.score(docs, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").collect()}
    assert len(got) == 900 and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k in truth if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] for k in held if truth[k]]) > 0.98
    assert np.mean([got[k]["predicted"] for k in held if not truth[k]]) < 0.1
    assert np.mean([(got[k]["score"] - truth[k]) ** 2 for k in held]) < 0.03  # calibrated: the Brier score of shares alone is 0.16
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_scores_are_those_of_whole_texts(spark, labelled, model):
    """Each score from sizes that zstandard gives for every block, one by one."""
    import zstandard

    docs = labelled[0].limit(30).unionByName(spark.createDataFrame([(5000, "long " * 4000 + "tail", None, None, 0), (5001, None, None, None, None)], labelled[0].schema))
    got = {r["doc_id"]: r for r in C.score(docs, model).collect()}
    for r in docs.collect():
        raw, sizes = (r["text"] or "").encode(), []
        for content in (model.bad, model.good, b""):
            more = {"dict_data": C._dictionary(content), "write_dict_id": False} if content else {}
            press = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, **more)
            sizes.append(sum(len(press.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024)))
        row = np.asarray([[*sizes, len(raw)]], float)
        assert got[r["doc_id"]]["score"] == pytest.approx(model.score(row)[0])
        assert got[r["doc_id"]]["size_difference"] == pytest.approx((sizes[0] - sizes[1]) / max(1, sizes[0] + sizes[1]))


def test_held_out_labels_and_other_columns_are_not_read(spark, labelled, model):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert C.train(docs.drop("lang", "source"), turned) == model


def test_copies_count_once(spark, labelled, model):
    docs, labels = labelled
    fresh = docs.join(labels, "doc_id", "left_semi").where("crc32(cast(doc_id as string)) % 5 <> 0")
    copies = fresh.limit(40).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    marks = labels.join(fresh.limit(40).select("doc_id"), "doc_id").selectExpr("doc_id + 100000 AS doc_id", "quality", "toxic")
    keep = "crc32(cast(doc_id as string)) % 5 <> 0"
    assert C.train(docs.unionByName(copies.where(keep)), labels.unionByName(marks.where(keep))) == model


def test_edges(spark, messy, nothing, labelled, model):
    docs, labels = labelled
    got = C.score(messy, model).collect()
    assert len(got) == messy.count() and C.score(nothing, model).count() == 0
    assert C.keep_good(messy, model).columns == messy.columns
    assert C.keep_good(docs, model).count() == C.score(docs, model).where("score >= 0.3").count()
    assert C.train(nothing, labels) == C.Model() and C.Model().score(np.zeros((2, 4))).tolist() == [0.5, 0.5]
    ones = C.train(docs, labels.where("quality = 1"))
    assert ones.calibration is None and ones.constant > 0.99
    empty = [r["score"] for r in got if r["doc_id"] in (0, 1)]
    assert len(set(empty)) == 1


def test_pieces_cover_the_whole_text():
    text = "".join(chr(97 + k // 1000 % 26) for k in range(26_000))
    cut = C.pieces_of(text)
    assert len(cut) == C.PIECE * C.PIECES and cut[:1] == b"a" and cut[-1:] == b"z"
    assert C.pieces_of("short") == b"short" and C.trained([b"a", b"bc"]) == [b"a", b"b"]


def test_query(spark, labelled, tmp_path):
    docs, labels = labelled
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op11_compression_quality"](spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 900
