"""Aggregates of any shape, logs of counts, and counters of running queries."""

import json
import time

from pyspark.sql import functions as F

from frames import rows
from quillgrid.operators import external as E
from quillgrid.operators import reports as R
from quillgrid.sources import readers, writers
from quillgrid.streaming import incremental as I
from quillgrid.streaming import progress as P


def test_aggregates_of_two_shapes(spark, tmp_path):
    folder = tmp_path / "aggregates"
    folder.mkdir()
    one = {"total": 3, "exact_match": 0.5, "mape": None, "model": "m", "by_question_type": {"Text Only": {"total": 1, "exact_match": 1.0}, "Table Only": {"total": 2, "exact_match": 0.25, "note": "x"}}, "token_f1_ci": {"lower": 0.1}}
    two = {"n": 7, "token_f1": 0.75, "by_question_type": {"Text Only": {"n": 7, "token_f1": 0.75}}, "by_company": {"Acme": {"n": 7, "token_f1": 0.75}}, "errors": [1, 2], "by_empty": {}}
    (folder / "own-model_hard_zero_shot.json").write_text(json.dumps(one))
    (folder / "broken.json").write_text("{")
    (folder / "notes.txt").write_text("no aggregate")
    writers.text(json.dumps(two, indent=2), str(folder / "stub_easy_closed_book.json"), spark)  # as this library writes it: a folder
    assert rows(readers.bad_aggregates(spark, str(folder))) == [("broken.json",)]
    found = R.long_aggregates(readers.aggregates(spark, str(folder)))
    got = {(x["model"], x["tier"], x["regime"], x["axis"], x["key"], x["metric"]): x["value"] for x in found.collect()}
    a, b = ("own-model", "hard", "zero_shot"), ("stub", "easy", "closed_book")
    assert got == {
        (*a, "all", None, "n"): 3.0, (*a, "all", None, "exact_match"): 0.5,
        (*a, "question_type", "Text Only", "n"): 1.0, (*a, "question_type", "Text Only", "exact_match"): 1.0,
        (*a, "question_type", "Table Only", "n"): 2.0, (*a, "question_type", "Table Only", "exact_match"): 0.25,
        (*b, "all", None, "n"): 7.0, (*b, "all", None, "token_f1"): 0.75,
        (*b, "question_type", "Text Only", "n"): 7.0, (*b, "question_type", "Text Only", "token_f1"): 0.75,
        (*b, "company", "Acme", "n"): 7.0, (*b, "company", "Acme", "token_f1"): 0.75,
    }
    table = [tuple(x) for x in R.breakdown(found, "question_type", ["exact_match", "token_f1"]).collect()]
    assert table == [(*a, "Table Only", 2.0, 0.25, None), (*a, "Text Only", 1.0, 1.0, None), (*b, "Text Only", 7.0, None, 0.75)]


def test_logs_by_company_and_for_all(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "easy", "Text Only"), ("A", "easy", "Text Only"), ("A", "hard", None), ("B", "easy", "Table Only")], "company string, tier string, kind string")
    dead = spark.createDataFrame([("A", "no JSON"), ("B", "no JSON"), ("B", "no answer")], "company string, reason string")
    logs = R.count_log(pairs, dead, "company", "tier", "kind")
    got = {x["scope"]: x["log"].split("\n") for x in logs.collect()}
    assert got["A"] == ["questions in all: 3", "  easy: 2", "    Text Only: 2", "  hard: 1", "removed in all: 1", "  no JSON: 1"]
    assert got[None] == ["questions in all: 4", "  easy: 3", "    Table Only: 1", "    Text Only: 2", "  hard: 1", "removed in all: 3", "  no JSON: 2", "  no answer: 1"]
    writers.count_logs(logs, str(tmp_path / "logs"))
    assert [x["value"] for x in spark.read.text(str(tmp_path / "logs" / "scope=B")).collect()] == got["B"]
    assert spark.read.text(str(tmp_path / "logs" / "scope=_all")).count() == 8


def test_retried_pages_are_counted(spark):
    pages = spark.createDataFrame([("d", 1, b"good"), ("d", 2, b"bad"), ("e", 1, b"good"), ("f", 1, b"bad")], "doc string, page int, content binary")
    first, second = (lambda: lambda data: "text" if data == b"good" else ""), (lambda: lambda data: "second text")
    read = E.read_twice(pages, ["doc", "page"], "doc", "content", first, second)
    states = E.document_status(read, "doc")
    assert rows(states.select("doc", "pages", "failed", "retried", "status")) == [("d", 2, 0, 1, "ok"), ("e", 1, 0, 0, "ok"), ("f", 1, 1, 0, "failed")]
    assert json.loads(E.progress(states))["all"] == {"documents": 3, "pages": 4, "failed": 1, "retried": 1}
    seen, told = P.observed(read, P.page_counts(read))
    assert seen.count() == 4 and told.get == {"pages": 4, "failed": 1, "retried": 1}


def test_counters_of_a_running_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "if(id % 5 = 0, 'failed', 'ok') AS status").coalesce(1).write.mode("append").parquet(source)
    counters = P.Counters("pages")
    spark.streams.addListener(counters)
    try:
        stream = I.file_stream(spark, source, "id bigint, status string", files=1)
        watched = counters.watch(stream, P.page_counts(stream))
        I.resumable(watched, lambda d: d.select("id"), ["id"], str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
        for _ in range(100):
            if counters.totals().get("pages") == 40:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals() == {"pages": 40, "failed": 8}  # a recount of the source gives the same
    assert [h["pages"] for h in counters.history] == [10, 20, 30, 40]


def test_labels_and_prompts(spark):
    df = spark.createDataFrame([("Public_Sector_Bank",), ("Steel_Pipes",)], "s string")
    assert [x[0] for x in df.select(E.sector_label(F.col("s"))).collect()] == ["Public Sector Banking", "Steel Pipes"]
    made = {t: df.limit(1).select(E.question_prompt(F.lit("body"), t, F.lit(3), sector=F.col("s"), year=F.lit(None).cast("string"))).first()[0] for t in E.TIERS}
    for tier, prompt in made.items():
        assert "at most 3 " in prompt and prompt.endswith("Sector: Public_Sector_Bank\nYear: \n<text>\nbody\n</text>")
        assert ("verification_anchors" in prompt) == (tier in E.ANCHORED) and all(e in prompt for e in E.TIERS[tier][1])
