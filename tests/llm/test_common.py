import threading

from quillgrid.llm import common


def test_setting_stands_again_behind_threads(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "9999")
    meet, seen = threading.Barrier(2), []

    def work(first):
        with common._small_batches(spark):
            meet.wait()
            if first:
                return  # leaves while the other is inside
            for _ in range(200):
                if common._WRITERS[id(spark)][0] == 1:
                    break
                threading.Event().wait(0.01)
            seen.append(spark.conf.get(key))

    threads = [threading.Thread(target=work, args=(k,)) for k in (True, False)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(10)
    assert seen == [str(common.SENT_ROWS)] and spark.conf.get(key) == "9999" and not common._WRITERS
    spark.conf.unset(key)


def test_names_that_no_column_has(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_Row int, _row_ int, x int")
    assert common.fresh(df, "_row", "_row", "y") == ["_row__", "_row___", "y"]


def test_few_rows_are_sent(spark, monkeypatch):
    shown = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in shown(common.sent_if_few(spark.range(5))).lower()
    monkeypatch.setattr(common, "SENT_ROWS_AT_MOST", 4)
    assert "broadcast" not in shown(common.sent_if_few(spark.range(5))).lower()
