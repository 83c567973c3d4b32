import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(14)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(3000)]
    text = lambda n: ". ".join(" ".join(r.choice(vocabulary) for _ in range(8)) for _ in range(n // 8)).replace(". ", ".\n")
    docs, bad = [], set()
    for k in range(300):
        t = text(160)
        if k % 9 == 0:
            t = t.replace("\n", " idiot scum moron\n", 3)
            bad.add(k)
        docs.append((k, t))
    copies = {400 + k: docs[k][1] for k in (1, 2, 4)} | {410 + k: docs[k][1] + " end" for k in (1, 5)}
    short = {500: "too short", 501: "a b c " * 60, 502: None, 503: ""}
    every = docs + list(copies.items()) + list(short.items())
    df = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in every], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in bad)) for k, _ in docs], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, now = {}, df
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        kept[name] = {x["doc_id"] for x in now.select("doc_id").distinct().collect()}
        if name != "packing":
            assert now.columns == df.columns
    good = {k for k, _ in docs} - bad
    assert kept["toxicity"] == {k for k, _ in every} - bad
    assert kept["quality_rules"] == good | set(copies)
    assert kept["simhash_near_dedup"] == good and kept["packing"] == good
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "packing"]
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == good


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
