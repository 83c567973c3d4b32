"""Writers: records, aggregates, logs and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import text as T


def records(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def generations(df: DataFrame, path: str) -> None:
    """Cache rows with the context cut to 300 characters."""
    df.withColumn("context", T.capped(F.col("context"), "cached_context")).write.mode("append").json(path)


def chunk_details(chunks: DataFrame) -> DataFrame:
    """Score rows of chunks: which score words and priority phrases were found, and the table's part."""
    return chunks.select(
        "chunk_id",
        "section",
        T.chunk_score(F.col("text"), F.col("section"), F.col("has_table")).alias("total_score"),
        F.when(F.col("has_table"), 2).alias("table_bonus"),
        F.nullif(T.found_words(F.col("text"), T.SCORE_WORDS), F.array().cast("array<string>")).alias("found_keywords"),
        F.nullif(T.found_words(F.col("section"), T.PRIORITY_SECTIONS), F.array().cast("array<string>")).alias("found_high_priority_sections"),
    )


def run_log(df: DataFrame, path: str) -> None:
    """Tab-separated rows with a header in each part, appended."""
    df.write.mode("append").option("sep", "\t").option("header", "true").csv(path)


def failures(df: DataFrame, path: str, message: str = "message") -> None:
    df.withColumn(message, T.csv_scrub(F.col(message))).write.mode("append").csv(path)


def aggregate_json(scorecard: DataFrame) -> str:
    """A scorecard (a few rows for each axis) as one nested JSON document: axis, key, measures."""
    import json

    out: dict = {}
    for row in scorecard.toJSON().collect():
        item = json.loads(row)
        axis, key = item.pop("axis"), item.pop("key", None)
        rounded = {k: round(v, 4) if isinstance(v, float) else v for k, v in item.items()}
        if axis == "all":
            out |= rounded
        else:
            out.setdefault(f"by_{axis}", {})[key] = rounded
    return json.dumps(out, indent=2, ensure_ascii=False)


def split_json(split: DataFrame, sector: str, company: str) -> str:
    """Splits as a JSON map from the split's name to its companies, in the sectors' order."""
    import json

    out: dict[str, list] = {}
    for r in split.orderBy("split", sector, company).collect():
        out.setdefault(r["split"], []).append({"sector": r[sector], "company": r[company]})
    return json.dumps(out, indent=2, ensure_ascii=False)


def quarantine(df: DataFrame, error: str, good: str, bad: str) -> None:
    """Rows without an error go to one table, those with one to the other."""
    df.where(F.col(error).isNull()).drop(error).write.mode("append").json(good)
    df.where(F.col(error).isNotNull()).write.mode("append").json(bad)


def count_logs(logs: DataFrame, root: str) -> None:
    """Texts of ``reports.count_log``: one file for each scope under its own folder, and one for all under ``_all``."""
    named = logs.select(F.coalesce("scope", F.lit("_all")).alias("scope"), "log")
    named.repartition("scope").write.mode("overwrite").partitionBy("scope").text(root)


def text(content: str, path: str, spark: SparkSession) -> None:
    """One text as a folder with one part, in any store Spark reaches."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
