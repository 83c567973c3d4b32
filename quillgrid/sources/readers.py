"""Readers: record files, reports and caches as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import replies as J
from quillgrid.functions import text as T

QA = (
    "question string, answer string, evidence string, question_type string, requires_calculation boolean, sector string, company string, year string, "
    "section string, page_numbers array<int>, bundle_id string, difficulty string, global_id string, verification_anchors string"
)
CHUNK = (
    "chunk_id string, doc_id string, sector string, company string, year string, section string, page_numbers array<int>, has_table boolean, "
    "token_count int, oversized_table boolean, score int, text string"
)
BUNDLE = "bundle_id string, score int, chunk_count int, section string"
GENERATION = (
    "question_id string, model_name string, question string, gold_answer string, predicted_answer string, context string, latency_ms double, "
    "prompt_tokens int, completion_tokens int, error string"
)
# Where each tier's file lies under a company.
TIER_FILES = {
    "easy": ("output_final_e_m", "easy/test_easy_qa.jsonl"),
    "medium": ("output_final_e_m", "medium/test_medium_qa.jsonl"),
    "hard": ("output_final_h_m", "hard/hard_qa_pairs.jsonl"),
    "multihop": ("output_final_h_m", "multihop/multihop_qa_pairs.jsonl"),
}


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, bad ones fail the read (or are dropped)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(path, line, record): with the place of each record in its file, for order-dependent uses.

    Files are split as usual: lines are numbered within each split, and splits begin after the lines of
    those before them in the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = raw.where(F.trim("value") != "")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n")).select("path", "split", before.alias("before"))
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")) - 1)
    found = placed.join(splits, ["path", "split"]).withColumn("line", (F.col("before") + F.col("place")).cast("int"))
    return found.select("path", "line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record"))


def qa_records(raw: DataFrame, sector: str | None = None, company: str | None = None) -> DataFrame:
    """Defaults for what is missing, anchors parsed, and the sustainability flag."""
    d = lambda c, v: F.coalesce(F.col(c), v).alias(c)
    empty = F.lit("")
    return raw.select(
        "question", "answer", "evidence", d("question_type", F.lit("Unknown")), d("requires_calculation", F.lit(False)),
        d("sector", F.lit(sector or "")), d("company", F.lit(company or "")), d("year", empty), d("section", empty),
        d("page_numbers", F.array().cast("array<int>")), d("bundle_id", empty), d("difficulty", F.lit("easy")), "global_id",
        J.anchors(F.col("verification_anchors")).alias("anchors"), T.is_brsr(F.col("section")).alias("is_brsr"),
    )


def tier_path(root: str, tier: str, sector: str = "*", company: str = "*", year: str = "FY2025") -> str:
    if tier not in TIER_FILES:
        raise ValueError(f"unknown tier: {tier}")
    base, name = TIER_FILES[tier]
    return f"{root}/{base}/{sector}/{company}/{year}/{name}"


def sample(spark: SparkSession, root: str, companies: list[tuple[str, str]], tier: str, most: int | None = None) -> DataFrame:
    """Records of a tier for the companies, each with global_id company_tier_place and at most ``most`` of each in file order."""
    paths = [tier_path(root, tier, s, c) for s, c in companies]
    rows = numbered_jsonl(spark, paths, QA)
    own = F.element_at(F.split("path", "/"), -4)
    base = rows.select(own.alias("_company"), "line", "record.*")
    kept = base if most is None else base.where(F.col("line") < most)
    named = kept.withColumn("company", F.coalesce("company", "_company")).withColumn("difficulty", F.coalesce("difficulty", F.lit(tier))).withColumn("global_id", F.concat_ws("_", "_company", F.lit(tier), "line"))
    return qa_records(named)


def brsr_subset(spark: SparkSession, root: str, chosen: list[tuple[str, str]] | None = None, tiers: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Sustainability records of several tiers. A tier of which a wanted file is missing gives none."""
    parts = []
    for tier in tiers or list(TIER_FILES):
        try:
            wanted = chosen or [tuple(r) for r in companies(spark, root, TIER_FILES[tier][0]).collect()]
            parts.append(sample(spark, root, wanted, tier, most).where("is_brsr"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not parts:
        return qa_records(spark.createDataFrame([], QA + ", global_id string"))
    return reduce(DataFrame.unionByName, parts)


def companies(spark: SparkSession, root: str, source: str = "output_final_e_m") -> DataFrame:
    """(sector, company) folders that hold files, in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{source}").select(F.split("path", "/").alias("p"))
    at = F.array_position("p", F.lit(source))
    return found.select(F.element_at("p", (at + 1).cast("int")).alias("sector"), F.element_at("p", (at + 2).cast("int")).alias("company")).distinct().orderBy("sector", "company")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their place in the file as ``pos``."""
    return numbered_jsonl(spark, path, CHUNK).select(F.col("line").alias("pos"), "record.*")


def bundles(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, BUNDLE)


def aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """(file, body): each JSON file of a folder as text that parses; others are left out."""
    return _json_files(spark, folder).where(F.try_parse_json("body").isNotNull())


def bad_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """(file): the JSON files of a folder that do not parse, for a warning."""
    return _json_files(spark, folder).where(F.try_parse_json("body").isNull()).select("file")


def _json_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, body): JSON files of a folder, and folders named like them, which hold a document in one part."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(parts.alias("p"), F.col("value").alias("body"))
    inside = F.element_at("p", -2).endswith(".json") & F.element_at("p", -1).startswith("part-")
    return rows.select(F.when(inside, F.element_at("p", -2)).when(F.element_at("p", -1).endswith(".json"), F.element_at("p", -1)).alias("file"), "body").where("file IS NOT NULL")


def reused(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path; where there is none it is made and written first."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def details(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Per-question rows of every JSON lines file in a folder, with the file's name; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json*").json(folder).withColumn("file", F.col("_metadata.file_name"))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """(sector, company, year, text) of Markdown reports; folders that begin with a dot or an underscore are skipped."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(root, wholetext=True).select("value", F.split(F.col("_metadata.file_path"), "/").alias("p"))
    stem = F.regexp_replace(F.element_at("p", -1), r"\.md$", "")
    year = F.when(stem.rlike(r"^(19|20)\d{2}$"), F.concat(F.lit("FY"), stem)).otherwise(stem)
    hidden = F.element_at("p", -2).rlike("^[._]") | F.element_at("p", -3).rlike("^[._]")
    return rows.where(~hidden).select(F.element_at("p", -3).alias("sector"), F.element_at("p", -2).alias("company"), year.alias("year"), F.col("value").alias("text"))


def pdfs(spark: SparkSession, root: str, least: int = 10_240) -> tuple[DataFrame, DataFrame]:
    """(files to read, files too small): path, length and content of PDF files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(root)
    return rows.where(F.col("length") >= least), rows.where(F.col("length") < least).select("path", "length")


def finished_reports(spark: SparkSession, root: str, placeholder: str = "EXTRACTION FAILED") -> DataFrame:
    """(path, complete): whether a stitched report is without failed pages."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), (~F.contains("value", F.lit(placeholder))).alias("complete"))


def id_log(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a log with one id on each line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def api_keys(environment: dict[str, str], name: str) -> list[str]:
    """A base key and its numbered siblings _1 to _9, as far as they are set (driver configuration)."""
    return [v for k in (name, *(f"{name}_{i}" for i in range(1, 10))) if (v := environment.get(k))]


def output_path(path, root_in: str, root_out: str):
    """Path of a PDF's Markdown under another root, as a Column."""
    return F.regexp_replace(F.replace(path, F.lit(root_in), F.lit(root_out)), r"\.pdf$", ".md")
