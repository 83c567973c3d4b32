"""The evaluation run from questions to scorecard, and the creation of questions from reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import alignment as A
from quillgrid.operators import bundles as U
from quillgrid.operators import documents as O
from quillgrid.operators import external as E
from quillgrid.operators import models as L
from quillgrid.operators import scorecard as S
from quillgrid.operators import similarity as V
from quillgrid.operators import stats as B
from quillgrid.session import kept

AXES = ["question_type", "difficulty", "company", "sector", "hop", "complexity"]
EMPTY = f"question_id string, {E.ANSWER}"


@dataclass
class Evaluation:
    """What a run gives: scored rows, their scorecard, new rows for the caches, and intervals of the means."""

    scored: DataFrame
    card: DataFrame
    generations: DataFrame
    judgements: DataFrame | None = None
    intervals: DataFrame | None = None


def evaluate(
    questions: DataFrame,
    backend: E.Backend,
    regime: str = "zero_shot",
    chunks: DataFrame | None = None,
    form: str = "html",
    cache: DataFrame | None = None,
    judge: E.Backend | None = None,
    judge_cache: DataFrame | None = None,
    scorer: L.PairScorer | None = None,
    extra: dict[str, S.Measure] | None = None,
    context_limit: int | None = None,
    examples: list[dict[str, str]] = (),
    vectors: DataFrame | None = None,
) -> Evaluation:
    """Ask, score and aggregate. ``questions`` are records of ``sources.readers``; answers are scored against their evidence.

    BERTScore comes from ``scorer``, or from a table of (token, vector) where one is given, else it is zero.
    """
    spark = questions.sparkSession
    q = questions.withColumn("question_id", F.col("global_id"))
    if chunks is None:
        q = q.withColumn("context", F.col("evidence"))
    else:
        q = U.with_context(q, chunks, ["sector", "company"], form)
    preamble = E.company_preamble(F.col("company"), F.col("sector"), F.col("year"))
    if context_limit is None:
        turns = E.messages(F.col("question"), F.col("context"), regime, preamble, list(examples))
        prompt: Column = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    else:
        prompt = E.completion_prompt(F.col("question"), F.col("context"), context_limit, preamble)
    held = cache if cache is not None else spark.createDataFrame([], EMPTY)
    answers, fresh = E.ask_cached(q.withColumn("_prompt", prompt), "question_id", "_prompt", backend, held)
    joined = q.join(answers, "question_id").withColumnsRenamed({"answer": "gold", "reply": "pred"})
    hops = F.coalesce(F.col("anchors.hops"), F.lit(0))
    joined = joined.withColumns({"hop": S.hop_bucket(hops), "complexity": S.operation_complexity(hops), "regime": F.lit(regime)})
    scored = S.score_rows(joined, error="error", extra=extra).drop("meteor")
    meteor = A.meteor_scores(joined, ["question_id"], "gold", "pred").select("question_id", "meteor")
    similar = V.embedding_scores(joined, ["question_id"], "gold", "pred", vectors) if vectors is not None and scorer is None else L.bert_scores(joined, "question_id", "gold", "pred", scorer)
    scored = scored.join(meteor, "question_id").withColumn("meteor", F.when(F.col("failed"), 0.0).otherwise(F.col("meteor"))).join(similar, "question_id")
    scored = kept(scored)  # card, intervals and judgements all read it
    judged = None
    if judge is not None:
        before = judge_cache if judge_cache is not None else spark.createDataFrame([], EMPTY.replace("question_id", "_key"))
        marks, judged = E.judge(S.judge_candidates(scored).select("question_id", "gold", "pred", "question"), judge, before)
        scored = scored.join(marks.select("question_id", "llm_num_equiv"), "question_id", "left")
    more = tuple(c for c in S.MORE if c in scored.columns)
    return Evaluation(scored, S.scorecard(scored, AXES, more), fresh, judged, B.metric_intervals(scored, "question_id"))


def chunk_reports(reports: DataFrame) -> DataFrame:
    """Chunks with ids and scores of (sector, company, year, text) reports: repetition removed, blocks, packing, scoring."""
    named = reports.withColumn("doc_id", F.concat_ws("/", "sector", "company", "year"))
    cleaned = O.remove_repetition(named).where(T.strip(F.col("text")) != "").select("doc_id", "text")
    packed = O.pack_chunks(O.block_rows(cleaned))
    parts = F.split("doc_id", "/")
    return packed.select(
        F.format_string("%s:%04d", "doc_id", "chunk").alias("chunk_id"), "doc_id", parts[0].alias("sector"), parts[1].alias("company"), parts[2].alias("year"), F.col("chunk").alias("pos"),
        "section", "pages", "has_table", F.col("tokens").alias("token_count"), "oversized_table", "is_truncated", T.chunk_score(F.col("text"), F.col("section"), F.col("has_table")).alias("score"), "text",
    )


def make_bundles(chunks: DataFrame) -> DataFrame:
    """Bundles worth asking about: four chunks or more each, weak neighbours merged, a score of eight at least, by first chunk."""
    numbered = U.build(chunks, "doc_id")
    first = U.merge_weak(U.assemble(numbered, "doc_id"), "doc_id").select("doc_id", "bundle", "merged_bundle", "merged")
    both = numbered.join(first, ["doc_id", "bundle"])
    made = U.assemble(both.drop("bundle"), "doc_id", bundle="merged_bundle")
    flags = first.groupBy("doc_id", "merged_bundle").agg(F.bool_or("merged").alias("merged"))
    return made.join(flags, ["doc_id", "merged_bundle"]).where(F.col("score") >= 8).orderBy("bundle_id")


def make_questions(bundles: DataFrame, tier: str, backend: E.Backend, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, dead letters) of the bundles that were not asked before."""
    left = bundles if done is None else E.pending(bundles, done, "bundle_id")
    return E.generate_pairs(left, "bundle_id", "text", tier, backend, T.question_budget(F.col("score"), F.col("merged")))
