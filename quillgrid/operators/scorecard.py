"""Scoring of answers row by row, and their aggregation along many axes in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import metrics as M
from quillgrid.functions import numeric as N
from quillgrid.functions import text as T
from quillgrid.operators import sequences as Q

#: Measures averaged over all rows, errors counting as zero.
MEANS = ("exact_match", "relaxed_em", "token_f1", "rouge_l", "meteor", "num_exact", "num_f1", "entailment_ratio", "evidence_traceability")
TOLERANCES = (1, 5, 10)
Measure = Callable[[Column, Column, Column], Column]
JUDGED_TYPES = ("Numerical Calculation", "Table Only", "Table with Text")


def hop_bucket(hops: Column) -> Column:
    return F.when(hops <= 0, None).when(hops <= 4, F.concat(hops.cast("string"), F.lit("-hop"))).when(hops > 4, "5+-hop")


def operation_complexity(hops: Column) -> Column:
    return F.when(hops == 0, "direct_lookup").when(hops == 1, "single_hop").when(hops == 2, "two_hop").when(hops >= 3, "multi_hop_3plus")


def score_rows(df: DataFrame, gold: str = "gold", pred: str = "pred", evidence: str = "evidence", error: str | None = None, rouge: bool = True, extra: dict[str, Measure] | None = None) -> DataFrame:
    """The rows with every measure as a column; a row with an error has zeros (and null direction).

    ``extra`` names further measures, each a function from the gold, predicted and evidence Columns to a Column.
    """
    g, p, e = (F.coalesce(F.col(x), F.lit("")) for x in (gold, pred, evidence))
    failed = F.lit(False) if error is None else F.coalesce(F.col(error), F.lit("")) != ""
    zero = lambda c, kind: F.when(failed, F.lit(0).cast(kind)).otherwise(c)
    numbers, ent = N.number_scores(g, p), M.entailment(e, p)
    out = {
        "exact_match": zero(M.exact_match(g, p), "int"),
        "relaxed_em": zero(M.relaxed_match(g, p), "int"),
        "token_f1": zero(M.token_f1(g, p)["f1"], "double"),
        "meteor": zero(M.meteor(g, p), "double"),
        "num_exact": zero(numbers["exact"], "int"),
        "num_f1": zero(numbers["f1"], "double"),
        **{f"tol{k}_acc": zero(N.within_tolerance(g, p, float(k)), "int") for k in TOLERANCES},
        "directional_acc": F.when(~failed, M.directional_accuracy(g, p)),
        "entailment_ratio": zero(ent["entailment"], "double"),
        "evidence_traceability": zero(M.traceability(e, p), "double"),
        "abstained": ~failed & T.is_abstention(p),
        "numeric_gold": ~failed & (F.size(N.number_strings(g)) > 0),
        "failed": failed,
    }
    out["rouge_l"] = zero(Q.rouge_l(g, p), "double") if rouge else F.lit(0.0)
    out |= {name: F.when(~failed, measure(g, p, e)) for name, measure in (extra or {}).items()}
    return df.withColumns(out)


#: Further columns that are averaged over the rows that have them, where a run has them.
MORE = ("bertscore_p", "bertscore_r", "bertscore_f1", "llm_num_equiv", "latency_ms")


def measures(more: tuple[str, ...] = ()) -> list[Column]:
    """The aggregates of a group: counts, means, conditional means with their own denominators."""
    return [
        *(F.avg(m).alias(m) for m in more),
        F.count("*").alias("n"),
        F.count_if("failed").alias("errors"),
        F.avg(F.col("abstained").cast("int")).alias("abstain_rate"),
        *(F.avg(m).alias(m) for m in MEANS),
        *(F.avg(F.when(F.col("numeric_gold"), F.col(f"tol{k}_acc"))).alias(f"tol{k}_acc") for k in TOLERANCES),
        F.count_if("numeric_gold").alias("tol_n"),
        F.avg("directional_acc").alias("directional_acc"),
        F.count("directional_acc").alias("directional_n"),
    ]


def scorecard(scored: DataFrame, axes: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """(axis, key, measures): the whole and every value of every axis from one scan (grouping sets); null keys are left out."""
    view = scored.select(*axes, "failed", "abstained", "numeric_gold", "directional_acc", *MEANS, *more, *(f"tol{k}_acc" for k in TOLERANCES))
    sets = [[]] + [[a] for a in axes]
    grouped = view.groupingSets([[F.col(a) for a in s] for s in sets], *map(F.col, axes)).agg(F.grouping_id().alias("gid"), *measures(more))
    top = (1 << len(axes)) - 1
    marks = {top: "all"} | {top & ~(1 << (len(axes) - 1 - k)): a for k, a in enumerate(axes)}
    axis = F.create_map(*[F.lit(x) for k, v in marks.items() for x in (k, v)])
    named = grouped.withColumn("axis", F.try_element_at(axis, F.col("gid").cast("int"))).withColumn("key", F.coalesce(*[F.col(a).cast("string") for a in axes]))
    return named.where((F.col("axis") == "all") | F.col("key").isNotNull()).drop("gid", *axes)


def hallucinations(scored: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(type, count, pct, total, rate): kinds of answers that are unsupported, not abstained and without an error, commonest first."""
    g, p = (F.coalesce(F.col(x), F.lit("")) for x in (gold, pred))
    bad = ~F.col("failed") & ~F.col("abstained") & (F.col("entailment_ratio") < 0.3)
    kinds = scored.select(F.when(bad, M.hallucination_type(g, p, F.col("entailment_ratio"))).alias("type"), F.col("failed")).groupBy("type").agg(
        F.count("type").alias("count"), F.count_if(~F.col("failed")).alias("fine")
    )
    whole = Window.partitionBy()  # a handful of rows, one for each kind
    return (
        kinds.withColumn("rows", F.sum("fine").over(whole))
        .where("count > 0")  # not "type IS NOT NULL", which would be worked out a second time, in the scan
        .withColumn("total", F.sum("count").over(whole))
        .select("type", "count", (F.col("count") / F.col("total")).alias("pct"), "total", (F.col("total") / F.nullif(F.col("rows"), F.lit(0))).alias("rate"))
        .orderBy(F.desc("count"), "type")
    )


def subset_means(scored: DataFrame, flag: Column) -> DataFrame:
    """Means of five measures over the rows of a flag."""
    return scored.where(flag).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in ("exact_match", "token_f1", "num_exact", "entailment_ratio", "evidence_traceability")))


def red_flag_detection(scored: DataFrame, flag: Column) -> DataFrame:
    """Share of red-flag rows whose entailment is below a half."""
    return scored.agg(F.count_if(flag).alias("n"), F.avg(F.when(flag, (F.col("entailment_ratio") < 0.5).cast("int"))).alias("detected"))


def mape(df: DataFrame, gold: str = "gold", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean absolute percentage error of last numbers, each error capped at 1000 %; null where no pair has numbers."""
    ape = N.absolute_percentage_error(F.col(gold), F.col(pred))
    return df.groupBy(*by).agg((F.avg(ape) * 100).alias("mape"), F.count(ape).alias("pairs"))


def two_level(scored: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts and means by both levels, with the outer level's subtotal and the total (rollup)."""
    return scored.rollup(outer, inner).agg(
        F.count("*").alias("n"), F.avg("exact_match").alias("exact_match"), F.avg("token_f1").alias("token_f1"), F.avg("num_exact").alias("num_exact"), F.count_if("abstained").alias("abstained")
    )


def judge_candidates(scored: DataFrame, type_col: str = "question_type", calc_col: str = "requires_calculation") -> DataFrame:
    wanted = F.coalesce(F.col(calc_col), F.lit(False)) | F.coalesce(F.col(type_col).isin(*JUDGED_TYPES), F.lit(False))
    return scored.where(~F.col("failed") & ~F.col("abstained") & wanted)


def folded(pairs: DataFrame, *columns: str) -> DataFrame:
    """The different rows of the columns and how many rows (``times``) each stands for, nulls being equal.

    Answers repeat, and a measure costs far more than a count: equal pairs are counted where they lie and measured
    once. Where all differ it costs one shuffle more, and as many measures as before.
    """
    return pairs.groupBy(*columns).agg(F.count("*").alias("times"))
