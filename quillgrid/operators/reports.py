"""Report queries over aggregates and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("easy", "medium", "hard", "multihop")
REGIMES = ("zero_shot", "closed_book", "few_shot", "chain_of_thought")


def run_name(name: Column) -> Column:
    """Struct model, tier, regime of a file name; question marks where it has no tier."""
    bare = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.jsonl?$", "")
    tier = None
    for t in TIERS:
        found = F.struct(F.substring_index(bare, f"_{t}_", 1).alias("model"), F.lit(t).alias("tier"), F.substring(bare, F.instr(bare, f"_{t}_") + len(t) + 2, 10_000).alias("regime"))
        tier = F.when(bare.contains(f"_{t}_"), found) if tier is None else tier.when(bare.contains(f"_{t}_"), found)
    return tier.otherwise(F.struct(F.lit("?").alias("model"), F.lit("?").alias("tier"), F.lit("?").alias("regime")))


def in_order(c: Column, values: tuple[str, ...]) -> Column:
    """Sort key of a fixed order; other values last."""
    place = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(place > 0, place).otherwise(len(values) + 1)


def summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def regime_delta(rows: DataFrame, model: str, tier: str, regime: str, metric: str, first: str = "zero_shot", second: str = "closed_book") -> DataFrame:
    """(model, tier, first, second, delta) side by side."""
    wide = rows.groupBy(model, tier).pivot(regime, [first, second]).agg(F.avg(metric))
    return wide.withColumn("delta", F.col(second) - F.col(first))


def tier_delta(rows: DataFrame, model: str, tier: str, metric: str) -> DataFrame:
    """Change of a measure from each tier to the next, in the tiers' order."""
    means = rows.groupBy(model, tier).agg(F.avg(metric).alias(metric)).withColumn("_o", in_order(F.col(tier), TIERS))
    w = Window.partitionBy(model).orderBy("_o")
    return means.withColumn("delta", F.col(metric) - F.lag(metric).over(w)).drop("_o")


def near_misses(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n rows of highest token F1 (0.7 at least) that are no exact match, ties by key."""
    near = F.when((F.col("exact_match") == 0) & (F.col("token_f1") >= 0.7) & ~F.col("failed"), F.col("token_f1"))
    # The filter comes after the limit, so that the measures are not worked out a second time for it.
    return scored.withColumn("_near", near).orderBy(F.desc_nulls_last("_near"), key).limit(n).where("_near IS NOT NULL").drop("_near")


def error_summary(rows: DataFrame, run: str, error: str, key: str, samples: int = 3) -> DataFrame:
    """(run, errors, first samples) with the grand total under a null run; the samples are a bounded top by key."""
    bad = rows.where(F.coalesce(F.col(error), F.lit("")) != "")
    counts = bad.rollup(run).agg(F.count("*").alias("errors"))
    first = bad.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(key))).where(F.col("_r") <= samples)
    texts = first.groupBy(F.col(run).alias("_run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", error))), lambda x: x[error]).alias("samples"))
    return counts.join(texts, F.col(run) == F.col("_run"), "left").drop("_run")


def ranked(means: DataFrame, metric: str) -> DataFrame:
    """A table of models (one row each) ranked by a measure."""
    return means.withColumn("rank", F.rank().over(Window.orderBy(F.desc(metric))))


def long_aggregates(files: DataFrame) -> DataFrame:
    """(file, model, tier, regime, axis, key, metric, value) of aggregates of any shape, from ``readers.aggregates``.

    Documents are read as VARIANT: a number at the top is a measure of the whole (axis ``all``), a map
    ``by_x`` of maps holds the measures of each value of x. Counts are called ``n``, whatever the document
    calls them (n, total or count); what is no number is left out. Documents of different runs of the
    program need not have the same measures or axes.
    """
    named = files.select("file", run_name(F.col("file")).alias("r"), F.parse_json("body").alias("v")).select("file", "r.*", "v")
    top = named.select("file", "model", "tier", "regime", F.explode(F.expr("cast(v as map<string, variant>)")).alias("name", "x"))
    kind = F.schema_of_variant("x")
    whole = top.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select("file", "model", "tier", "regime", F.lit("all").alias("axis"), F.lit(None).cast("string").alias("key"), F.col("name").alias("metric"), "x")
    by = top.where(kind.startswith("OBJECT") & F.col("name").startswith("by_")).select("file", "model", "tier", "regime", F.substring("name", 4, 10_000).alias("axis"), F.explode(F.expr("try_cast(x as map<string, variant>)")).alias("key", "y"))
    inner = by.where(F.schema_of_variant("y").startswith("OBJECT")).select("file", "model", "tier", "regime", "axis", "key", F.explode(F.expr("cast(y as map<string, variant>)")).alias("metric", "x"))
    flat = whole.unionByName(inner).withColumn("value", F.expr("try_variant_get(x, '$', 'double')")).drop("x").where("value IS NOT NULL")
    return flat.withColumn("metric", F.when(F.col("metric").isin("total", "count"), "n").otherwise(F.col("metric")))


def breakdown(aggregates: DataFrame, axis: str, metrics: list[str]) -> DataFrame:
    """(model, tier, regime, key, n, metrics) of one axis of long aggregates, side by side, the most frequent keys first."""
    wide = aggregates.where(F.col("axis") == axis).groupBy("model", "tier", "regime", "key").pivot("metric", ["n", *metrics]).agg(F.max("value"))
    return wide.orderBy("model", in_order(F.col("tier"), TIERS), "regime", F.desc("n"), "key")


def count_log(pairs: DataFrame, dead: DataFrame, by: str, tier: str, kind: str, reason: str = "reason") -> DataFrame:
    """(scope, log): counts of questions by tier and type, and of removals by reason, as text for each value of ``by`` and, under a null scope, for all.

    A question without a type counts for its tier and the total only.
    """
    made = pairs.select(F.col(by).alias("scope"), F.col(tier).alias("a"), F.col(kind).alias("b"), F.lit("questions").alias("of"))
    gone = dead.select(F.col(by).alias("scope"), F.col(reason).alias("a"), F.lit(None).cast("string").alias("b"), F.lit("removed").alias("of"))
    rows = made.unionByName(gone).withColumn("scoped", F.lit(True))
    sets = [s + extra for s in ([], ["scope", "scoped"]) for extra in (["of"], ["of", "a"], ["of", "a", "b"])]
    counted = rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, ("scope", "scoped", "of", "a", "b"))).agg(F.grouping("a").alias("ga"), F.grouping("b").alias("gb"), F.count("*").alias("n"))
    shown = counted.where((F.col("gb") == 1) | F.col("b").isNotNull()).where((F.col("ga") == 1) | F.col("a").isNotNull())
    name = F.when(F.col("ga") == 1, F.concat("of", F.lit(" in all"))).when(F.col("gb") == 1, F.concat(F.lit("  "), "a")).otherwise(F.concat(F.lit("    "), "b"))
    line = F.struct("of", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"), F.concat(name, F.lit(": "), F.col("n").cast("string")).alias("line"))
    logs = shown.groupBy("scope", "scoped").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("log"))
    return logs.select(F.when(F.col("scoped"), F.coalesce("scope", F.lit(""))).alias("scope"), "log")


def question_counts(pairs: DataFrame, tier: str, kind: str) -> DataFrame:
    """Totals, by tier, and by tier and type, in one pass."""
    return pairs.groupingSets([[], [F.col(tier)], [F.col(tier), F.col(kind)]], F.col(tier), F.col(kind)).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
