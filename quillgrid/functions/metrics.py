"""Answer-quality measures of a gold and a predicted text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import numeric as N
from quillgrid.functions import text as T

# Words that tell a direction, and phrases that tell there is none.
DIRECTION_WORDS = {
    "up": (
        "increase", "increased", "increases", "growth", "grew", "grow", "rose", "rise",
        "risen", "higher", "up", "gain", "gained", "gains", "improved", "improvement",
        "profit", "profits", "strengthened", "expansion", "expanded", "surge", "surged", "jumped",
    ),
    "down": (
        "decrease", "decreased", "decreases", "decline", "declined", "declines", "declining", "fell",
        "fall", "fallen", "drop", "dropped", "drops", "lower", "down", "reduction",
        "reduced", "reduce", "shrink", "shrunk", "shrank", "loss", "losses", "deteriorated",
        "weakened", "contraction", "contracted", "negative", "deficit",
    ),
    "flat": (
        "unchanged", "stable", "flat", "marginal",
    ),
    "yes": ("yes",),
    "no": ("no",),
}
FLAT_PHRASES = (
    "no change", "no significant change", "no major change", "no material change", "no meaningful change",
    "remained unchanged", "remained stable", "no notable change", "no considerable change",
)


def exact_match(gold: Column, pred: Column) -> Column:
    return (T.normalize(gold) == T.normalize(pred)).cast("int")


def set_f1(gold_set: Column, pred_set: Column) -> Column:
    """Struct of precision, recall and f1 of two arrays without repeats; both empty counts as equal."""

    def sizes(v: Column) -> Column:
        return F.struct(F.size(F.array_intersect(v["g"], v["p"])).alias("both"), F.size(v["g"]).alias("g"), F.size(v["p"]).alias("p"))

    def shares(v: Column) -> Column:
        empty = (v["g"] == 0) & (v["p"] == 0)
        precision = F.when(empty, 1.0).otherwise(F.coalesce(v["both"] / F.nullif(v["p"], F.lit(0)), F.lit(0.0)))
        recall = F.when(empty, 1.0).otherwise(F.coalesce(v["both"] / F.nullif(v["g"], F.lit(0)), F.lit(0.0)))
        return F.struct(precision.alias("precision"), recall.alias("recall"))

    f1 = lambda v: F.coalesce(2 * v["precision"] * v["recall"] / F.nullif(v["precision"] + v["recall"], F.lit(0.0)), F.lit(0.0))
    found = T.let(T.let(F.struct(gold_set.alias("g"), pred_set.alias("p")), sizes), shares)
    return T.let(found, lambda v: F.struct(v["precision"].alias("precision"), v["recall"].alias("recall"), f1(v).alias("f1")))


def token_f1(gold: Column, pred: Column) -> Column:
    return set_f1(F.array_distinct(T.tokens(gold)), F.array_distinct(T.tokens(pred)))


#: A word of any side between spaces.
_DIRECTION = r"(?<!\S)(?:" + "|".join(w for own in DIRECTION_WORDS.values() for w in own) + r")(?!\S)"


def direction(c: Column, strict: bool = False) -> Column:
    """up, down, flat, yes or no; null if the text tells none. Strictly, yes and no must be words of their own."""

    def side(last: Column) -> Column:
        label = None
        for name, own in DIRECTION_WORDS.items():
            label = (F.when if label is None else label.when)(last.isin(*own), name)
        return label

    def by_words(norm: Column) -> Column:
        last = F.try_element_at(F.regexp_extract_all(norm, F.lit(_DIRECTION), F.lit(0)), F.lit(-1))
        return (
            F.when(T.contains_any(norm, FLAT_PHRASES), "flat")
            .when(norm.rlike(_DIRECTION), T.let(last, side))
            .when(~F.lit(strict) & norm.contains("yes"), "yes")
            .when(~F.lit(strict) & norm.contains("no"), "no")
        )

    bare = T.strip(c)
    return (
        F.when(bare.rlike(r"(?U)^-\d"), "down")
        .when(bare.rlike(r"(?U)^\+\d"), "up")
        .when(bare.rlike(r"(?U)^\([\d₹$]"), "down")
        .otherwise(T.let(T.normalize(c), by_words))
    )


def directional_accuracy(gold: Column, pred: Column) -> Column:
    both = F.struct(direction(gold).alias("g"), direction(pred).alias("p"))
    return T.let(both, lambda v: F.when(v["g"].isNotNull(), F.coalesce((v["g"] == v["p"]).cast("int"), F.lit(0))))


def _sides(c: Column) -> Column:
    """What relaxed matching compares of a text."""
    bare = T.strip_units(c)
    return F.struct(
        T.normalize(c).alias("norm"), direction(c).alias("direction"), F.abs(N.last_number(c)).alias("last"), N.canonical_value(c).alias("value"),
        bare.alias("bare"), N.to_number(F.regexp_replace(bare, "_", "x")).alias("number"),
    )


def relaxed_match(gold: Column, pred: Column) -> Column:
    """1 on equal text; equal direction and number; equal canonical value; or equal text or number without units."""

    def matched(v: Column) -> Column:
        g, p = v["g"], v["p"]
        same, gn, pn = g["direction"] == p["direction"], g["last"], p["last"]
        near = gn.isNull() | pn.isNull() | ((gn < 1e-10) & (pn < 1e-10)) | ((gn > 1e-10) & (F.abs(gn - pn) / F.nullif(gn, F.lit(0.0)) < 0.015))
        yes = (
            (g["norm"] == p["norm"])
            | F.coalesce(same & near, F.lit(False))
            | ((g["direction"].isNull() | p["direction"].isNull() | same) & N.same_value(g["value"], p["value"]))
            | (g["bare"] == p["bare"])
            | F.coalesce(F.abs(g["number"] - p["number"]) < 0.015 * F.greatest(F.abs(g["number"]), F.lit(1.0)), F.lit(False))
        )
        return F.coalesce(yes.cast("int"), F.lit(0))

    return T.let(F.struct(_sides(gold).alias("g"), _sides(pred).alias("p")), matched)


def rouge_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a fold over one of a row of the table."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        places = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, zero, row), -1)


def f_measure(hits: Column, gold_size: Column, pred_size: Column) -> Column:
    p, r = hits / F.nullif(pred_size, F.lit(0)), hits / F.nullif(gold_size, F.lit(0))
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def rouge_l(gold: Column, pred: Column) -> Column:
    g, p = rouge_words(gold), rouge_words(pred)
    return f_measure(lcs_length(g, p), F.size(g), F.size(p))


def meteor(gold: Column, pred: Column) -> Column:
    """Token F1, which stands in for METEOR inside a row; 0 for a blank text. ``alignment.meteor_scores`` is METEOR itself."""
    return F.when((T.strip(gold) == "") | (T.strip(pred) == ""), 0.0).otherwise(token_f1(gold, pred)["f1"])


def sentence_labels(evidence: Column, answer: Column) -> Column:
    """ENTAILMENT, CONTRADICTION or NEUTRAL of each sentence of the answer, by the words it shares with the evidence."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))

    def share(own: Column, vocabulary: Column) -> Column:
        """Share of the words that are in the vocabulary, repeats counted: all less those that are not, by a hash set."""
        strange = F.array_except(own, vocabulary)
        hits = F.when(F.size(strange) == 0, F.size(own)).otherwise(F.size(F.filter(own, lambda w: ~F.array_contains(strange, w))))
        return hits / F.nullif(F.size(own), F.lit(0))

    def label(s: Column, ev: Column, vocabulary: Column) -> Column:
        by_share = lambda x: F.when(x >= 0.75, "ENTAILMENT").when(x < 0.3, "CONTRADICTION").otherwise("NEUTRAL")
        return F.when(F.length(s) < 5, "NEUTRAL").when(F.contains(ev, s), "ENTAILMENT").otherwise(T.let(T.let(words(s), lambda own: share(own, vocabulary)), by_share))

    def labels(v: Column) -> Column:
        return F.transform(T.sentences(answer), lambda x: T.let(T.strip(F.lower(x)), lambda s: label(s, v["ev"], v["words"])))

    return T.let(F.struct(F.lower(evidence).alias("ev"), F.array_distinct(words(F.lower(evidence))).alias("words")), labels)


def entailment(evidence: Column, answer: Column) -> Column:
    """Struct of n and the three label ratios; a blank answer is (0, 0, 1) with n = 0."""

    def ratios(labels: Column) -> Column:
        n = F.size(labels)
        ratio = lambda name, blank: F.when(n == 0, blank).otherwise(F.size(F.filter(labels, lambda x: x == name)) / F.nullif(n, F.lit(0))).alias(name.lower())
        return F.struct(n.alias("n"), ratio("ENTAILMENT", 0.0), ratio("CONTRADICTION", 0.0), ratio("NEUTRAL", 1.0))

    return T.let(sentence_labels(evidence, answer), ratios)


def traceability(evidence: Column, other: Column) -> Column:
    """1 if either contains the other, else the overlap of their words over the smaller set."""
    a, b = T.collapse(F.lower(evidence)), T.collapse(F.lower(other))
    x, y = F.array_distinct(T.words(a)), F.array_distinct(T.words(b))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(F.contains(a, b) | F.contains(b, a), 1.0)
        .otherwise(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)))
    )


def hallucination_type(gold: Column, pred: Column, entailed: Column) -> Column:
    """Kind of an answer that its evidence doesn't support; the first rule that fits."""

    def kind(v: Column) -> Column:
        g, p, gd, pd = v["g"], v["p"], v["gd"], v["pd"]
        shared, extra = F.size(F.array_intersect(g, p)), F.size(F.array_except(p, g))
        return (
            F.when((gd != pd) & ~gd.isin("yes", "no") & ~pd.isin("yes", "no"), "direction_error")
            .when((extra > 0) & (extra / F.nullif(F.size(p), F.lit(0)) > 0.5), "numeric_fabrication")
            .when((shared > 0) & (F.size(F.array_except(g, p)) > 0), "numeric_miscalculation")
            .when((F.size(T.words(pred)) > 2 * F.size(T.words(gold))) & (entailed < 0.2), "over_interpretation")
            .when((F.size(g) > 0) & (F.size(p) > 0) & (shared == 0), "misattribution")
            .otherwise("other")
        )

    found = lambda c: F.array_distinct(N.number_strings(c))
    return T.let(F.struct(found(gold).alias("g"), found(pred).alias("p"), direction(gold).alias("gd"), direction(pred).alias("pd")), kind)


def judge_key(gold: Column, pred: Column, question: Column) -> Column:
    return F.md5(F.concat_ws("||", gold, pred, question))


def judge_reply(reply: Column) -> Column:
    """Struct equivalent, confidence, reason, error of a judge's free-form reply: its first JSON object, else its words."""
    body = F.regexp_extract(reply, r"(?s)\{[^}]+\}", 0)
    parsed = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "equivalent string, confidence string, reason string")
    low = F.lower(reply)
    plain = low.startswith("yes") | low.contains('"equivalent": true') | low.contains("are equivalent") | low.contains("numerically equivalent")
    truth = ~F.coalesce(parsed["equivalent"], F.lit("false")).isin("false", "0", "0.0", "", "[]", "{}")
    blank = F.coalesce(reply, F.lit("")) == ""
    return F.struct(
        F.when(blank, False).when(parsed.isNotNull(), truth).otherwise(plain).alias("equivalent"),
        F.when(blank | parsed.isNull(), "LOW").otherwise(F.upper(F.coalesce(parsed["confidence"], F.lit("LOW")))).alias("confidence"),
        F.when(blank, "empty response").when(parsed.isNotNull(), T.strip(F.coalesce(parsed["reason"], F.lit("")))).otherwise(F.replace(T.capped(reply, "judge_reason"), F.lit("\n"), F.lit(" "))).alias("reason"),
        F.when(blank, "empty response").alias("error"),
    )
