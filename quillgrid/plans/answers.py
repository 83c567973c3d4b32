"""Queries on answer quality: pair measures, numbers, directions, scorecards, statistics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import metrics as M
from quillgrid.functions import numeric as N
from quillgrid.functions import stems
from quillgrid.functions import text as T
from quillgrid.operators import alignment as A
from quillgrid.operators import external as E
from quillgrid.operators import reports as R
from quillgrid.operators import scorecard as S
from quillgrid.operators import sequences as Q
from quillgrid.operators import similarity as V
from quillgrid.operators import stats as B
from quillgrid.plans import duck as D
from quillgrid.plans.catalog import query, table


def r6(c: Column) -> Column:
    return F.round(c, 6)


# Pairs of a user's turn (gold) and the assistant's next (predicted).
PAIRS_SQL = "SELECT u.conv_id, u.turn, u.text AS gold, a.text AS pred FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations")
    u = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    a = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return u.join(a, ["conv_id", "turn"])


# Answers made from orders: a price in words, and one off by up to ten percent.
ANSWERS_SQL = """SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, n, p, 'Rs ' || CAST(n AS VARCHAR) || ' million' AS gold, 'about ' || CAST(p AS VARCHAR) || ' million in all' AS pred
FROM (SELECT *, n + (n * (o_orderkey % 11)) // 100 AS p FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders))"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("n", F.floor("o_totalprice").cast("bigint"))
    o = o.withColumn("p", F.expr("n + (n * (o_orderkey % 11)) div 100"))
    return o.select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "n", "p",
        F.concat(F.lit("Rs "), F.col("n").cast("string"), F.lit(" million")).alias("gold"), F.concat(F.lit("about "), F.col("p").cast("string"), F.lit(" million in all")).alias("pred"),
    )


# Statements of direction made from line items.
PHRASES = ("Revenue increased by {q}%", "it declined {q}%", "-{q}%", "({q}%)", "no significant change", "Yes, by {q}", "there was nothing", "+{q}%", "profit of Rs {q} crore", "{q} crore", "loss of {q}%")


def _phrase(key: Column, q: Column) -> Column:
    out = None
    for k, p in enumerate(PHRASES):
        head, _, tail = p.partition("{q}")
        text = F.concat(F.lit(head), q, F.lit(tail)) if "{q}" in p else F.lit(p)
        out = F.when(key == k, text) if out is None else out.when(key == k, text)
    return out


def _phrase_sql(key: str, q: str) -> str:
    arms = []
    for k, p in enumerate(PHRASES):
        head, _, tail = p.partition("{q}")
        arms.append(f"WHEN {key} = {k} THEN " + (f"{D.lit(head)} || {q} || {D.lit(tail)}" if "{q}" in p else D.lit(p)))
    return f"CASE {' '.join(arms)} END"


STATEMENTS_SQL = f"""SELECT l_orderkey, l_linenumber, l_returnflag, {_phrase_sql('(l_orderkey + l_linenumber) % 11', 'CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)')} AS gold,
{_phrase_sql('(l_orderkey + l_suppkey) % 11', "CAST(CAST(l_quantity + (l_partkey % 2) AS BIGINT) AS VARCHAR)")} AS pred FROM lineitem"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint").cast("string")
    p = (F.col("l_quantity") + F.col("l_partkey") % 2).cast("bigint").cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", _phrase((F.col("l_orderkey") + F.col("l_linenumber")) % 11, q).alias("gold"), _phrase((F.col("l_orderkey") + F.col("l_suppkey")) % 11, p).alias("pred")
    )


_g, _p = D.tokens("gold"), D.tokens("pred")


@query(
    "flagship_scorecard",
    f"""WITH x AS ({PAIRS_SQL}), t AS (SELECT *, {_g} AS gt, {_p} AS pt, {D.norm('gold')} AS gn, {D.norm('pred')} AS pn FROM x),
s AS (SELECT conv_id % 5 AS bucket, (gn = pn)::INT AS em, {D.set_f1('gt', 'pt')} AS f1, {D.traceability('gold', 'pred')} AS tr, {D.any_of('lower(pred)', D.ABSTAIN_PHRASES)}::INT AS ab FROM t)
SELECT bucket, count(*) AS n, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS token_f1, round(avg(tr), 6) AS traceability, round(avg(ab), 6) AS abstain_rate FROM s GROUP BY bucket""",
)
def flagship_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    scored = pairs(spark, sf).select(
        (F.col("conv_id") % 5).alias("bucket"), M.exact_match(g, p).alias("em"), M.token_f1(g, p)["f1"].alias("f1"), M.traceability(g, p).alias("tr"), T.is_abstention(p).cast("int").alias("ab")
    )
    return scored.groupBy("bucket").agg(
        F.count("*").alias("n"), r6(F.avg("em")).alias("exact_match"), r6(F.avg("f1")).alias("token_f1"), r6(F.avg("tr")).alias("traceability"), r6(F.avg("ab")).alias("abstain_rate")
    )


@query(
    "pair_metrics",
    f"""WITH x AS ({PAIRS_SQL}), t AS (SELECT *, {_g} AS gt, {_p} AS pt FROM x)
SELECT conv_id, turn, ({D.norm('gold')} = {D.norm('pred')})::INT AS exact_match, round({D.set_f1('gt', 'pt')}, 6) AS token_f1, round({D.traceability('gold', 'pred')}, 6) AS traceability FROM t""",
)
def pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    return pairs(spark, sf).select("conv_id", "turn", M.exact_match(g, p).alias("exact_match"), r6(M.token_f1(g, p)["f1"]).alias("token_f1"), r6(M.traceability(g, p)).alias("traceability"))


@query("rouge_l_pairs")
def rouge_l_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("conv_id", "turn", r6(Q.rouge_l(F.col("gold"), F.col("pred"))).alias("rouge_l"))


# Words and stems, stated here again for the SQL.
_WORD_SQL = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*|[^\p{L}\p{M}\p{N}_\s\x0B]"
_STEM_SQL = "CASE WHEN regexp_matches(w, '[^ea]ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[^aeo]es$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, '[^us]s$') AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END"


@query(
    "meteor_pairs",
    f"""WITH x AS ({PAIRS_SQL}), t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(gold, '')), '{_WORD_SQL}') AS g, regexp_extract_all(lower(coalesce(pred, '')), '{_WORD_SQL}') AS p FROM x),
k AS (SELECT conv_id, turn, 'g' AS side, unnest(g) AS w, generate_subscripts(g, 1) AS pos FROM t UNION ALL SELECT conv_id, turn, 'p', unnest(p), generate_subscripts(p, 1) FROM t),
k1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, w ORDER BY pos DESC) AS r, {_STEM_SQL} AS stem FROM k),
m1 AS (SELECT g.conv_id, g.turn, g.pos AS g, p.pos AS p FROM k1 g JOIN k1 p USING (conv_id, turn, w, r) WHERE g.side = 'g' AND p.side = 'p'),
l AS (SELECT k1.* FROM k1 LEFT JOIN (SELECT conv_id, turn, 'g' AS side, g AS pos FROM m1 UNION ALL SELECT conv_id, turn, 'p', p FROM m1) m USING (conv_id, turn, side, pos) WHERE m.pos IS NULL),
k2 AS (SELECT conv_id, turn, side, pos, stem, row_number() OVER (PARTITION BY conv_id, turn, side, stem ORDER BY pos DESC) AS r FROM l),
m AS (FROM m1 UNION ALL SELECT g.conv_id, g.turn, g.pos, p.pos FROM k2 g JOIN k2 p USING (conv_id, turn, stem, r) WHERE g.side = 'g' AND p.side = 'p'),
c AS (SELECT conv_id, turn, count(*) AS n, sum(CASE WHEN p = bp + 1 AND g = bg + 1 THEN 0 ELSE 1 END) AS chunks FROM (SELECT *, lag(p) OVER o AS bp, lag(g) OVER o AS bg FROM m WINDOW o AS (PARTITION BY conv_id, turn ORDER BY p)) GROUP BY conv_id, turn)
SELECT conv_id, turn, CAST(coalesce(n, 0) AS INTEGER) AS matches, CAST(coalesce(chunks, 0) AS INTEGER) AS chunks,
round(coalesce((n / len(p)) * (n / len(g)) / (0.9::DOUBLE * (n / len(p)) + 0.1::DOUBLE * (n / len(g))) * (1 - 0.5::DOUBLE * pow(chunks / n, 3)), 0.0::DOUBLE), 6) AS meteor FROM t LEFT JOIN c USING (conv_id, turn)""",
)
def meteor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = A.meteor_scores(pairs(spark, sf), ["conv_id", "turn"], "gold", "pred", stages=(lambda c: c, stems.plural))
    return found.select("conv_id", "turn", "matches", "chunks", r6(F.col("meteor")).alias("meteor"))


def token_vectors(spark: SparkSession, sf: str, x: DataFrame) -> DataFrame:
    """A row of the embeddings for each word of the texts, by its md5; every fifth word has none."""
    held = table(spark, sf, "embeddings")
    words = x.select(F.explode(F.concat(A.words(V.shown(F.col("gold"))), A.words(V.shown(F.col("pred"))))).alias("token")).distinct()
    mark = B.md5_number(F.col("token"))
    return words.where(mark % 5 != 0).withColumn("vec_id", mark % held.count()).join(held, "vec_id").select("token", F.col("embedding").alias("vector"))


@query(
    "bertscore_pairs",
    f"""WITH x AS ({PAIRS_SQL}), t AS (SELECT conv_id, turn, regexp_extract_all(lower(CASE WHEN regexp_matches(left(coalesce(gold, ''), 1024), '\\S') THEN left(gold, 1024) ELSE 'n/a' END), '{_WORD_SQL}') AS g,
  regexp_extract_all(lower(CASE WHEN regexp_matches(left(coalesce(pred, ''), 1024), '\\S') THEN left(pred, 1024) ELSE 'n/a' END), '{_WORD_SQL}') AS p FROM x),
k AS (SELECT conv_id, turn, side, w, count(*) AS n FROM (SELECT conv_id, turn, 'g' AS side, unnest(g) AS w FROM t UNION ALL SELECT conv_id, turn, 'p', unnest(p) FROM t) GROUP BY ALL),
d AS (SELECT w, count(*) AS df FROM k WHERE side = 'g' GROUP BY w),
e AS (SELECT w, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM (SELECT DISTINCT w FROM k) JOIN embeddings ON vec_id = {D.md5_number('w')} % (SELECT count(*) FROM embeddings) WHERE {D.md5_number('w')} % 5 <> 0),
f AS (SELECT k.*, ln(((SELECT count(*) FROM x) + 1) / (coalesce(df, 0) + 1)::DOUBLE) * n AS weight, v FROM k LEFT JOIN d USING (w) LEFT JOIN e USING (w)),
s AS (SELECT g.conv_id, g.turn, g.w AS gw, p.w AS pw, g.weight AS gweight, p.weight AS pweight, CASE WHEN g.w = p.w THEN 1.0::DOUBLE WHEN g.v IS NULL OR p.v IS NULL THEN 0.0::DOUBLE ELSE list_cosine_similarity(g.v, p.v) END AS alike FROM f g JOIN f p USING (conv_id, turn) WHERE g.side = 'g' AND p.side = 'p'),
r AS (SELECT conv_id, turn, sum(best * weight) / sum(weight) AS r FROM (SELECT conv_id, turn, gw, any_value(gweight) AS weight, max(alike) AS best FROM s GROUP BY ALL) GROUP BY ALL),
q AS (SELECT conv_id, turn, sum(best * weight) / sum(weight) AS p FROM (SELECT conv_id, turn, pw, any_value(pweight) AS weight, max(alike) AS best FROM s GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, turn, round(p, 6) AS bertscore_p, round(r, 6) AS bertscore_r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS bertscore_f1 FROM r JOIN q USING (conv_id, turn)""",
)
def bertscore_pairs(spark: SparkSession, sf: str) -> DataFrame:
    x = pairs(spark, sf)
    found = V.embedding_scores(x, ["conv_id", "turn"], "gold", "pred", token_vectors(spark, sf, x))
    return found.select("conv_id", "turn", *(r6(F.col(c)).alias(c) for c in V.NAMES))


_SENT = "list_filter(list_transform(string_split(regexp_replace(trim(pred, e' \\n\\t\\r'), '([.!?])\\s+', '\\1' || chr(7), 'g'), chr(7)), lambda s: trim(s, e' \\n\\t\\r')), lambda s: s <> '')"


@query(
    "heuristic_nli",
    f"""WITH x AS ({PAIRS_SQL}), s AS (SELECT conv_id, turn, lower(gold) AS ev, list_distinct(regexp_extract_all(lower(gold), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS vocab, unnest({_SENT}) AS sentence FROM x),
w AS (SELECT *, lower(sentence) AS low, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS own FROM s),
l AS (SELECT conv_id, turn, CASE WHEN length(low) < 5 THEN 'NEUTRAL' WHEN contains(ev, low) THEN 'ENTAILMENT' WHEN len(own) = 0 THEN 'NEUTRAL'
  WHEN len(list_filter(own, lambda z: list_contains(vocab, z)))::DOUBLE / len(own) >= 0.75::DOUBLE THEN 'ENTAILMENT' WHEN len(list_filter(own, lambda z: list_contains(vocab, z)))::DOUBLE / len(own) < 0.3::DOUBLE THEN 'CONTRADICTION' ELSE 'NEUTRAL' END AS label FROM w)
SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n, round(avg((label = 'ENTAILMENT')::INT), 6) AS entailment, round(avg((label = 'CONTRADICTION')::INT), 6) AS contradiction, round(avg((label = 'NEUTRAL')::INT), 6) AS neutral FROM l GROUP BY conv_id, turn""",
)
def heuristic_nli(spark: SparkSession, sf: str) -> DataFrame:
    x = pairs(spark, sf).select("conv_id", "turn", M.entailment(F.col("gold"), F.col("pred")).alias("e"))
    return x.where("e.n > 0").select("conv_id", "turn", "e.n", *(r6(F.col(f"e.{c}")).alias(c) for c in ("entailment", "contradiction", "neutral")))


@query(
    "number_metrics",
    f"""WITH x AS ({ANSWERS_SQL}), y AS (SELECT o_orderpriority, {D.last_number('gold')} AS g, {D.last_number('pred')} AS p FROM x)
SELECT o_orderpriority, count(*) AS n, CAST(sum((abs(g - p) < 0.01)::INT) AS BIGINT) AS num_exact, CAST(sum((abs(p - g) / abs(g) * 100 <= 1)::INT) AS BIGINT) AS tol1, CAST(sum((abs(p - g) / abs(g) * 100 <= 5)::INT) AS BIGINT) AS tol5, CAST(sum((abs(p - g) / abs(g) * 100 <= 10)::INT) AS BIGINT) AS tol10 FROM y GROUP BY o_orderpriority""",
)
def number_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    s = answers(spark, sf).select("o_orderpriority", N.number_scores(g, p)["exact"].alias("e"), *(N.within_tolerance(g, p, k).alias(f"t{k}") for k in (1, 5, 10)))
    return s.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("e").alias("num_exact"), *(F.sum(f"t{k}").alias(f"tol{k}") for k in (1, 5, 10)))


@query(
    "mape_by_segment",
    f"""WITH x AS ({ANSWERS_SQL}), y AS (SELECT c_mktsegment, {D.last_number('gold')} AS g, {D.last_number('pred')} AS p FROM x JOIN customer ON c_custkey = o_custkey)
SELECT c_mktsegment, round(avg(least(abs(p - g) / abs(g), 10)) * 100, 4) AS mape, count(*) AS pairs FROM y WHERE abs(g) >= 1e-10 AND p IS NOT NULL GROUP BY c_mktsegment""",
)
def mape_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    x = answers(spark, sf).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return S.mape(x, by=("c_mktsegment",)).withColumn("mape", F.round("mape", 4))


_UNIT = "CASE o_orderkey % 6 WHEN 0 THEN ' crore' WHEN 1 THEN ' lakh' WHEN 2 THEN ' million' WHEN 3 THEN ' bn' WHEN 4 THEN ' thousand' ELSE '' END"


@query(
    "canonical_units",
    f"""WITH x AS ({ANSWERS_SQL}), y AS (SELECT o_orderkey, '₹ ' || CAST(n AS VARCHAR) || {_UNIT} AS a, CAST(n // 10 AS VARCHAR) || ' lakhs' AS b FROM x), z AS (SELECT o_orderkey, {D.canonical('a')} AS va, {D.canonical('b')} AS vb FROM y)
SELECT o_orderkey, va, {D.equivalent('va', 'vb')} AS same FROM z""",
)
def canonical_units(spark: SparkSession, sf: str) -> DataFrame:
    a = F.concat(F.lit("₹ "), F.col("n").cast("string"), F.expr(_UNIT))
    b = F.concat(F.expr("n div 10").cast("string"), F.lit(" lakhs"))
    return answers(spark, sf).select("o_orderkey", N.canonical_value(a).alias("va"), N.equivalent(a, b).alias("same"))


@query(
    "direction_labels",
    f"""WITH x AS ({STATEMENTS_SQL}), y AS (SELECT l_returnflag, {D.direction('gold')} AS g, {D.direction('pred')} AS p FROM x)
SELECT l_returnflag, coalesce(g, 'none') AS gold_label, count(*) AS n, CAST(sum(CASE WHEN g IS NULL THEN NULL WHEN p IS NULL THEN 0 ELSE (g = p)::INT END) AS BIGINT) AS hits FROM y GROUP BY ALL""",
)
def direction_labels(spark: SparkSession, sf: str) -> DataFrame:
    told = S.folded(statements(spark, sf), "l_returnflag", "gold", "pred")
    x = told.select("l_returnflag", "times", F.coalesce(M.direction(F.col("gold")), F.lit("none")).alias("gold_label"), M.directional_accuracy(F.col("gold"), F.col("pred")).alias("hit"))
    return x.groupBy("l_returnflag", "gold_label").agg(F.sum("times").alias("n"), F.sum(F.col("hit") * F.col("times")).alias("hits"))


@query(
    "directional_means",
    f"""WITH x AS ({STATEMENTS_SQL}), y AS (SELECT l_returnflag, {D.direction('gold')} AS g, {D.direction('pred')} AS p FROM x)
SELECT l_returnflag, round(avg(CASE WHEN g IS NULL THEN NULL WHEN p IS NULL THEN 0 ELSE (g = p)::INT END), 6) AS accuracy, count(g) AS n FROM y GROUP BY l_returnflag""",
)
def directional_means(spark: SparkSession, sf: str) -> DataFrame:
    told = S.folded(statements(spark, sf), "l_returnflag", "gold", "pred")
    hit = told.select("l_returnflag", "times", M.directional_accuracy(F.col("gold"), F.col("pred")).alias("h"))
    hits, n = F.sum(F.col("h") * F.col("times")), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("times"))), F.lit(0))
    return hit.groupBy("l_returnflag").agg(r6(hits / F.nullif(n, F.lit(0))).alias("accuracy"), n.alias("n"))


_REL = f"""SELECT *, {D.direction('gold')} AS gd, {D.direction('pred')} AS pd, abs({D.last_number('gold')}) AS gl, abs({D.last_number('pred')}) AS pl, {D.canonical('gold')} AS gc, {D.canonical('pred')} AS pc,
{D.strip_units('gold')} AS gs, {D.strip_units('pred')} AS ps, {D.norm('gold')} AS gn, {D.norm('pred')} AS pn FROM x"""


@query(
    "relaxed_em",
    f"""WITH x AS ({STATEMENTS_SQL}), y AS ({_REL})
SELECT l_returnflag, count(*) AS n, CAST(sum((gn = pn)::INT) AS BIGINT) AS exact_match, CAST(sum((gn = pn OR coalesce(gd = pd AND (gl IS NULL OR pl IS NULL OR (gl < 1e-10 AND pl < 1e-10) OR (gl > 1e-10 AND abs(gl - pl) / gl < 0.015::DOUBLE)), FALSE)
 OR ((gd IS NULL OR pd IS NULL OR gd = pd) AND {D.equivalent('gc', 'pc')}) OR gs = ps OR coalesce(abs(TRY_CAST(gs AS DOUBLE) - TRY_CAST(ps AS DOUBLE)) < 0.015::DOUBLE * greatest(abs(TRY_CAST(gs AS DOUBLE)), 1), FALSE))::INT) AS BIGINT) AS relaxed_em FROM y GROUP BY l_returnflag""",
)
def relaxed_em(spark: SparkSession, sf: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    told = S.folded(statements(spark, sf), "l_returnflag", "gold", "pred")
    x = told.select("l_returnflag", "times", M.exact_match(g, p).alias("em"), M.relaxed_match(g, p).alias("rm"))
    return x.groupBy("l_returnflag").agg(F.sum("times").alias("n"), F.sum(F.col("em") * F.col("times")).alias("exact_match"), F.sum(F.col("rm") * F.col("times")).alias("relaxed_em"))


_TAX = f"""SELECT *, list_distinct({D.number_strings('gold')}) AS gs, list_distinct({D.number_strings('pred')}) AS ps, {D.direction('gold')} AS gd, {D.direction('pred')} AS pd, len({D.words('gold')}) AS gw, len({D.words('pred')}) AS pw FROM x"""


@query(
    "hallucination_taxonomy",
    f"""WITH x AS ({STATEMENTS_SQL}), y AS ({_TAX}), z AS (SELECT CASE WHEN gd <> pd AND gd NOT IN ('yes', 'no') AND pd NOT IN ('yes', 'no') THEN 'direction_error'
 WHEN len(ps) > 0 AND len(list_filter(ps, lambda v: NOT list_contains(gs, v)))::DOUBLE / len(ps) > 0.5 THEN 'numeric_fabrication'
 WHEN len(list_intersect(gs, ps)) > 0 AND len(list_filter(gs, lambda v: NOT list_contains(ps, v))) > 0 THEN 'numeric_miscalculation'
 WHEN pw > 2 * gw THEN 'over_interpretation' WHEN len(gs) > 0 AND len(ps) > 0 AND len(list_intersect(gs, ps)) = 0 THEN 'misattribution' ELSE 'other' END AS type FROM y)
SELECT type, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM z), 6) AS pct FROM z GROUP BY type""",
)
def hallucination_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    x = statements(spark, sf).withColumns({"failed": F.lit(False), "abstained": F.lit(False), "entailment_ratio": F.lit(0.1)})
    return S.hallucinations(x).select("type", "count", r6(F.col("pct")).alias("pct"))


@query(
    "abstain_rate",
    f"""WITH x AS (SELECT o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN 'It is Not Mentioned here' WHEN 1 THEN 'cannot be determined' WHEN 2 THEN '' ELSE 'Not available in memory' END AS t FROM orders)
SELECT o_orderpriority, round(avg({D.any_of('lower(t)', D.ABSTAIN_PHRASES)}::INT), 6) AS abstain_rate FROM x GROUP BY o_orderpriority""",
)
def abstain_rate(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'It is Not Mentioned here' WHEN 1 THEN 'cannot be determined' WHEN 2 THEN '' ELSE 'Not available in memory' END")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(r6(F.avg(T.is_abstention(t).cast("int"))).alias("abstain_rate"))


_SECTION = "CASE o_custkey % 5 WHEN 0 THEN 'BRSR Core' WHEN 1 THEN 'Principle 3: well-being' WHEN 2 THEN 'Balance Sheet' WHEN 3 THEN 'Section C' ELSE 'Directors'' Report' END"
_HOPS = "CAST(o_orderkey % 7 AS INT)"


@query(
    "brsr_subset",
    f"""WITH x AS ({ANSWERS_SQL}), y AS (SELECT {D.any_of(f'lower({_SECTION})', D.BRSR_WORDS)} AS f, (abs(n - p) < 0.01)::INT AS e FROM x)
SELECT f AS is_brsr, count(*) AS n, round(avg(e), 6) AS num_exact FROM y GROUP BY f""",
)
def brsr_subset(spark: SparkSession, sf: str) -> DataFrame:
    x = answers(spark, sf).select(T.is_brsr(F.expr(_SECTION)).alias("is_brsr"), N.number_scores(F.col("gold"), F.col("pred"))["exact"].alias("e"))
    return x.groupBy("is_brsr").agg(F.count("*").alias("n"), r6(F.avg("e")).alias("num_exact"))


@query(
    "scorecard_grouping_sets",
    f"""WITH x AS ({ANSWERS_SQL}), y AS (SELECT c_mktsegment AS segment, r_name AS region, o_orderpriority AS priority,
  CASE WHEN {_HOPS} <= 0 THEN NULL WHEN {_HOPS} <= 4 THEN {_HOPS} || '-hop' ELSE '5+-hop' END AS hop,
  CASE WHEN {_HOPS} = 0 THEN 'direct_lookup' WHEN {_HOPS} = 1 THEN 'single_hop' WHEN {_HOPS} = 2 THEN 'two_hop' ELSE 'multi_hop_3plus' END AS complexity,
  o_orderkey % 13 = 0 AS failed, (abs(n - p) < 0.01)::INT AS e, (abs(p - n) / abs(n)::DOUBLE * 100 <= 5)::INT AS t5 FROM x JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT 'all' AS axis, NULL AS key, * FROM y UNION ALL SELECT 'segment', segment, * FROM y UNION ALL SELECT 'region', region, * FROM y UNION ALL SELECT 'priority', priority, * FROM y UNION ALL SELECT 'hop', hop, * FROM y WHERE hop IS NOT NULL UNION ALL SELECT 'complexity', complexity, * FROM y)
SELECT axis, key, count(*) AS n, count(*) FILTER (failed) AS errors, round(avg(CASE WHEN failed THEN 0 ELSE e END), 6) AS num_exact, round(avg(CASE WHEN failed THEN NULL ELSE t5 END), 6) AS tol5_acc, count(*) FILTER (NOT failed) AS tol_n FROM a GROUP BY axis, key""",
)
def scorecard_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    x = (
        answers(spark, sf)
        .join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    hops = F.expr(_HOPS)
    x = x.select(
        F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), F.col("o_orderpriority").alias("priority"), S.hop_bucket(hops).alias("hop"), S.operation_complexity(hops).alias("complexity"),
        "gold", "pred", F.col("gold").alias("evidence"), F.when(F.col("o_orderkey") % 13 == 0, "timeout").alias("error"),
    )
    scored = S.score_rows(x, error="error")
    card = S.scorecard(scored, ["segment", "region", "priority", "hop", "complexity"])
    return card.select("axis", "key", "n", "errors", r6(F.col("num_exact")).alias("num_exact"), r6(F.col("tol5_acc")).alias("tol5_acc"), "tol_n")


@query(
    "red_flag_detection",
    """SELECT count(*) FILTER (o_orderkey % 3 = 0) AS n, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN ((o_custkey % 10) / 10.0::DOUBLE < 0.5::DOUBLE)::INT END), 6) AS detected FROM orders""",
)
def red_flag_detection(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").withColumn("entailment_ratio", (F.col("o_custkey") % 10) / F.lit(10.0))
    return S.red_flag_detection(x, F.col("o_orderkey") % 3 == 0).withColumn("detected", r6(F.col("detected")))


@query(
    "two_level_summary",
    f"""WITH x AS ({ANSWERS_SQL}), y AS (SELECT o_orderstatus, o_orderpriority, (abs(n - p) < 0.01)::INT AS e FROM x)
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(e), 6) AS num_exact FROM y GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def two_level_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = answers(spark, sf).withColumns({"num_exact": N.number_scores(F.col("gold"), F.col("pred"))["exact"], "exact_match": F.lit(0), "token_f1": F.lit(0.0), "abstained": F.lit(False)})
    return S.two_level(x, "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", "n", r6(F.col("num_exact")).alias("num_exact"))


# Statistics.

_BOOT = 200
#: Replicates of the intervals: as many as the library makes by default.
_INTERVAL = B.REPLICATES


@query(
    "bootstrap_ci",
    f"""WITH r AS (SELECT c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
d AS (SELECT c_mktsegment, n, b.b, j.j, {D.md5_number('42', 'b.b', 'j.j')} % n AS i FROM (SELECT DISTINCT c_mktsegment, n FROM r) g CROSS JOIN range({_INTERVAL}) b(b) CROSS JOIN LATERAL range(g.n) j(j)),
m AS (SELECT d.c_mktsegment, b, avg(v) AS mean FROM d JOIN r ON r.c_mktsegment = d.c_mktsegment AND r.i = d.i GROUP BY ALL), o AS (SELECT c_mktsegment, list_sort(list(mean)) AS l FROM m GROUP BY 1)
SELECT o.c_mktsegment, round(c.mean, 4) AS mean, round(l[{int(0.025 * _INTERVAL) + 1}], 4) AS lower, round(l[{int(0.975 * _INTERVAL) + 1}], 4) AS upper, c.n FROM o JOIN (SELECT c_mktsegment, avg(c_acctbal) AS mean, count(*) AS n FROM customer GROUP BY 1) c USING (c_mktsegment)""",
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    ci = B.bootstrap_ci(table(spark, sf, "customer"), "c_acctbal", "c_custkey", ["c_mktsegment"], _INTERVAL)
    return ci.select("c_mktsegment", *(F.round(c, 4).alias(c) for c in ("mean", "lower", "upper")), "n")


@query(
    "resampled_in_parts",
    """WITH c AS (SELECT c_mktsegment, avg(c_acctbal) AS mean, count(*) AS n, stddev_pop(c_acctbal) / sqrt(count(*)) AS se FROM customer GROUP BY 1)
SELECT c_mktsegment, round(mean, 4) AS mean, n, TRUE AS lower_as_normal, TRUE AS upper_as_normal FROM c""",
)
def resampled_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of draws split over parts; each bound lies where the normal limit has it, give or take a fifth of the half width."""
    c = table(spark, sf, "customer")
    ci = B.bootstrap_ci(c, "c_acctbal", "c_custkey", ["c_mktsegment"], draws="parts")
    se = c.groupBy("c_mktsegment").agg((F.stddev_pop("c_acctbal") / F.sqrt(F.count("*"))).alias("se"))
    near = lambda side: F.abs(F.abs(F.col(side) - F.col("mean")) / (1.96 * F.col("se")) - 1) < 0.2
    return ci.join(se, "c_mktsegment").select("c_mktsegment", F.round("mean", 4).alias("mean"), "n", near("lower").alias("lower_as_normal"), near("upper").alias("upper_as_normal"))


@query(
    "paired_bootstrap",
    f"""WITH r AS (SELECT s_nationkey % 3 AS k, (s_acctbal > 4000)::INT - (s_acctbal > 5000)::INT AS d, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey % 3) AS n FROM supplier),
c AS (SELECT k, avg(d) AS delta, count(*) AS n FROM r GROUP BY k),
x AS (SELECT c.k, c.n, c.delta, b.b, {D.md5_number('42', 'b.b', 'j.j')} % c.n AS i FROM c CROSS JOIN range({_BOOT}) b(b) CROSS JOIN LATERAL range(c.n) j(j)),
m AS (SELECT x.k, x.b, any_value(x.delta) AS delta, avg(r.d) AS mean FROM x JOIN r ON r.k = x.k AND r.i = x.i GROUP BY x.k, x.b)
SELECT m.k, round(any_value(m.delta), 6) AS delta, round(avg((abs(mean - m.delta) >= abs(m.delta))::INT), 6) AS p_value, any_value(c.n) AS n FROM m JOIN c ON c.k = m.k GROUP BY m.k""",
)
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 3).alias("k"), "s_suppkey", (F.col("s_acctbal") > 4000).cast("int").alias("a"), (F.col("s_acctbal") > 5000).cast("int").alias("b")
    )
    return B.paired_bootstrap(x, "a", "b", "s_suppkey", ["k"], _BOOT).select("k", r6(F.col("delta")).alias("delta"), r6(F.col("p_value")).alias("p_value"), "n")


@query(
    "company_split",
    """WITH x AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS sector, s_name AS company, md5('42:' || CAST(s_nationkey AS VARCHAR) || ':' || s_name) AS m FROM supplier),
a AS (SELECT sector, company, row_number() OVER (PARTITION BY sector ORDER BY m) AS r FROM x WHERE sector IN ('1', '2')), b AS (SELECT sector, company, row_number() OVER (ORDER BY m) AS r, count(*) OVER () AS n FROM x WHERE sector NOT IN ('1', '2'))
SELECT sector, company, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'dev' ELSE 'train' END AS split FROM a
UNION ALL SELECT sector, company, CASE WHEN r <= greatest(1, round_even(0.6 * n, 0)) THEN 'train' WHEN r <= greatest(1, round_even(0.6 * n, 0)) + greatest(1, round_even(0.2 * n, 0)) THEN 'dev' ELSE 'test' END FROM b""",
)
def company_split(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("sector"), F.col("s_name").alias("company"))
    return B.company_split(x, "sector", "company", ["1", "2"])


# Reports.

_RUNS = "SELECT 'm' || (l_suppkey % 4) AS model, CASE l_linenumber % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'multihop' END AS tier, CASE l_orderkey % 2 WHEN 0 THEN 'zero_shot' ELSE 'closed_book' END AS regime, l_discount AS score, l_orderkey, l_linenumber FROM lineitem"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('m', l_suppkey % 4) AS model", "CASE l_linenumber % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'multihop' END AS tier",
        "CASE l_orderkey % 2 WHEN 0 THEN 'zero_shot' ELSE 'closed_book' END AS regime", "l_discount AS score", "l_orderkey", "l_linenumber",
    )


@query(
    "regime_pivot_delta",
    f"""WITH x AS ({_RUNS}), y AS (SELECT model, tier, avg(score) FILTER (regime = 'zero_shot') AS z, avg(score) FILTER (regime = 'closed_book') AS c FROM x GROUP BY ALL)
SELECT model, tier, round(z, 6) AS zero_shot, round(c, 6) AS closed_book, round(c - z, 6) AS delta FROM y""",
)
def regime_pivot_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = R.regime_delta(runs(spark, sf), "model", "tier", "regime", "score")
    return d.select("model", "tier", *(r6(F.col(c)).alias(c) for c in ("zero_shot", "closed_book", "delta")))


@query(
    "tier_degradation",
    f"""WITH x AS ({_RUNS}), y AS (SELECT model, tier, avg(score) AS s, CASE tier WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END AS o FROM x GROUP BY ALL)
SELECT model, tier, round(s, 6) AS score, round(s - lag(s) OVER (PARTITION BY model ORDER BY o), 6) AS delta FROM y""",
)
def tier_degradation(spark: SparkSession, sf: str) -> DataFrame:
    return R.tier_delta(runs(spark, sf), "model", "tier", "score").select("model", "tier", r6(F.col("score")).alias("score"), r6(F.col("delta")).alias("delta"))


@query("model_ranking", f"WITH x AS ({_RUNS}), y AS (SELECT model, round(avg(score), 6) AS score FROM x GROUP BY model) SELECT model, score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank FROM y")
def model_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(runs(spark, sf).groupBy("model").agg(r6(F.avg("score")).alias("score")), "score")


@query(
    "near_miss_topk",
    f"""WITH x AS ({STATEMENTS_SQL}), t AS (SELECT l_orderkey * 10 + l_linenumber AS key, {_g} AS gt, {_p} AS pt, {D.norm('gold')} = {D.norm('pred')} AS em FROM x), s AS (SELECT key, em, {D.set_f1('gt', 'pt')} AS f FROM t)
SELECT key, round(f, 6) AS token_f1 FROM s WHERE NOT em AND f >= 0.7::DOUBLE ORDER BY f DESC, key LIMIT 10""",
)
def near_miss_topk(spark: SparkSession, sf: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    x = statements(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), M.exact_match(g, p).alias("exact_match"), M.token_f1(g, p)["f1"].alias("token_f1"), F.lit(False).alias("failed"))
    return R.near_misses(x, "key").select("key", r6(F.col("token_f1")).alias("token_f1"))


@query(
    "error_summary",
    """WITH x AS (SELECT o_orderstatus AS run, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout ' || (o_orderkey % 3) END AS error FROM orders), b AS (SELECT * FROM x WHERE error IS NOT NULL),
s AS (SELECT run, list(error ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) AS r FROM b) WHERE r <= 3 GROUP BY run)
SELECT c.run, c.errors, array_to_string(s.samples, '; ') AS samples FROM (SELECT run, count(*) AS errors FROM b GROUP BY ROLLUP (run)) c LEFT JOIN s ON s.run = c.run""",
)
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").selectExpr("o_orderstatus AS run", "o_orderkey", "CASE WHEN o_orderkey % 17 = 0 THEN concat('timeout ', o_orderkey % 3) END AS error")
    return R.error_summary(x, "run", "error", "o_orderkey").withColumn("samples", F.array_join("samples", "; "))


@query(
    "question_counts",
    """WITH x AS (SELECT event_type AS tier, CAST(user_id % 3 AS VARCHAR) AS kind FROM events) SELECT tier, kind, CAST(grouping(tier) * 2 + grouping(kind) AS BIGINT) AS level, count(*) AS n FROM x GROUP BY GROUPING SETS ((), (tier), (tier, kind))""",
)
def question_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select(F.col("event_type").alias("tier"), (F.col("user_id") % 3).cast("string").alias("kind"))
    return R.question_counts(x, "tier", "kind").select("tier", "kind", "level", "n")


@query(
    "run_names",
    """WITH x AS (SELECT p_partkey, 'model-' || (p_partkey % 5) || CASE p_partkey % 4 WHEN 0 THEN '_easy_zero_shot' WHEN 1 THEN '_hard_closed_book_markdown' WHEN 2 THEN '_multihop_few_shot' ELSE '-untiered' END AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '?' ELSE 'model-' || (p_partkey % 5) END AS model, CASE p_partkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' WHEN 2 THEN 'multihop' ELSE '?' END AS tier,
CASE p_partkey % 4 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'closed_book_markdown' WHEN 2 THEN 'few_shot' ELSE '?' END AS regime FROM x""",
)
def run_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr("concat('model-', p_partkey % 5, CASE p_partkey % 4 WHEN 0 THEN '_easy_zero_shot' WHEN 1 THEN '_hard_closed_book_markdown' WHEN 2 THEN '_multihop_few_shot' ELSE '-untiered' END, '.json')")
    return table(spark, sf, "part").select("p_partkey", R.run_name(name).alias("r")).select("p_partkey", "r.*")


@query(
    "judge_cache_pending",
    """WITH k AS (SELECT DISTINCT md5(o_orderpriority || '||' || o_orderstatus || '||' || CAST(o_custkey % 50 AS VARCHAR)) AS _key FROM orders), d AS (SELECT DISTINCT md5(o_orderpriority || '||' || o_orderstatus || '||' || CAST(o_custkey % 50 AS VARCHAR)) AS _key FROM orders WHERE o_custkey % 2 = 0)
SELECT _key FROM k WHERE _key NOT IN (SELECT _key FROM d)""",
)
def judge_cache_pending(spark: SparkSession, sf: str) -> DataFrame:
    key = M.judge_key(F.col("o_orderpriority"), F.col("o_orderstatus"), (F.col("o_custkey") % 50).cast("string")).alias("_key")
    o = table(spark, sf, "orders")
    return E.pending(o.select(key).distinct(), o.where("o_custkey % 2 = 0").select(key), "_key")


@query("pending_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_documents(spark: SparkSession, sf: str) -> DataFrame:
    return E.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(
    "run_matrix_pending",
    "SELECT DISTINCT t.p_brand, o.o_orderpriority FROM part t CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) o WHERE (t.p_brand, o.o_orderpriority) NOT IN (SELECT DISTINCT p_brand, o_orderpriority FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 50 AND l_discount > 0.05)",
)
def run_matrix_pending(spark: SparkSession, sf: str) -> DataFrame:
    brands = table(spark, sf, "part").select("p_brand").distinct()
    tiers = table(spark, sf, "orders").select("o_orderpriority").distinct()
    l = table(spark, sf, "lineitem").where("l_quantity = 50 AND l_discount > 0.05")
    done = l.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("p_brand", "o_orderpriority")
    return E.pending_matrix(brands, tiers, done, ["p_brand", "o_orderpriority"])
