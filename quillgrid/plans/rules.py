"""Queries on single rules: page marks, replies, prompts, ids, counters, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import numeric as N
from quillgrid.functions import replies as J
from quillgrid.functions import text as T
from quillgrid.operators import bundles as U
from quillgrid.operators import documents as O
from quillgrid.operators import external as E
from quillgrid.operators import reports as R
from quillgrid.operators import scorecard as S
from quillgrid.operators import stats as B
from quillgrid.plans import duck as D
from quillgrid.plans.catalog import query, table


def r6(c: Column) -> Column:
    return F.round(c, 6)


@query(
    "page_marks",
    """SELECT p_partkey, chr(10) || chr(10) || '__PAGE_' || p_size || '__' || chr(10) || chr(10) || p_name || '<!-- image: ' || p_brand || ' -->' || 'tail' AS marked, CAST(p_size AS VARCHAR) AS pages FROM part""",
)
def page_marks(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat('<page_number>', p_size, '</page_number>', p_name, '<IMG>', p_brand, '</IMG><watermark>gone', p_size, '</watermark>tail')")
    x = table(spark, sf, "part").select("p_partkey", T.mark_pages(raw).alias("marked"))
    return x.select("p_partkey", "marked", F.array_join(T.page_numbers(F.col("marked")).cast("array<string>"), ",").alias("pages"))


@query("markdown_normal_form", "SELECT p_partkey, p_name || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || p_type AS text FROM part")
def markdown_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("\r\n\n\n\n"), "p_brand", F.lit("\n --- \r\n\n"), "p_type")
    return table(spark, sf, "part").select("p_partkey", T.normalize_markdown(raw).alias("text"))


@query("complete_sentences", """SELECT doc_id, regexp_matches(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), '[.。!?"'')}\\]]$') AS complete FROM documents""")
def complete_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.is_complete(F.col("text")).alias("complete"))


_PAGE = "CASE event_id % 5 WHEN 0 THEN concat('Traceback of ', event_id) WHEN 1 THEN ' x ' WHEN 2 THEN concat(repeat('a', 120), ' error processing') WHEN 3 THEN 'Unable to get page' ELSE concat('Page ', event_id) END"


@query(
    "page_validity",
    "SELECT event_id, event_id % 5 IN (0, 3) AS ocr_error, event_id % 5 IN (2, 4) AS valid FROM events",
)
def page_validity(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("event_id", F.expr(_PAGE).alias("t"))
    return x.select("event_id", T.is_ocr_error(F.col("t")).alias("ocr_error"), T.is_valid_page(F.col("t")).alias("valid"))


@query("csv_scrubbing", """SELECT doc_id, left(translate(text, chr(34) || chr(10), chr(39) || ' '), 400) AS cell FROM documents""")
def csv_scrubbing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.csv_scrub(F.col("text")).alias("cell"))


@query("table_balance", "SELECT p_partkey, p_size % 3 <> 0 AS unbalanced FROM part")
def table_balance(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat('<TABLE a=1>', p_name, CASE p_size % 3 WHEN 0 THEN '</table>' WHEN 1 THEN '' ELSE '</table></Table>' END)")
    return table(spark, sf, "part").select("p_partkey", T.unbalanced_tables(raw).alias("unbalanced"))


@query(
    "bundle_id_intervals",
    "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_brand || ':' || p_size END AS first, CASE WHEN p_size % 3 < 2 THEN p_brand || ':' || (p_size + 3) END AS last FROM part",
)
def bundle_id_intervals(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("CASE p_size % 3 WHEN 0 THEN concat(p_brand, ':', p_size, '_to_', p_brand, ':', p_size + 3) WHEN 1 THEN concat(p_brand, ':', p_size, '_to_', p_brand, ':', p_size + 3, '_x') ELSE concat(p_brand, '_to_', p_size) END")
    i = U.interval(raw)
    return table(spark, sf, "part").select("p_partkey", i["first"].alias("first"), i["last"].alias("last"))


@query(
    "company_preambles",
    """SELECT s_suppkey, 'Company: ' || replace(s_name, '_', ' ') || chr(10) || 'Sector: ' || CASE s_suppkey % 4 WHEN 0 THEN 'A B' WHEN 1 THEN 'FMCG' WHEN 2 THEN 'Automotive' ELSE 'Private Sector Banking' END || chr(10) || 'Fiscal year: ' || CASE s_suppkey % 3 WHEN 0 THEN 'FY' || y || ' (April ' || (y - 1) || ' – March ' || y || ')' WHEN 1 THEN CAST(y AS VARCHAR) ELSE 'FY20XX' END AS preamble
FROM (SELECT *, 2000 + s_suppkey % 30 AS y FROM supplier)""",
)
def company_preambles(spark: SparkSession, sf: str) -> DataFrame:
    year = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('FY', 2000 + s_suppkey % 30) WHEN 1 THEN cast(2000 + s_suppkey % 30 AS string) ELSE 'FY20XX' END")
    sector = F.element_at(F.array(*map(F.lit, ("A_B", "Fast_Moving_Consumer_Goods", "Automobile", "Private_Sector_Bank"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", E.company_preamble(F.col("s_name"), sector, year).alias("preamble"))


@query(
    "chat_prompts",
    """SELECT doc_id, 'user' AS role, CASE WHEN doc_id % 2 = 0 THEN 'Context:' || chr(10) || text || chr(10) || chr(10) ELSE '' END || 'Question: q' || doc_id AS content, 2 AS messages FROM documents""",
)
def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    q = F.concat(F.lit("q"), F.col("doc_id").cast("string"))
    made = F.when(F.col("doc_id") % 2 == 0, E.messages(q, F.col("text"), "zero_shot")).otherwise(E.messages(q, F.col("text"), "closed_book"))
    x = table(spark, sf, "documents").select("doc_id", made.alias("m"))
    return x.select("doc_id", F.col("m")[1]["role"].alias("role"), F.col("m")[1]["content"].alias("content"), F.size("m").alias("messages"))


@query(
    "completion_prompts",
    """SELECT doc_id, 'Context:' || chr(10) || CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '[... truncated ...]' ELSE text END || chr(10) || chr(10) || 'Question: why' || chr(10) || 'Answer:' AS prompt FROM documents""",
)
def completion_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", E.completion_prompt(F.lit("why"), F.col("text"), 500).alias("prompt"))


@query(
    "question_prompts",
    """SELECT p_partkey, 'Ask about one stated fact: a figure, a date, a name. Nothing may have to be worked out or guessed.' || chr(10) || 'Write at most ' || CASE WHEN p_size % 2 = 0 THEN 2 WHEN p_size >= 18 THEN 4 WHEN p_size >= 11 THEN 2 ELSE 1 END
|| ' question-answer pairs, fewer where the text does not carry them.' || chr(10) || '- Reply with a JSON array of objects with the keys question, answer, evidence, question_type, requires_calculation.' || chr(10)
|| '- question_type is one of Text Only, Table Only, Table with Text, Numerical Calculation, Sentiment Divergence.' || chr(10) || '- requires_calculation is true only if the answer is not stated and has to be computed.' || chr(10)
|| '- evidence is copied from the text to the letter, tables with their markup, without cuts.' || chr(10) || 'Such questions are, in words of your own:' || chr(10)
|| '- How high were the year''s sales?' || chr(10) || '- Who audits the accounts?' || chr(10) || '- On which day was the meeting held?' || chr(10) || chr(10)
|| 'Sector: ' || p_brand || chr(10) || '<text>' || chr(10) || p_name || chr(10) || '</text>' AS prompt FROM part""",
)
def question_prompts(spark: SparkSession, sf: str) -> DataFrame:
    budget = T.question_budget(F.col("p_size"), F.col("p_size") % 2 == 0)
    return table(spark, sf, "part").select("p_partkey", E.question_prompt(F.col("p_name"), "easy", budget, sector=F.col("p_brand")).alias("prompt"))


@query("stream_replies", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || p_size ELSE p_brand END AS reply FROM part")
def stream_replies(spark: SparkSession, sf: str) -> DataFrame:
    delta = lambda c: f"concat('data: {{\"choices\":[{{\"delta\":{{\"content\":\"', {c}, '\"}}}}]}}\\n')"
    raw = F.concat(F.expr(delta("p_brand")), F.when(F.col("p_size") % 2 == 1, F.lit("data: [DONE]\n")).otherwise(F.lit(": ping\n")), F.expr(delta("p_size")), F.lit("data: [DONE]\n"))
    return table(spark, sf, "part").select("p_partkey", J.stream_text(raw).alias("reply"))


@query(
    "unit_hints",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 1e7 WHEN 1 THEN p_size * 1e5 WHEN 2 THEN p_size * 1e6 ELSE p_size::DOUBLE END AS value FROM part",
)
def unit_hints(spark: SparkSession, sf: str) -> DataFrame:
    hint = F.expr("CASE p_size % 4 WHEN 0 THEN 'in Crores' WHEN 1 THEN '(Rs lakh)' WHEN 2 THEN 'MN' ELSE 'units' END")
    return table(spark, sf, "part").select("p_partkey", N.with_unit_hint(F.col("p_size").cast("string"), hint).alias("value"))


@query(
    "judge_candidates",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND (o_orderstatus = 'O' OR o_orderkey % 3 = 0)",
)
def judge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 7 = 0 AS failed", "o_orderkey % 5 = 0 AS abstained", "o_orderstatus = 'O' AS requires_calculation",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Table Only' WHEN o_orderkey % 3 = 1 THEN 'Text Only' END AS question_type",
    )
    return S.judge_candidates(x).select("o_orderkey")


@query(
    "split_statistics",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || n_name || ':' || c_name)) AS r, count(*) OVER () AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, CASE WHEN r <= greatest(1, round_even(0.6 * n, 0)) THEN 'train' WHEN r <= greatest(1, round_even(0.6 * n, 0)) + greatest(1, round_even(0.2 * n, 0)) THEN 'dev' ELSE 'test' END AS split FROM r)
SELECT split, count(DISTINCT c_name) AS companies, count(DISTINCT n_name) AS sectors FROM s GROUP BY split""",
)
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return B.split_stats(B.company_split(named, "n_name", "c_name"), "n_name", "c_name")


@query("split_disjointness", "SELECT count(*) AS overlaps FROM (SELECT c_name FROM customer GROUP BY c_name HAVING count(DISTINCT c_nationkey) > 1)")
def split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    # A name with two nations is two companies, which may come into two splits; others never do.
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return B.split_overlaps(B.company_split(named, "n_name", "c_name"), "c_name").agg(F.count("*").alias("overlaps"))


@query(
    "last_cached_answers",
    "SELECT custkey AS question_id, arg_max(reply, asked * 10000000000 + k) AS reply FROM (SELECT o_custkey AS custkey, 'r' || o_orderkey AS reply, o_orderkey % 1000 AS asked, o_orderkey AS k FROM orders) GROUP BY custkey",
)
def last_cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    cache = table(spark, sf, "orders").selectExpr("o_custkey AS question_id", "concat('r', o_orderkey) AS reply", "o_orderkey % 1000 AS asked", "o_orderkey AS k")
    return E.last_cached(cache, "question_id", F.struct("asked", "k")).select("question_id", "reply")


@query(
    "paired_significance",
    """WITH a AS (SELECT o_custkey AS k, arg_max(o_orderkey % 10 / 10.0::DOUBLE, o_orderkey) AS x, arg_max(o_orderkey % 7 / 10.0::DOUBLE, o_orderkey) AS y FROM orders GROUP BY 1) SELECT count(*) AS n, round(avg(x - y), 6) AS delta FROM a""",
)
def paired_significance(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").orderBy("o_orderkey").selectExpr("o_custkey AS k", "o_orderkey % 10 / 10.0D AS x", "o_orderkey % 7 / 10.0D AS y")
    found = B.significance_table(runs.select("k", F.col("x").alias("m")), runs.select("k", F.col("y").alias("m")), "k", ["m"], 20)
    return found.select("n", r6(F.col("delta")).alias("delta"))


@query(
    "document_states",
    """SELECT o_custkey AS doc, count(*) AS pages, CAST(sum((o_orderkey % 4 = 0)::INT) AS BIGINT) AS failed, CASE WHEN sum((o_orderkey % 4 = 0)::INT) = 0 THEN 'ok' WHEN sum((o_orderkey % 4 = 0)::INT) < count(*) THEN 'partial' ELSE 'failed' END AS status FROM orders GROUP BY 1""",
)
def document_states(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "orders").selectExpr("o_custkey AS doc", "CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status")
    return E.document_status(pages, "doc")


_STATES_SQL = """SELECT doc, pages, failed, CASE WHEN failed = 0 THEN 'ok' WHEN failed < pages THEN 'partial' ELSE 'failed' END AS status FROM (SELECT o_custkey AS doc, count(*) AS pages, sum((o_orderkey % 4 = 0)::INT) AS failed FROM orders GROUP BY 1)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "orders").selectExpr("o_custkey AS doc", "CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status")
    return E.document_status(pages, "doc")


@query(
    "processing_counters",
    f"SELECT status, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(failed) AS BIGINT) AS failed FROM ({_STATES_SQL}) GROUP BY ROLLUP (status)",
)
def processing_counters(spark: SparkSession, sf: str) -> DataFrame:
    return E.processing_counters(_states(spark, sf))


@query("retry_set", f"SELECT doc FROM ({_STATES_SQL}) WHERE status = 'partial' UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def retry_set(spark: SparkSession, sf: str) -> DataFrame:
    reports = table(spark, sf, "customer").selectExpr("c_custkey AS doc", "c_custkey % 10 <> 0 AS complete")
    return E.retry_set(_states(spark, sf), reports, "doc")


@query("failed_page_places", "SELECT conv_id, turn + 1 AS page FROM conversations WHERE turn % 3 = 1")
def failed_page_places(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 3 = 1 THEN '**EXTRACTION FAILED**' ELSE 'text' END AS t")
    stitched = talk.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n\n---\n\n").alias("text"))
    return O.failed_pages(stitched, "conv_id")


@query(
    "tier_changes",
    """WITH m AS (SELECT o_orderstatus AS model, CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS tier, avg(o_totalprice::DOUBLE) AS price FROM orders GROUP BY ALL)
SELECT model, tier, round(price, 4) AS price, round(price - lag(price) OVER (PARTITION BY model ORDER BY CASE tier WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END), 4) AS delta FROM m""",
)
def tier_changes(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").selectExpr("o_orderstatus AS model", "CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS tier", "cast(o_totalprice AS double) AS price")
    return R.tier_delta(x, "model", "tier", "price").select("model", "tier", F.round("price", 4).alias("price"), F.round("delta", 4).alias("delta"))


@query(
    "metric_interval_centres",
    "SELECT m AS metric, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT unnest(['exact_match', 'token_f1']) AS m, unnest([(o_orderkey % 2)::DOUBLE, (o_orderkey % 10) / 10.0::DOUBLE]) AS x FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY m",
)
def metric_interval_centres(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 9 = 0 AS failed", "cast(o_orderkey % 2 AS int) AS exact_match", "o_orderkey % 10 / 10.0D AS token_f1")
    found = B.metric_intervals(x, "o_orderkey", ("exact_match", "token_f1"), 20)
    return found.where("lower <= mean AND mean <= upper").select("metric", r6(F.col("mean")).alias("mean"), "n")


_DRAWS = f"""SELECT g.metric, n, b.b, {D.md5_number('42', 'b.b', 'j.j')} % n AS i FROM (SELECT DISTINCT metric, n FROM r) g CROSS JOIN range(20) b(b) CROSS JOIN LATERAL range(g.n) j(j)"""


@query(
    "metric_interval_bounds",
    f"""WITH x AS (SELECT o_orderkey, unnest(['exact_match', 'token_f1']) AS metric, unnest([(o_orderkey % 2)::DOUBLE, (o_orderkey % 10) / 10.0::DOUBLE]) AS v FROM orders WHERE o_orderkey % 9 <> 0),
r AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM x), d AS ({_DRAWS}),
m AS (SELECT d.metric, b, avg(v) AS mean FROM d JOIN r ON r.metric = d.metric AND r.i = d.i GROUP BY ALL), o AS (SELECT metric, list_sort(list(mean)) AS l FROM m GROUP BY metric)
SELECT metric, round(avg(v), 6) AS mean, round(any_value(l[1]), 6) AS lower, round(any_value(l[20]), 6) AS upper, count(*) AS n FROM r JOIN o USING (metric) GROUP BY metric""",
)
def metric_interval_bounds(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 9 = 0 AS failed", "cast(o_orderkey % 2 AS int) AS exact_match", "o_orderkey % 10 / 10.0D AS token_f1")
    found = B.metric_intervals(x, "o_orderkey", ("exact_match", "token_f1"), 20, draws="md5")
    return found.select("metric", *(r6(F.col(c)).alias(c) for c in ("mean", "lower", "upper")), "n")


@query(
    "paired_p_values",
    f"""WITH a AS (SELECT c_custkey, (c_acctbal > 4000)::INT - (c_acctbal > 4500)::INT AS u, (c_custkey % 7)::INT - (c_custkey % 5)::INT AS w FROM customer WHERE c_nationkey = 3 OR c_nationkey = 7),
x AS (SELECT c_custkey, unnest(['balance', 'key']) AS metric, unnest([u, w]) AS v FROM a), r AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM x),
d AS ({_DRAWS}), c AS (SELECT metric, avg(v) AS delta FROM x GROUP BY metric), m AS (SELECT d.metric, b, avg(v) AS mean FROM d JOIN r ON r.metric = d.metric AND r.i = d.i GROUP BY ALL)
SELECT metric, round(any_value(delta), 6) AS delta, round(avg((abs(mean - delta) >= abs(delta))::INT), 6) AS p_value, avg((abs(mean - delta) >= abs(delta))::INT) < 0.05 AS significant, (SELECT count(*) FROM a) AS n FROM m JOIN c USING (metric) GROUP BY metric""",
)
def paired_p_values(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "customer").where("c_nationkey = 3 OR c_nationkey = 7")
    run = lambda balance, key: some.selectExpr("c_custkey", f"cast({balance} AS double) AS balance", f"cast({key} AS double) AS key")
    found = B.significance_table(run("c_acctbal > 4000", "c_custkey % 7"), run("c_acctbal > 4500", "c_custkey % 5"), "c_custkey", ["balance", "key"], 20, draws="md5")
    return found.select("metric", r6(F.col("delta")).alias("delta"), r6(F.col("p_value")).alias("p_value"), "significant", "n")


@query(
    "latency_and_judge_means",
    "SELECT o_orderstatus AS key, count(*) AS n, round(avg(o_totalprice::DOUBLE), 1) AS latency_ms, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END), 6) AS llm_num_equiv FROM orders GROUP BY 1",
)
def latency_and_judge_means(spark: SparkSession, sf: str) -> DataFrame:
    zero = {m: F.lit(0.0) for m in S.MEANS} | {f"tol{k}_acc": F.lit(0) for k in S.TOLERANCES}
    flags = {"failed": F.lit(False), "abstained": F.lit(False), "numeric_gold": F.lit(False), "directional_acc": F.lit(None).cast("int")}
    x = table(spark, sf, "orders").withColumns({**zero, **flags, "latency_ms": F.col("o_totalprice").cast("double"), "llm_num_equiv": F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 2).cast("int"))})
    card = S.scorecard(x, ["o_orderstatus"], ("latency_ms", "llm_num_equiv")).where("axis = 'o_orderstatus'")
    return card.select("key", "n", F.round("latency_ms", 1).alias("latency_ms"), r6(F.col("llm_num_equiv")).alias("llm_num_equiv"))
