"""Queries on documents: blocks, sections, chunks, bundles, tables, replies, pages, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import replies as J
from quillgrid.functions import tables as H
from quillgrid.functions import text as T
from quillgrid.operators import bundles as U
from quillgrid.operators import documents as O
from quillgrid.operators import external as E
from quillgrid.plans import duck as D
from quillgrid.plans.catalog import query, table
from quillgrid.session import shared_dir
from quillgrid.streaming import incremental as I

# Documents as Markdown: every seventh line (from the first) a heading, lines parted by blank lines.
LINES_SQL = "SELECT doc_id, k - 1 AS pos, CASE WHEN (k - 1) % 7 = 0 THEN '## ' || l ELSE l END AS text, (k - 1) % 7 = 0 AS head, l FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents))"


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(lines, lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(marked, "\n\n").alias("text"))


@query(
    "section_carry_forward",
    f"""WITH x AS ({LINES_SQL}) SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(CASE WHEN head THEN trim(l) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section, {D.token_estimate('text')} AS tokens FROM x""",
)
def section_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return O.block_rows(markdown(spark, sf)).select("doc_id", "pos", "section", "tokens")


_ROOTED = "SELECT *, CAST(length(text) AS BIGINT) AS len, regexp_matches(rtrim(text), '[.。!?\"'')}\\]]$') AS closed FROM (" + f"""SELECT doc_id, pos, text, last_value(CASE WHEN head THEN trim(l) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section, {D.token_estimate('text')} AS tokens FROM ({LINES_SQL})""" + ")"
# Blocks are dealt to chunks one after another: a new section closes a chunk of 240 tokens, 800 close it anyhow, 900 are its limit.
PACK_SQL = f"""l AS ({_ROOTED}), p AS (
  SELECT doc_id, pos, 0 AS chunk, tokens AS held, section FROM l WHERE pos = 0
  UNION ALL
  SELECT l.doc_id, l.pos, CASE WHEN new THEN chunk + 1 ELSE chunk END, CASE WHEN new THEN l.tokens ELSE held + l.tokens END, l.section
  FROM (SELECT p.*, n.tokens AS more, n.section AS next, (n.section <> p.section AND held >= 240) OR held + n.tokens > 900 OR held >= 800 AS new FROM p JOIN l n ON n.doc_id = p.doc_id AND n.pos = p.pos + 1) q
  JOIN l ON l.doc_id = q.doc_id AND l.pos = q.pos + 1),
c AS (SELECT p.doc_id, p.chunk, arg_min(l.section, l.pos) AS section, CAST(sum(l.tokens) AS INTEGER) AS tokens, NOT arg_max(l.closed, l.pos) AS is_truncated, CAST(sum(l.len) + 2 * (count(*) - 1) AS INTEGER) AS n_chars
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.pos = p.pos GROUP BY p.doc_id, p.chunk)"""


@query("chunk_pack", f"WITH RECURSIVE {PACK_SQL} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, section, tokens, is_truncated, n_chars FROM c")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    return O.pack_chunks(O.block_rows(markdown(spark, sf))).select("doc_id", "chunk", "section", "tokens", "is_truncated", F.length("text").alias("n_chars"))


@query(
    "merge_truncated_chunks",
    f"""WITH RECURSIVE {PACK_SQL}, m AS (
  SELECT doc_id, chunk, chunk AS lead, tokens AS held, is_truncated FROM c WHERE chunk = 0
  UNION ALL
  SELECT c.doc_id, c.chunk, CASE WHEN m.is_truncated AND held + c.tokens <= 900 THEN lead ELSE c.chunk END, CASE WHEN m.is_truncated AND held + c.tokens <= 900 THEN held + c.tokens ELSE c.tokens END, c.is_truncated
  FROM m JOIN c ON c.doc_id = m.doc_id AND c.chunk = m.chunk + 1)
SELECT m.doc_id, CAST(lead AS INTEGER) AS chunk, CAST(sum(c.tokens) AS INTEGER) AS tokens, arg_max(c.is_truncated, c.chunk) AS is_truncated, CAST(sum(c.n_chars) + 2 * (count(*) - 1) AS INTEGER) AS n_chars
FROM m JOIN c ON c.doc_id = m.doc_id AND c.chunk = m.chunk GROUP BY m.doc_id, lead""",
)
def merge_truncated_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return O.merge_truncated(O.pack_chunks(O.block_rows(markdown(spark, sf)))).select("doc_id", "chunk", "tokens", "is_truncated", F.length("text").alias("n_chars"))


@query(
    "chunk_validation",
    f"""WITH RECURSIVE {PACK_SQL} SELECT level, issue, count(*) AS n FROM (
  SELECT 'warning' AS level, 'incomplete sentence' AS issue FROM c WHERE is_truncated UNION ALL SELECT 'error', 'empty text' FROM c WHERE n_chars = 0
  UNION ALL SELECT 'warning', 'too many tokens' FROM c WHERE tokens > 1000 UNION ALL SELECT 'warning', 'no section' FROM c WHERE section = 'root') GROUP BY level, issue""",
)
def chunk_validation(spark: SparkSession, sf: str) -> DataFrame:
    return O.chunk_issues(O.pack_chunks(O.block_rows(markdown(spark, sf)))).groupBy("level", "issue").agg(F.count("*").alias("n"))


# Documents as chunks that break rules: some blank, with open tables, long, cut off, without a section.
@query(
    "chunk_rules",
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 5 = 0 THEN coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN '<TABLE><tr><td>1' ELSE '<table></table>' END ELSE coalesce(text, '') END AS text, doc_id % 5 = 0 AS has_table,
  n_chars % 2000 AS tokens, doc_id % 3 = 0 AS cut, doc_id % 4 = 0 AS rooted, doc_id % 8 = 0 AS oversized FROM documents),
i AS (SELECT doc_id, unnest(list_filter([CASE WHEN cut THEN 'warning: incomplete sentence' END, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'error: empty text' END,
  CASE WHEN has_table AND (length(lower(text)) - length(replace(lower(text), '<table', ''))) // 6 <> (length(lower(text)) - length(replace(lower(text), '</table>', ''))) // 8 THEN 'error: unbalanced table tags' END,
  CASE WHEN tokens > 1000 THEN 'warning: too many tokens' END, CASE WHEN rooted AND NOT oversized THEN 'warning: no section' END], lambda x: x IS NOT NULL)) AS issue FROM x)
SELECT doc_id, string_agg(issue, '; ' ORDER BY issue) AS issues FROM i GROUP BY doc_id""",
)
def chunk_rules(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").selectExpr(
        "doc_id", "0 AS chunk", "doc_id % 5 = 0 AS has_table", "cast(n_chars % 2000 AS int) AS tokens", "doc_id % 3 = 0 AS is_truncated", "if(doc_id % 4 = 0, 'root', 'A') AS section", "doc_id % 8 = 0 AS oversized_table",
        "CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 5 = 0 THEN concat(coalesce(text, ''), if(doc_id % 10 = 0, '<TABLE><tr><td>1', '<table></table>')) ELSE coalesce(text, '') END AS text",
    )
    found = O.chunk_issues(x).select("doc_id", F.concat_ws(": ", "level", "issue").alias("issue"))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("issues"))


@query("token_estimates", f"SELECT doc_id, {D.token_estimate('text')} AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "chunk_scores",
    f"""SELECT doc_id, CAST((CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN {D.any_of('lower(text)', D.SCORE_WORDS)} THEN 1 ELSE 0 END) + (CASE WHEN {D.any_of("lower('Risk Management ' || source)", D.PRIORITY_SECTIONS)} THEN 2 ELSE 0 END) AS INTEGER) AS score FROM documents""",
)
def chunk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.chunk_score(F.col("text"), F.concat(F.lit("Risk Management "), F.col("source")), F.col("doc_id") % 3 == 0).alias("score"))


# Documents of a source as its chunks, in order of id.
CHUNKS_SQL = "SELECT source, doc_id AS pos, source || ':' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS chunk_id, text, n_chars % 6 AS score, CASE (doc_id // 60) % 3 WHEN 0 THEN 'Risk' WHEN 1 THEN 'Audit' ELSE '' END AS section, doc_id % 5 = 0 AS has_table, [CAST(doc_id % 4 AS INTEGER), CAST(doc_id % 3 AS INTEGER)] AS pages FROM documents"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "source", "doc_id AS pos", "concat(source, ':', lpad(cast(doc_id AS string), 7, '0')) AS chunk_id", "text", "n_chars % 6 AS score",
        "CASE (doc_id div 60) % 3 WHEN 0 THEN 'Risk' WHEN 1 THEN 'Audit' ELSE '' END AS section", "doc_id % 5 = 0 AS has_table", "array(cast(doc_id % 4 AS int), cast(doc_id % 3 AS int)) AS pages",
    )


@query(
    "bundle_build",
    f"""WITH RECURSIVE x AS (SELECT *, CASE WHEN section = '' THEN 'root' ELSE section END AS name, row_number() OVER (PARTITION BY source ORDER BY pos) AS r FROM ({CHUNKS_SQL})),
e AS (SELECT *, name <> lead(name) OVER (PARTITION BY source ORDER BY pos) AS ends FROM x), b AS (
  SELECT source, r, 0 AS bundle, 1 AS held, ends FROM e WHERE r = 1
  UNION ALL
  SELECT e.source, e.r, CASE WHEN b.held >= 4 AND b.ends THEN bundle + 1 ELSE bundle END, CASE WHEN b.held >= 4 AND b.ends THEN 1 ELSE held + 1 END, e.ends FROM b JOIN e ON e.source = b.source AND e.r = b.r + 1),
n AS (SELECT e.*, b.bundle FROM e JOIN b ON b.source = e.source AND b.r = e.r),
s AS (SELECT source, bundle, string_agg(section, ' | ' ORDER BY first) AS section FROM (SELECT source, bundle, section, min(pos) AS first FROM n WHERE section <> '' GROUP BY ALL) GROUP BY ALL)
SELECT n.source, CAST(n.bundle AS INTEGER) AS bundle, arg_min(chunk_id, pos) || '_to_' || arg_max(chunk_id, pos) AS bundle_id, count(*) AS chunk_count, CAST(sum(score) AS BIGINT) AS score, bool_or(has_table) AS has_table,
coalesce(any_value(s.section), '') AS section, CAST(sum(length(text)) + 7 * (count(*) - 1) AS INTEGER) AS n_chars FROM n LEFT JOIN s ON s.source = n.source AND s.bundle = n.bundle GROUP BY n.source, n.bundle""",
)
def bundle_build(spark: SparkSession, sf: str) -> DataFrame:
    made = U.assemble(U.build(chunks(spark, sf), "source"), "source")
    return made.select("source", "bundle", "bundle_id", "chunk_count", "score", "has_table", "section", F.length("text").alias("n_chars"))


# Bundles of five documents each, by rank.
FIVES_SQL = f"SELECT *, (row_number() OVER (PARTITION BY source ORDER BY pos) - 1) // 5 AS bundle FROM ({CHUNKS_SQL})"


def fives(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).withColumn("bundle", F.expr("(row_number() OVER (PARTITION BY source ORDER BY pos) - 1) div 5"))


@query(
    "bundle_assembly",
    f"""WITH x AS ({FIVES_SQL}) SELECT source, bundle, arg_min(chunk_id, pos) || '_to_' || arg_max(chunk_id, pos) AS bundle_id, count(*) AS chunk_count, CAST(sum(score) AS BIGINT) AS score, bool_or(has_table) AS has_table,
md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS text_md5, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages FROM x GROUP BY source, bundle""",
)
def bundle_assembly(spark: SparkSession, sf: str) -> DataFrame:
    made = U.assemble(fives(spark, sf), "source")
    return made.select("source", "bundle", "bundle_id", "chunk_count", "score", "has_table", F.md5("text").alias("text_md5"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(
    "weak_merge",
    f"""WITH x AS (SELECT source, bundle, CAST(sum(score) AS BIGINT) AS score, count(*) AS chunk_count FROM ({FIVES_SQL}) GROUP BY source, bundle),
w AS (SELECT *, score BETWEEN 8 AND 10 AS weak FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bundle) - sum(weak::INT) OVER (PARTITION BY source ORDER BY bundle ROWS UNBOUNDED PRECEDING) AS run FROM w),
p AS (SELECT *, (row_number() OVER (PARTITION BY source, run, weak ORDER BY bundle) - 1) // 2 AS pair FROM r), m AS (SELECT *, CASE WHEN weak THEN min(bundle) OVER (PARTITION BY source, run, weak, pair) ELSE bundle END AS merged_bundle, weak AND count(*) OVER (PARTITION BY source, run, weak, pair) = 2 AS merged FROM p)
SELECT source, merged_bundle, CAST(sum(score) AS BIGINT) AS score, CAST(sum(chunk_count) AS BIGINT) AS chunk_count, bool_or(merged) AS merged FROM m GROUP BY source, merged_bundle HAVING sum(score) >= 8""",
)
def weak_merge(spark: SparkSession, sf: str) -> DataFrame:
    made = fives(spark, sf).groupBy("source", "bundle").agg(F.sum("score").alias("score"), F.count("*").alias("chunk_count"))
    return U.strong(U.merge_weak(made, "source"), "source")


@query(
    "bundle_interval_join",
    f"""WITH x AS ({FIVES_SQL}), b AS (SELECT source, bundle, min(pos) AS lo, max(pos) AS hi FROM x GROUP BY ALL)
SELECT source, bundle AS question, md5((SELECT string_agg(c.text, chr(10) || chr(10) ORDER BY c.pos) FROM x c WHERE c.source = b.source AND c.pos BETWEEN b.lo AND b.hi)) AS context_md5 FROM b""",
)
def bundle_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    c = fives(spark, sf)
    q = c.groupBy("source", F.col("bundle").alias("question")).agg(F.concat(F.min_by("chunk_id", "pos"), F.lit("_to_"), F.max_by("chunk_id", "pos")).alias("bundle_id"))
    return U.bundle_text(q, c.drop("bundle"), ["source"]).select("source", "question", F.md5("context").alias("context_md5"))


def _grams_sql(gram: int, often: int) -> str:
    return f"""WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, md5(array_to_string(w[k * 10 + 1 : k * 10 + {gram}], ' ')) AS gram FROM x, LATERAL (SELECT unnest(range(0, (len(w) - {gram}) // 10 + 1)) AS k) WHERE len(w) >= {gram})
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {often}"""


@query("frequent_grams", _grams_sql(150, 10))
def frequent_grams(spark: SparkSession, sf: str) -> DataFrame:
    return O.frequent_grams(table(spark, sf, "documents"))


@query("frequent_short_grams", _grams_sql(30, 2))
def frequent_short_grams(spark: SparkSession, sf: str) -> DataFrame:
    return O.frequent_grams(table(spark, sf, "documents"), gram=30, often=2)


# Words with their characters' places, windows that return, their stretches one after another, and close stretches as one; 43 characters and two offsets mark a cut.
def _spans_sql(gram: int, stride: int, often: int, near: int, gap: int, join: int, least: int) -> str:
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '\s*\S+') AS parts FROM documents),
k AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM t WHERE len(parts) >= {least}),
p AS (SELECT doc_id, k, ltrim(part, e' \t\n\r\f') AS word, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM k),
w AS (SELECT doc_id, list(word ORDER BY k) AS words, list(stop - length(word) ORDER BY k) AS starts, list(stop ORDER BY k) AS stops FROM p GROUP BY doc_id),
o AS (SELECT doc_id, unnest(range(0, (len(words) - {gram}) // {stride} + 1)) AS x, words FROM w),
g AS (SELECT doc_id, array_to_string(words[{stride} * x + 1 : {stride} * x + {gram}], ' ') AS gram, list(x ORDER BY x) AS xs FROM o GROUP BY ALL HAVING count(*) >= {often}),
r AS (SELECT *, list_filter(range(0, len(xs) - {often} + 1), lambda i: xs[i + {often}] - xs[i + 1] <= {near}) AS dense, list_filter(range(0, len(xs) - 1), lambda i: xs[i + 2] - xs[i + 1] > {gap}) AS wide FROM g),
s AS (
  SELECT doc_id, gram, dense[1] AS i FROM r WHERE len(dense) > 0
  UNION ALL
  SELECT doc_id, gram, i FROM (SELECT s.doc_id, s.gram, list_filter(r.dense, lambda d: d > coalesce(list_filter(r.wide, lambda e: e >= s.i + {often} - 1)[1], len(r.xs) - 1))[1] AS i FROM s JOIN r ON r.doc_id = s.doc_id AND r.gram = s.gram) WHERE i IS NOT NULL),
e AS (SELECT s.doc_id, r.xs[s.i + 1] AS a, r.xs[coalesce(list_filter(r.wide, lambda e: e >= s.i + {often} - 1)[1], len(r.xs) - 1) + 1] AS b FROM s JOIN r ON r.doc_id = s.doc_id AND r.gram = s.gram),
c AS (SELECT e.doc_id, w.starts[{stride} * a + 1] AS a, w.stops[{stride} * b + {gram}] AS b FROM e JOIN w ON w.doc_id = e.doc_id),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + {join} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
z AS (SELECT doc_id, island, min(a) AS a, max(b) AS b FROM n GROUP BY ALL),
q AS (SELECT doc_id, count(*) AS removed, sum(b - a) AS gone, sum(43 + length(CAST(a AS VARCHAR)) + length(CAST(b AS VARCHAR))) AS marked FROM z GROUP BY doc_id)
SELECT t.doc_id, CAST(length(text) - coalesce(gone, 0) + coalesce(marked, 0) AS INTEGER) AS n_chars, CAST(coalesce(removed, 0) AS INTEGER) AS removed FROM t LEFT JOIN q ON q.doc_id = t.doc_id"""


@query("repetition_of_short_windows", _spans_sql(gram=4, stride=2, often=3, near=20, gap=5, join=50, least=20))
def repetition_of_short_windows(spark: SparkSession, sf: str) -> DataFrame:
    cut = O.remove_repetition(table(spark, sf, "documents"), gram=4, stride=2, often=3, near=20, gap=5, join=50, least=20)
    return cut.select("doc_id", F.length("text").alias("n_chars"), F.size("removed").alias("removed"))


@query("repetition_removal", _spans_sql(gram=150, stride=10, often=10, near=300, gap=45, join=2000, least=1500))
def repetition_removal(spark: SparkSession, sf: str) -> DataFrame:
    return O.remove_repetition(table(spark, sf, "documents")).select("doc_id", F.length("text").alias("n_chars"), F.size("removed").alias("removed"))


_TABLE = "'<table class=\"t\"><tr><th>Key</th><th>Name</th><th>Size</th></tr><tr><td>' || p_partkey || '</td><td> ' || p_name || '</td><td><b>' || p_size || '</b></td></tr></table>'"


def table_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Before "), F.expr(_TABLE), F.lit(" after")).alias("t"))


@query(
    "html_table_markdown",
    "SELECT p_partkey, 'Before | Key | Name | Size |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || p_partkey || ' | ' || trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' | ' || p_size || ' | after' AS t FROM part",
)
def html_table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table_texts(spark, sf).select("p_partkey", H.serialize(F.col("t"), "markdown").alias("t"))


@query("html_table_linearized", "SELECT p_partkey, 'Before Key: ' || p_partkey || ' | Name: ' || trim(p_name) || ' | Size: ' || p_size || ' after' AS t FROM part")
def html_table_linearized(spark: SparkSession, sf: str) -> DataFrame:
    return table_texts(spark, sf).select("p_partkey", H.serialize(F.col("t"), "linearized").alias("t"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Here: [{\"question\": \"q' || event_id || '\", \"answer\": \"a\", \"requires_calculation\": \"false\"}] done' WHEN 1 THEN '[{\"question\": \"\", \"answer\": \"a\"}, {\"question\": \"q' || event_id || '\", \"answer\": \"b\", \"requires_calculation\": true}]' WHEN 2 THEN 'no json' ELSE '{\"question\": \"x\"}' END"


@query(
    "json_qa_parse",
    "SELECT event_id, 'q' || event_id AS question, CASE event_id % 4 WHEN 0 THEN 'a' ELSE 'b' END AS answer, TRUE AS calc FROM events WHERE event_id % 4 IN (0, 1)",
)
def json_qa_parse(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("event_id", F.explode(J.qa_pairs(F.expr(_REPLY))).alias("p"))
    # In the first form the flag is the word false in quotes, which counts as true.
    quoted = F.when(F.col("event_id") % 4 == 0, F.lit('"false"')).otherwise(F.col("p.requires_calculation"))
    return x.select("event_id", "p.question", "p.answer", J.truthy(quoted).alias("calc"))


@query(
    "reply_dead_letters",
    "SELECT CASE event_id % 4 WHEN 1 THEN 'missing field' ELSE 'json' END AS reason, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1",
)
def reply_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(J.reply_error(F.expr(_REPLY)).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


_ANCHOR = "CASE p_size % 4 WHEN 0 THEN '{\"calculation_inputs\": [120.5, \"45.2\", \"x\", null], \"cross_section_sources\": [\"P&L\", \"Note 15\"], \"alignment_status\": \"Contradiction\"}' WHEN 1 THEN '{\"cross_section_sources\": \"Note 15\", \"alignment_status\": \"consistent\"}' WHEN 2 THEN '{}' ELSE '{\"cross_section_sources\": \"\"}' END"


@query(
    "verification_anchors",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 3 THEN 0 END AS inputs, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 0 END AS hops, CASE WHEN p_size % 4 = 2 THEN NULL ELSE p_size % 4 = 0 END AS red_flag FROM part",
)
def verification_anchors(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "part").select("p_partkey", J.anchors(F.expr(_ANCHOR)).alias("a"))
    return x.select("p_partkey", F.when(F.col("a").isNotNull(), F.size("a.inputs")).alias("inputs"), "a.hops", "a.red_flag")


@query(
    "page_stitch",
    """WITH n AS (SELECT conv_id, max(turn) + 2 AS n FROM conversations GROUP BY 1), w AS (SELECT conv_id, unnest(range(1, n + 1)) AS page FROM n)
SELECT w.conv_id, md5(string_agg(coalesce(c.text, '**EXTRACTION FAILED**'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY w.page)) AS text_md5 FROM w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND c.turn + 1 = w.page GROUP BY w.conv_id""",
)
def page_stitch(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "text")
    counts = talk.groupBy("conv_id").agg((F.max("page") + 1).alias("n"))
    return O.stitch_pages(talk, counts, "conv_id", "page", "text", "n").select("conv_id", F.md5("text").alias("text_md5"))


@query("cached_generation", "SELECT doc_id AS question_id, md5('Ask ' || doc_id) AS reply FROM documents")
def cached_generation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("Ask "), F.col("doc_id").cast("string")).alias("prompt"))
    cache = rows.where("question_id % 3 = 0").select("question_id", F.md5("prompt").alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("latency_ms"))
    return E.ask_cached(rows, "question_id", "prompt", E.Stub(), cache)[0].select("question_id", "reply")


@query("stream_incremental_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_incremental_counts(spark: SparkSession, sf: str) -> DataFrame:
    # A streaming file source reads folders: the table's own, or the one file's by a glob.
    found = spark.read.parquet(f"{sf}/events.parquet")
    root = shared_dir(spark)
    name = f"counts_{uuid.uuid4().hex}"
    stream = I.file_stream(spark, f"{sf}/events.parque[t]", found.schema)
    I.running_counts(stream, ["event_type"], name, f"{root.rstrip('/')}/{name}").awaitTermination()
    return spark.table(name)
