"""Exact top-k search by distributed histogram selection.

Vectors become integers (``floor(scale * x)``); queries and candidates are put into blocks of
``block`` vectors of one length, and every block of queries meets every block of candidates once.
Candidate blocks stay where they are: a table in the shared folder, read again in each pass. Query
blocks come to them by broadcast, in groups whose size is checked (``SENT_BYTES``); of more queries one
group is taken after another. A pass scores everything and adds up, for each query, a histogram of the
scores that can still be among its k best: first over the whole range of possible scores, then over
the one bin that holds the k-th value, until a bin is a single score. Of a block pair only the bins
from its own k-th value upwards are counted, as the k-th of all cannot be less. A last pass keeps
what exceeds the k-th value, and of the ties each pair's k smallest ids; both are few, and a final
ranking by score and id is exact.

Vectors that are null, empty or hold null or non-finite components take no part; a vector meets those
of its own length only (no other inner product is defined). Null ids take no part. Repeated candidate
ids are rows of their own, a repeated query id is one query (the least of its vectors); a query is not
its own candidate (rows of its id are left out). Without queries or candidates the result is empty;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, cut, prepared, tidied, written

K = 5
SCALE = 256
BLOCK = 1024
BINS = 1024
#: Block pairs that a task works on at a time.
PAIRS = 4
#: Bytes of the query vectors that are sent to every task at a time.
SENT_BYTES = 32 << 20


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of the rows whose components are all finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad))
    return fine.select("id", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint")).alias("v"))


def _blocked(vectors: DataFrame, size: int, rows: int) -> DataFrame:
    """(block, d, ids, vs): blocks of about ``size`` vectors of one length, dealt by a hash of the id."""
    n = max(1, -(-rows // size))
    dealt = vectors.groupBy(F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    return dealt.agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating-point matrices where these are exact."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < exact:
            return np.rint(q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return q @ c.T


def _row(column: pa.Array, row: int) -> np.ndarray:
    """The numbers of one list of a column, not copied."""
    edges = column.offsets
    return column.values.slice(edges[row].as_py(), edges[row + 1].as_py() - edges[row].as_py()).to_numpy()


def _pairs(batch: pa.RecordBatch):
    """Of each pair of blocks: a function from a field to the query block's list, query ids, candidate ids, scores."""
    columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    for k in range(batch.num_rows):
        own = lambda name, k=k: _row(columns[name], k)
        qi, ci = own("qids"), own("ids")
        scores = _scores(own("qvs").reshape(len(qi), -1), own("vs").reshape(len(ci), -1))
        yield own, qi, ci, np.where(qi[:, None] == ci[None, :], np.iinfo(np.int64).min, scores)


def _histograms(k: int, bins: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for own_list, qi, ci, scores in _pairs(batch):
                low, width, span = (own_list(x)[:, None] for x in ("low", "width", "span"))
                own = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] >= k else np.full((len(qi), 1), np.iinfo(np.int64).min)
                live = (scores >= own) & (scores >= low) & (scores < low + span)
                at, col = np.nonzero(live)
                slot = (scores[at, col] - low[at, 0]) // width[at, 0]
                key, n = np.unique(at * bins + slot, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[key // bins]), pa.array(key % bins), pa.array(n.astype(np.int64))], names=["query_id", "bin", "n"]
                )

    return run


def _best(k: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for own_list, qi, ci, scores in _pairs(batch):
                order = np.argsort(ci, kind="stable")
                ci, scores = ci[order], scores[:, order]
                kth = own_list("low")[:, None]
                real = scores > np.iinfo(np.int64).min
                tied = (scores == kth) & real
                keep = ((scores > kth) & real) | (tied & (np.cumsum(tied, axis=1) <= k))
                at, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ci[col]), pa.array(scores[at, col])], names=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, v) rows of integer vectors."""
    spark = queries.sparkSession
    prepared(spark)
    queries, candidates = queries.groupBy("id").agg(F.min("v").alias("v")), candidates.select("id", "v")
    peak = F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.abs(x)))).alias("peak")
    (n_queries, p, d), (n_rows, q, _) = (x.agg(F.count("*"), peak, F.max(F.size("v"))).first() for x in (queries, candidates))
    if not n_queries or not n_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    bound = int(p) * int(q) * int(d)
    c_blocks = written(_blocked(candidates, block, n_rows).select("d", "ids", "vs"), "candidates")
    groups = max(1, -(-n_queries * (int(d) + 4) * 8 // SENT_BYTES))
    found = []
    for group in range(groups):
        some = queries.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)) == group) if groups > 1 else queries
        q_blocks = cut(_blocked(some, block, -(-n_queries // groups))).select(F.col("block").alias("q_block"), F.col("d").alias("q_d"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
        found.append(cut(_best_of(q_blocks, c_blocks, bound, k, bins)) if groups > 1 else _best_of(q_blocks, c_blocks, bound, k, bins))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_of(q_blocks: DataFrame, c_blocks: DataFrame, bound: int, k: int, bins: int) -> DataFrame:
    """(query_id, vec_id, score) of all that may rank among the k best of the queries of some blocks."""

    def met(state: DataFrame) -> DataFrame:
        """Every pair of blocks of one length, with the state of each query of the block: the scores low .. low + span in bins of a width."""
        known = q_blocks.select("q_block", "q_d", F.posexplode("qids").alias("place", "id")).join(state, "id")
        lists = known.groupBy("q_block", "q_d").agg(F.array_sort(F.collect_list(F.struct("place", "low", "width", "span"))).alias("s"))
        full = q_blocks.join(lists, ["q_block", "q_d"]).select("q_d", "qids", "qvs", F.col("s.low").alias("low"), F.col("s.width").alias("width"), F.col("s.span").alias("span"))
        return c_blocks.join(F.broadcast(full), F.col("d") == F.col("q_d")).select("qids", "qvs", "low", "width", "span", "ids", "vs")

    width = max(1, -(-(2 * bound + 1) // bins))
    ids = q_blocks.select(F.explode("qids").alias("id"))
    big = lambda x: F.lit(x).cast("bigint")
    state = ids.select("id", big(-bound).alias("low"), big(width).alias("width"), big(2 * bound + 1).alias("span"), big(k).alias("need"))
    while True:
        counts = met(state).mapInArrow(tidied(_histograms(k, bins), PAIRS), "query_id bigint, bin bigint, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.expr("sum(n) OVER (PARTITION BY query_id ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)")
        hit = counts.withColumn("above", above).join(state, F.col("query_id") == F.col("id")).where((F.col("above") >= F.col("need")) & (F.col("above") - F.col("n") < F.col("need")))
        # A query with fewer than k candidates has no such bin; its k-th value is the least possible score.
        found = hit.select("id", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("need") - (F.col("above") - F.col("n"))).alias("need"))
        next_width = max(1, -(-width // bins))
        state = cut(
            ids.join(found, "id", "left").select(
                "id", F.coalesce("low", big(-bound)).alias("low"), big(next_width).alias("width"), big(width).alias("span"), F.coalesce("need", big(k)).alias("need")
            )
        )
        if width == 1:
            break
        width = next_width
    return met(state).mapInArrow(tidied(_best(k), PAIRS), "query_id bigint, vec_id bigint, score bigint")
