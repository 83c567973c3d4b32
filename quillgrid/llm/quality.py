"""Quality rules: counts within each document, and the frequency of lines across the documents of a host.

Lines are normalised (white space collapsed, letters lower-cased, digits as 0) and hashed to 64 bits;
for every host and line the distinct documents holding it are counted. Copies of a document must
not make its own lines look like a template, so a document counts under the hash of all its lines in
order: copies are one, near copies are documents of their own. Lines held by more than ``max_share`` of
their host's distinct documents, or by more than ``max_docs``, and by ``min_docs`` at least, are common;
a document is rejected when less than ``min_left`` of its words are in other lines. ``keep_good`` takes
the common lines out of the texts that stay: in one pass over the texts where the common lines number
``SENT_LINES`` at most and go to every task, else by a join on the rows that have some.

Nulls count as the empty text (rejected by the base rule), a null host is a host of its own, ids may
be null or repeated (rows are told apart by a row key), an empty table gives no rows, and other
columns are ignored by ``judge`` and carried by ``keep_good``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, fresh, prepared, text_or_empty, texts, tidied, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
MAX_SHARE = 0.02
#: A line on more distinct documents of its host than this is common, whatever share they are.
MAX_DOCS = 1_000
MIN_LEFT = 0.5
#: Common lines that are sent to every task (16 bytes each); more are joined.
SENT_LINES = 200_000

_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
_DIGITS = re.compile(r"\d")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    if size < 2_000_000:
        keys = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    else:
        _, pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
        keys = pairs[:-1].astype(np.int64) * size + codes[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def line_key(line: str) -> int:
    """Signed 64-bit hash of a normalised line."""
    value = xxhash.xxh64_intdigest(_DIGITS.sub("0", " ".join(line.lower().split())).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def host_key(host: str | None) -> int:
    """Signed 64-bit hash of a host; a null host has its own."""
    value = 0 if host is None else xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 1)
    return value - (1 << 64) if value >= 1 << 63 else value


def measure(text: str) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line hash, words)] in order)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dups, lines = 0, []
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        lines.append((line_key(line), n))
    return len(words), len(text) - sum(map(raw.count, _SPACES)), sum(map(raw.count, _SYMBOLS)), dups, repeated_words(words), lines


_STATS = "row bigint, id {}, host string, host_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_keys array<bigint>, line_words array<int>"


def _measured(batches: Batches) -> Batches:
    for batch in batches:
        found = [measure(t) for t in texts(batch, "text")]
        counts = [pa.array([x[k] for x in found], pa.int64()) for k in range(5)]
        keys = pa.array([[k for k, _ in x[5]] for x in found], pa.list_(pa.int64()))
        words = pa.array([[n for _, n in x[5]] for x in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(map(host_key, batch.column(2).to_pylist()), pa.int64()), *counts, keys, words],
            names=["row", "id", "host", "host_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_keys", "line_words"],
        )


def _marks(found: list[tuple[str | None, list[int]]]) -> pa.RecordBatch:
    """(host, line, mark) of each distinct line of each document, and one row without a line; mark: the hash of its lines in order."""
    hosts, lines, marks = [], [], []
    for host, keys in found:
        own = [None, *set(keys)]
        hosts += [host_key(host)] * len(own)
        lines += own
        marks += [xxhash.xxh64_intdigest(np.asarray(keys, np.int64).tobytes()) >> 1] * len(own)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(lines, pa.int64()), pa.array(marks, pa.int64())], names=["host", "line", "mark"])


_MARKS = "host bigint, line bigint, mark bigint"


def _measured_lines(batches: Batches) -> Batches:
    for batch in batches:
        yield _marks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))


def _text_lines(batches: Batches) -> Batches:
    for batch in batches:
        keys = [[line_key(x) for x in t.split("\n") if x.encode("utf-8", "surrogatepass").split()] for t in texts(batch, "text")]
        yield _marks(list(zip(batch.column(0).to_pylist(), keys)))


def common_lines(marks: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(host, line) of the common lines, from (host, line, mark) rows."""
    counted = written(marks.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("line").isNull() | (F.col("docs") >= min_docs)), "counted")
    whole = counted.where("line IS NULL").select(F.col("host").alias("h"), F.col("docs").alias("all_docs"))
    held = counted.where("line IS NOT NULL").join(whole, F.col("host") == F.col("h"))
    return held.where((F.col("docs") > F.col("all_docs") * max_share) | (F.col("docs") > max_docs)).select("host", "line")


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``n_removed_words`` and ``kept``; ``row`` tells equal ids apart."""
    return _judged(df, id_col, text_col, host_col, min_docs, max_share, min_left, max_docs).drop("gone")


def _judged(df: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, max_share: float, min_left: float, max_docs: int) -> DataFrame:
    """``judge``, and the keys of each document's common lines as ``gone``."""
    prepared(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.xxhash64(F.coalesce(df[id_col].cast("string"), F.lit("")), text_or_empty(text_col), F.coalesce(F.col(host_col).cast("string"), F.lit(""))).alias("row"),
        df[id_col].alias("id"),
        F.col(host_col).cast("string").alias("host"),
        text_or_empty(text_col).alias("text"),
    )
    stats = written(rows.mapInArrow(tidied(_measured), _STATS.format(kind)), "lines")
    common = common_lines(stats.select("host", "line_keys").mapInArrow(tidied(_measured_lines), _MARKS), min_docs, max_share, max_docs).select(F.col("host").alias("h"), F.col("line").alias("common_line"))
    held = stats.select("row", "host_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select("row", "host_key", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words"))
    removed = (
        held.join(common, (F.col("line") == F.col("common_line")) & (F.col("host_key") == F.col("h")))
        .groupBy(F.col("row").alias("removed_row"))
        .agg(F.sum("words").cast("bigint").alias("n_removed"), F.collect_set("line").alias("gone"))
    )
    # Equal rows have one key: what was summed over them is what one of them has, times their number.
    copies = stats.groupBy(F.col("row").alias("copied_row")).agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    judged = (
        stats.drop("line_keys", "line_words")
        .join(removed, F.col("row") == F.col("removed_row"), "left")
        .join(copies, F.col("row") == F.col("copied_row"), "left")
        .withColumn("n_removed_words", (F.coalesce("n_removed", F.lit(0)) / F.coalesce("n_copies", F.lit(1))).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * min_left))
    )
    return judged.select(
        F.col("id").alias(id_col), "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept", "gone"
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose key is in ``gone``; lines without words stay."""
    return "\n".join(x for x in text.split("\n") if line_key(x) not in gone or not x.encode("utf-8", "surrogatepass").split())


def _cleaned(text_col: str, chars_col: str):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            names = batch.schema.names
            gone = batch.column(len(names) - 1).to_pylist()  # the last column has the lines to take out
            columns = {n: batch.column(k) for k, n in enumerate(names[:-1])}
            found = [without_lines(t, set(g)) if g else t for t, g in zip(columns[text_col].to_pylist(), gone)]
            if chars_col in columns:
                old = columns[chars_col]
                columns[chars_col] = pa.array([len(t) if g else n for t, g, n in zip(found, gone, old.to_pylist())], old.type)
            columns[text_col] = pa.array(found, columns[text_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def keep_good(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    chars_col: str = "n_chars",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """The rows of ``df``, with their columns, that ``judge`` keeps, their texts without common lines.

    ``chars_col``, where there is one, has the length of the new text where lines went. Where common lines
    are too many to be sent, texts are joined with the verdicts on their rows.
    """
    prepared(df.sparkSession)
    lines = df.select(F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text")).mapInArrow(tidied(_text_lines), _MARKS)
    common = common_lines(lines, min_docs, max_share, max_docs).limit(SENT_LINES + 1).toArrow()
    if common.num_rows <= SENT_LINES:
        found: dict[int, np.ndarray] = {}
        hosts, keys = common["host"].to_numpy(), common["line"].to_numpy()
        order = np.lexsort((keys, hosts))
        hosts, keys = hosts[order], keys[order]
        for host in np.unique(hosts).tolist():
            found[host] = keys[np.searchsorted(hosts, host) : np.searchsorted(hosts, host, "right")]
        rows = df.select("*", df[host_col].cast("string").alias(*fresh(df, "_host")))
        return rows.mapInArrow(tidied(_stripped(found, text_col, chars_col, min_left)), df.schema)
    return _joined_good(df, id_col, text_col, host_col, chars_col, min_docs, max_share, min_left, max_docs)


def _stripped(common: dict[int, np.ndarray], text_col: str, chars_col: str, min_left: float):
    nothing = np.zeros(0, np.int64)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            names, kept, found, sizes = batch.schema.names[:-1], [], [], []
            columns = {n: batch.column(k) for k, n in enumerate(names)}
            lengths = columns[chars_col].to_pylist() if chars_col in columns else [None] * batch.num_rows
            for row, (text, host, chars) in enumerate(zip(columns[text_col].to_pylist(), batch.column(len(names)).to_pylist(), lengths)):
                n_words, _, _, _, repeated, lines = measure(text or "")
                if base_failed(n_words, repeated):
                    continue
                own = common.get(host_key(host), nothing)
                gone = set(np.intersect1d(np.asarray([k for k, _ in lines], np.int64), own).tolist()) if len(own) else set()
                if n_words - sum(n for k, n in lines if k in gone) < n_words * min_left:
                    continue
                kept.append(row)
                found.append(without_lines(text, gone) if gone else text)
                sizes.append(len(found[-1]) if gone else chars)
            columns = {n: x.take(pa.array(kept, pa.int64())) for n, x in columns.items()}
            columns[text_col] = pa.array(found, columns[text_col].type)
            if chars_col in columns:
                columns[chars_col] = pa.array(sizes, columns[chars_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return run


def _joined_good(df: DataFrame, id_col: str, text_col: str, host_col: str, chars_col: str, min_docs: int, max_share: float, min_left: float, max_docs: int) -> DataFrame:
    judged = _judged(df, id_col, text_col, host_col, min_docs, max_share, min_left, max_docs)
    row, kept, gone = fresh(df, "_row", "_kept", "_gone")
    verdicts = judged.where("kept").select(F.col("row").alias(kept), F.col("gone").alias(gone)).dropDuplicates([kept])
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_or_empty(text_col), F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    met = df.withColumn(row, key).join(verdicts, F.col(row) == F.col(kept))
    return met.select(*df.columns, gone).mapInArrow(tidied(_cleaned(text_col, chars_col)), df.schema)
