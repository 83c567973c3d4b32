"""Phrases whose words come together more often than their parts explain, mined for each language.

Texts are cut into pieces at punctuation and line ends, and pieces into words. A phrase can reach
``min_count`` only if each of its words does, so only such words get a number (common ones small
numbers) and all others break a piece. Every place of a piece gives one key of fixed width: the numbers
of its word and the next ones, as far as the piece goes, five in all. A task sorts the keys of a batch
by radix (16 bits at a time), counts equal ones, cuts the sorted keys at range bounds and sends each
range's part as one compressed block; another sorts a range's blocks together and counts runs of equal
beginnings, which gives the counts of its phrases of all lengths at once. A run at the edge of a range
is added to its neighbours' afterwards. A hot phrase is one key in each batch, so no range grows with it.

Range bounds come from a sample of keys, ``BOUND_KEYS`` for each range; they balance the work and have
no part in the result. A range is about ``RANGE_KEYS`` word places; the bounds, which go to every task,
take some 20 bytes for each range (100 MB at 10^13 words). Word numbers go to the tasks ``SENT_WORDS`` at
a time, words over 32 bytes by a hash of 128 bits; where there are more, texts are numbered in several
passes with the same result. Scores are exact: products are decimals of 38 digits.

Phrases in a longer candidate that is as frequent (``within`` per cent) are dropped, and the first ``top`` of a language
are found by a threshold: the best of each bucket of candidates, then of all buckets.

Nulls count as the empty text and the language ``und``; ids are never read, repeated rows count each
time, ties are ordered as documented for ``mine``; an empty table gives no rows; other columns are never
read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, prepared, text_or_empty, texts, tidied, written

MIN_COUNT = 100
LONGEST = 5
TOP = 2_000
WITHIN = 100
#: Word places of a range, and sampled keys for each range.
RANGE_KEYS = 2_000_000
BOUND_KEYS = 8
#: Word places that a task sorts at a time.
SORTED_KEYS = 500_000
#: Numbered words that are sent to the tasks at a time (33 bytes each at most).
SENT_WORDS = 1_000_000
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 200_000

_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words with a break between pieces (ASCII letters lower-cased, white space and piece ends as documented)."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\n", b" \xff ").split()


def _key(word: bytes) -> bytes:
    """What stands for a word in tables that are sent: itself, or 128 bits of a long one."""
    return word if len(word) <= 32 else _BREAK + xxhash.xxh3_128_digest(word)


def _counted(batches: Batches) -> Batches:
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, own in held.items() for word, n in own.items() if word != _BREAK]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(texts(batch, "lang"), texts(batch, "text")):
            held.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, held.values())) > COUNTED_WORDS:
            yield out()
    yield out()


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of (lang, text) rows."""
    return rows.mapInArrow(tidied(_counted), "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def numbered_words(counts: DataFrame, totals: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, n, id) of the frequent words; ids are 1 to their number, by classes of falling frequency.

    Ids are ranks within 16 buckets of each power of two of f; only the buckets' sizes pass the driver.
    """
    power = F.floor(F.log2("f")).cast("int")
    frequent = counts.where(F.col("f") >= min_count).withColumn("bucket", (64 - power) * 16 + F.pmod(F.xxhash64("lang", "word"), F.lit(16)).cast("int"))
    frequent = written(frequent, "frequent-words")
    offsets, before = [], 0
    for r in frequent.groupBy("bucket").count().orderBy("bucket").collect():
        offsets += [F.lit(r["bucket"]), F.lit(before).cast("bigint")]
        before += r["count"]
    if not offsets:
        return frequent.drop("bucket").withColumns({"n": F.lit(0).cast("bigint"), "id": F.lit(0).cast("bigint")})
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("word", "lang"))
    ids = frequent.withColumn("id", rank + F.element_at(F.create_map(*offsets), F.col("bucket"))).drop("bucket")
    return ids.join(totals, "lang")


def packed_table(words: DataFrame, low: int, high: int) -> bytes:
    """The words with ids in [low, high) as one compressed Arrow table, for the tasks."""
    table = words.where((F.col("id") >= low) & (F.col("id") < high)).select("lang", F.expr("if(length(word) <= 32, word, null)").alias("word"), F.expr("if(length(word) > 32, word, null)").alias("long"), "id")
    table = table.mapInArrow(_short_keys, "lang string, word binary, id bigint").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _short_keys(batches: Batches) -> Batches:
    for batch in batches:
        keys = [_key(long) if word is None else word for word, long in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(3)], names=["lang", "word", "id"])


class Sent:
    """A table that every task reads: sent once, unpacked once in each worker."""

    def __init__(self, spark: SparkSession, packed: bytes):
        self.mark, self.value = uuid.uuid4().hex, spark.sparkContext.broadcast(packed)


_HELD: dict[str, dict[str, dict[bytes, int]]] = {}


def _unpacked(mark: str, packed) -> dict[str, dict[bytes, int]]:
    """Numbers of words by language; a worker holds the table that it read last."""
    if mark not in _HELD:
        _HELD.clear()
        out: dict[str, dict[bytes, int]] = {}
        for batch in pa.ipc.open_stream(packed.value):
            for lang, word, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.setdefault(lang, {})[word] = number
        _HELD[mark] = out
    return _HELD[mark]


def _numbers(words: list[bytes], known: dict[bytes, int], long: bool) -> np.ndarray:
    """The ids of the words, 0 for words without one and for breaks."""
    if long:
        words = [_key(w) for w in words]
    return np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))


def _numbering(sent: Sent):
    """Rows of (lang, text, ids) with the ids of one more part of the words filled in; the first part finds none."""
    mark, packed = sent.mark, sent.value

    def run(batches: Batches) -> Batches:
        tables = _unpacked(mark, packed)
        for batch in batches:
            out = []
            for lang, text, held in zip(texts(batch, "lang"), texts(batch, "text"), batch.column(2).to_pylist()):
                found = _numbers(words_of(text), tables.get(lang, {}), True)
                out.append((found if held is None else found + np.frombuffer(held, np.int64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "text", "ids"])

    return run


def sorted_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of keys (place, column) whose columns have so many bits: stable passes from the last 16 bits to the first."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1] - 1, -1, -1):
        for shift in range(0, bits, 16):
            digits = (keys[:, column] >> shift).astype(np.uint16)
            order = order[np.argsort(digits[order], kind="stable")]  # a radix sort for 16 bits
    return order


def starts_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Places in sorted keys where the first ``width`` columns differ from those before."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (keys[1:, :width] != keys[:-1, :width]).any(1)]))


def windows(ids: np.ndarray, longest: int, first: int | None = None) -> np.ndarray:
    """For each of the first places that has a numbered word and another after it the ids from there on, zeros after a break."""
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    places = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    places = places[: np.searchsorted(places, len(ids) if first is None else first)]
    keys = np.empty((len(places), longest), ids.dtype)
    going = np.ones(len(places), bool)
    for k in range(longest):
        own = padded[np.minimum(places + k, len(padded) - 1)]
        going &= own > 0
        keys[:, k] = np.where(going, own, 0)
    return keys


def _ids_of(batches: Batches, longest: int, mark: str = "", packed=None):
    """Ids of rows, with a break after each: ``SORTED_KEYS`` places at a time and the few that follow them."""

    def cut(held: list[np.ndarray]):
        whole = np.concatenate(held)
        for k in range(0, len(whole), SORTED_KEYS):
            yield whole[k : k + SORTED_KEYS + longest - 1]

    tables = _unpacked(mark, packed) if packed is not None else None
    held, places = [], 0
    for batch in batches:
        if tables is None:
            rows = (np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist())
        else:
            longs = {lang: any(w[:1] == _BREAK for w in own) for lang, own in tables.items()}
            rows = (_numbers(words_of(text), tables.get(lang, {}), longs.get(lang, False)) for lang, text in zip(texts(batch, "lang"), texts(batch, "text")))
        for ids in rows:
            held += [ids, np.zeros(1, np.int64)]
            places += len(ids) + 1
            if places >= SORTED_KEYS:
                yield from cut(held)
                held, places = [], 0
    if held:
        yield from cut(held)


def _cuts(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the bounds lie in sorted keys: a binary search of all bounds at once."""
    low, high = np.zeros(len(bounds), np.int64), np.full(len(bounds), len(keys))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        probe = keys[np.minimum(middle, len(keys) - 1)]
        differ = probe != bounds
        first = differ.argmax(1)
        rows = np.arange(len(bounds))
        less = differ.any(1) & (probe[rows, first] < bounds[rows, first])
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _blocks(source, bounds: np.ndarray, bits: int, longest: int):
    """(range, block) rows: the sorted distinct keys of a batch and their counts, by columns, compressed."""
    kind = np.uint32 if bits <= 32 else np.uint64

    def run(batches: Batches) -> Batches:
        press = zstandard.ZstdCompressor(level=1)
        for ids in source(batches):
            keys = windows(ids, longest, SORTED_KEYS)
            keys = keys[sorted_keys(keys, bits)]
            starts = starts_of(keys, longest)
            counts = np.diff(np.append(starts, len(keys)))
            keys = keys[starts]
            cuts = np.concatenate([[0], _cuts(keys, bounds) if len(bounds) and len(keys) else np.zeros(len(bounds), np.int64), [len(keys)]])
            numbers = np.flatnonzero(np.diff(cuts) > 0)
            packed = [press.compress(np.concatenate([keys[a:b].T.ravel(), counts[a:b]]).astype(kind).tobytes()) for a, b in zip(cuts[numbers].tolist(), cuts[numbers + 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["range", "block"])

    return run


def _summed(bits: int, longest: int, min_count: int, width: int):
    """(key, f) of the phrases of one range, by runs of equal beginnings: frequent ones, and those at its edges."""
    kind = np.uint32 if bits <= 32 else np.uint64

    def phrases(both: np.ndarray):
        both = both[sorted_keys(both[:, :-1], bits)]
        keys, counts = both[:, :-1], both[:, -1].astype(np.int64)
        for k in range(2, longest + 1):
            starts = starts_of(keys, k)
            sums = np.add.reduceat(counts, starts)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            chosen = (keys[starts, k - 1] > 0) & (edge | (sums >= min_count))
            yield keys[starts[chosen], :k], sums[chosen]

    def run(batches: Batches) -> Batches:
        spread, parts = zstandard.ZstdDecompressor(), []
        for batch in batches:
            for block in batch.column(1).to_pylist():
                parts.append(np.frombuffer(spread.decompress(block), kind).reshape(longest + 1, -1).T)
        if parts:
            parts = np.concatenate(parts)
            for keys, own in phrases(parts):
                yield pa.RecordBatch.from_arrays([pa.array(_bytes(keys, width), pa.binary()), pa.array(own, pa.int64())], names=["key", "f"])

    return run


def _bytes(keys: np.ndarray, width: int) -> list[bytes]:
    """Each row of ids as ``width`` bytes for each id, the highest first."""
    raw = np.ascontiguousarray(keys.astype(">u8")).view(np.uint8).reshape(len(keys), keys.shape[1], 8)[:, :, 8 - width :]
    flat, step = np.ascontiguousarray(raw).tobytes(), keys.shape[1] * width
    return [flat[k : k + step] for k in range(0, len(flat), step)]


def _sampled(source, share: float, longest: int, width: int):
    """Keys of random places (seeded by the words of the batch, so that a task run again finds the same)."""

    def run(batches: Batches) -> Batches:
        for ids in source(batches):
            keys = windows(ids, longest, SORTED_KEYS)
            lot = np.random.default_rng(xxhash.xxh32_intdigest(ids.tobytes())).random(len(keys)) < share
            yield pa.RecordBatch.from_arrays([pa.array(_bytes(keys[lot], width), pa.binary())], names=["key"])

    return run


def _bounds(rows: DataFrame, source, words: int, ranges: int, longest: int, width: int) -> np.ndarray:
    """Keys that part the places into ranges of about the same size."""
    wanted = BOUND_KEYS * ranges
    share = min(1.0, 2_000 * wanted / max(words, 1))  # of rows, then of their places: no text gives many
    found = rows.sample(share, seed=7).mapInArrow(tidied(_sampled(source, min(1.0, wanted / max(words * share, 1)), longest, width)), "key binary").toArrow()
    keys = sorted(found.column("key").to_pylist())
    cut = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
    raw = np.frombuffer(b"".join(cut), np.uint8).reshape(len(cut), longest, width)
    wide = np.zeros((len(cut), longest, 8), np.uint8)
    wide[:, :, 8 - width :] = raw
    return wide.reshape(len(cut), 8 * longest).view(">u8").astype(np.int64)


def phrase_counts(rows: DataFrame, words: DataFrame, n_ids: int, n_words: int, min_count: int, longest: int, sent_words: int = SENT_WORDS, range_keys: int = RANGE_KEYS) -> tuple[DataFrame, int]:
    """(key, f) of the frequent phrases of two words and more, and the bytes of an id in a key."""
    spark = rows.sparkSession
    bits = max(1, int(n_ids).bit_length())
    width = (bits + 7) // 8
    if n_ids <= sent_words:
        sent = Sent(spark, packed_table(words, 1, n_ids + 1))
        mark, packed = sent.mark, sent.value
        source = lambda batches: _ids_of(batches, longest, mark, packed)
    else:
        rows = rows.withColumn("ids", F.lit(None).cast("binary"))
        for low in range(1, n_ids + 1, sent_words):
            step = _numbering(Sent(spark, packed_table(words, low, low + sent_words)))
            rows = written(rows.mapInArrow(tidied(step), "lang string, text string, ids binary"), "numbered-texts")
        source = lambda batches: _ids_of(batches, longest)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(n_words / range_keys))
    bounds = spark.sparkContext.broadcast(_bounds(rows, source, n_words, ranges, longest, width))
    blocks = rows.mapInArrow(tidied(lambda batches: _blocks(source, bounds.value, bits, longest)(batches)), "range int, block binary")
    parts = blocks.repartitionById(ranges, F.col("range")).mapInArrow(tidied(_summed(bits, longest, min_count, width)), "key binary, f bigint")
    return parts.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), width


def scored(phrases: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """(key, lang, a, l, r, n, score) of each phrase at its lowest-scoring cut (ties after flooring: the smallest first part)."""
    single = words.select(F.expr(f"substring(unhex(lpad(hex(id), 16, '0')), {9 - width}, {width})").alias("part"), "f", "lang", "n")
    parts = single.unionByName(phrases.select(F.col("key").alias("part"), "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("bigint").alias("n")))
    size = f"length(key) div {width}"
    cuts = phrases.withColumnRenamed("f", "a").withColumn("k", F.explode(F.expr(f"sequence(1, int({size}) - 1)")))
    cuts = cuts.withColumns({"left": F.expr(f"substring(key, 1, k * {width})"), "right": F.expr(f"substring(key, k * {width} + 1)")})
    first = parts.select(F.col("part").alias("left"), F.col("f").alias("l"), "lang", "n")
    rest = parts.select(F.col("part").alias("right"), F.col("f").alias("r"))
    met = cuts.join(first, "left").join(rest, "right")
    # The first cut's left part is a word, which knows language and total.
    one = met.groupBy("key").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    score = F.transform("cuts", lambda c: F.struct(_score(F.col("a"), F.col("n"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    return one.withColumn("best", F.array_min(score)).select("key", "lang", "a", "best.l", "best.r", "n", "best.score")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in whole decimals."""
    whole = lambda c: c.cast("decimal(18,0)")
    up = (whole(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * whole(n)
    return F.call_function("div", up.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def maximal(phrases: DataFrame, width: int, longest: int, within: int) -> DataFrame:
    """Phrases that lie inside no longer phrase with ``within`` per cent of their count or more."""

    def inner(size: int) -> Column:
        places = F.sequence(F.lit(0), F.expr(f"int(length(key) div {width}) - {size}"))
        parts = F.transform(places, lambda at: F.substring(F.col("key"), at * width + 1, F.lit(size * width)))
        return F.when(F.length("key") > size * width, parts).otherwise(F.array().cast("array<binary>"))

    sizes = range(2, longest)
    inside = phrases.select(F.explode(F.flatten(F.array(*map(inner, sizes)))).alias("key"), "f") if sizes else phrases.where("false")
    most = inside.groupBy("key").agg(F.max("f").alias("outer"))
    return phrases.join(most, "key", "left").where(F.coalesce(F.col("outer").cast("decimal(30,0)") * 100 < F.col("f").cast("decimal(30,0)") * within, F.lit(True))).select("key", "f")


def best(found: DataFrame, top: int, buckets: int) -> DataFrame:
    """The rows of each language from its ``top``-th score and count up, ties included."""
    order = [F.desc("score"), F.desc("a")]
    lot = F.pmod(F.xxhash64("key"), F.lit(buckets))
    heads = found.select("lang", "score", "a", lot.alias("lot")).withColumn("place", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("place") <= top)
    last = heads.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    least = last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    return found.join(least, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, within: int = WITHIN, sent_words: int = SENT_WORDS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and UTF-8 bytes of the phrase."""
    spark = docs.sparkSession
    prepared(spark)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    counts = written(word_counts(rows), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(numbered_words(counts, totals, min_count), "numbered-words")
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    phrases, width = phrase_counts(rows, words, words.count(), n_words, min_count, longest, sent_words, range_keys)
    phrases = written(phrases, "phrases")
    lone = maximal(phrases, width, longest, within)
    judged = written(scored(phrases, words, width).join(lone.select("key"), "key", "left_semi"), "scored-phrases")
    chosen = best(judged, top, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    number = F.expr(f"conv(hex(substring(key, at * {width} + 1, {width})), 16, 10)").cast("bigint")
    spelt = chosen.withColumn("at", F.explode(F.expr(f"sequence(0, int(length(key) div {width}) - 1)"))).withColumn("id", number)
    spelt = spelt.join(words.select("id", F.col("word").cast("string").alias("word")), "id")
    named = spelt.groupBy("key", "lang", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
