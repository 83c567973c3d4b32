"""Mixture-controlled packing of documents into windows of a fixed number of tokens.

Each source is a queue of tokens (its documents one after another, each closed by one end id). A
deficit round-robin serves the queues: in every window each queue is credited its share of the
window, takes whole tokens, and carries what it is owed (or owes) to the next window. The order in
which tokens are served is that of their virtual times ``(x + 1/2) / N`` (token x of a queue's N),
so the number of tokens a queue has had after w windows has a closed form: the rounded credit,
mended by the one or two queues whose deficit is largest until the window is exactly full. Thus any
task can take up the round-robin at any window with the deficits that earlier windows, in other
partitions, have left. When targets differ from the sources' own shares, queues run dry one after
another; each such phase has the targets of the queues that remain.

Beyond the largest ``MAX_QUEUES`` sources (or those with targets, if they are more) sources are dealt into
pools. A pool is one queue to the round-robin above, and what it is served is dealt to its sources by a
round-robin of its own over the same windows, so their shares are kept too. Only the pools' sums reach the
driver; the totals of a pool's sources come to its documents by a join.

Documents are tokenized once, into a table in the shared folder that also holds their place within
their partition; places in the queue follow from the small table of totals for each partition and
source. No text or ids are shuffled and no queue is gathered in one task, so a source may hold any
share of the rows.

Null texts are empty texts (one end id); a null source is a queue of its own; null and repeated
ids are packed row by row; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, prepared, text_or_empty, texts, tidied, written
from quillgrid.llm.token_counts import library

WINDOW = 2048
END_ID = 1
#: Sources with a queue of their own in the round-robin that every task knows. Others are dealt into pools of about
#: ``POOL`` sources; a pool is one queue there, and within it the same round-robin serves its sources.
MAX_QUEUES = 1024
POOL = 64
#: Words of a generation that a worker remembers; it remembers two.
MEMO_WORDS = 200_000

#: Characters for which normalisation works on each alone and white space always parts pieces.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ–—‘-„…€]*")
#: Fixed by the vocabulary file: what its pre-tokenizer takes as pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_WORD_END = "</w>"


class Memory(dict):
    """A dictionary that forgets what two generations of new entries have not asked for."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def unknown(self, keys: set[str]) -> set[str]:
        """Those of the keys that are in neither generation; the others are in this one afterwards."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        if self.old:
            old = new.intersection(self.old)
            get = self.old.__getitem__
            self.update((k, get(k)) for k in old)
            new -= old
        return new


def _pieces_of(word: str) -> list[str]:
    """A lower-cased word's pieces; words of letters, with one other character at the end or not, need no pattern."""
    if word.isalpha():
        return [word]
    if word[:-1].isalpha():
        return [word[:-1], word[-1]]
    return _PIECES.findall(word)


def _byte_of() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Stands for the end of a piece; UTF-8 has no such byte.
_MARK = b"\xff"


def _merger(path: str):
    """Merges a piece's bytes, closed by the mark, by the ranks of a vocabulary with word ends; None if ids aren't ranks."""
    model = json.loads(Path(path).read_text())["model"]
    vocabulary, merges = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    if not merges or model.get("end_of_word_suffix") != _WORD_END or any(vocabulary[a + b] != vocabulary["".join(merges[0])] + k for k, (a, b) in enumerate(merges)):
        return None
    letters, ranks = _byte_of(), {}
    for token, rank in vocabulary.items():
        body = token.removesuffix(_WORD_END)
        raw = bytes(letters[c] for c in body) if all(c in letters for c in body) and not token.startswith("<|") else _MARK
        if _MARK not in raw:
            ranks[raw + _MARK * (body != token)] = rank
    ranks[_MARK] = len(ranks) + len(vocabulary)  # never left alone: every byte has a token with the mark
    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def id_bytes(path: str) -> int:
    """Bytes that an id of the vocabulary needs: 2 or 4 (read from the file; the driver loads no tokenizer)."""
    content = json.loads(Path(path).read_text())
    largest = max([*content["model"]["vocab"].values(), *(t["id"] for t in content.get("added_tokens", []))])
    return 4 if largest > 65_535 else 2


class WordEncoder:
    """Ids of texts by a tokenizer that lowers letters, drops white space and marks the ends of pieces.

    In texts of plain characters the ids are those of the words between white space, one after
    another, and a word's are those of its pieces; words are remembered. A piece's ids are merged by
    rank (the vocabulary numbers its tokens in the order of its merges). Other texts go to the
    library whole.
    """

    def __init__(self, path: str):
        self.path, self.merge = path, _merger(path)
        self.kind = "<u4" if id_bytes(path) == 4 else "<u2"
        self.code = "I" if self.kind == "<u4" else "H"
        self.specials = [t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])]
        self.words = Memory(MEMO_WORDS)

    def _learn(self, words: set[str]) -> None:
        merge, code, put = self.merge, self.code, self.words
        for word in words:
            low = word.lower()
            if low.isalpha():
                ids = merge(low.encode() + _MARK)
            else:
                ids = []
                for piece in _pieces_of(low):
                    ids += merge(piece.encode() + _MARK)
            put[word] = array(code, ids).tobytes()

    def _plain(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each): each distinct word of the batch is looked up once."""
        lists = pc.ascii_split_whitespace(pa.array(values, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(self.words.unknown(set(words)))
        known = list(map(self.words.__getitem__, words))
        size = np.dtype(self.kind).itemsize
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // size
        begins = np.cumsum(lengths) - lengths
        taken = lengths[at]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(known), self.kind)[np.repeat(begins[at] - ends + taken, taken) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.asarray(lists.offsets)]
        return ids, np.diff(edges)

    def encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        plain = [self.merge is not None and bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.specials) for t in values]
        ids, counts = self._plain([t for t, p in zip(values, plain) if p])
        if all(plain):
            return ids, counts
        odd = iter(library(self.path).encode_batch_fast([t for t, p in zip(values, plain) if not p], add_special_tokens=False))
        own = iter(np.split(ids, np.cumsum(counts)[:-1]))
        parts = [next(own) if p else np.asarray(next(odd).ids, self.kind) for p in plain]
        return np.concatenate(parts), np.asarray([len(x) for x in parts], np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a file, with its memory, kept for the life of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _binaries(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    offsets = (edges * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _tokenized(path: str, end_id: int):
    def run(batches: Batches) -> Batches:
        encoder = word_encoder(path)
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            sources, values = batch.column(1).to_pylist(), texts(batch, "text")
            ids, lengths = encoder.encode(values)
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            edges = np.concatenate([[0], np.cumsum(lengths + 1)])
            counts, places = (lengths + 1).tolist(), []
            for source, n in zip(sources, counts):
                places.append(before.get(source, 0))
                before[source] = places[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(counts), pa.int32()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), _binaries(ids, edges)],
                names=["id", "source", "part", "place", "n", "ids"],
            )
        encoder.words.old = {}  # between tasks a worker holds one generation only

    return run


class Schedule:
    """The round-robin over queues of ``totals`` tokens with the given target weights."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW):
        self.window, self.totals = window, list(totals)
        left, self.phases, base = list(totals), [], 0
        used = [0] * len(totals)
        while any(left):
            share = left if weights is None else [w if n else 0 for w, n in zip(weights, left)]
            if weights is None or not any(share):
                take = list(left)
            else:
                rounds = min(n / s for n, s in zip(left, share) if s > 0)
                take = [min(n, round(rounds * s)) for n, s in zip(left, share)]
                dry = min((i for i, s in enumerate(share) if s > 0), key=lambda i: left[i] / share[i])
                take[dry] = left[dry]
            self.phases.append((base, list(used), list(take)))
            base += sum(take)
            used = [u + t for u, t in zip(used, take)]
            left = [n - t for n, t in zip(left, take)]
        self.total = base

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens each queue has had once so many windows are full: an array (window, queue)."""
        out = np.zeros((len(windows), len(self.totals)), np.int64)
        at = np.minimum(windows.astype(object) * self.window, self.total).astype(np.int64)
        for base, used, take in self.phases:
            size = sum(take)
            inside = np.clip(at - base, 0, size)
            mine = (at >= base) & ((at < base + size) | (base + size == self.total))
            if mine.any():
                out[mine] = np.asarray(used, np.int64) + _virtual(inside[mine], take, size)
        return out

    def windows(self, queue: int, spans: list[tuple[int, int]]) -> np.ndarray:
        """The windows that may hold tokens of the spans [first, stop) of a queue, rising: never many more than hold one."""
        found = []
        for base, used, take in self.phases:
            mine = [(max(a, used[queue]) - used[queue], min(b, used[queue] + take[queue]) - used[queue]) for a, b in spans]
            for low, high in _ranks(take, queue, [(a, b) for a, b in mine if a < b], self.window):
                found.append(np.arange((base + low) // self.window, (base + high) // self.window + 1))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _ranks(take: list[int], queue: int, spans: list[tuple[int, int]], apart: int) -> list[tuple[int, int]]:
    """Intervals [low, high] of the order of all tokens by virtual time in which those of a queue's spans lie.

    A token's rank is its virtual time times the number of tokens, within the number of queues on either
    side. Where a queue's tokens are further apart than ``apart`` ranks each has an interval of its own, so
    that the intervals of a rare queue are as few as its tokens.
    """
    size, own, spare = sum(take), take[queue], len(take)
    if not spans:
        return []
    rank = lambda x: (2 * x + 1) * size // (2 * own)
    if size > own * (apart + 2 * spare):
        spans = [(x, x + 1) for a, b in spans for x in range(a, b)]
    return [(max(0, rank(a) - spare), min(size - 1, rank(b - 1) + spare)) for a, b in spans]


def _virtual(at: np.ndarray, take: list[int], size: int) -> np.ndarray:
    """Of the first ``at`` tokens by virtual time, how many come from each queue."""
    n = np.asarray(take, np.int64)
    if 2 * size * int(n.max()) < 2**62:
        got = (2 * at[:, None] * n[None, :] + size) // (2 * size)
    else:
        exact = (2 * at.astype(object)[:, None] * n.astype(object)[None, :] + size) // (2 * size)
        got = exact.astype(np.int64)
    got = np.minimum(got, n)
    due = at - got.sum(1)
    live = np.maximum(n, 1).astype(np.float64)
    while (up := np.flatnonzero(due > 0)).size:
        time = np.where(got[up] < n, (got[up] + 0.5) / live, np.inf)
        got[up, time.argmin(1)] += 1
        due[up] -= 1
    while (down := np.flatnonzero(due < 0)).size:
        time = np.where(got[down] > 0, (got[down] - 0.5) / live, -np.inf)
        k = time.shape[1] - 1 - time[:, ::-1].argmax(1)
        got[down, k] -= 1
        due[down] += 1
    return got


def _pieces(schedule: Schedule, width: int):
    kind = "<u4" if width == 4 else "<u2"

    def run(batches: Batches) -> Batches:
        pools: dict[int, Schedule] = {}
        for batch in batches:
            ids_col = batch.column(4).to_pylist()
            queues = list(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()))
            for (queue, _), totals in zip(queues, batch.column(6).to_pylist()):
                if totals is not None and queue not in pools:
                    pools[queue] = Schedule(totals, None, schedule.window)
            starts, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            spans: dict[tuple, list[tuple[int, int]]] = {}
            for q, s, n in zip(queues, starts, counts):
                own = spans.setdefault(q, [])
                if own and own[-1][1] == s:  # documents of a source follow each other
                    own[-1] = (own[-1][0], s + n)
                else:
                    own.append((s, s + n))
            edges = {q: _edges(schedule, pools, q, own) for q, own in spans.items()}
            rows, start_, length_, crc_, win_, off_ = [], [], [], [], [], []
            for i, (q, s, n) in enumerate(zip(queues, starts, counts)):
                windows, lows, highs, offsets = edges[q]
                k = int(np.searchsorted(highs, s, "right"))
                whole, at = np.frombuffer(ids_col[i], kind).astype("<u4").tobytes(), s
                while at < s + n:
                    if not lows[k] <= at < highs[k]:
                        raise RuntimeError("a token lies outside of the windows worked out for it")
                    to = min(s + n, int(highs[k]))
                    rows.append(i)
                    start_.append(at - s)
                    length_.append(to - at)
                    crc_.append(zlib.crc32(whole[4 * (at - s) : 4 * (to - s)]))
                    win_.append(int(windows[k]))
                    off_.append(int(offsets[k]) + at - int(lows[k]))
                    at, k = to, k + 1
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), *(pa.array(x, pa.int64()) for x in (start_, length_, crc_)), batch.column(3).take(take), *(pa.array(x, pa.int64()) for x in (win_, off_))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


#: Numbers of a table of windows and queues that are worked out at a time.
_CELLS = 1 << 21


def _edges(schedule: Schedule, pools: dict[int, Schedule], queue: tuple, spans: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """(window, first token, end, offset in the window) of what a queue, or a source of a pool, has in the windows of its spans."""
    at, slot = queue
    if slot is not None:
        totals = pools[at].totals
        spans = [(a, b + 1) for a, b in _ranks(totals, slot, spans, schedule.window)]
    windows = schedule.windows(at, spans)
    step = max(1, _CELLS // len(schedule.totals))
    parts = []
    for k in range(0, len(windows), step):
        own = windows[k : k + step]
        marks = np.union1d(own, own + 1)
        served = schedule.served(marks)
        first = np.searchsorted(marks, own)  # each window's end is the next mark
        lows, highs = served[first, at], served[first + 1, at]
        offsets = (served[first + 1, :at] - served[first, :at]).sum(1)
        if slot is not None:
            inside = _virtual(served[:, at], totals, sum(totals))
            lows, highs = inside[first, slot], inside[first + 1, slot]
            offsets = offsets + (inside[first + 1, :slot] - inside[first, :slot]).sum(1)
        held = highs > lows
        parts.append((own[held], lows[held], highs[held], offsets[held]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack(
    df: DataFrame,
    path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    targets: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` maps sources to weights (sources it doesn't name are served once the named ones are
    dry); None keeps the corpus's own proportions in every window.
    """
    spark = df.sparkSession
    prepared(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, source string, part int, place bigint, n bigint, ids binary"
    tokens = written(rows.mapInArrow(tidied(_tokenized(path, end_id)), schema), "tokens")
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = written(sums.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    aimed = F.lit(False) if targets is None else F.coalesce(F.col("source").isin([x for x in targets if x is not None]), F.lit(None in targets))
    limit = max(MAX_QUEUES, len(targets or {}))
    largest = [(r["source"], r["n"]) for r in by_source.orderBy(aimed.desc(), F.desc("n"), F.col("source").asc_nulls_last()).limit(limit).collect()]
    totals, weights = [n for _, n in largest], None if targets is None else [float(targets.get(s, 0.0)) for s, _ in largest]
    queues = spark.createDataFrame([(s, i, None, None) for i, (s, _) in enumerate(largest)], "source string, queue int, slot int, pool array<bigint>")
    rest = by_source.count() - len(largest)
    if rest > 0:
        pools = -(-rest // POOL)
        left = by_source.join(F.broadcast(queues.select(F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s")), "left_anti")
        left = left.withColumn("queue", (len(largest) + F.pmod(F.xxhash64("source", F.col("source").isNull()), F.lit(pools))).cast("int"))
        pooled = {r["queue"]: r["n"] for r in left.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
        totals += [pooled.get(len(largest) + k, 0) for k in range(pools)]
        weights = weights and weights + [0.0] * pools
        lists = left.groupBy("queue").agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "n"))).alias("x"))
        sources = lists.select("queue", F.posexplode("x").alias("slot", "y"), F.col("x.n").alias("pool"))
        queues = queues.unionByName(sources.select("y.source", "queue", "slot", "pool"))
    # A source may have a row for each partition; the running sum is over partitions, not documents.
    placed_sums = sums.withColumn("base", F.expr("sum(n) OVER (PARTITION BY source ORDER BY part ROWS UNBOUNDED PRECEDING) - n")).select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    queues = queues.withColumnRenamed("source", "q")
    places = written(placed_sums.join(queues, F.col("s").eqNullSafe(F.col("q"))).drop("q"), "places")
    schedule = Schedule(totals, weights, window)
    width = id_bytes(path)
    placed = tokens.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        "id", "queue", (F.col("base") + F.col("place")).alias("start"), "n", "ids", "slot", "pool"
    )
    out = "id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint".format(kind)
    return placed.mapInArrow(tidied(_pieces(schedule, width)), out).withColumnRenamed("id", id_col)
