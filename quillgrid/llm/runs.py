"""Periodic runs of words: stretches that repeat a period several times over, found by a suffix automaton.

A run is a stretch of consecutive words with smallest period q and a length of ``min_length`` and
``min_exponent`` * q at least, which no neighbouring word extends keeping period q. The words of a text
are numbered and a suffix automaton is built of them. From its longest states to its shortest, the
ordered sets of end positions of a state's children are merged, the smaller into the larger; each end
that comes into a set is held against its new neighbours. Two neighbours at a distance d within the
state's length are the ends of a square of period d, and d is the smallest period there, as an end in
between would show a smaller one. Every square seeds one stretch, extended to both sides; seeds inside
a stretch already found with their period are passed over.

Only parts of a text that can hold a run go into an automaton. A run of exponent e has each of its words
e times and each pair of neighbours e - 1 times, and all windows of a length that follows from the two
bounds (five words for 4 and 6) twice at least; the parts are the stretches where all that holds in
the text, so that no run is lost or cut. Texts are worked on one at a time in a single pass without any
shuffle; the automaton needs a few hundred bytes for each word of such a stretch.

``find`` gives a row for each row: nulls count as the empty text (no words, no runs); ids may be null or
repeated; ties are ordered by start, then period; an empty table gives no rows; other columns are never
read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import let
from quillgrid.llm.common import Batches, prepared, text_or_empty, texts, tidied

MIN_LENGTH = 6
MIN_EXPONENT = 4
_BLOCK = 1024


class Ends:
    """An ordered set of numbers in blocks, so that coming in costs little in sets of any size."""

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        at = max(0, bisect_right(self.lows, x) - 1)
        block = self.blocks[at]
        insort(block, x)
        self.lows[at] = block[0]
        self.size += 1
        if len(block) > _BLOCK:
            self.blocks[at : at + 1] = block[: _BLOCK // 2], block[_BLOCK // 2 :]
            self.lows.insert(at + 1, self.blocks[at + 1][0])

    def neighbours(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after the member x."""
        at = bisect_right(self.lows, x) - 1
        block = self.blocks[at]
        k = bisect_left(block, x)
        before = block[k - 1] if k else self.blocks[at - 1][-1] if at else None
        after = block[k + 1] if k + 1 < len(block) else self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None
        return before, after


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of the states of the suffix automaton; end is -1 for the root and for copied states.

    Most states have one transition, which lies in two lists; only states with more have a dictionary.
    """
    length, link, end, symbol, target = [0], [-1], [-1], [-1], [-1]
    more: dict[int, dict[int, int]] = {}
    last = 0
    for place, c in enumerate(codes):
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(place)
        symbol.append(-1)
        target.append(-1)
        p, q = last, -1
        while p >= 0:
            if symbol[p] == c:
                q = target[p]
                break
            if symbol[p] < 0:
                symbol[p], target[p] = c, now
            else:
                own = more.get(p)
                if own is None:
                    more[p] = {c: now}
                elif (q := own.get(c, -1)) >= 0:
                    break
                else:
                    own[c] = now
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                symbol.append(symbol[q])
                target.append(target[q])
                if q in more:
                    more[copy] = dict(more[q])
                link[q] = link[now] = copy
                while p >= 0:
                    if symbol[p] == c:
                        if target[p] != q:
                            break
                        target[p] = copy
                    else:
                        own = more.get(p)
                        if own is None or own.get(c) != q:
                            break
                        own[c] = copy
                    p = link[p]
        last = now
    return length, link, end


def _reach(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from the places a < b on, rightwards (step 1) or leftwards (step -1), in growing bites."""
    n, found, bite = len(codes), 0, 16
    while True:
        room = min(bite, n - b - found if step > 0 else a - found + 1)
        if room <= 0:
            return found
        if step > 0:
            same = codes[a + found : a + found + room] == codes[b + found : b + found + room]
        else:
            same = codes[a - found - room + 1 : a - found + 1][::-1] == codes[b - found - room + 1 : b - found + 1][::-1]
        if not same.all():
            return found + int(same.argmin())
        found += room
        bite *= 2


class Stretches:
    """Maximal stretches by their period; two of the same period share fewer words than it."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.found = codes, {}

    def seed(self, i: int, j: int) -> None:
        """The words that end at i and at j agree on j - i places at least."""
        d = j - i
        own = self.found.setdefault(d, [])
        at = bisect_right(own, (i - d + 1, len(self.codes))) - 1
        if at >= 0 and own[at][1] >= j:
            return
        start = i - _reach(self.codes, i, j, -1) + 1
        insort(own, (start, j + _reach(self.codes, i + 1, j + 1, 1)))

    def runs(self, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of the stretches that are long enough."""
        return [(a, b - a + 1, d) for d, own in self.found.items() for a, b in own if b - a + 1 >= max(min_length, min_exponent * d)]


def squares(codes: np.ndarray) -> Stretches:
    """All maximal stretches of two periods or more, each with its smallest period."""
    length, link, end = automaton(codes.tolist())
    kids: list[list[int] | None] = [None] * len(length)
    for state in range(1, len(length)):
        if kids[link[state]] is None:
            kids[link[state]] = [state]
        else:
            kids[link[state]].append(state)
    out = Stretches(codes)
    sets: list[Ends | None] = [None] * len(length)
    for state in np.argsort(-np.asarray(length), kind="stable").tolist():
        if state == 0:  # the empty word: no distance is within its length
            break
        own = [sets[k] for k in kids[state] or ()]
        for k in kids[state] or ():
            sets[k] = None
        if end[state] >= 0:
            own.append(Ends(end[state]))
        large = max(own, key=lambda s: s.size)
        come = [x for s in own if s is not large for x in s]
        for x in come:
            large.add(x)
        sets[state] = large
        limit = length[state]
        for x in come:
            before, after = large.neighbours(x)
            if before is not None and x - before <= limit:
                out.seed(before, x)
            if after is not None and after - x <= limit:
                out.seed(x, after)
    return out


def _often(keys: np.ndarray, times: int) -> np.ndarray:
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[place] >= times


def _all_of(marks: np.ndarray, width: int) -> np.ndarray:
    """Whether all marks of each window are set."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[width:] - total[:-width] == width


def repeating_parts(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Stretches [a, b) outside of which there is no run."""
    n = len(codes)
    if n < min_length:
        return []
    # A window of so many words fits twice into every run at its period's distance.
    width = max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2)))
    keep = _all_of(np.bincount(codes)[codes] >= min_exponent, width)
    if keep.any() and width > 1:
        keep &= _all_of(_often(codes[:-1] * (codes.max() + 1) + codes[1:], min_exponent - 1), width - 1)
    if keep.any():
        # Windows with equal hashes count as equal: a collision may keep a part too much, never too few.
        mixed = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (codes[k : n - width + 1 + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        keep &= _often(mixed, 2)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    return [(a, b + width - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + width - 1 - a >= min_length]


def runs_of(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period."""
    numbers = dict(zip(dict.fromkeys(words), range(len(words))))
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    found: set[tuple[int, int, int]] = set()
    for a, b in repeating_parts(codes, min_length, min_exponent):
        found.update((a + start, length, period) for start, length, period in squares(codes[a:b]).runs(min_length, min_exponent))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([w for w, held in zip(words, np.cumsum(change)[:-1].tolist()) if not held])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(min_length: int, min_exponent: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            counts, runs, left = [], [], []
            for text in texts(batch, "text"):
                words = text.encode("utf-8", "surrogatepass").split()  # bytes split at space and 09 to 0D only
                own = runs_of(words, min_length, min_exponent)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                left.append(collapsed(words, own).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, n_words, runs, collapsed): every run of every row's words, and the text without the repetitions."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(tidied(_found(min_length, min_exponent)), schema).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of the longest run of each row (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose crc32 h divides by ten, with its words from a place on repeated at a period.

    With g = h / 10 and n words, the place is a = g % n and the period 1 + (n - a) / (3 + g % 8), both whole
    divisions. A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")

    def repeated(v: Column) -> Column:
        place = lambda i: F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(v["w"]) - 1), lambda i: v["w"][place(i)]), " ")

    def sized(v: Column) -> Column:
        p = lambda u: F.lit(1) + F.floor((F.size(u["w"]) - u["a"]) / (F.lit(3) + u["g"] % 8))
        with_a = F.struct(v["w"].alias("w"), v["g"].alias("g"), (v["g"] % F.size(v["w"])).alias("a"))
        return let(with_a, lambda u: let(F.struct(u["w"].alias("w"), u["a"].alias("a"), p(u).alias("p")), repeated))

    whole = let(F.struct(words.alias("w"), F.floor(h / 10).alias("g")), lambda v: F.when(F.size(v["w"]) > 0, sized(v)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, whole).otherwise(text)
