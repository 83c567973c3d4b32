"""N-best SentencePiece segmentation, and decoding.

A text is normalised by its model, and its segmentations are the paths of a lattice whose edges are
pieces (their scores from the model file) and, for a character that is no piece, its bytes (ten
below the least score). The best paths come from a forward Viterbi pass, whose scores are exact
heuristics for a backward A-star search: paths leave the queue in the order of their scores.

No piece spans two characters that no piece has side by side. Texts are cut at such places, which
leaves short stretches that recur; each distinct one is searched once and remembered. The best path of
a text is the sum of its stretches', and its n best differ from it in the n - 1 stretches at most whose
second paths cost least, so whole texts of any length are segmented exactly without a lattice of
their own. Equal scores are told apart by place, so results do not depend on partitions.

Nulls count as the empty text (no pieces, score 0, one path); ids may be null or repeated; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, prepared, text_or_empty, texts, tidied
from quillgrid.llm.packing import Memory
from quillgrid.llm.token_counts import library

PATHS = 4
MEMO = 400_000
#: A piece's score counts as set by hand, not learnt, below this.
LEAST_LEARNT = -1e8

_SPACE = "▁"


def _unrolled(tail: tuple | None) -> tuple[int, ...]:
    """Ids of a path kept as a chain of (ids of a way, rest), which paths share."""
    out: list[int] = []
    while tail is not None:
        out += tail[0]
        tail = tail[1]
    return tuple(out)


class Lattice:
    """Pieces of a model, places where texts can be cut, and the search."""

    def __init__(self, path: str):
        self.model = model = library(path)
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k))]
        self.pieces = {model.id_to_piece(k): ((k,), model.get_score(k)) for k in plain}
        #: Every beginning of a piece: the piece it is, or nothing.
        self.begun: dict[str, tuple] = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.bytes = {int(model.id_to_piece(k)[3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.unknown = min(s for _, s in self.pieces.values() if s > LEAST_LEARNT) - 10.0
        letters = sorted({c for p in self.pieces for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.pieces:
            codes = self.number[[ord(c) for c in p]]
            self.joined[codes[:-1], codes[1:]] = True
        raw = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) or model.is_unknown(k) else model.id_to_piece(k).replace(_SPACE, " ").encode() for k in range(size)]
        self.lengths = np.asarray([len(x) for x in raw], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.memory = Memory(MEMO)

    def paths(self, text: str, n: int = PATHS) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a stretch, best first."""
        size, get = len(text), self.begun.get
        best = [0.0] + [-np.inf] * size
        into: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            base, alone = best[i], False
            for j in range(i + 1, size + 1):
                found = get(text[i:j])
                if found is None:  # no piece begins so
                    break
                if found:
                    if j == i + 1:
                        alone = True
                    into[j].append((i, *found))
                    if base + found[1] > best[j]:
                        best[j] = base + found[1]
            if not alone:
                into[i + 1].append((i, tuple(self.bytes[b] for b in text[i].encode("utf-8", "replace")), self.unknown))
                best[i + 1] = max(best[i + 1], base + self.unknown)
        # Every entry of the queue completes to a path of just its score, so more entries than paths wanted are never needed;
        # of the ways on from the first entry, the best has the entry's own score and is followed without queueing.
        out: list[tuple[float, tuple[int, ...]]] = []
        queue: list = [(-best[size], 0, size, 0.0, None)]
        made, room = 0, n
        while queue:
            _, _, at, cost, tail = queue.pop(0)
            room -= 1
            while at:
                edges = into[at]
                if len(edges) > 1:
                    ways = sorted([(-cost - s - best[i], k) for k, (i, _, s) in enumerate(edges)])
                    for f, k in ways[1:]:
                        if len(queue) >= room:
                            if not room or f >= queue[-1][0]:
                                break
                            queue.pop()
                        i, ids, s = edges[k]
                        made += 1
                        insort(queue, (f, made, i, cost + s, (ids, tail)))
                    i, ids, s = edges[ways[0][1]]
                else:
                    i, ids, s = edges[0]
                at, cost, tail = i, cost + s, (ids, tail)
            out.append((cost, _unrolled(tail)))
            if not room:
                break
        return out

    def learn(self, stretches: set[str], n: int) -> None:
        for text in stretches:
            found = self.paths(text, n)
            top = found[0][0]
            self.memory[text] = (array("I", found[0][1]).tobytes(), top, tuple((top - s, ids) for s, ids in found[1:]))

    def cut(self, values: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(stretches of all texts one after another, number of stretches of each)."""
        whole = "".join(values)
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4")
        sizes = np.asarray([len(v) for v in values], np.int64)
        numbers = self.number[codes]
        opens = np.ones(len(codes), bool)
        opens[1:] = ~self.joined[numbers[:-1], numbers[1:]]
        starts = np.cumsum(sizes) - sizes
        opens[starts[sizes > 0]] = True
        at = np.flatnonzero(opens)
        ends = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        offsets = np.concatenate([np.concatenate([[0], ends])[at], ends[-1:]]).astype(np.int64) if len(codes) else np.zeros(1, np.int64)
        data = whole.encode("utf-8", "replace")
        stretches = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        counts = np.bincount(np.searchsorted(np.cumsum(sizes), at, "right"), minlength=len(values)) if len(values) else np.zeros(0, np.int64)
        return stretches, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the normalised text, with spaces, that the ids stand for."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()


def combine(spare: list[tuple[float, int, list[float]]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n least sums of costs over places, each left as it is or changed to one of its ways: (sum, ((place, way), ...))."""
    best: list = [(0.0, ())]
    for _, place, costs in sorted(spare)[: n - 1]:
        more = [(s + c, (*w, (place, k))) for s, w in best for k, c in enumerate(costs)]
        best = heapq.nsmallest(n, best + more)
    return best


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def _segmented(path: str, n: int, keep_ids: bool):
    way = pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Batches) -> Batches:
        lat = lattice(path)
        for batch in batches:
            values = texts(batch, "text")
            normal = [lat.model.normalize(t) if t else "" for t in values]
            stretches, counts = lat.cut(normal)
            coded = stretches.dictionary_encode()
            known, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            lat.learn(lat.memory.unknown(set(known)), n)
            found = list(map(lat.memory.__getitem__, known))
            sizes = np.asarray([len(x[0]) // 4 for x in found], np.int64)
            scores = np.asarray([x[1] for x in found], np.float64)
            second = np.asarray([x[2][0][0] if x[2] else np.inf for x in found], np.float64)
            begins = np.cumsum(sizes) - sizes
            flat = np.frombuffer(b"".join(x[0] for x in found), "<u4")
            edges = np.concatenate([[0], np.cumsum(counts)])
            every, trips, lists = {"score": [], "n_pieces": [], "ids_crc32": []}, [], []
            offsets = [0]
            for k, text in enumerate(normal):
                own = at[edges[k] : edges[k + 1]]
                taken = sizes[own]
                ends = np.cumsum(taken)
                best = flat[np.repeat(begins[own] - ends + taken, taken) + np.arange(int(ends[-1]) if len(ends) else 0)]
                top = float(scores[own].sum())
                # Places by the cost of their second path, ties by place; more than n - 1 are never changed.
                costs = second[own]
                few = min(len(own), n - 1)
                if few and few < len(own):
                    limit = np.partition(costs, few - 1)[few - 1]
                    less = np.flatnonzero(costs < limit)
                    places = np.concatenate([less, np.flatnonzero(costs == limit)[: few - len(less)]])
                else:
                    places = np.arange(len(own))
                spare = [(float(costs[p]), int(p), [c for c, _ in found[own[p]][2]]) for p in places if np.isfinite(costs[p])]
                for cost, change in combine(spare, n):
                    ids, done, parts = best, 0, []
                    for p, w in sorted(change):
                        parts += [best[done : ends[p] - taken[p]], np.asarray(found[own[p]][2][w][1], best.dtype)]
                        done = ends[p]
                    if change:
                        ids = np.concatenate([*parts, best[done:]])
                    every["score"].append(top - cost)
                    every["n_pieces"].append(len(ids))
                    every["ids_crc32"].append(zlib.crc32(ids.astype("<u4", copy=False).tobytes()))
                    if keep_ids:
                        lists.append(ids)
                offsets.append(len(every["score"]))
                trips.append(lat.decode(best) == text.replace(_SPACE, " ").encode("utf-8", "replace"))
            columns = [pa.array(every[name], way.field(name).type) for name in every]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32))))
            ways = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(way)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ways, pa.array(trips, pa.bool_())], names=["id", "nbest", "round_trip"])
        lat.memory.old = {}

    return run


#: Texts that a task works on at a time; fewer where their ids are handed on.
ROWS = 2_048
ROWS_WITH_IDS = 128


def segment(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n: int = PATHS, keep_ids: bool = True) -> DataFrame:
    """(id, nbest, round_trip) of every text.

    ``nbest`` has a struct for each of the n best segmentations, best first: score, n_pieces, ids_crc32 (of
    the ids as little-endian 32-bit numbers) and, with ``keep_ids``, the ids themselves. ``round_trip``:
    whether the best path decodes to the normalised text.
    """
    prepared(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, nbest array<struct<score: double, n_pieces: bigint, ids_crc32: bigint{', ids: array<int>' * keep_ids}>>, round_trip boolean"
    return rows.mapInArrow(tidied(_segmented(path, n, keep_ids), ROWS_WITH_IDS if keep_ids else ROWS), schema).withColumnRenamed("id", id_col)


def _decoded(path: str):
    def run(batches: Batches) -> Batches:
        lat = lattice(path)
        for batch in batches:
            found = [None if ids is None else lat.decode(np.asarray(ids, np.int64)).decode("utf-8", "replace").removeprefix(" ") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "text"])

    return run


def decoded(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text."""
    prepared(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidied(_decoded(path), ROWS_WITH_IDS), f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode(text: str, path: str, n: int = PATHS) -> list[tuple[float, list[int]]]:
    """The n best (score, ids) of one text."""
    lat = lattice(path)
    stretches, _ = lat.cut([lat.model.normalize(text) if text else ""])
    each = [lat.paths(s, n) for s in stretches.to_pylist()]
    top = [p[0] for p in each]
    spare = [(p[0][0] - p[1][0], k, [p[0][0] - s for s, _ in p[1:]]) for k, p in enumerate(each) if len(p) > 1]
    out = []
    for cost, change in combine(spare, n):
        chosen = dict(change)
        ids = [i for k, p in enumerate(each) for i in (p[chosen[k] + 1][1] if k in chosen else p[0][1])]
        out.append((sum(s for s, _ in top) - cost, ids))
    return out


def decode(ids: list[int], path: str) -> str:
    """The text of ids, without the space that normalisation puts before it."""
    text = lattice(path).decode(np.asarray(ids, np.int64)).decode("utf-8", "replace")
    return text.removeprefix(" ")
