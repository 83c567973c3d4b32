"""Log-likelihoods of whole documents by a gated recurrent language model.

Tokens are the words of a text (ASCII letters lower-cased) and one end. Their counts over all training
documents are summed in Spark. The ``SHORTLIST`` commonest tokens are outputs of the network; every
other word belongs to one of ``GROUPS`` groups by its last letters, each group is an output too, and
within a group words have their smoothed frequencies over the whole corpus, so that the
probabilities of all words add up to one. The output softmax is factored: classes of tokens of like
frequency, then the token in its class; its biases start from the counts of the whole corpus.

A gated recurrent unit is trained in numpy by truncated backpropagation through time on every token of
every training document, in ``ROUNDS`` rounds over disjoint shares of the documents. In a round each
task starts from the same network, runs through its documents (many streams side by side, the state
carried from one stretch to the next), and hands its parameters on; their mean, weighted by tokens
and summed in Spark in two steps, is the network of the next round. Tasks get ``TASK_TOKENS`` tokens
or more, so their number and the work follow the corpus, and what reaches the driver is one network.

Scoring runs many documents side by side in windows and carries each one's state from window to
window to its end. The head of the vocabulary (the commonest words, ``HEAD`` at most, cut off at a
count found from a histogram) goes to the executors; occurrences of rarer words are joined with
their counts, an ordinary shuffle join.

Nulls count as the empty text (one end); ids may be null (in training) or repeated, each row is
scored; without training rows all words are unseen; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, fold, prepared, text_or_empty, texts, tidied, written

FOLDS = 5
HELD_OUT = 1
SHORTLIST = 600
GROUPS = 96
HEAD = 200_000
HIDDEN = 16
#: Eighths of the documents that each round of training has.
ROUNDS = ((0, 1), (1, 8))
#: Training tokens of a task at least (where the corpus has so many).
TASK_TOKENS = 2_000_000
#: Tokens that a task holds before it trains on them.
RUN_TOKENS = 1_000_000
STEPS = 24
STREAMS = 512
RATE = 0.3
#: Parameters are kept within this (biases of the output may be lower).
CLIP = 4.0
#: Steps that a run of tokens is good for at least: short runs have fewer streams.
LEAST_UPDATES = 64
#: Parameters of a row of the table in which networks are added up, and tasks that the first step adds up.
SLOT = 8_192
ADDED_TASKS = 64
#: Tokens that a worker holds before it scores them.
HELD_TOKENS = 1_500_000
WINDOW = 16
#: Words that a worker counts before it hands the counts on.
COUNTED_WORDS = 300_000

END = b""


#: Bytes of a text that are split into words at a time.
SPLIT_BYTES = 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def tokens_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text, without the end, in lists of bounded size."""
    raw, at = text.encode("utf-8", "surrogatepass").lower(), 0
    while len(raw) - at > SPLIT_BYTES and (blank := _BLANK.search(raw, at + SPLIT_BYTES)):
        yield raw[at : blank.start()].split()
        at = blank.end()
    yield raw[at:].split()


def group_of(word: bytes, groups: int = GROUPS) -> int:
    """Group of a word outside the shortlist, by its last two bytes and whether punctuation follows them."""
    bare = word.rstrip(b".,;:!?*#$%&|\"')")
    return zlib.crc32(bare[-2:] if len(bare) == len(word) else bare[-2:] + b".") % groups


def _counted(batches: Batches) -> Batches:
    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in texts(batch, "text"):
            found[END] += 1
            for words in tokens_of(text):
                found.update(words)
                if len(found) > COUNTED_WORDS:
                    yield out(found)
                    found = Counter()
    yield out(found)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; the end is the empty word."""
    prepared(docs.sparkSession)
    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(tidied(_counted), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """A gated recurrent unit with a class-factored softmax; tokens are numbered by falling frequency."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        m = len(counts)
        self.hidden, self.m = hidden, m
        self.size = max(1, math.isqrt(m - 1) + 1) if m else 1  # tokens of a class
        self.classes = -(-m // self.size)
        small = lambda *s: (rng.standard_normal(s) * 0.08).astype(np.float32)
        padded = np.zeros(self.classes * self.size)
        padded[:m] = counts + 0.5
        by_class = padded.reshape(self.classes, self.size)
        with np.errstate(divide="ignore"):
            word_bias = np.where(by_class > 0, np.log(by_class / by_class.sum(1, keepdims=True)), -1e9)
        self.lowest = {"bc": -np.inf, "bw": -np.inf}
        self.p = {
            "x": small(m, 3 * hidden),
            "u": small(hidden, 3 * hidden),
            "b": np.zeros(3 * hidden, np.float32),
            "wc": small(hidden, self.classes),
            "bc": np.log(by_class.sum(1) / by_class.sum()).astype(np.float32),
            "ww": small(self.classes, hidden, self.size),
            "bw": word_bias.astype(np.float32),
        }

    def step(self, token: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, update gate, reset gate, candidate, candidate's recurrent part)."""
        k = self.hidden
        x = self.p["x"][token]
        x += self.p["b"]
        a = h @ self.p["u"]
        gates = x[:, : 2 * k] + a[:, : 2 * k]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :k], gates[:, k:]
        part = a[:, 2 * k :]
        n = r * part
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, part

    def _softmax(self, h: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, their exponentials, sums of these); states lie in -1..1 and weights are clipped, so nothing overflows."""
        logits = h @ w
        logits += b
        e = np.exp(logits)
        return logits, e, e @ np.ones(e.shape[1], e.dtype)

    def _members(self, c: np.ndarray):
        """(class, places of its targets) of every class that has some."""
        order = np.argsort(c.astype(np.uint16 if self.classes <= 1 << 16 else np.int64), kind="stable")
        edges = np.searchsorted(c[order], np.arange(self.classes + 1))
        return [(k, order[edges[k] : edges[k + 1]]) for k in np.flatnonzero(np.diff(edges))]

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after each state."""
        c = target // self.size
        logits, _, sums = self._softmax(h, self.p["wc"], self.p["bc"])
        out = (logits[np.arange(len(c)), c] - np.log(sums)).astype(np.float64)
        for k, at in self._members(c):
            own, _, sums = self._softmax(h[at], self.p["ww"][k], self.p["bw"][k])
            out[at] += own[np.arange(len(at)), target[at] - k * self.size] - np.log(sums)
        return out

    def _output_gradients(self, h: np.ndarray, target: np.ndarray, g: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
        c, n = target // self.size, len(target)
        logits, probs, sums = self._softmax(h, self.p["wc"], self.p["bc"])
        loss = float((np.log(sums) - logits[np.arange(n), c]).sum())
        probs /= sums[:, None]
        probs[np.arange(n), c] -= 1
        g["wc"] += h.T @ probs
        g["bc"] += np.ones(n, probs.dtype) @ probs
        dh = probs @ self.p["wc"].T
        for k, at in self._members(c):
            states, inside, places = h[at], target[at] - k * self.size, np.arange(len(at))
            logits, own, sums = self._softmax(states, self.p["ww"][k], self.p["bw"][k])
            loss += float((np.log(sums) - logits[places, inside]).sum())
            own /= sums[:, None]
            own[places, inside] -= 1
            g["ww"][k] += states.T @ own
            g["bw"][k] += np.ones(len(at), own.dtype) @ own
            dh[at] += own @ self.p["ww"][k].T
        return loss, dh

    def train(self, line: np.ndarray, squares: dict[str, np.ndarray], steps: int = STEPS, streams: int = STREAMS, rate: float = RATE) -> float:
        """Truncated backpropagation through time over documents laid end to end, each closed by token 0; the mean loss.

        The line is cut into streams that run side by side; every token is a target once. ``squares``
        holds the summed squares of the gradients, by which steps are scaled.
        """
        k, n = self.hidden, len(line)
        width = max(1, min(streams, n // (LEAST_UPDATES * steps)))
        long = -(-n // width)
        padded = np.zeros(width * long + 1, np.int64)
        padded[1 : n + 1] = line
        given, wanted = padded[:-1].reshape(width, long), padded[1:].reshape(width, long)
        live = np.arange(width * long).reshape(width, long) < n
        h, total = np.zeros((width, k), np.float32), 0.0
        for start in range(0, long, steps):
            times = range(start, min(long, start + steps))
            states = np.empty((len(times), width, k), np.float32)
            trace = []
            for i, t in enumerate(times):
                before = h * (given[:, t] != 0)[:, None]  # an end: the next document starts from nothing
                h, z, r, x, part = self.step(given[:, t], before)
                states[i] = h
                trace.append((before, z, r, x, part))
            g = {name: np.zeros_like(self.p[name]) for name in self.p if name != "x"}
            due = live[:, times.start : times.stop].T.ravel()
            hidden, target = states.reshape(-1, k), wanted[:, times.start : times.stop].T.ravel()
            if due.all():
                loss, dh_out = self._output_gradients(hidden, target, g)
            else:
                loss, some = self._output_gradients(hidden[due], target[due], g)
                dh_out = np.zeros_like(hidden)
                dh_out[due] = some
            total += loss
            dh_out = dh_out.reshape(len(times), width, k)
            dh, inputs = np.zeros((width, k), np.float32), np.empty((len(times), width, 3 * k), np.float32)
            for i in range(len(times) - 1, -1, -1):
                before, z, r, x, part = trace[i]
                dh = dh + dh_out[i]
                kept = 1 - z
                down = dh * kept
                dx = down * (1 - x * x)
                kept = before - x
                kept *= z
                np.multiply(kept, down, out=inputs[i, :, :k])
                kept = 1 - r
                kept *= part
                kept *= r
                np.multiply(kept, dx, out=inputs[i, :, k : 2 * k])
                inputs[i, :, 2 * k :] = dx
                recurrent = inputs[i].copy()
                recurrent[:, 2 * k :] *= r
                g["u"] += before.T @ recurrent
                dh = (dh * z + recurrent @ self.p["u"].T) * (given[:, times[i]] != 0)[:, None]
            flat, tokens = inputs.reshape(-1, 3 * k), given[:, times.start : times.stop].T.ravel()
            g["b"] += flat.sum(0)
            order = np.argsort(tokens.astype(np.uint16 if self.m <= 1 << 16 else np.int64), kind="stable")
            rows, firsts = np.unique(tokens[order], return_index=True)
            for name, d, at in (("x", np.add.reduceat(flat[order], firsts), rows), *((name, d, slice(None)) for name, d in g.items())):
                d /= width
                squares[name][at] += d * d
                self.p[name][at] = np.clip(self.p[name][at] - rate * d / np.sqrt(squares[name][at]), self.lowest.get(name, -CLIP), CLIP)
        return total / max(1, n)

    def squares(self) -> dict[str, np.ndarray]:
        return {name: np.full_like(x, 1e-5) for name, x in self.p.items()}

    def flat(self) -> np.ndarray:
        """All parameters one after another."""
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        """Take parameters as ``flat`` gives them."""
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each document (its tokens with the end), all run side by side in windows."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lengths = np.asarray([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        live_at = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # documents longer than t come first
        h = np.zeros((len(order), self.hidden), np.float32)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def settle() -> None:
            nonlocal held
            if kept:
                states, target, owner = (np.concatenate(x) for x in zip(*kept))
                out[:] += np.bincount(owner, self.log_probs(states, target), len(docs))
                kept.clear()
                held = 0

        names, token = np.asarray(order), np.zeros(len(order), np.int64)
        for t, live in enumerate(live_at.tolist()):
            h = self.step(token[:live], h[:live])[0]
            token = flat[starts[:live] + t]
            kept.append((h, token, names[:live]))
            held += live
            if held >= 1024 * WINDOW:
                settle()
        settle()
        return out


class Tables:
    """What workers need to know of the corpus: the head of the counts and the groups' sizes."""

    def __init__(self, head: list[tuple[bytes, int]], group_sums: dict[int, tuple[int, int]], total: int, distinct: int, shortlist: int = SHORTLIST, groups: int = GROUPS):
        self.total, self.distinct, self.groups = total, distinct, groups
        short = [w for w, _ in head if w != END][:shortlist]
        self.outputs = {END: 0} | {w: k for k, w in enumerate(short, 1)}
        known = dict(head)
        self.words = [END, *(w for w, _ in head if w != END)]
        self.log_c = np.log10(np.asarray([known.get(w, 0) for w in self.words]) + 0.5)
        self.short = len(self.outputs)
        # Network outputs: end, shortlist, groups; then numbered anew by falling frequency, the end staying first.
        sums = [group_sums.get(g, (0, 0)) for g in range(groups)]
        counts = np.asarray([known.get(w, 0) for w in self.outputs] + [n for n, _ in sums], np.float64)
        rank = np.concatenate([[0], 1 + np.argsort(-counts[1:], kind="stable")])
        self.number = np.empty(len(counts), np.int64)
        self.number[rank] = np.arange(len(counts))
        self.counts = counts[rank]
        self.log_group = np.asarray([math.log10(n + 0.5 * (v + 1)) for n, v in sums])
        self.log_base = math.log10(total + 0.5 * (distinct + 1))
        self.code = np.asarray([self.outputs[w] if w in self.outputs else self.short + group_of(w, groups) for w in self.words], np.int64)

    def lookup(self) -> "_Lookup":
        return _Lookup({w: k for k, w in enumerate(self.words)}, self.groups)

    def places(self, text: str, lookup: "_Lookup") -> tuple[np.ndarray, list[bytes]]:
        """(place in the head of every word, or -1 less its group; the words that are not in the head)."""
        places, rare = [], []
        for words in tokens_of(text):
            at = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
            rare += [words[i] for i in np.flatnonzero(at < 0)]
            places.append(at)
        return np.concatenate(places), rare

    def codes(self, at: np.ndarray) -> np.ndarray:
        """Network outputs, as first numbered, of places."""
        return np.where(at < 0, self.short - 1 - at, self.code[np.maximum(at, 0)])


class _Lookup(dict):
    """Place of a word in the head; for other words -1 less their group."""

    def __init__(self, places: dict[bytes, int], groups: int):
        super().__init__(places)
        self.groups = groups

    def __missing__(self, word: bytes) -> int:
        return -1 - group_of(word, self.groups)


def _grouped(groups: int, skip: frozenset):
    def run(batches: Batches) -> Batches:
        n, v = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in skip:
                    g = group_of(word, groups)
                    n[g] += count
                    v[g] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), pa.array(n), pa.array(v)], names=["g", "n", "v"])

    return run


def _trained(tables: Tables, network: Network):
    """Trains a copy of the network on a task's documents: its parameters times the tokens, in slots."""

    def run(batches: Batches) -> Batches:
        lookup, squares, seen = tables.lookup(), network.squares(), 0
        held, size = [], 0
        for batch in batches:
            for text in texts(batch, "text"):
                held.append(np.append(tables.number[tables.codes(tables.places(text, lookup)[0])], 0))
                size += len(held[-1])
                if size >= RUN_TOKENS:
                    network.train(np.concatenate(held), squares)
                    seen, held, size = seen + size, [], 0
        if held:
            network.train(np.concatenate(held), squares)
            seen += size
        if seen:
            flat = network.flat().astype(np.float64) * seen
            slots = [flat[k : k + SLOT].tobytes() for k in range(0, len(flat), SLOT)]
            part, n = TaskContext.get().partitionId(), len(slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([float(seen)] * n, pa.float64()), pa.array(slots, pa.binary())],
                names=["part", "slot", "weight", "values"],
            )

    return run


_SLOTS = "part int, slot int, weight double, values binary"


def _added(table: pa.Table) -> pa.Table:
    """The sum of weights and values, always in the order of the parts."""
    table = table.sort_by("part")
    total = np.zeros(len(table["values"][0].as_py()) // 8)
    for x in table["values"]:
        total += np.frombuffer(x.as_buffer(), np.float64)
    first = table.slice(0, 1)
    return pa.table({"part": first["part"], "slot": first["slot"], "weight": [float(np.sum(table["weight"].to_numpy()))], "values": pa.array([total.tobytes()], pa.binary())})


def fit_network(train: DataFrame, tables: Tables, id_col: str, text_col: str) -> Network:
    """A network trained on all rows: in each round the mean of the networks of its tasks."""
    network = Network(tables.counts)
    eighth = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_or_empty(text_col)), F.lit(8))
    for low, high in ROUNDS:
        tasks = max(1, tables.total * (high - low) // 8 // TASK_TOKENS)
        share = train.where((eighth >= low) & (eighth < high)).select(text_or_empty(text_col).alias("text")).coalesce(tasks)
        slots = share.mapInArrow(tidied(_trained(tables, network)), _SLOTS)
        some = slots.groupBy("slot", F.floor(F.col("part") / ADDED_TASKS)).applyInArrow(lambda t: _added(t), _SLOTS)
        found = some.groupBy("slot").applyInArrow(lambda t: _added(t), _SLOTS).toArrow().sort_by("slot")
        if found.num_rows:
            network.load(np.concatenate([np.frombuffer(x.as_buffer(), np.float64) / w.as_py() for x, w in zip(found["values"], found["weight"])]))
    return network


def _scored(tables: Tables, network: Network):
    def run(batches: Batches) -> Batches:
        lookup, part, row = tables.lookup(), TaskContext.get().partitionId(), 0
        ids, docs, rows, sizes, known, base, fixed, tails = [], [], [], [], [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held
            scores = network.score(docs) / math.log(10) + np.asarray(fixed)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.concat_arrays(ids),
                    pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array(tails, pa.list_(pa.binary())),
                ],
                names=["row", "id", "n_tokens", "head_tokens", "head_base", "head_score", "tail"],
            )
            for x in (ids, docs, rows, sizes, known, base, fixed, tails):
                x.clear()
            held = 0
            return batch

        for batch in batches:
            values, begin = texts(batch, "text"), 0
            for k, text in enumerate(values):
                at, tail = tables.places(text, lookup)
                n, code, rare = len(at) + 1, tables.codes(at), at < 0
                log_c = np.where(rare, 0.0, tables.log_c[np.maximum(at, 0)])
                grouped = code >= tables.short
                docs.append(np.append(tables.number[code], 0))
                rows.append((part << 33) + row)
                row += 1
                sizes.append(n)
                known.append(n - 1 - len(tail) + (tables.log_c[0] > math.log10(0.75)))
                base.append(float(log_c.sum() + tables.log_c[0] - n * tables.log_base))
                fixed.append(float(log_c[grouped].sum() - tables.log_group[code[grouped] - tables.short].sum()))
                tails.append(tail)
                held += n
                if held >= HELD_TOKENS:
                    ids.append(batch.column(0).slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield out()
            if begin < len(values):
                ids.append(batch.column(0).slice(begin))
        if rows:
            yield out()

    return run


def _bin(n):
    """Sixteenths of the powers of two, in which counts are put for the cut-off."""
    return F.floor(F.log2(n) * 16)


def head_of(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, n) of the commonest words by falling count: all above a count such that they are ``most`` at most, and the end."""
    bins = sorted(((r["bin"], r["words"]) for r in counts.groupBy(_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    cut, held = math.inf, 0
    for bin_, words in bins:
        held += words
        if held > most:
            break
        cut = bin_
    found = counts.where((F.col("word") == F.lit(END)) | (_bin(F.col("n")) >= F.lit(float(cut)))).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return list(zip(found["word"].to_pylist(), found["n"].to_pylist()))


def fit(train: DataFrame, id_col: str, text_col: str) -> tuple[Tables, Network, DataFrame]:
    """Tables and network from training documents, and their (word, n)."""
    counts = written(word_counts(train, text_col), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = head_of(counts, HEAD)
    short = frozenset([END, *[w for w, _ in head if w != END][:SHORTLIST]])
    sums = counts.select("word", "n").mapInArrow(tidied(_grouped(GROUPS, short)), "g bigint, n bigint, v bigint").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    tables = Tables(head, {int(r["g"]): (int(r["n"]), int(r["v"])) for r in sums.collect()}, int(total), int(distinct))
    return tables, fit_network(train, tables, id_col, text_col), counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    prepared(docs.sparkSession)
    tables, network, counts = fit(docs.where(fold(id_col, FOLDS) != HELD_OUT), id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"row bigint, id {kind}, n_tokens bigint, head_tokens bigint, head_base double, head_score double, tail array<binary>"
    scored = written(rows.mapInArrow(tidied(_scored(tables, network)), schema), "scores")
    rare = scored.select("row", F.explode("tail").alias("word"))
    joined = rare.join(counts.select("word", "n"), "word", "left")
    tail = joined.groupBy(F.col("row").alias("tail_row")).agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log"), F.count("n").alias("tail_known")
    )
    whole = scored.drop("tail").join(tail, F.col("row") == F.col("tail_row"), "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        (fold("id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("head_tokens") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tables.total).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + log).alias("base_score"),
        (F.col("head_score") + log).alias("score"),
    )
