"""Toxicity by weak supervision.

Voters look at whole texts: lexicons (seed words, and words and word beginnings mined from the labelled
rows, in groups of like strength) and patterns (insults aimed at a reader, shouted or masked words). A
generative label model estimates each voter's accuracy and coverage by expectation maximisation, with
the labelled mark as one more voter whose accuracy it estimates too, and deflates voters by how they
correlate beyond what the label explains. A linear classifier is trained on the posterior labels over
words, word beginnings and the voters, and scores every text.

Only rows with a label outside the held-out fold take part in training: a sample of ``SAMPLE_ROWS`` of
the labelled ids at most, those with the least hashes, each with its whole text (of several rows of
an id the one with the least hash of its text). The bound is a parameter of the fit; every row is scored
on its whole text. Labelled rows with the same label and the same longest words are copies: they share the
weight of one row, so that copies of one toxic text do not make its other words look toxic. The fit runs
in one task over this bounded sample; the driver gets the model only.

Nulls count as the empty text, which has the score of a text without features; ids may be null (never
held out, crc32 of the empty text) or repeated (rows are scored one by one; of several labels of an id the
largest counts). Without labelled rows, or with one class only, all scores come from the seed lexicon
voters. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, fold, prepared, text_or_empty, texts, tidied

FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
SAMPLE_ROWS = 10_000
MINED_GROUPS = 12
PREFIXES = (4, 5, 6, 7, 8)
#: Training rows made for a mined feature alone, at most.
ALONE = 10
#: Lower end of a feature's log odds for it to count as well attested.
ATTESTED = 4.0
#: Lower end of a feature's log odds for it to be mined.
SURE = 1.0

# Seed lexicon of common insults and slurs on character, by language.
SEEDS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown imbecile jerk bastard bitch asshole shit fuck fucking crap hate",
    "de": "idiot idioten dumm blöd trottel abschaum wertlos erbärmlich widerlich arschloch scheiße depp versager",
    "fr": "idiot idiote crétin stupide nul ordure minable pathétique dégoûtant connard salaud merde imbécile",
    "es": "idiota estúpido imbécil basura inútil patético asqueroso payaso perdedor mierda cabrón tonto",
}

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
_AIMED = re.compile(rb"\b(?:you|du|tu|vous|eres) (?:are|bist|es|\xc3\xaates|un|una|ein|eine|a|an) (?:\w+ ){0,2}\w*(?:idiot|moron|stupid|loser|scum|trash|clown|dumm|idiota)", re.I)
_MASKED = re.compile(rb"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]+\b")
_SHOUTED = re.compile(rb"[!?]{3,}")
PATTERNS = (_AIMED, _MASKED, _SHOUTED)


def words_of(text: str) -> set[bytes]:
    """Distinct words, ASCII letters lower-cased, punctuation as white space."""
    return set(text.encode("utf-8", "surrogatepass").translate(_SPLIT).split())


@dataclass
class Model:
    """All that scoring needs; its size is bounded by the number of mined and classified features."""

    weights: dict[bytes, float] = field(default_factory=dict)
    pattern_weights: tuple[float, ...] = (0.0,) * len(PATTERNS)
    bias: float = -3.0
    #: What the label model found: (voter, accuracy, coverage, weight), for inspection.
    voters: list[tuple[str, float, float, float]] = field(default_factory=list)

    def score(self, text: str) -> float:
        total, get = self.bias, self.weights.get
        words = words_of(text)
        for w in words:
            if (x := get(w)) is not None:
                total += x
        longer = {w for w in words if len(w) > PREFIXES[0]}
        begins: set[bytes] = set()
        for n in PREFIXES:
            begins |= {w[:n] + b"*" for w in longer if len(w) > n}
        for w in begins:
            if (x := get(w)) is not None:
                total += x
        if any(self.pattern_weights):
            raw = text.encode("utf-8", "surrogatepass")
            for p, x in zip(PATTERNS, self.pattern_weights):
                if x and p.search(raw):
                    total += x
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))


class Sample:
    """Labelled rows as arrays: each distinct word is kept once, each row as the numbers of its words."""

    def __init__(self):
        self.families: dict[tuple, int] = {}
        self.family: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []
        self.hits: list[int] = []
        self.labels: list[int] = []

    def add(self, words, hits: int, label: int) -> None:
        longest = (label, *sorted(words, key=lambda w: (-len(w), w))[:3])
        alone = (len(self.rows),)  # short texts are no copies of each other
        self.family.append(self.families.setdefault(longest if len(words) > 3 else alone, len(self.families)))
        own = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
        self.rows.append(np.unique(np.asarray(own, np.int32)))
        self.hits.append(hits)
        self.labels.append(label)

    def weights(self) -> np.ndarray:
        """One for each row, shared out among copies."""
        return 1 / np.bincount(self.family)[self.family] if self.rows else np.zeros(0)

    def holding(self, words: set[bytes]) -> np.ndarray:
        """Whether each row has one of the words."""
        wanted = np.zeros(len(self.numbers), bool)
        wanted[[self.numbers[w] for w in words if w in self.numbers]] = True
        return np.asarray([bool(wanted[r].any()) for r in self.rows])

    def features(self, marked: np.ndarray, least: int) -> tuple[list[bytes], np.ndarray]:
        """Features that so many of the marked rows have, and for each word the numbers of its own (0 for none).

        Only features of words in marked rows are ever named, which are far fewer than all.
        """
        words, known = list(self.numbers), np.zeros(len(self.numbers), bool)
        for k in np.flatnonzero(marked):
            known[self.rows[k]] = True
        counts: dict[bytes, float] = {}
        weights = self.weights()
        for k in np.flatnonzero(marked):
            for f in {f for w in self.rows[k].tolist() for f in features_of(words[w])}:
                counts[f] = counts.get(f, 0.0) + weights[k]
        names = [b"", *sorted(f for f, n in counts.items() if n >= least - 1e-9)]
        numbers = {f: k for k, f in enumerate(names)}
        table = np.zeros((len(words), 1 + len(PREFIXES)), np.int32)
        for k, word in enumerate(words):
            for j, f in enumerate(features_of(word)):
                table[k, j] = numbers.get(f, 0)
        return names, table


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, as far as it is longer; beginnings end in a star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def _mine(sample: Sample, y: np.ndarray) -> list[tuple[bytes, float, np.ndarray]]:
    """All features far commoner in toxic rows: (feature, lower end of its log odds, rows that have it); the sample's rows bound their number."""
    weights = sample.weights()
    n1, n0 = float(weights[y == 1].sum()), float(weights[y == 0].sum())
    names, table = sample.features(y == 1, max(3, round(0.005 * n1)))
    df = np.zeros((2, len(names)))
    for own, mark, weight in zip(sample.rows, y, weights):
        df[mark, np.unique(table[own])] += weight
    a, b = df[1], df[0]
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    # The lower end of the log odds, so that rare features need a cleaner record.
    sure = odds - 2.0 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    sure[0] = 0
    found = sorted(np.flatnonzero(sure > SURE).tolist(), key=lambda k: (-sure[k], names[k]))
    place = np.full(len(names), -1)
    place[found] = np.arange(len(found))
    where: list[list[int]] = [[] for _ in found]
    for k, own in enumerate(sample.rows):
        mine = place[np.unique(table[own])]
        for f in mine[mine >= 0]:
            where[f].append(k)
    return [(names[k], float(sure[k]), np.asarray(at, np.int64)) for k, at in zip(found, where)]


def label_model(votes: np.ndarray, prior: float, rounds: int = 25, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the label for each row, and each voter's (rate in class 1, rate in class 0, weight).

    ``votes`` (row, voter) holds 1 where a voter fires. Class-conditional rates are estimated by
    expectation maximisation; a voter's log odds are divided by one plus its summed correlations with
    the others within the classes, so that voters saying the same thing count about once.
    """
    v = votes.astype(np.float64)
    weights = np.ones(len(v)) if weights is None else weights
    posterior = np.clip(v[:, -1] * 0.9 + 0.02, 0.02, 0.98)  # the last voter is the labelled mark
    for _ in range(rounds):
        w1, w0 = posterior * weights, (1 - posterior) * weights
        r1 = (w1 @ v + 0.5) / (w1.sum() + 1)
        r0 = (w0 @ v + 0.5) / (w0.sum() + 1)
        centred = v - np.outer(posterior, r1) - np.outer(1 - posterior, r0)
        cov = centred.T @ (centred * weights[:, None]) / weights.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        deflate = 1 / (1 + corr.sum(1))
        on, off = np.log(r1 / r0) * deflate, np.log((1 - r1) / (1 - r0)) * deflate
        z = math.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return posterior, np.stack([r1, r0, on], 1)


def _logistic(columns: list[np.ndarray], scale: np.ndarray, weights: np.ndarray, target: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse columns, each 0 or its scale, by adaptive gradient steps; weights are for 0 and 1."""
    which = np.concatenate([np.full(len(c), k) for k, c in enumerate(columns)]) if columns else np.zeros(0, np.int64)
    at = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    m = len(columns)
    x, bias = np.zeros(m), -2.0
    gx, gb = np.zeros(m), 0.0
    for k in range(rounds):
        z = bias + np.bincount(at, (x * scale)[which], len(weights))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weights
        d = np.bincount(which, error[at], m) * scale + penalty * x
        gx += d * d
        gb += error.sum() ** 2
        x -= 0.5 * d / np.sqrt(gx + 1e-9)
        bias -= 0.1 * error.sum() / math.sqrt(gb + 1e-9)
    return x * scale, bias


def fit(sample: Sample) -> Model:
    """Train on labelled rows."""
    y = np.asarray(sample.labels, np.int64)
    seeds = {lang: {w.encode() for w in words.split()} for lang, words in SEEDS.items()}
    if not len(y) or y.min() == y.max():
        return Model({w: 4.0 for own in seeds.values() for w in own}, (1.0,) * len(PATTERNS), -3.0)
    mined, weights = _mine(sample, y), sample.weights()
    patterns = [np.asarray([bool(h >> k & 1) for h in sample.hits]) for k in range(len(PATTERNS))]
    names, votes = [], []
    for lang, own in seeds.items():
        names.append(f"seed {lang}")
        votes.append(sample.holding(own))
    for k, fired in enumerate(patterns):
        names.append(f"pattern {k}")
        votes.append(fired)
    groups = max(1, min(MINED_GROUPS, len(mined)))
    for g in range(groups):
        fired = np.zeros(len(y), bool)
        for _, _, at in mined[g::groups]:
            fired[at] = True
        names.append(f"mined {g}")
        votes.append(fired)
    names.append("label")
    votes.append(y)
    posterior, voters = label_model(np.asarray(votes, bool).T, float(np.clip(weights @ y / weights.sum(), 0.01, 0.5)), weights=weights)
    columns, keys = [at for _, _, at in mined], [f for f, _, _ in mined]
    # A text with nothing but one well-attested feature (and the beginnings it implies) is as toxic as the rows that have it:
    # such rows join the training, or else features that come together would each get a part of the weight only.
    target, places = [posterior], {f: k for k, f in enumerate(keys)}
    made: list[list[int]] = [[] for _ in keys]
    size = len(y)
    for f, sure, at in mined:
        if sure < ATTESTED:
            continue
        found = weights[at].sum()
        share = (posterior[at] @ weights[at] + y.mean()) / (found + 1)
        times = min(ALONE, round(found))
        implied = {f, *(b for n in PREFIXES if len(f.rstrip(b"*")) > n and (b := f[:n] + b"*") in places)}
        for g in implied:
            made[places[g]] += range(size, size + times)
        target.append(np.full(times, share))
        size += times
    columns = [np.concatenate([at, np.asarray(more, np.int64)]) for at, more in zip(columns, made)]
    known = set(keys)
    for own in seeds.values():
        for w in sorted(own - known):
            columns.append(np.flatnonzero(sample.holding({w})))
            keys.append(w)
            known.add(w)
    columns += [np.flatnonzero(fired) for fired in patterns]
    # Columns of less certain features are scaled down, so that chance finds of a small sample weigh little.
    scale = np.ones(len(columns))
    scale[: len(mined)] = np.clip([sure / ATTESTED for _, sure, _ in mined], 0.05, 1.0)
    x, bias = _logistic(columns, scale, np.concatenate([weights, np.ones(size - len(y))]), np.concatenate(target), 0.3)
    report = [(n, float((np.asarray(v, bool) == (posterior > 0.5)).mean()), float(np.mean(v)), float(w)) for n, v, w in zip(names, votes, voters[:, 2])]
    return Model({f: float(w) for f, w in zip(keys, x) if abs(w) > 1e-6}, tuple(float(w) for w in x[len(keys) :]), float(bias), report)


def _sampled(batches: Batches) -> Batches:
    for batch in batches:
        found, hits, marks = [], [], []
        for text in texts(batch, "text"):
            raw = text.encode("utf-8", "surrogatepass")
            found.append(b" ".join(sorted(words_of(text))))
            hits.append(sum(1 << k for k, p in enumerate(PATTERNS) if p.search(raw)))
            marks.append(xxhash.xxh64_intdigest(raw) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(hits, pa.int32()), pa.array(marks, pa.int64())], names=["id", "toxic", "words", "hits", "mark"])


def _fitted(batches: Batches) -> Batches:
    rows = sorted((r["id"], r["words"], r["hits"], r["toxic"]) for batch in batches for r in batch.to_pylist())
    sample = Sample()
    for _, words, hits, toxic in rows:
        sample.add(words.split(), hits, int(toxic > 0))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows of ``docs`` outside the held-out fold."""
    prepared(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    marks = marks.groupBy(F.col(id_col).alias("mark_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    present = docs.select(F.col(id_col).alias("mark_id")).distinct()
    chosen = marks.join(present, "mark_id", "left_semi").orderBy(F.xxhash64(F.col("mark_id").cast("string")), "mark_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("mark_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "mark_id").select(F.col("mark_id").cast("string").alias("id"), "toxic", "text")
    found = rows.mapInArrow(tidied(_sampled), "id string, toxic int, words binary, hits int, mark bigint")
    one = found.groupBy("id").agg(F.min(F.struct("mark", "words", "hits", "toxic")).alias("x")).select("id", "x.words", "x.hits", "x.toxic")
    models = one.repartition(1).mapInArrow(tidied(_fitted, sample_rows), "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit(Sample())


def _scored(model: Model, threshold: float):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            scores = [model.score(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["id", "score", "predicted"]
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    prepared(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(tidied(_scored(model, threshold)), f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), (fold("id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def _clean(model: Model, threshold: float):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in texts(batch, "text")], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is below the threshold."""
    prepared(docs.sparkSession)
    plain = docs.withColumnRenamed(text_col, "text")
    return plain.mapInArrow(tidied(_clean(model, threshold)), plain.schema).withColumnRenamed("text", text_col)
