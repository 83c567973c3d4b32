"""Quality by compression: a text is like the labelled texts whose dictionary compresses it better.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces of bad labelled texts. A
whole text is cut into blocks of ``BLOCK`` bytes, each block is compressed on its own with either
dictionary and with none, and the sizes are summed. Their normalised difference, (bad - good) / (bad +
good), is what the score is made of; a logistic calibration of it beside the compressibility of the text
turns it into the probability of label 1. Blocks keep the dictionaries' share in a long text as large as
in a short one, and the memory of a text at one block.

Only rows with a label outside the held-out fold take part in training: a sample of ``SAMPLE_ROWS`` of
the labelled ids at most, those with the least hashes. Equal texts count once (as good if any of them
is). By the hash of its text each goes to the dictionaries (``PIECES`` pieces of ``PIECE`` bytes spread
evenly over the whole text, as many bytes of good as of bad) or to the calibration (the whole text), so
that no text is scored with a dictionary made of itself while the scale is set. Dictionaries are trained
in a task; the driver gets them, and four sizes of each calibration text. Every row is scored on its
whole text.

Nulls count as the empty text, whose score is what the calibration gives for sizes of zero; ids may be
null (crc32 of the empty text, fold 0, held out) or repeated (rows are scored one by one; of several
labels of an id the largest counts). Without labelled rows every score is 0.5; with one class only it is
that class's smoothed share. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, fold, prepared, text_or_empty, texts, tidied

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
SAMPLE_ROWS = 10_000
#: Bytes of a dictionary at most, of a block, of a piece; pieces of a text at most.
DICTIONARY = 112_640
BLOCK = 1024
PIECE = 512
PIECES = 8
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text (empty: none) and the calibration: means, scales and weights of the features."""

    bad: bytes = b""
    good: bytes = b""
    calibration: tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]] | None = None
    constant: float = 0.5

    def score(self, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of (with the bad, with the good, with no dictionary, bytes)."""
        if self.calibration is None:
            return np.full(len(sizes), self.constant)
        mean, scale, weights = (np.asarray(x) for x in self.calibration)
        z = (features(sizes) - mean) / scale @ weights[:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised size difference, alone and by compressibility and length, and compressibility itself."""
    bad, good, plain, size = np.asarray(sizes, float).reshape(-1, 4).T
    n = np.maximum(size, 1.0)
    difference = (bad - good) / np.maximum(bad + good, 1.0)
    best, alone, short = np.minimum(bad, good) / n, plain / n, 1 / np.sqrt(n)
    # Knees where repetitive, common and incompressible texts part.
    return np.stack([difference, difference * best, difference * short, (bad - good) / n, best, np.minimum(best, 0.3), np.maximum(best, 0.5), alone, np.minimum(alone, 0.35), short, np.log(n)], 1)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """A trained dictionary knows itself by its first bytes; anything else is plain content."""
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


@lru_cache(maxsize=2)
def _compressors(contents: tuple[bytes, ...], level: int) -> list[zstandard.ZstdCompressor]:
    """One for each content, digested once in a worker; the empty content is no dictionary."""
    bare, out = {"level": level, "write_content_size": False, "write_checksum": False}, []
    for content in contents:
        if content:
            known = _dictionary(content)
            known.precompute_compress(level=level)
            out.append(zstandard.ZstdCompressor(**bare, dict_data=known, write_dict_id=False))
        else:
            out.append(zstandard.ZstdCompressor(**bare))
    return out


def compressed_sizes(text: str, contents: tuple[bytes, ...], level: int = LEVEL, block: int = BLOCK) -> list[int]:
    """Bytes of the whole text compressed by blocks with each content as dictionary, then its own bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    blocks = [raw[k : k + block] for k in range(0, len(raw), block)]
    return [*(sum(len(c.compress(b)) for b in blocks) for c in _compressors(contents, level)), len(raw)]


def pieces_of(text: str, piece: int = PIECE, pieces: int = PIECES) -> bytes:
    """Pieces at even distances over the whole text, joined; a short text as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= piece * pieces:
        return raw
    return b"".join(raw[at : at + piece] for at in (k * (len(raw) - piece) // (pieces - 1) for k in range(pieces)))


def trained(sources: list[bytes], size: int = DICTIONARY) -> list[bytes]:
    """A dictionary for each class of pieces, all from as many bytes; the content itself where it is too little to train on."""
    least = min(map(len, sources))
    out = []
    for content in sources:
        samples = [content[k : k + PIECE] for k in range(0, least, PIECE)]
        try:
            out.append(zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes())
        except zstandard.ZstdError:
            out.append(content[: min(least, size)])
    return out


def calibrated(sizes: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple:
    """Means, scales and weights of a ridge logistic regression of the labels on the features, by Newton steps."""
    x, y = features(sizes), np.asarray(labels, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge, z.T @ (p - y) / len(y) + penalty * w)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def _piece_rows(batches: Batches) -> Batches:
    for batch in batches:
        cut = [pieces_of(t) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary())], names=["mark", "label", "pieces"])


def _train_rows(batches: Batches) -> Batches:
    rows = sorted((r["mark"], r["label"], r["pieces"]) for batch in batches for r in batch.to_pylist())
    sources = [b"".join(p for _, label, p in rows if label == k) for k in (0, 1)]
    found = trained(sources) if all(sources) else [b"", b""]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["found"])


def _sized(contents: tuple[bytes, ...], level: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes = [compressed_sizes(t, contents, level) for t in texts(batch, "text")]
            columns = list(zip(*sizes)) or [()] * (len(contents) + 1)
            kept = [batch.column(k) for k, f in enumerate(batch.schema) if f.name != "text"]
            names = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], names=[*names, "bad", "good", "plain", "size"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """A model from the labelled rows of ``docs`` outside the held-out fold."""
    prepared(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
    marks = marks.groupBy(F.col(id_col).alias("mark_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    present = docs.select(F.col(id_col).alias("mark_id")).distinct()
    chosen = marks.join(present, "mark_id", "left_semi").orderBy(F.xxhash64(F.col("mark_id").cast("string")), "mark_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("mark_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "mark_id")
    sample = rows.select(F.xxhash64("text").alias("mark"), "label", "text")
    once = lambda found, *more: found.groupBy("mark").agg(F.max("label").alias("label"), *(F.first(c).alias(c) for c in more))
    pieces = once(sample.where("mark & 1 = 0").mapInArrow(tidied(_piece_rows), "mark bigint, label int, pieces binary"), "pieces")
    found = pieces.repartition(1).mapInArrow(tidied(_train_rows, sample_rows), "found binary").collect()  # PIECES pieces of sample_rows texts at most
    bad, good = pickle.loads(found[0]["found"]) if found else (b"", b"")
    sizes = sample.mapInArrow(tidied(_sized((bad, good, b""), LEVEL)), "mark bigint, label int, bad bigint, good bigint, plain bigint, size bigint")
    rest = once(sizes, "bad", "good", "plain", "size").toPandas().sort_values("mark")  # six numbers for each of sample_rows texts at most
    return fitted(bad, good, rest["label"].to_numpy(), rest["mark"].to_numpy() & 1, rest[["bad", "good", "plain", "size"]].to_numpy())


def fitted(bad: bytes, good: bytes, labels: np.ndarray, half: np.ndarray, sizes: np.ndarray) -> Model:
    """Calibrate on the half that is not in the dictionaries; on all where that half lacks a class."""
    if not len(labels) or labels.min() == labels.max() or not (bad and good):
        return Model(constant=float((labels.sum() + 0.5) / (len(labels) + 1)))
    own = labels[half == 1]
    chosen = half == 1 if len(own) and own.min() < own.max() else np.ones(len(labels), bool)
    return Model(bad, good, calibrated(sizes[chosen], labels[chosen]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(id, held_out, score, predicted, size_difference) of every row; the last is the normalised difference of the sizes."""
    prepared(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    sized = _sized((model.bad, model.good, b""), LEVEL)

    def run(batches: Batches) -> Batches:
        for batch in sized(batches):
            sizes = np.stack([batch.column(k).to_numpy() for k in range(1, 5)], 1)
            scores = model.score(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(features(sizes)[:, 0])], names=["id", "score", "predicted", "size_difference"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(tidied(run), f"id {kind}, score double, predicted int, size_difference double")
    return scored.select(F.col("id").alias(id_col), (fold("id", folds) == held_out).alias("held_out"), "score", "predicted", "size_difference")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score reaches the threshold."""
    prepared(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            own = ["" if t is None else t for t in batch.column(at).to_pylist()]
            sizes = [compressed_sizes(t, (model.bad, model.good, b"")) for t in own]
            yield batch.filter(pa.array(model.score(np.asarray(sizes, float).reshape(-1, 4)) >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
