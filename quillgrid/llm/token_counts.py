"""Token counts by overlap resynchronisation.

Texts of up to ``chunk_chars`` code points are encoded whole. A longer one is encoded in chunks
that overlap, each once and with offsets; two neighbours are spliced at a boundary that both
encodings have and that is *proven* stable, and the overlap is widened where there is none. What lies
behind the splice is read from the right chunk's offsets, so the work is in proportion to the text.

The proof is for byte-level BPE with the usual pre-tokenizer, whose pieces are runs of letters, of
digits or of other signs, each with a space before it at most, apostrophes with a few letters, and white
space. Where white space follows another character, or where letters, digits and signs of those named
below (no apostrophe) meet, one piece ends and the next begins whatever stands around, so the
encodings on either side do not depend on each other, unless a special token spans the place. A
stretch without such a place is one chunk, however long. The kind is read from the vocabulary file;
texts for other kinds of files are encoded whole.

Nulls count as the empty text (0 tokens). Ids may be null or repeated: rows are independent, none is
dropped, and other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.common import Batches, prepared, text_or_empty, texts, tidied

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
LIMIT = 512

_LOADED: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a file, loaded once in each Python worker, without padding or truncation."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = tokenizer
    return _LOADED[path]


#: Characters that every version of Unicode puts in the same class, and that are enough to find places.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SIGN = r"!-&(-/:-@\[-`{-~\u3001-\u3003\u3008-\u3011\uff01-\uff0f"
_PLACE = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=[{_LETTER}])(?=[0-9'{_SIGN}])|(?<=[0-9])(?=[{_LETTER}'{_SIGN}])|(?<=[{_SIGN}])(?=[0-9{_LETTER}])")


def spliceable(path: str) -> bool:
    """Whether the proof holds for a vocabulary file."""
    if path.endswith(".model"):
        return False
    content = json.loads(Path(path).read_text())
    before, odd = content.get("pre_tokenizer") or {}, ("lstrip", "rstrip", "single_word", "normalized")
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return plain and not content.get("normalizer") and not content["model"].get("dropout") and not any(t.get(x) for t in content.get("added_tokens", []) for x in odd)


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _places(text: str, low: int, high: int, special: list[str]) -> list[int]:
    """Stable places between two points, in order; none lies inside a special token."""
    found = [m.start() for m in _PLACE.finditer(text, low + 1, min(high, len(text) - 1) + 1) if low < m.start() < high]
    for x in special:
        n = len(x)
        found = [p for p in found if x not in text[max(0, p - n + 1) : p + n - 1]]
    return found


def spliced_count(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a long text from overlapping chunks; equal to the count of the whole text."""
    special, size = specials(tokenizer), len(text)

    def reached(start: int, least: int) -> tuple[int, list[int]]:
        """(end of a chunk from ``start`` that has stable places near its end, these places)."""
        reach = min(size, least)
        while reach < size:
            wide = overlap
            while True:
                low = max(start, reach - wide)
                if found := _places(text, low, reach, special):
                    return reach, found
                if low == start:
                    break
                wide *= 2  # no place to resynchronise: widen the overlap
            reach = min(size, start + 2 * (reach - start))
        return size, []

    def encoded(start: int, stop: int) -> tuple[dict[int, int], int]:
        """(number of tokens up to each place where one ends, number of all)."""
        offsets = tokenizer.encode(text[start:stop], add_special_tokens=False).offsets
        return {start + end: k for k, (_, end) in enumerate(offsets, 1)}, len(offsets)

    reach, places = reached(0, chunk + overlap)
    ends, n = encoded(0, reach)
    start, spent, total = 0, 0, 0  # tokens of the left chunk before ``start`` are spent
    while reach < size:
        begin = max(start, places[0] - 1)  # the right chunk begins before the place, with the characters around it
        stop, more = reached(places[0], begin + chunk + overlap)
        right, m = encoded(begin, stop)
        at = next((p for p in places if p in ends and p in right), None)
        if at is None:  # not aligned: one longer chunk
            stop, more = reached(start, start + 2 * (stop - start))
            ends, n = encoded(start, stop)
            spent = 0
        else:
            total += ends[at] - spent
            ends, n, spent, start = right, m, right[at], at
        reach, places = stop, more
    return total + n - spent


def _counter(path: str, chunk: int, overlap: int):
    def run(batches: Batches) -> Batches:
        tokenizer = library(path)
        pieces, cut = path.endswith(".model"), chunk if spliceable(path) else None
        for batch in batches:
            values = texts(batch, "text")
            counts = [0] * len(values)
            if pieces:
                counts = [len(x) for x in tokenizer.encode(values, num_threads=1)] if values else []
            else:
                short = [i for i, t in enumerate(values) if cut is None or len(t) <= cut]
                for i, e in zip(short, tokenizer.encode_batch_fast([values[i] for i in short], add_special_tokens=False)):
                    counts[i] = len(e)
                for i, t in enumerate(values):
                    if cut is not None and len(t) > cut:
                        counts[i] = spliced_count(tokenizer, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in values], pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; one pass over the scan, no shuffle."""
    prepared(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidied(_counter(path, chunk, overlap)), f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
