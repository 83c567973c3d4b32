"""Long documents: repetition removal, blocks with carried sections and pages, chunks, checks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.session import ship_package

TARGET, LARGEST = 800, 900
GRAM, STRIDE, OFTEN, NEAR, GAP, JOIN, LEAST = 150, 10, 10, 300, 45, 2000, 1500


def frequent_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, stride: int = STRIDE, often: int = OFTEN) -> DataFrame:
    """(id, gram, n) of word windows, one every ``stride`` words, found ``often`` times or more in a document."""
    w = T.words(F.col(text_col))
    last = F.floor((F.size("w") - gram) / stride).cast("int")
    grams = docs.select(id_col, w.alias("w")).where(F.size("w") >= gram).select(
        id_col, F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.md5(F.array_join(F.slice("w", k * stride + 1, gram), " ")))).alias("gram")
    )
    return grams.groupBy(id_col, "gram").agg(F.count("*").alias("n")).where(F.col("n") >= often)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _numbered_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, first character, end) of each word, in arrays."""
    numbers: dict[str, int] = {}
    codes, starts, ends = array("i"), array("q"), array("q")
    for m in re.finditer(r"\S+", text):
        codes.append(numbers.setdefault(m[0], len(numbers)))
        starts.append(m.start())
        ends.append(m.end())
    return np.asarray(codes), np.asarray(starts), np.asarray(ends)


def returning_windows(codes: np.ndarray, gram: int, stride: int, often: int) -> Iterator[np.ndarray]:
    """The numbers of equal windows of ``gram`` words, one every ``stride`` words, of which there are ``often`` or more.

    Windows with equal hashes are compared word by word, place after place, with the first of them; those
    that differ from it are compared among themselves again. Nothing but numbers is held of a window.
    """
    at = np.arange(0, len(codes) - gram + 1, stride)
    marks = np.zeros(len(at), np.uint64)
    for k in range(gram):
        marks = marks * _FACTOR + codes[at + k].astype(np.uint64) + np.uint64(1)
    order = np.argsort(marks, kind="stable")
    edges = np.flatnonzero(np.diff(marks[order])) + 1
    for own in np.split(order, edges):
        while len(own) >= often:
            same = np.ones(len(own), bool)
            for k in range(gram):
                same &= codes[at[own] + k] == codes[at[own[0]] + k]
            if same.sum() >= often:
                yield own[same]
            own = own[~same]


def repeated_spans(text: str, gram: int = GRAM, stride: int = STRIDE, often: int = OFTEN, near: int = NEAR, gap: int = GAP, join: int = JOIN, least: int = LEAST) -> list[tuple[int, int]]:
    """Character spans where the same window of words keeps returning at short distances."""
    codes, starts, ends = _numbered_words(text)
    if len(codes) < max(least, gram):
        return []
    spans = []
    for at in returning_windows(codes, gram, stride, often):
        dense = np.flatnonzero(at[often - 1 :] - at[: len(at) - often + 1] <= near)
        wide = np.flatnonzero(np.diff(at) > gap)  # a stretch goes on up to the next of these
        i = 0
        while (k := np.searchsorted(dense, i)) < len(dense):
            i = int(dense[k])
            m = np.searchsorted(wide, i + often - 1)
            j = int(wide[m]) if m < len(wide) else len(at) - 1
            spans.append((int(starts[at[i] * stride]), int(ends[min(at[j] * stride + gram, len(codes)) - 1])))
            i = j + 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + join:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _cleaned(text: str, bounds: dict[str, int]) -> tuple[str, list[str]]:
    parts, removed, at = [], [], 0
    for a, b in repeated_spans(text, **bounds):
        parts += [text[at:a], f"\n\n[...HALLUCINATION REMOVED (Chars {a}-{b})...]\n\n"]
        removed.append(text[a:b][: T.CAPS["removed"]])
        at = b
    return "".join([*parts, text[at:]]), removed


#: Characters of texts that are cleaned before they are handed on.
_HANDED = 4 << 20


def _shares(texts: pd.Series) -> Iterator[slice]:
    """Stretches of the texts of some ``_HANDED`` characters, one text at least."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= _HANDED:
            yield slice(first, k + 1)
            first, held = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def remove_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(id, text, removed): texts with repeated stretches replaced by a marker, and what was removed (its first 1000 characters).

    ``bounds`` are those of ``repeated_spans``.
    """
    ship_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # What Spark sends at once can be thousands of long texts: a few of them are cleaned and handed on at a time.
            for at in _shares(f["text"]):
                own = f.iloc[at]
                both = [_cleaned(t or "", bounds) for t in own["text"]]
                yield pd.DataFrame({"id": own["id"], "text": [x for x, _ in both], "removed": [r for _, r in both]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, text string, removed array<string>").withColumnRenamed("id", id_col)


def block_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_page_tags: bool = True) -> DataFrame:
    """(id, pos, text, pages, section, is_table, tokens): blocks in order, sections and pages carried forward.

    A heading of level 2 or more sets the section from its own block on; a block without a page mark
    has the pages of the block before it.
    """
    # Each step is a projection of its own, as an expression that is mentioned twice is worked out twice.
    lines = docs.select(id_col, T.normalize_markdown(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    marked = lines.select(id_col, T.mark_pages(F.col("lines")).alias("marked")).select(id_col, T.without_blank_lines_in_tables(F.col("marked")).alias("whole"))
    raw = marked.select(id_col, F.posexplode(T.blocks(F.col("whole"))).alias("pos", "raw"))
    tag = "<page_number>$1</page_number>" if keep_page_tags else ""
    plain = F.when(F.contains("raw", F.lit("__PAGE_")), F.regexp_replace("raw", r"__PAGE_(.*?)__", tag)).otherwise(F.col("raw"))
    pages = F.when(F.contains("raw", F.lit("__PAGE_")), T.page_numbers(F.col("raw"))).otherwise(F.array().cast("array<int>"))
    found = raw.select(id_col, "pos", T.strip(plain).alias("text"), pages.alias("own_pages"), T.heading(plain).alias("h")).where("text <> ''")
    order = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return found.select(
        id_col,
        "pos",
        "text",
        F.coalesce(F.last(F.when(F.size("own_pages") > 0, F.col("own_pages")), ignorenulls=True).over(order), F.array().cast("array<int>")).alias("pages"),
        F.coalesce(F.last(F.when(F.col("h.level") != 1, F.col("h.title")), ignorenulls=True).over(order), F.lit("root")).alias("section"),
        F.contains(F.lower("text"), F.lit("<table")).alias("is_table"),
        T.token_estimate(F.col("text")).alias("tokens"),
    )


_CHUNK = "chunk int, section string, pages array<int>, has_table boolean, tokens int, oversized_table boolean, is_truncated boolean, text string"
_CHUNK_COLUMNS = {
    "chunk": pa.int32(), "section": pa.string(), "pages": pa.list_(pa.int32()), "has_table": pa.bool_(),
    "tokens": pa.int32(), "oversized_table": pa.bool_(), "is_truncated": pa.bool_(), "text": pa.string(),
}


def _closes(text: str) -> bool:
    return text.rstrip()[-1:] in tuple(".。!?\"')}]") and bool(text.strip())


class _Block(NamedTuple):
    text: str
    pages: list[int]
    section: str
    is_table: bool
    tokens: int


class _Packer:
    """Greedy packing of a document's blocks in order."""

    def __init__(self, target: int, largest: int):
        self.target, self.largest = target, largest
        self.held: list[_Block] = []
        self.tokens = 0
        self.chunks, self.before = 0, None
        self.out: list[dict] = []

    def flush(self, oversized: bool = False) -> None:
        if not self.held:
            return
        named = next((b.section for b in self.held if b.section != "root"), None)
        section = named or (self.before["section"] if self.before and self.before["is_truncated"] else "root")
        text = "\n\n".join([b.text for b in self.held])
        self.before = {
            "chunk": self.chunks,
            "section": section,
            "pages": sorted({p for b in self.held for p in b.pages}),
            "has_table": any(b.is_table for b in self.held),
            "tokens": self.tokens,
            "oversized_table": oversized,
            "is_truncated": not _closes(text),
            "text": text,
        }
        self.out.append(self.before)
        self.held, self.tokens, self.chunks = [], 0, self.chunks + 1

    def add(self, block: _Block) -> None:
        if self.held and block.section not in ("root", self.held[-1].section) and self.tokens >= 0.3 * self.target:
            self.flush()
        if not self.held and block.is_table and block.tokens > self.largest:
            self._hold(block)
            self.flush(oversized=True)
            return
        if self.held and (self.tokens + block.tokens > self.largest or (not block.is_table and self.tokens >= self.target)):
            self.flush()
        self._hold(block)

    def _hold(self, block: _Block) -> None:
        self.held.append(block)
        self.tokens += block.tokens

    def finished(self) -> list[dict]:
        """The chunks that are complete and were not asked for before."""
        out, self.out = self.out, []
        return out


class _Merger:
    """Truncated chunks of a document that take up the next ones, in order."""

    def __init__(self, largest: int):
        self.largest = largest
        self.last: dict | None = None
        self.out: list[dict] = []

    def add(self, chunk: dict) -> None:
        last = self.last
        if last and last["is_truncated"] and last["tokens"] + chunk["tokens"] <= self.largest:
            last["pages"] = sorted({*last["pages"], *chunk["pages"]})
            last["text"] += "\n\n" + chunk["text"]
            last["tokens"] += chunk["tokens"]
            last["has_table"] = last["has_table"] or chunk["has_table"]
            last["is_truncated"] = chunk["is_truncated"]
        else:
            self.flush()
            self.last = {**chunk, "pages": sorted(chunk["pages"])}

    def flush(self) -> None:
        if self.last:
            self.out.append(self.last)
        self.last = None

    def finished(self) -> list[dict]:
        out, self.out = self.out, []
        return out


def _folded(rows: DataFrame, id_col: str, order: str, fold: Callable[[], _Packer | _Merger], item: Callable[..., object], columns: list[str]) -> DataFrame:
    """Chunks that a fold makes of each document's rows in order, batch by batch: documents are told apart where the numbering begins anew.

    Rows that a window has dealt by document and sorted are neither dealt nor sorted again, and a document is never
    gathered: only the chunk at hand is held.
    """
    ship_package(rows.sparkSession)
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    numbered = rows.select(F.col(id_col).alias("id"), turn.alias("turn"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, kind = None, None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([i for i, _ in done], kind)] + [pa.array([c[name] for _, c in done], t) for name, t in _CHUNK_COLUMNS.items()]
            return pa.RecordBatch.from_arrays(arrays, ["id", *_CHUNK_COLUMNS])

        for batch in batches:
            kind, done = batch.schema.field("id").type, []
            for i, k, *values in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", *columns))):
                if k == 1:
                    if state is not None:
                        state.flush()
                        done += [(own, c) for c in state.finished()]
                    state, own = fold(), i
                state.add(item(*values))
            if state is not None:
                done += [(own, c) for c in state.finished()]
            yield made(done)
        if state is not None:
            state.flush()
            yield made([(own, c) for c in state.finished()])

    return numbered.mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, {_CHUNK}").withColumnRenamed("id", id_col)


def pack_chunks(blocks: DataFrame, id_col: str = "doc_id", target: int = TARGET, largest: int = LARGEST) -> DataFrame:
    """Chunks of each document's blocks: documents are independent, so this is one shuffle by document at most."""
    return _folded(blocks, id_col, "pos", lambda: _Packer(target, largest), _Block, list(_Block._fields))


def merge_truncated(chunks: DataFrame, id_col: str = "doc_id", largest: int = LARGEST) -> DataFrame:
    """A truncated chunk takes up the next ones while both fit ``largest`` tokens."""
    names = list(_CHUNK_COLUMNS)
    return _folded(chunks, id_col, "chunk", lambda: _Merger(largest), lambda *values: dict(zip(names, values)), names)


#: Tokens above which a chunk is worth a warning.
MANY_TOKENS = 1000


def chunk_issues(chunks: DataFrame, id_col: str = "doc_id", largest: int = MANY_TOKENS) -> DataFrame:
    """(id, chunk, level, issue): one row for each finding of five rules: text cut off, no text, tables that do not close, many tokens, no heading."""

    def found(when, level: str, issue: str):
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue")))

    checks = F.array(
        found(F.col("is_truncated"), "warning", "incomplete sentence"),
        found(T.strip(F.col("text")) == "", "error", "empty text"),
        found(F.col("has_table") & T.unbalanced_tables(F.col("text")), "error", "unbalanced table tags"),
        found(F.col("tokens") > largest, "warning", "too many tokens"),
        found((F.col("section") == "root") & ~F.col("oversized_table"), "warning", "no section"),
    )
    return chunks.select(id_col, "chunk", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select(id_col, "chunk", "x.level", "x.issue")


def chunk_id(sector: str, company: str, year: str, chunk: str):
    return F.format_string("%s/%s/%s:%04d", F.col(sector), F.col(company), F.col(year), F.col(chunk))


def stitch_pages(pages: DataFrame, counts: DataFrame, id_col: str, page_col: str, text_col: str, n_col: str, placeholder: str = "**EXTRACTION FAILED**", separator: str = "\n\n---\n\n") -> DataFrame:
    """(id, text): pages 1..n joined in order, missing or null ones as the placeholder."""
    wanted = counts.select(id_col, F.explode(F.sequence(F.lit(1), F.col(n_col).cast("int"))).alias(page_col))
    filled = wanted.join(pages.select(id_col, page_col, text_col), [id_col, page_col], "left").withColumn(text_col, F.coalesce(text_col, F.lit(placeholder)))
    parts = F.array_sort(F.collect_list(F.struct(page_col, text_col)))
    return filled.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p[text_col]), separator).alias("text"))


def failed_pages(docs: DataFrame, id_col: str, text_col: str = "text", placeholder: str = "EXTRACTION FAILED", separator: str = "\n\n---\n\n") -> DataFrame:
    """(id, page): 1-based places of stitched parts that failed."""
    parts = docs.select(id_col, F.posexplode(F.split(text_col, separator)).alias("k", "part"))
    return parts.where(F.contains("part", F.lit(placeholder))).select(id_col, (F.col("k") + 1).alias("page"))
