"""Text functions as Column expressions: normalisation, sentences, blocks, headings, page marks, flags.

White space is Unicode white space throughout, as ``(?U)\\s``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Every character that ``(?U)\s`` matches.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Phrases and words that the flags look for.
ABSTAIN_PHRASES = (
    "not available in context", "cannot be determined", "not mentioned", "not provided", "no information",
    "information not available", "not stated", "not specified", "not found in context", "insufficient information",
)
BRSR_WORDS = (
    "brsr", "business responsibility", "sustainability report", "esg",
    "principle 1", "principle 2", "principle 3", "principle 4", "principle 5", "principle 6", "principle 7", "principle 8", "principle 9",
    "essential indicators", "leadership indicators", "responsible business conduct", "section c",
)
SCORE_WORDS = (
    "revenue", "profit", "loss", "cash flow", "dividend", "audit", "auditor", "board", "director", "risk", "remuneration", "share capital",
    "borrowings", "debt", "equity", "segment", "md&a", "management discussion", "contingent", "ebitda", "pat", "eps", "roce", "roe",
    "working capital", "inventory", "finance cost", "interest coverage", "related party", "pledge", "promoter", "note ", "schedule ",
    "exceptional item", "capital expenditure", "capex",
)
PRIORITY_SECTIONS = (
    "management discussion", "directors' report", "directors report", "corporate governance", "notes to accounts", "financial statements",
    "profit and loss", "balance sheet", "cash flow", "auditor", "risk management", "related party", "shareholding pattern",
)
OCR_ERRORS = ("❌", "error processing", "unable to get", "traceback")
STRIPPED_UNITS = (
    "crores", "crore", "cr", "lakhs", "lakh", "lac", "lk", "millions", "million", "mn", "billions", "billion", "bn", "thousands", "thousand",
    "rs", "inr", "₹", "$",
)


#: Characters of a text that count or are kept, by what it serves for.
CAPS = {
    "similarity": 1024,
    "premise": 1800,
    "cached_context": 300,
    "judge_reason": 120,
    "page_error": 120,
    "failure": 400,
    "dead_letter": 1000,
    "removed": 1000,
}


def capped(c: Column, use: str) -> Column:
    """What of a text serves for a use."""
    return F.left(c, F.lit(CAPS[use]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(c: Column, parts: tuple[str, ...], by: str = "") -> Column:
    """Each of the parts replaced in turn."""
    return reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(by)), parts, c)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def normalize(c: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, spaces collapsed; currency signs and codes then deleted wherever they stand."""
    plain = collapse(F.regexp_replace(F.lower(c), r"\p{Punct}", " "))
    return F.trim(without(plain, ("₹", "$", "€", "£", "rs", "inr")))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def tokens(c: Column) -> Column:
    return words(normalize(c))


def sentences(c: Column) -> Column:
    """Parts that end in . ! or ? before white space."""
    return F.filter(F.transform(F.split(strip(c), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def strip_units(c: Column) -> Column:
    return F.regexp_replace(without(F.lower(c), STRIPPED_UNITS), r"(?U)[,()%\s]", "")


def is_abstention(c: Column, strict: bool = False) -> Column:
    """Whether a text says that it has no answer; strictly also in the words that closed-book prompts ask for."""
    return contains_any(F.lower(c), (*ABSTAIN_PHRASES, "not available in memory") if strict else ABSTAIN_PHRASES)


def is_brsr(section: Column) -> Column:
    return contains_any(F.lower(F.coalesce(section, F.lit(""))), BRSR_WORDS)


def chunk_score(text: Column, section: Column, has_table: Column) -> Column:
    """2 for a table, 1 for any score word in the text, 2 for any priority phrase in the section."""
    return (
        F.when(has_table, 2).otherwise(0)
        + F.when(contains_any(F.lower(text), SCORE_WORDS), 1).otherwise(0)
        + F.when(contains_any(F.lower(section), PRIORITY_SECTIONS), 2).otherwise(0)
    )


def found_words(text: Column, parts: tuple[str, ...]) -> Column:
    """Those of the parts that a text contains, in their order."""
    return F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(text), p))


def question_budget(score: Column, merged: Column) -> Column:
    return F.when(merged, 2).when(score >= 18, 4).when(score >= 11, 2).otherwise(1)


def token_estimate(c: Column) -> Column:
    """Words times a ratio of 1.3 to 2.5 that grows with numbers and signs; truncated."""
    counts = F.struct(F.regexp_count(c, F.lit(r"(?U)\S+")).alias("n"), F.regexp_count(c, F.lit(r"(?U)\d+")).alias("numbers"), F.regexp_count(c, F.lit(r"[₹$€£%]")).alias("signs"))

    def estimate(v: Column) -> Column:
        share = lambda k: k / F.nullif(v["n"], F.lit(0))
        ratio = F.least(F.lit(2.5), F.lit(1.3) + share(F.lit(0.8) * v["numbers"]) + share(F.lit(0.5) * v["signs"]))
        return F.coalesce((v["n"] * ratio).cast("int"), F.lit(0))

    return let(counts, estimate)


def is_complete(c: Column) -> Column:
    """Whether the last character ends a sentence or closes a bracket."""
    last = F.right(F.regexp_replace(c, r"(?U)\s+$", ""), F.lit(1))
    return last.isin(*".。!?\"')}]")


def normalize_markdown(c: Column) -> Column:
    """Line feeds only, blank runs as one blank line, rule lines deleted."""
    lines = F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"\n{3,}", "\n\n")
    return F.when(lines.contains("---"), F.regexp_replace(F.regexp_replace(lines, r"(?m)^[ \t]*---[ \t]*$", ""), r"\n{3,}", "\n\n")).otherwise(lines)


def mark_pages(c: Column, keep_images: bool = True) -> Column:
    """Watermarks deleted, images as comments or deleted, page tags as markers of their own."""
    plain = F.regexp_replace(c, r"(?is)<watermark>.*?</watermark>", "")
    plain = F.regexp_replace(plain, r"(?is)<img>(.*?)</img>", "<!-- image: $1 -->" if keep_images else "")
    plain = F.regexp_replace(plain, r"(?is)<page_number>(.*?)</page_number>", "\n\n__PAGE_$1__\n\n")
    return F.when(c.contains("<"), plain).otherwise(c)


def page_numbers(c: Column) -> Column:
    """First digits of each page marker, null where there are none."""
    marks = F.regexp_extract_all(c, F.lit(r"__PAGE_(.*?)__"), F.lit(1))
    digits = F.transform(marks, lambda m: F.expr("int(null)") if m is None else F.regexp_extract(m, r"\d+", 0))
    return F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))


def without_blank_lines_in_tables(c: Column) -> Column:
    """Blank lines inside tables collapsed; the rest as it is."""
    parts = F.split(c, r"(?i)(?=<table>)|(?<=</table>)")
    whole = F.array_join(F.transform(parts, lambda p: F.when(F.lower(p).startswith("<table>"), F.regexp_replace(p, r"\n(?:[ \t]*\n)+", "\n")).otherwise(p)), "")
    return F.when(c.contains("<"), whole).otherwise(c)


def blocks(c: Column) -> Column:
    """Tables whole, other text parted by blank lines; empty ones dropped."""
    parts = F.split(c, r"(?i)(?=<table>)|(?<=</table>)")
    plain = lambda p: F.split(p, r"\n[ \t]*\n")
    nested = F.transform(parts, lambda p: F.when(F.lower(p).startswith("<table>"), F.array(p)).otherwise(plain(p)))
    return F.filter(F.transform(F.when(c.contains("<"), F.flatten(nested)).otherwise(plain(c)), strip), lambda b: b != "")


def heading(c: Column) -> Column:
    """(title, level) of the first line that is a heading: hashes give the level, a bold line is of level 2."""
    lines = F.filter(
        F.transform(F.split(c, "\n"), strip),
        lambda s: ~s.startswith("<page_number>") & ~s.startswith("<!--") & s.rlike(r"^(#{1,6}\s+\S.*|\*\*[^*]+\*\*)$"),
    )

    def parsed(first: Column) -> Column:
        hashes = F.regexp_extract(first, r"^(#{1,6})\s", 1)
        title = F.when(hashes != "", strip(F.regexp_replace(first, r"^#{1,6}\s+", ""))).otherwise(strip(F.regexp_extract(first, r"^\*\*(.*?)\*\*$", 1)))
        return F.when(first.isNotNull(), F.struct(strip(F.regexp_replace(title, r"^\*\*(.*)\*\*$", "$1")).alias("title"), F.when(hashes != "", F.length(hashes)).otherwise(2).alias("level")))

    return F.when(c.contains("#") | c.contains("**"), let(F.try_element_at(lines, F.lit(1)), parsed))


def is_ocr_error(c: Column) -> Column:
    return contains_any(F.lower(capped(c, "page_error")), OCR_ERRORS)


def is_valid_page(c: Column) -> Column:
    return (F.length(strip(c)) >= 3) & ~is_ocr_error(c)


def csv_scrub(c: Column) -> Column:
    return capped(F.translate(F.translate(c, '"', "'"), "\n", " "), "failure")


def unbalanced_tables(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)<table")) != F.regexp_count(c, F.lit(r"(?i)</table>"))
