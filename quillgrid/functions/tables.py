"""HTML tables inside text, rewritten by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import text as T


def _rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))


def _cells(row: Column) -> Column:
    raw = F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))
    return F.transform(raw, lambda c: T.strip(F.regexp_replace(c, r"<[^>]+>", " ")))


def to_markdown(html: Column) -> Column:
    """Pipe rows with a rule after the first."""

    def line(row: Column, i: Column) -> Column:
        cells = F.transform(_cells(row), lambda c: F.regexp_replace(c, T.SPACE, " "))
        pipe = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda _: F.lit("---")), "|"), F.lit("|"))
        return F.when(i == 0, F.concat(pipe, F.lit("\n"), rule)).otherwise(pipe)

    return F.array_join(F.transform(_rows(html), line), "\n")


def to_linearized(html: Column) -> Column:
    """``header: value`` pairs of each row after the first; empty headers, values and rows are left out."""
    rows = _rows(html)
    headers = _cells(F.try_element_at(rows, F.lit(1)))

    def line(row: Column) -> Column:
        pairs = F.transform(F.arrays_zip(headers.alias("h"), _cells(row).alias("v")), lambda z: F.when((z["h"] != "") & (z["v"] != ""), F.concat(z["h"], F.lit(": "), z["v"])))
        return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), " | ")

    lines = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def serialize(c: Column, form: str = "markdown") -> Column:
    """Every table of a text in the form named: markdown, linearized or html (as it is)."""
    if form == "html":
        return c
    if form not in ("markdown", "linearized"):
        raise ValueError(f"unknown table form: {form}")
    change = to_markdown if form == "markdown" else to_linearized
    parts = F.split(c, r"(?is)(?=<table[^>]*>)|(?<=</table>)")

    def part(p: Column) -> Column:
        whole = p.rlike(r"(?is)^<table[^>]*>.*</table>$")
        return F.when(whole, change(p)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")
