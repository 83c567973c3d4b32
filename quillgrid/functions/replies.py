"""Free-form model replies and polymorphic records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import text as T

PAIRS = "array<struct<question:string,answer:string,evidence:string,question_type:string,requires_calculation:string>>"


def json_array(c: Column) -> Column:
    """The array that a reply is or holds between its outermost brackets, as text; null if there is none."""
    inner = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    good = lambda x: F.when(F.try_parse_json(x).isNotNull() & T.strip(x).startswith("["), x)
    return F.coalesce(good(c), good(inner))


def truthy(c: Column, strict: bool = False) -> Column:
    """Truth of a JSON scalar as text: any non-empty string that isn't a false, zero or null is true, also (unless strict) the word false in quotes."""
    c = F.replace(c, F.lit('"'), F.lit("")) if strict else c
    return F.coalesce(~T.strip(c).isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def qa_pairs(c: Column) -> Column:
    """Valid pairs of a reply: a non-blank question and answer."""
    items = F.from_json(json_array(c), PAIRS)
    fine = lambda x: (T.strip(F.coalesce(x["question"], F.lit(""))) != "") & (T.strip(F.coalesce(x["answer"], F.lit(""))) != "")
    return F.filter(items, fine)


def reply_error(c: Column) -> Column:
    """Why a reply gives no or fewer pairs; null if all is well."""
    items = F.from_json(json_array(c), PAIRS)
    return F.when(items.isNull(), "json").when(F.size(qa_pairs(c)) < F.size(items), "missing field")


def anchors(raw: Column) -> Column:
    """Struct inputs, sources, status, hops, red_flag of a verification record as JSON text; null unless it is a non-empty object."""
    v = F.try_parse_json(raw)
    sources = F.coalesce(
        F.try_variant_get(v, "$.cross_section_sources", "array<string>"),
        F.when(F.coalesce(F.try_variant_get(v, "$.cross_section_sources", "string"), F.lit("")) != "", F.array(F.try_variant_get(v, "$.cross_section_sources", "string"))),
        F.array().cast("array<string>"),
    )
    inputs = F.filter(
        F.transform(F.coalesce(F.try_variant_get(v, "$.calculation_inputs", "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("double")),
        lambda x: x.isNotNull(),
    )
    status = F.coalesce(F.try_variant_get(v, "$.alignment_status", "string"), F.lit(""))
    return F.when(
        T.strip(raw).startswith("{") & ~T.strip(raw).rlike(r"^\{\s*\}$") & v.isNotNull(),
        F.struct(inputs.alias("inputs"), sources.alias("sources"), status.alias("status"), F.size(sources).alias("hops"), (F.lower(status) == "contradiction").alias("red_flag")),
    )


def stream_text(c: Column) -> Column:
    """Concatenated deltas of a server-sent event stream, up to its [DONE] line."""
    lines = F.split(F.split(c, r"(?m)^data: \[DONE\]")[0], "\n")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.get_json_object(F.substring(x, 7, 2**31 - 1), "$.choices[0].delta.content"))
    return F.array_join(F.filter(data, lambda x: x.isNotNull()), "")
