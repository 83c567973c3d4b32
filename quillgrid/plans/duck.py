"""DuckDB forms of the library's expressions, for the equivalent SQL of the registered queries."""

from __future__ import annotations

from functools import reduce

# Fixed values, stated here again so that the SQL does not take them from what it checks.
UNITS = (
    ("crores", 1e7), ("crore", 1e7), ("cr", 1e7), ("lakhs", 1e5), ("lakh", 1e5), ("lac", 1e5), ("lk", 1e5),
    ("billions", 1e9), ("billion", 1e9), ("bn", 1e9), ("millions", 1e6), ("million", 1e6), ("mn", 1e6), ("thousands", 1e3), ("thousand", 1e3), ("k", 1e3),
)
CURRENCIES = ("₹", "$", "€", "£", "rs.", "rs ", "inr", "usd", "eur")
DIRECTION_WORDS = {
    "up": (
        "increase", "increased", "increases", "growth", "grew", "grow", "rose", "rise",
        "risen", "higher", "up", "gain", "gained", "gains", "improved", "improvement",
        "profit", "profits", "strengthened", "expansion", "expanded", "surge", "surged", "jumped",
    ),
    "down": (
        "decrease", "decreased", "decreases", "decline", "declined", "declines", "declining", "fell",
        "fall", "fallen", "drop", "dropped", "drops", "lower", "down", "reduction",
        "reduced", "reduce", "shrink", "shrunk", "shrank", "loss", "losses", "deteriorated",
        "weakened", "contraction", "contracted", "negative", "deficit",
    ),
    "flat": (
        "unchanged", "stable", "flat", "marginal",
    ),
    "yes": ("yes",),
    "no": ("no",),
}
FLAT_PHRASES = (
    "no change", "no significant change", "no major change", "no material change", "no meaningful change",
    "remained unchanged", "remained stable", "no notable change", "no considerable change",
)
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
STRIPPED_UNITS = (
    "crores", "crore", "cr", "lakhs", "lakh", "lac", "lk", "millions", "million", "mn", "billions", "billion", "bn", "thousands", "thousand",
    "rs", "inr", "₹", "$",
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def removed(x: str, parts, by: str = "") -> str:
    return reduce(lambda a, p: f"replace({a}, {lit(p)}, {lit(by)})", parts, x)


def norm(x: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"trim({removed(plain, ('₹', '$', '€', '£', 'rs', 'inr'))})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''))"


def set_f1(g: str, p: str) -> str:
    both = f"len(list_intersect({g}, {p}))"
    return (
        f"CASE WHEN len({g}) = 0 AND len({p}) = 0 THEN 1.0::DOUBLE WHEN len({g}) = 0 OR len({p}) = 0 OR {both} = 0 THEN 0.0::DOUBLE "
        f"ELSE 2::DOUBLE * ({both}::DOUBLE / len({p})) * ({both}::DOUBLE / len({g})) / (({both}::DOUBLE / len({p})) + ({both}::DOUBLE / len({g}))) END"
    )


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def traceability(a: str, b: str) -> str:
    x, y = (f"trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))" for t in (a, b))
    u, v = (f"list_distinct(list_filter(string_split({t}, ' '), lambda w: w <> ''))" for t in (x, y))
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 1.0::DOUBLE ELSE len(list_intersect({u}, {v}))::DOUBLE / least(len({u}), len({v})) END"


def number_strings(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\d,]+(?:\\.\\d+)?')"


def numbers(x: str) -> str:
    return f"list_filter(list_transform({number_strings(x)}, lambda n: TRY_CAST(replace(n, ',', '') AS DOUBLE)), lambda n: n IS NOT NULL)"


def last_number(x: str) -> str:
    return f"({numbers(x)})[-1]"


def canonical(x: str) -> str:
    bare = removed(f"lower({x})", CURRENCIES, " ")
    tried = [f"TRY_CAST(nullif(replace(regexp_extract({bare}, '([\\d,]+(?:\\.\\d+)?)\\s*{u}\\b', 1), ',', ''), '') AS DOUBLE) * {f!r}::DOUBLE" for u, f in UNITS]
    return f"coalesce({', '.join(tried)}, TRY_CAST(nullif(replace(regexp_extract({bare}, '[\\d,]+(?:\\.\\d+)?'), ',', ''), '') AS DOUBLE))"


def equivalent(x: str, y: str) -> str:
    """Of canonical values."""
    return f"coalesce(CASE WHEN abs({x}) < 1e-10 AND abs({y}) < 1e-10 THEN TRUE WHEN abs({x}) < 1e-10 OR abs({y}) < 1e-10 THEN FALSE ELSE abs({x} - {y}) / greatest(abs({x}), abs({y})) <= 0.015::DOUBLE END, FALSE)"


def direction(x: str) -> str:
    n = norm(x)
    pairs = ", ".join(f"{lit(w)}: {lit(side)}" for side, own in DIRECTION_WORDS.items() for w in own)
    known = "[" + ", ".join(lit(w) for own in DIRECTION_WORDS.values() for w in own) + "]"
    last = f"(list_filter(string_split({n}, ' '), lambda w: list_contains({known}, w)))[-1]"
    return (
        f"CASE WHEN regexp_matches(trim({x}), '^-\\d') THEN 'down' WHEN regexp_matches(trim({x}), '^\\+\\d') THEN 'up' WHEN regexp_matches(trim({x}), '^\\([\\d₹$]') THEN 'down' "
        f"WHEN {any_of(n, FLAT_PHRASES)} THEN 'flat' WHEN {last} IS NOT NULL THEN MAP {{{pairs}}}[{last}] WHEN contains({n}, 'yes') THEN 'yes' WHEN contains({n}, 'no') THEN 'no' END"
    )


def strip_units(x: str) -> str:
    return f"regexp_replace({removed(f'lower({x})', STRIPPED_UNITS)}, '[,()%\\s]', '', 'g')"


def token_estimate(x: str) -> str:
    n, d, s = (f"len(regexp_extract_all({x}, '{p}'))" for p in ("\\S+", "\\d+", "[₹$€£%]"))
    return f"CASE WHEN {n} = 0 THEN 0 ELSE CAST(floor({n} * least(2.5::DOUBLE, 1.3::DOUBLE + 0.8::DOUBLE * {d} / {n} + 0.5::DOUBLE * {s} / {n})) AS INTEGER) END"


def md5_number(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || chr(58) || '.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 8) AS BIGINT)"
