from __future__ import annotations

import random

import pytest

CLASHING = "id bigint, row bigint, host string, node bigint, fp bigint, n bigint, start bigint, part int, word string, queue int, mark string, key bigint, html_x string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties and repeats, and columns whose names operators use inside."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = line(80)
    texts = [None, "", " \n ", "One", base, base, base + " tail", "\n".join(line(12) for _ in range(10)), line(3000), "x\x0by\x1cz w", "<|endoftext|> a </s>", "日本語 text ☃ 𝒳"]
    texts += [line(r.randint(1, 120)) for _ in range(40)]
    rows = [(None if k == 3 else k, t, "en", None if k == 2 else f"s{k % 3}", 0) for k, t in enumerate(texts)]
    rows += [rows[5], (7, line(20), "de", "s0", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"cast(7 as {c.split()[1]}) AS {c.split()[0]}" for c in CLASHING.split(", ")])


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
