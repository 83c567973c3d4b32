"""Value tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import metrics as M
from quillgrid.functions import numeric as N
from quillgrid.functions import replies as J
from quillgrid.functions import tables as H
from quillgrid.functions import text as T
from quillgrid.operators import sequences as Q


@pytest.fixture(scope="module")
def pair(spark):
    def run(expr, *cases):
        df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
        return [r[0] for r in df.select(expr(F.col("a"), F.col("b")).alias("x"), "i").orderBy("i").collect()]

    return run


@pytest.fixture(scope="module")
def one(pair):
    return lambda expr, *texts: pair(lambda a, _: expr(a), *[(t, "") for t in texts])


def test_normalize(one):
    assert one(T.normalize, "  RS 7,  Towers?", "Farsi", "€ 3 km", "") == ["7 towe", "fai", "3 km", ""]


def test_relaxed_match(pair):
    yes = [("₹ 88.5 lakh", "88.5"), ("$ 7,300 thousand", "7300"), ("dropped 4 points", "-4 points"), ("-9", "lower by 9"), ("profits up 6", "+6"), ("(17)", "a deficit of 17"), ("sales of 20 lakh", "sales of 2 million"), ("0.3 bn", "30 cr")]
    no = [("fell 4", "+4"), ("gained 8", "-8"), ("north", "south")]
    assert pair(M.relaxed_match, *yes) == [1] * len(yes)
    assert pair(M.relaxed_match, *no) == [0] * len(no)


def test_relaxed_is_looser_than_exact(pair):
    cases = [("Seven (7) plants", "seven 7 plants"), ("a", "b"), ("No", "no!"), ("", ""), ("4%", "4 %")]
    for e, r in zip(pair(M.exact_match, *cases), pair(M.relaxed_match, *cases)):
        assert r >= e


def test_directional(pair):
    cases = [("rose", "grew"), ("rose", "shrank"), ("a drop of 9", "-9"), ("weakened", "(4)"), ("surged", "+3"), ("stable", "no change"), ("zebra", "up"), ("up", "zebra")]
    assert pair(M.directional_accuracy, *cases) == [1, 0, 1, 1, 1, 1, None, 0]


def test_direction_labels(one):
    assert one(M.direction, "saw no material change, then rose", "unknown", "eyesight", "quiet", "-5", "+5", "(₹ 3)", "rose, then fell") == ["flat", "no", "yes", None, "down", "up", "down", "down"]


def test_token_f1(pair):
    f1 = pair(lambda a, b: M.token_f1(a, b)["f1"], ("four red boats at sea", "four boats"), ("", ""), ("a", ""), ("a a b", "a b b"))
    assert 0.5 < f1[0] <= 1 and f1[1:] == [1.0, 0.0, 1.0]


def test_numbers(one):
    assert one(N.number_strings, "7,300 of 12.25", "room 9b", "x, y -4%") == [["7,300", "12.25"], ["9"], [",", "4"]]
    assert one(N.to_number, "7,300", "12.25", "abc", ",") == [7300.0, 12.25, None, None]


def test_canonical(one):
    assert one(N.canonical_value, "₹ 2 lakh", "rs. 3 million", "4,000 k", "2,34,567", "9 lakh and 4 crore", "x, 5", "none") == [2e5, 3e6, 4e6, 234567.0, 4e7, None, None]
    # Plurals come before singulars, whatever stands first in the text.
    both = ["5 crore and 3 crores", "5 lakh, 3 lakhs", "5 billion or 3 billions", "5 million 3 millions", "5 thousand 3 thousands"]
    assert one(N.canonical_value, *both) == [3e7, 3e5, 3e9, 3e6, 3e3]


def test_equivalence(pair):
    assert pair(N.equivalent, ("30 lakh", "3 million"), ("2,34,567", "234567"), ("30 lakh", "4 million"), ("a", "5"), ("0", "0"), ("1000", "1010")) == [True, True, False, False, True, True]


def test_number_scores(pair):
    got = pair(N.number_scores, ("7,300 boats", "7,300 boats"), ("7,300 boats", "8,000 boats"), ("12.5 and 40", "12.5 and 41"), ("north", "north"), ("5", "x"))
    assert [g["exact"] for g in got] == [1, 0, 0, 1, 0]
    assert got[0]["f1"] == 1 and 0 < got[2]["f1"] < 1 and got[3]["f1"] == 1 and got[4]["f1"] == 0


def test_tolerance(pair):
    assert pair(N.within_tolerance, ("80", "84"), ("80", "84.1"), ("80", "79"), ("0", "0"), ("0", "1"), ("x", "1")) == [1, 0, 1, 1, 0, 0]


def test_error(pair):
    got = pair(N.absolute_percentage_error, ("4", "5"), ("1", "900"), ("0", "1"), ("5", "x"), ("x", "5"))
    assert got[0] == pytest.approx(0.25) and got[1:] == [10.0, None, None, None]


def test_rouge_forms_agree(pair, spark):
    cases = [("the cat sat on the mat", "the cat on a mat"), ("a", "a"), ("", "a"), ("a b c", "c b a"), ("x y", "z")]
    short, long = pair(M.rouge_l, *cases), pair(Q.rouge_l, *cases)
    assert short == pytest.approx(long) and short[1] == 1.0 and short[2] == 0.0


def test_entailment(pair):
    got = pair(M.entailment, ("The ferry sank near the old harbour.", "The ferry sank near the old harbour"), ("abc", " "), ("The firm sold boats.", "Quantum chess wins. no"), ("a b c d e f", "a b x y zz"))
    assert got[0]["entailment"] == 1.0 and tuple(got[1]) == (0, 0.0, 0.0, 1.0)
    assert got[2]["n"] == 2 and got[2]["contradiction"] == 0.5 and got[2]["neutral"] == 0.5
    assert got[3]["neutral"] == 1.0


def test_traceability(pair):
    assert pair(M.traceability, ("a  B", "A b"), ("a b", "c d"), ("", "a"), ("a b c", "c d")) == [1.0, 0.0, 0.0, 0.5]


def test_abstention_and_flags(one):
    assert one(T.is_abstention, "Not available in context", "It cannot be determined.", "not stated", "It is 5", "", "Not available in memory") == [True, True, True, False, False, False]
    assert one(T.is_brsr, "BRSR Section", "Principle 6", "Balance Sheet", None) == [True, True, False, False]


def test_hallucinations(pair):
    low = lambda a, b: M.hallucination_type(a, b, F.lit(0.1))
    assert pair(low, ("rose 4", "fell 4"), ("5", "6"), ("5 and 6", "5"), ("a", "a b c d"), ("a", "b")) == ["direction_error", "numeric_fabrication", "numeric_miscalculation", "over_interpretation", "other"]


def test_judge_replies(one):
    got = one(M.judge_reply, 'ok {"equivalent": true, "confidence": "high", "reason": " same "}', "yes they match", "", '{"equivalent": false}')
    assert [g["equivalent"] for g in got] == [True, True, False, False]
    assert got[0]["confidence"] == "HIGH" and got[0]["reason"] == "same" and got[2]["error"] == "empty response"


def test_tables(one):
    html = "<TABLE><tr><th>Item</th><th>Year</th></tr><tr><td>Boats <b>sold</b></td><td>7,300</td></tr><tr><td></td><td></td></tr></TABLE>"
    md, lin = one(lambda c: H.serialize(c), f"x {html} y")[0], one(lambda c: H.serialize(c, "linearized"), f"x {html} y")[0]
    assert "| Item | Year |\n|---|---|\n" in md and md.startswith("x ") and md.endswith(" y")
    assert lin == "x Item: Boats  sold | Year: 7,300 y"
    assert one(lambda c: H.serialize(c, "html"), html) == [html]


def test_markdown(one):
    assert one(T.normalize_markdown, "a\r\n\n\n\nb\n---\nc")[0] == "a\n\nb\n\nc"
    assert one(T.heading, "# Top", "**Bold**", "text\n## Sub", "plain")[:3] == [("Top", 1), ("Bold", 2), ("Sub", 2)]
    assert one(T.blocks, "a\n\nb<table><tr>\n\n</tr></table>c")[0] == ["a", "b", "<table><tr>\n\n</tr></table>", "c"]
    assert one(T.token_estimate, "", "a b c d", "1 2 3 4") == [0, 5, 8]
    assert one(T.is_complete, "Done.", "open", "list)") == [True, False, True]
    assert one(T.sentences, "One. Two!  Three? ")[0] == ["One.", "Two!", "Three?"]


def test_replies(one):
    good = '[{"question": "q", "answer": "a"}]'
    assert [len(x or []) for x in one(J.qa_pairs, good, f"see: {good} end", "none", '[{"question": " ", "answer": "a"}]')] == [1, 1, 0, 0]
    assert one(J.reply_error, good, "none", '[{"question": " ", "answer": "a"}]') == [None, "json", "missing field"]
    assert one(J.truthy, "false", '"false"', "0", "1", None) == [False, True, False, True, False]
    assert one(J.stream_text, 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"c"}}]}') == ["ab"]


def test_anchors(one):
    got = one(J.anchors, '{"calculation_inputs": [120.5, "45.2", "x", null], "cross_section_sources": ["P&L", "Note 15"], "alignment_status": "Contradiction"}', '{"cross_section_sources": "Note 15"}', '{"cross_section_sources": ""}', "{}", None, "[]")
    assert got[0]["inputs"] == [120.5, 45.2] and got[0]["hops"] == 2 and got[0]["red_flag"]
    assert got[1]["sources"] == ["Note 15"] and got[2]["hops"] == 0 and got[3:] == [None, None, None]
