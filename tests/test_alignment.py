import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import stems
from quillgrid.operators import alignment as A

# Published examples of the suffix rules, and whole words.
PORTER = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration
digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form formalize formal
electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust irritant irrit replacement replac adoption adopt effective effect
bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll generalizations gener oscillators oscil is is 2024 2024 größe größe""".split()
GUIDE = (
    "It is a guide to action that ensures that the military will forever heed Party commands",
    "It is a guide to action which ensures that the military always obeys the commands of the party",
)


@pytest.mark.parametrize("word,stem", list(zip(PORTER[::2], PORTER[1::2])))
def test_porter(word, stem):
    assert stems.porter_stem(word) == stem


def test_plurals(spark):
    df = spark.createDataFrame([("flies",), ("dies",), ("boxes",), ("shoes",), ("cats",), ("bus",), ("class",), ("gas",)], "w string")
    assert [r[0] for r in df.select(stems.plural(F.col("w"))).collect()] == ["fly", "die", "boxe", "shoe", "cat", "bus", "class", "gas"]
    assert [r[0] for r in df.limit(3).select(stems.porter(F.col("w"))).collect()] == ["fli", "di", "box"]


def best_by_trying(pred, gold):
    """(crossings, matches) of the best of all largest matchings."""
    options = []
    for c in set(pred) & set(gold):
        ps, gs = [p for p, x in enumerate(pred) if x == c], [g for g, x in enumerate(gold) if x == c]
        k = min(len(ps), len(gs))
        options.append([tuple(zip(a, b)) for a in itertools.combinations(ps, k) for b in itertools.permutations(gs, k)])
    return min((A.crossing_pairs(pairs), len(pairs)) for pairs in ([x for o in choice for x in o] for choice in itertools.product(*options)))


def test_fewest_crossings_against_all_alignments():
    r = random.Random(1)
    for _ in range(300):
        pred, gold = [[r.choice("abcd") for _ in range(r.randint(0, 7))] for _ in range(2)]
        found = A.fewest_crossings([pred], [gold], beam=10**6)
        assert (A.crossing_pairs(found), len(found)) == best_by_trying(pred, gold)
        assert A.fewest_crossings([pred], [gold]) == found  # forty choices are enough for so short texts


def plain_last_first(pred, gold):
    """Words from the end, each with the last word of the other text that is still free; then the same for stems."""
    met, left, right = [], list(enumerate(pred)), list(enumerate(gold))
    for same in (lambda w: w, stems.porter_stem):
        for p in left[::-1]:
            for g in right[::-1]:
                if same(p[1]) == same(g[1]):
                    met.append((p[0], g[0]))
                    left.remove(p)
                    right.remove(g)
                    break
    return sorted(met)


def score(matches, chunks, n_gold, n_pred):
    if not matches:
        return 0.0
    p, r = matches / n_pred, matches / n_gold
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / matches) ** 3)


def test_meteor_of_many_pairs(spark):
    r = random.Random(6)
    vocabulary = "run runs running ran the the the cat cats , . 4,000 50 of of".split()
    text = lambda: r.choice([None, "", " "]) if r.random() < 0.1 else " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25)))
    rows = [(k, text(), text()) for k in range(120)] + [(500, "w " * 800, "w " * 790 + "x"), (501, "Größe é", "größe É")]
    df = spark.createDataFrame(rows, "k int, gold string, pred string")
    got = {x["k"]: x for x in A.meteor_scores(df, ["k"], "gold", "pred").collect()}
    exact = {x["k"]: x for x in A.meteor_scores(df.where("k < 60"), ["k"], "gold", "pred", align="fewest_crossings").collect()}
    assert set(got) == {k for k, _, _ in rows} and len(exact) == 60
    for k, gold, pred in rows:
        g, p = (x.lower().split() if x else [] for x in (gold, pred))
        met = plain_last_first(p, g) if k < 500 else None
        x = got[k]
        assert (x["gold_words"], x["pred_words"]) == (len(g), len(p))
        if met is not None:
            assert (x["matches"], x["chunks"]) == (len(met), A.chunk_count(met))
        assert x["meteor"] == pytest.approx(score(x["matches"], x["chunks"], len(g), len(p)))
        if k < 60:
            y = exact[k]
            assert y["matches"] == x["matches"] and y["meteor"] == pytest.approx(score(y["matches"], y["chunks"], len(g), len(p)))
    assert (got[500]["matches"], got[501]["matches"]) == (790, 2)


def test_known_scores(spark):
    df = spark.createDataFrame([(1, *GUIDE), (2, "Thirteen Directors on the Board",) * 1 + ("Thirteen Directors on the Board",), (3, "Revenue increased by eighteen percent", "Revenue increased"), (4, "", "anything")], "k int, gold string, pred string")
    last = {x["k"]: x for x in A.meteor_scores(df, ["k"], "gold", "pred").collect()}
    few = {x["k"]: x for x in A.meteor_scores(df, ["k"], "gold", "pred", align="fewest_crossings").collect()}
    assert round(last[1]["meteor"], 4) == 0.6944 and (last[1]["matches"], last[1]["chunks"]) == (12, 6)  # as the usual toolkit's manual has it
    assert (few[1]["matches"], few[1]["chunks"]) == (12, 4) and few[1]["meteor"] > last[1]["meteor"]
    assert last[2]["meteor"] >= 0.99 and 0 < last[3]["meteor"] < 1 and last[4]["meteor"] == 0.0
