"""Endpoints of models, and models that score pairs (similarity, entailment) as pluggable operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import metrics as M
from quillgrid.functions import text as T
from quillgrid.session import ship_package


@dataclass(frozen=True)
class Endpoint:
    """A model behind an address: what a backend needs to know to ask it."""

    model: str
    address: str
    label: str = ""
    key_variable: str | None = None
    options: dict = field(default_factory=dict)

    @property
    def shown(self) -> str:
        return self.label or self.model.rpartition("/")[2]


def endpoints(path: str) -> dict[str, Endpoint]:
    """Endpoints by short name from a JSON file of objects with the fields of ``Endpoint``."""
    return {name: Endpoint(**settings) for name, settings in json.loads(Path(path).read_text()).items()}


def local_server(model: str, port: int, host: str = "localhost", **options) -> Endpoint:
    """A server of one's own with the usual chat interface."""
    return Endpoint(model, f"http://{host}:{port}/v1", options=options)


def run_tag(model: str, tier: str, regime: str, form: str = "html") -> str:
    return "_".join([model, tier, regime, *([form] if form != "html" else [])])


#: Once in each partition gives a function from texts to (precision, recall, f1) for each pair.
PairScorer = Callable[[], Callable[[list[str], list[str]], list[tuple[float, float, float]]]]


def bert_scores(df: DataFrame, key: str, gold: str, pred: str, scorer: PairScorer | None = None) -> DataFrame:
    """(key, bertscore_p, bertscore_r, bertscore_f1): zeros without a scorer; texts cut to 1024 characters, blank ones as n/a."""
    text = lambda c: F.when(T.strip(F.coalesce(F.col(c), F.lit(""))) == "", "n/a").otherwise(T.capped(F.col(c), "similarity"))
    names = ["bertscore_p", "bertscore_r", "bertscore_f1"]
    if scorer is None:
        return df.select(key, *(F.lit(0.0).alias(n) for n in names))
    ship_package(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = None
        for f in frames:
            score = score or scorer()
            yield pd.concat([f[[key]], pd.DataFrame(score(list(f["g"]), list(f["p"])), columns=names, index=f.index)], axis=1)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text(gold).alias("g"), text(pred).alias("p")).mapInPandas(run, f"{key} {kind}, bertscore_p double, bertscore_r double, bertscore_f1 double")


#: Once in each partition gives a function from (evidence, sentence) to label scores.
Entailer = Callable[[], Callable[[str, str], dict[str, float]]]


def entailments(df: DataFrame, key: str, evidence: str, answer: str, entailer: Entailer | None = None) -> DataFrame:
    """(key, n, entailment, contradiction, neutral): by a model where one is given (its best label of each sentence, NEUTRAL
    where a call fails), else by shared words."""
    if entailer is None:
        return df.select(key, M.entailment(F.col(evidence), F.col(answer)).alias("e")).select(key, "e.*")
    ship_package(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for f in frames:
            call = call or entailer()
            labels = []
            for premise, sentence in zip(f["e"], f["s"]):
                try:
                    scores = call(premise, sentence)
                    labels.append(max(scores, key=scores.get).upper())
                except Exception:
                    labels.append("NEUTRAL")
            yield f[[key]].assign(label=labels)

    kind = df.schema[key].dataType.simpleString()
    each = df.select(key, T.capped(F.coalesce(F.col(evidence), F.lit("")), "premise").alias("e"), F.explode(T.sentences(F.coalesce(F.col(answer), F.lit("")))).alias("s")).mapInPandas(run, f"{key} {kind}, label string")
    share = lambda name: F.avg((F.col("label") == name).cast("int")).alias(name.lower())
    found = each.groupBy(key).agg(F.count("*").cast("int").alias("n"), share("ENTAILMENT"), share("CONTRADICTION"), share("NEUTRAL"))
    return df.select(key).join(found, key, "left").fillna({"n": 0, "entailment": 0.0, "contradiction": 0.0, "neutral": 1.0})
