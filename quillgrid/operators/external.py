"""Calls to outside models as cached, resumable operators with pluggable backends.

A backend is a picklable factory that gives, once per partition, a function from a list of prompts to
replies. What was answered before is read from a cache table and not asked again. New answers are asked
for once and kept in the shared folder before anything reads them, so that every use of an operator's results
sees the same replies and costs no further calls; the caller (or ``streaming.incremental``) writes them to
the cache table.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import metrics as M
from quillgrid.functions import replies as J
from quillgrid.functions import text as T
from quillgrid.session import kept, ship_package

Reply = tuple[str, str | None]
Backend = Callable[[], Callable[[str], Reply]]

#: Columns of an answer; asked_at (seconds) tells which of repeated answers is the last.
ANSWER = "reply string, error string, latency_ms double, asked_at double"


class Retryable(Exception):
    """An error after which the call is worth another try."""


class Rejected(Exception):
    """An error that another try would not mend."""


@dataclass
class Retrying:
    """A backend with up to ``attempts`` tries, waiting twice as long after each."""

    inner: Backend
    attempts: int = 5
    wait: float = 2.0
    jitter: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self) -> Callable[[str], Reply]:
        call = self.inner()

        def run(prompt: str) -> Reply:
            error = ""
            for k in range(self.attempts):
                try:
                    return call(prompt)
                except Rejected as e:
                    return "", str(e)
                except Exception as e:  # any other failure may pass
                    error = str(e)
                    if k + 1 < self.attempts:
                        self.sleep(self.wait * 2**k + random.random() * self.jitter)
            return "", error or "no answer"

        return run


@dataclass
class Fallback:
    """Asks the second backend where the first fails."""

    first: Backend
    second: Backend

    def __call__(self) -> Callable[[str], Reply]:
        a, b = self.first(), self.second()

        def run(prompt: str) -> Reply:
            try:
                reply, error = a(prompt)
            except Exception:
                return b(prompt)
            return (reply, None) if error is None else b(prompt)

        return run


class Limited(Exception):
    """The backend takes no more calls with this key just now."""


@dataclass
class Rotating:
    """Backends with different keys or hosts, one used until it says ``Limited``; then the next one is tried, each once a call."""

    inner: list[Backend]

    def __call__(self) -> Callable[[str], Reply]:
        calls, at = [b() for b in self.inner], [0]

        def run(prompt: str) -> Reply:
            for _ in calls:
                try:
                    return calls[at[0]](prompt)
                except Limited:
                    at[0] = (at[0] + 1) % len(calls)
            raise Retryable("all backends are at their limit")

        return run


@dataclass
class Overflow:
    """Asks the first backend as often as its rate allows, and the second at once where it does not or where the first fails.

    ``per_minute`` is the first's rate in all, shared out among ``parallel`` partitions; ``burst`` calls may come together.
    """

    first: Backend
    second: Backend
    per_minute: float = 30.0
    parallel: int = 1
    burst: int = 1
    clock: Callable[[], float] = time.monotonic

    def __call__(self) -> Callable[[str], Reply]:
        a, b, held, last = self.first(), self.second(), [float(self.burst)], [self.clock()]

        def run(prompt: str) -> Reply:
            now = self.clock()
            held[0] = min(float(self.burst), held[0] + (now - last[0]) * self.per_minute / 60.0 / self.parallel)
            last[0] = now
            if held[0] < 1:
                return b(prompt)
            held[0] -= 1
            try:
                reply, error = a(prompt)
            except Exception:
                return b(prompt)
            return (reply, None) if error is None else b(prompt)

        return run


@dataclass
class RateLimited:
    """At most ``per_minute`` calls a minute in all, shared out among ``parallel`` partitions that ask at a time, in equal parts.

    ``ask_at_rate`` shares one rate among tasks as they need it.
    """

    inner: Backend
    per_minute: float = 30.0
    parallel: int = 1
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __call__(self) -> Callable[[str], Reply]:
        call, last = self.inner(), [float("-inf")]

        def run(prompt: str) -> Reply:
            left = last[0] + 60.0 * self.parallel / self.per_minute - self.clock()
            if left > 0:
                self.sleep(left)
            last[0] = self.clock()
            return call(prompt)

        return run


@dataclass
class Stub:
    """A deterministic backend for tests: the md5 of the prompt, or a fixed reply."""

    fixed: str | None = None

    def __call__(self) -> Callable[[str], Reply]:
        return lambda prompt: (self.fixed if self.fixed is not None else hashlib.md5(prompt.encode()).hexdigest(), None)


def last_cached(cache: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row for each key of a cache: the last by ``order``, else by when it was asked, else by its place in the table."""
    place = F.monotonically_increasing_id()
    if order is None:
        order = F.struct(F.coalesce("asked_at", F.lit(0.0)), place) if "asked_at" in cache.columns else place
    row = F.struct(*[F.col(c) for c in cache.columns])
    return cache.select(F.col(key).alias("_key_"), row.alias("_row"), order.alias("_order")).groupBy("_key_").agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key was not done before."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def pending_matrix(left: DataFrame, right: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of two small lists (models and tiers) that was not done before."""
    return left.crossJoin(F.broadcast(right)).join(done.select(*keys).distinct(), keys, "left_anti")


def ask(rows: DataFrame, key: str, prompt: str, backend: Backend, parallel: int | None = None) -> DataFrame:
    """(key, reply, error, latency_ms) of each row; ``parallel`` bounds the calls at a time."""
    ship_package(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for f in frames:
            call = call or backend()
            out = []
            for k, p in zip(f[key], f["prompt"]):
                began = time.monotonic()
                try:
                    reply, error = call(p)
                except Exception as e:
                    reply, error = "", str(e) or type(e).__name__
                out.append((k, reply, error, 1000 * (time.monotonic() - began), time.time()))
            yield pd.DataFrame(out, columns=[key, "reply", "error", "latency_ms", "asked_at"])

    asked = rows.select(key, F.col(prompt).alias("prompt"))
    asked = asked.repartition(parallel) if parallel else asked
    return asked.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {ANSWER}")


def shares(demands: list[int], allowance: int, turn: int = 0) -> list[int]:
    """What each task may ask of an allowance: as equal as demands allow, none above its demand, odd ones from task ``turn`` on."""
    out, left = [0] * len(demands), min(allowance, sum(demands))
    while left > 0:
        open_ = [k for k in ((turn + j) % len(demands) for j in range(len(demands))) if out[k] < demands[k]]
        each = max(1, left // len(open_))
        for k in open_:
            more = min(demands[k] - out[k], each, left)
            out[k] += more
            left -= more
    return out


def in_rounds(rank: int, prompts: Iterator[tuple], call: Callable[[str], Reply], gather: Callable[[str], list[str]], rate: float, burst: int, clock: Callable[[], float], sleep: Callable[[float], None]) -> Iterator[tuple]:
    """(key, prompt, reply, error, milliseconds) of a task's prompts, asked in rounds with the tasks beside it.

    In each round the tasks tell each other how much they have to ask, and the first task's clock. All of
    them work out the same division of what the job's rate (calls a second) allows by that clock, less what
    it has spent, so what idle tasks leave is the others'. A task that has run dry stays until all have.
    """
    held: list[tuple] = []
    began, spent, turn, dry = None, 0, 0, False
    while True:
        while not held and not dry:
            if (more := next(prompts, None)) is None:
                dry = True
            else:
                held += more
        told = [json.loads(x) for x in gather(json.dumps([len(held), clock()]))]
        demands, now = [d for d, _ in told], told[0][1]
        if not any(demands):
            return
        began = now if began is None else began
        mine = shares(demands, burst + int((now - began) * rate + 1e-9) - spent, turn)
        spent, turn = spent + sum(mine), turn + 1
        for key, prompt in held[: mine[rank]]:
            start = clock()
            try:
                reply, error = call(prompt)
            except Exception as e:
                reply, error = "", str(e) or type(e).__name__
            yield key, prompt, reply, error, 1000 * (clock() - start)
        held = held[mine[rank] :]
        if not any(mine):
            sleep(max(0.0, began + (spent + 1 - burst) / rate - now))


def ask_at_rate(rows: DataFrame, key: str, prompt: str, backend: Backend, per_minute: float, parallel: int, burst: int = 1) -> DataFrame:
    """As ``ask``, with one rate for the whole job: ``parallel`` tasks run side by side (a barrier stage) and share it as they need it."""
    ship_package(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        prompts = (list(zip(f[key], f["prompt"])) for f in frames)
        for k, _, reply, error, took in in_rounds(context.partitionId(), prompts, backend(), context.allGather, per_minute / 60.0, burst, time.monotonic, time.sleep):
            yield pd.DataFrame([(k, reply, error, took, time.time())], columns=[key, "reply", "error", "latency_ms", "asked_at"])

    asked = rows.select(key, F.col(prompt).alias("prompt")).repartition(parallel)
    told = asked.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {ANSWER}", barrier=True)
    return told.repartition(parallel)  # the barrier stage ends here: what follows need not run side by side


def ask_cached(rows: DataFrame, key: str, prompt: str, backend: Backend, cache: DataFrame, parallel: int | None = None, retry_errors: bool = False, per_minute: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers of all rows, those that are new). Of repeated cache rows the last counts; errors count as answers unless ``retry_errors``.

    Each key that the cache lacks is asked once, when this is called; with ``per_minute`` at one rate for
    all ``parallel`` tasks.
    """
    held = last_cached(cache, key)
    held = (held.where("error IS NULL") if retry_errors else held).select(key, "reply", "error", "latency_ms")
    left = pending(rows, held, key).dropDuplicates([key])
    fresh = kept(ask(left, key, prompt, backend, parallel) if per_minute is None else ask_at_rate(left, key, prompt, backend, per_minute, parallel or 1))
    known = held.join(rows.select(key).distinct(), key, "left_semi")
    return known.unionByName(fresh.drop("asked_at")), fresh


REGIMES = ("zero_shot", "few_shot", "closed_book", "chain_of_thought")


# Sectors that are shown by another name.
SECTOR_LABELS = {
    "Private_Sector_Bank": "Private Sector Banking",
    "Public_Sector_Bank": "Public Sector Banking",
    "Information_Technology": "Information Technology",
    "Pharmaceutical": "Pharmaceuticals",
    "Automobile": "Automotive",
    "Fast_Moving_Consumer_Goods": "FMCG",
}


def sector_label(sector: Column) -> Column:
    """The name that a sector is shown by: its label, else its own with spaces for underscores."""
    labels = F.create_map(*[F.lit(x) for pair in SECTOR_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, sector), F.replace(sector, F.lit("_"), F.lit(" ")))


def company_preamble(company: Column, sector: Column, year: Column) -> Column:
    """Names with spaces for underscores, sectors by their labels, and a fiscal year such as FY2025 with its months."""
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    number = F.substring(year, 3, 4).try_cast("int")
    months = F.when((F.length(year) == 6) & number.isNotNull(), F.concat(year, F.lit(" (April "), (number - 1).cast("string"), F.lit(" – March "), number.cast("string"), F.lit(")"))).otherwise(year)
    return F.concat(F.lit("Company: "), plain(company), F.lit("\nSector: "), sector_label(sector), F.lit("\nFiscal year: "), months)


def messages(question: Column, context: Column, regime: str, preamble: Column | None = None, examples: list[dict[str, str]] = ()) -> Column:
    """Chat messages (role, content) of a regime; closed_book has no context."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime: {regime}")
    lead = F.concat(preamble, F.lit("\n\n")) if preamble is not None else F.lit("")
    shots = "".join(f"Q: {e['question']}\nA: {e['answer']}\n\n" for e in examples) if regime == "few_shot" else ""
    system = "Answer from what you know; say so if you don't." if regime == "closed_book" else "Answer from the context alone; say so if it doesn't hold the answer."
    if regime == "chain_of_thought":
        system += " Reason step by step, then give the answer on the last line."
    given = F.lit("") if regime == "closed_book" else F.concat(F.lit("Context:\n"), context, F.lit("\n\n"))
    user = F.concat(lead, F.lit(shots), given, F.lit("Question: "), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def completion_prompt(question: Column, context: Column, limit: int = 8000, preamble: Column | None = None) -> Column:
    """One text for completion models; a context beyond the limit is cut and marked."""
    cut = F.when(F.length(context) > limit, F.concat(F.left(context, F.lit(limit)), F.lit("\n[... truncated ...]"))).otherwise(context)
    lead = F.concat(preamble, F.lit("\n\n")) if preamble is not None else F.lit("")
    return F.concat(lead, F.lit("Context:\n"), cut, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


#: Of each tier: what to ask about, and examples of such questions.
TIERS = {
    "easy": ("Ask about one stated fact: a figure, a date, a name. Nothing may have to be worked out or guessed.", ("How high were the year's sales?", "Who audits the accounts?", "On which day was the meeting held?")),
    "medium": (
        "Ask for a short derivation within one section: a comparison, a trend, a cause that the text gives. Let openings of questions differ.",
        ("How did borrowings develop against the year before?", "What drove the change in margins?", "Did exports contribute to growth?"),
    ),
    "hard": (
        "Ask what a forensic auditor would: earnings that cash does not back, one-off items, debts and their service, related parties, pledges, contingent liabilities. List the inputs of a calculation.",
        ("Is the profit of the year backed by cash from operations?", "How often is interest covered, and is that enough?", "Do dealings with related parties call for attention?"),
    ),
    "multihop": (
        "Ask what needs two sections or tables or more, such as the income statement and the balance sheet, and name them.",
        ("What rate of interest do finance cost and borrowings imply?", "Do receivables grow faster than sales, and what follows for cash?", "How far would contingent liabilities lower net worth?"),
    ),
}
#: Keys of a pair, those that every tier has and those of the tiers that show their working.
PAIR_KEYS = ("question", "answer", "evidence", "question_type", "requires_calculation")
ANCHORED = ("hard", "multihop")


def question_prompt(text: Column, tier: str, budget: Column, **about: Column) -> Column:
    """What a model is asked for a bundle: task, rules and examples of the tier, and the text, headed by what ``about`` names (sector, company ...)."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier: {tier}")
    task, examples = TIERS[tier]
    keys = [*PAIR_KEYS, *(["verification_anchors"] if tier in ANCHORED else [])]
    rules = [
        f"Reply with a JSON array of objects with the keys {', '.join(keys)}.",
        "question_type is one of Text Only, Table Only, Table with Text, Numerical Calculation, Sentiment Divergence.",
        "requires_calculation is true only if the answer is not stated and has to be computed.",
        "evidence is copied from the text to the letter, tables with their markup, without cuts.",
    ]
    if tier in ANCHORED:
        rules.append("verification_anchors is an object: alignment_status (consistent, contradiction or not_applicable), calculation_inputs (numbers), cross_section_sources (section names).")
    head = [x for name, c in about.items() for x in (F.lit(f"{name.capitalize()}: "), F.coalesce(c, F.lit("")), F.lit("\n"))]
    ask = f"{task}\nWrite at most "
    rest = " question-answer pairs, fewer where the text does not carry them.\n" + "\n".join(f"- {r}" for r in rules) + "\nSuch questions are, in words of your own:\n" + "\n".join(f"- {e}" for e in examples) + "\n\n"
    return F.concat(F.lit(ask), budget.cast("string"), F.lit(rest), *head, F.lit("<text>\n"), text, F.lit("\n</text>"))


def generate_pairs(bundles: DataFrame, key: str, text: str, tier: str, backend: Backend, budget: Column, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(valid pairs, dead letters with their reason) of each bundle; replies that hold no JSON are asked for again up to ``tries`` times."""

    @dataclass
    class Parsing:
        inner: Backend
        tries: int

        def __call__(self):
            call = self.inner()

            def run(prompt: str) -> Reply:
                reply, error = "", None
                for _ in range(self.tries):
                    reply, error = call(prompt)
                    start, stop = reply.find("["), reply.rfind("]")
                    try:
                        if error is None and isinstance(json.loads(reply[start : stop + 1]), list):
                            break
                    except ValueError:
                        continue
                return reply, error

            return run

    about = {c: F.col(c) for c in ("sector", "company", "year", "section") if c in bundles.columns}
    asked = kept(ask(bundles.withColumn("_prompt", question_prompt(F.col(text), tier, budget, **about)), key, "_prompt", Parsing(backend, tries)))
    pairs = asked.select(key, F.explode(J.qa_pairs(F.col("reply"))).alias("p")).select(
        key, "p.question", "p.answer", "p.evidence", F.coalesce("p.question_type", F.lit("Unknown")).alias("question_type"), J.truthy(F.col("p.requires_calculation")).alias("requires_calculation")
    )
    dead = asked.withColumn("reason", F.coalesce("error", J.reply_error(F.col("reply")))).where("reason IS NOT NULL").select(key, "reason", T.capped(F.col("reply"), "dead_letter").alias("reply"))
    return pairs, dead


def judge(scored: DataFrame, backend: Backend, cache: DataFrame, gold: str = "gold", pred: str = "pred", question: str = "question") -> tuple[DataFrame, DataFrame]:
    """(scored with llm_num_equiv, new cache rows): equal triples are asked once; an error leaves null."""
    keyed = scored.withColumn("_key", M.judge_key(F.col(gold), F.col(pred), F.col(question)))
    prompt = F.concat(F.lit("Are these equivalent? Reply as JSON.\nQuestion: "), F.col(question), F.lit("\nGold: "), F.col(gold), F.lit("\nAnswer: "), F.col(pred))
    unique = keyed.select("_key", prompt.alias("_prompt")).dropDuplicates(["_key"])
    answers, fresh = ask_cached(unique, "_key", "_prompt", backend, cache)
    parsed = answers.select("_key", F.when(F.col("error").isNull(), M.judge_reply(F.col("reply"))).alias("j"))
    score = parsed.select("_key", F.when(F.col("j.error").isNull(), F.col("j.equivalent").cast("int")).alias("llm_num_equiv"))
    return keyed.join(score, "_key", "left").drop("_key"), fresh


def read_pages(pages: DataFrame, key: list[str], content: str, backend: Callable[[], Callable[[bytes], str]], attempts: int = 3) -> DataFrame:
    """(key, md, status) of page images: up to ``attempts`` tries; ``failed`` where no valid text came (a ValueError ends the tries)."""
    ship_package(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for f in frames:
            call = call or backend()
            out = []
            for data in f[content]:
                text = ""
                for _ in range(attempts):
                    try:
                        text = call(bytes(data)) or ""
                    except ValueError:
                        break
                    except Exception:
                        continue
                    if len(text.strip()) >= 3:
                        break
                out.append(text)
            yield f[key].assign(md=out)

    schema = ", ".join([*(f"{k} {pages.schema[k].dataType.simpleString()}" for k in key), "md string"])
    return pages.select(*key, content).mapInPandas(run, schema).withColumn("status", F.when(T.is_valid_page(F.col("md")), "ok").otherwise("failed"))


def upright(pages: DataFrame, key: list[str], content: str, detect: Callable[[], Callable[[bytes], int]], turn: Callable[[], Callable[[bytes, int], bytes]]) -> DataFrame:
    """(key, content, rotation): page images turned back by the angle (90, 180 or 270) that a detector finds."""
    ship_package(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = rotate = None
        for f in frames:
            find, rotate = find or detect(), rotate or turn()
            angles = [a if (a := find(bytes(d)) % 360) in (90, 180, 270) else 0 for d in f[content]]
            yield f[key].assign(**{content: [rotate(bytes(d), 360 - a) if a else bytes(d) for d, a in zip(f[content], angles)], "rotation": angles})

    schema = ", ".join([*(f"{k} {pages.schema[k].dataType.simpleString()}" for k in key), f"{content} binary, rotation int"])
    return pages.select(*key, content).mapInPandas(run, schema)


def read_twice(pages: DataFrame, key: list[str], doc: str, content: str, first: Callable, second: Callable, attempts: int = 3) -> DataFrame:
    """(key, md, status, retried) of page images, where the failed pages of documents that are partly read get a second pass by ``second``."""
    read = kept(read_pages(pages, key, content, first, attempts))
    partial = document_status(read, doc).where("status = 'partial'").select(doc)
    failed = read.where("status = 'failed'").join(partial, doc, "left_semi").select(*key)
    again = kept(read_pages(pages.join(failed, key, "left_semi"), key, content, second, attempts))
    once = read.join(again.select(*key), key, "left_anti").select(*key, "md", "status", F.lit(False).alias("retried"))
    return once.unionByName(again.select(*key, "md", "status", F.lit(True).alias("retried")))


def document_status(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, pages, failed, status): ok, partial or failed; partial ones are read again in a second pass. Pages of ``read_twice`` give retried too."""
    more = [F.count_if("retried").alias("retried")] if "retried" in pages.columns else []
    counted = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"), *more)
    return counted.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("failed") < F.col("pages"), "partial").otherwise("failed"))


def processing_counters(states: DataFrame) -> DataFrame:
    """(status, documents, pages, failed) of document states, with the total under a null status; retried pages where states tell them."""
    more = [F.sum("retried").alias("retried")] if "retried" in states.columns else []
    return states.rollup("status").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("failed").alias("failed"), *more)


def retry_set(states: DataFrame, reports: DataFrame, doc: str) -> DataFrame:
    """(doc): what a second pass reads: documents partly read, and reports that are not ``complete``."""
    return states.where("status = 'partial'").select(doc).unionByName(reports.where("NOT complete").select(doc)).distinct()


def progress(states: DataFrame) -> str:
    """A snapshot of the counters as JSON (a handful of rows)."""
    rows = processing_counters(states).collect()
    return json.dumps({r["status"] or "all": {k: v for k, v in r.asDict().items() if k != "status"} for r in rows}, sort_keys=True)
