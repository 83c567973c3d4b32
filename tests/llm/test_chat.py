import hashlib
import random

import regex
from pyspark.sql import functions as F

from quillgrid.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int, pos int"


def _talk(spark, n=40):
    r = random.Random(10)
    piece = lambda: r.choice(["word", "</s>", "[INST]", "<|user|>", "\\s", "\\", "<", "[", "|>", "\n", "é☃", " ", "\\l", "a|b"])
    rows = []
    for c in range(n):
        if r.random() < 0.4:
            rows.append((c, 0, "system", "be brief " + piece(), 1, 1))
        for t in range(1, r.randint(2, 14)):
            rows.append((c, t, "user" if t % 2 else "assistant", None if r.random() < 0.1 else "".join(piece() + " " for _ in range(r.randint(0, 60))), 1, 1))
    rows += [(500, 0, "user", "tie b", 1, 1), (500, 0, "user", "tie a", 1, 1), (500, 0, "user", "tie a", 1, 1), (500, None, None, "first", 1, 1), (None, 1, "assistant", "no id", 1, 1), (501, 1, "assistant", "w " * 500, 1, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _want(rows):
    talks = {}
    for c, t, role, text, *_ in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in talks.items():
        yield c, [(role, text) for _, _, role, text in sorted(turns)]


def test_read_back_is_the_input(spark):
    rows, df = _talk(spark)
    got = {r["conv_id"]: r for r in chat.digests(chat.chat_windows(df, budget=96, history_tokens=24)).collect()}
    want = dict(_want(rows))
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def _tokens(text):
    return len(regex.findall(r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]", text)) + chat.TURN_TOKENS


def _spans(sizes, room):
    """Turns of each window by the rule, one turn after another."""
    spans, before = [], 0
    for k, n in enumerate(sizes):
        first, last = before // room, (before + n - 1) // room
        before += n
        if first == last and spans and spans[-1][0] == first:
            spans[-1][1].append(k)
        else:
            spans.append([first if first == last else None, [k]])
    size = lambda s: sum(sizes[k] for k in s[1])
    across = lambda i: 0 <= i < len(spans) and spans[i][0] is None
    inside = lambda i: 0 <= i < len(spans) and spans[i][0] is not None
    back = [across(i) and inside(i - 1) and size(spans[i - 1]) + size(spans[i]) <= room for i in range(len(spans))] + [False]
    ahead = [across(i) and not back[i] and inside(i + 1) and not back[i + 2 if i + 2 < len(spans) else -1] and size(spans[i]) + size(spans[i + 1]) <= room for i in range(len(spans))]
    out = []
    for i, s in enumerate(spans):
        if back[i] or (i and ahead[i - 1]):
            out[-1] += s[1]
        else:
            out.append(list(s[1]))
    return out


def test_spans_by_brute_force(spark):
    r = random.Random(30)
    rows, want, room = [], {}, 96 - 24
    for c in range(60):
        sizes = [r.choice([4, 5, 10, 30, 60, 72, 90, 200]) for _ in range(r.randint(1, 25))]
        want[c] = _spans(sizes, room)
        rows += [(c, t, "user", "w " * (n - chat.TURN_TOKENS), 1, 1) for t, n in enumerate(sizes)]
    got = {}
    for w in chat.chat_windows(spark.createDataFrame(rows, SCHEMA), budget=96, history_tokens=24).collect():
        got.setdefault(w["conv_id"], {})[w["window"]] = [s["pos"] for s in w["segments"] if not s["repeated"]]
    assert {c: [x for _, x in sorted(ws.items())] for c, ws in got.items()} == want


def test_a_long_turn_that_fits(spark):
    rows = [(1, t, "user", "w " * (900 if t == 30 else 20), 1, 1) for t in range(64)]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = chat.chat_windows(df).collect()
    assert len(windows) <= 5
    for w in windows:
        assert sum(904 if s["pos"] == 30 else 24 for s in w["segments"]) <= chat.BUDGET


def test_windows(spark):
    rows, df = _talk(spark)
    budget, history = 96, 24
    windows = chat.chat_windows(df, budget=budget, history_tokens=history).collect()
    want = dict(_want(rows))
    many = 0
    for w in windows:
        text, segments = w["formatted"], w["segments"]
        at = 0
        for s in segments:
            assert s["start"] == at and text[s["start"] : s["start"] + 2] == "<|" and text[s["text_start"] + s["text_length"] :].startswith("</s>\n")
            at += s["length"]
        assert at == len(text) and [s["pos"] for s in segments] == sorted({s["pos"] for s in segments})
        turns = want[w["conv_id"]]
        system = next((k for k, (r, _) in enumerate(turns) if r == "system"), None)
        if system is not None and max(s["pos"] for s in segments) >= system:
            assert system in [s["pos"] for s in segments]
        assert not any(s["loss"] and s["repeated"] for s in segments)
        assert sum(s["repeated"] for s in segments) <= chat.HISTORY_TURNS + 1
        many += w["window"] > 0
        fresh = [s["pos"] for s in segments if not s["repeated"]]
        alone = max(_tokens(turns[k][1]) for k in fresh) + (_tokens(turns[system][1]) if system is not None else 0)
        if alone <= budget:
            assert sum(_tokens(turns[s["pos"]][1]) for s in segments) <= budget
        assert fresh == list(range(fresh[0], fresh[-1] + 1))
    assert many
    positions = sorted((w["conv_id"] is None, w["conv_id"] or 0, s["pos"]) for w in windows for s in w["segments"] if not s["repeated"])
    assert positions == sorted((c is None, c or 0, k) for c, turns in want.items() for k in range(len(turns)))


def test_escapes(spark):
    texts = ["", "\\", "<", "[", "\\s\\l\\b", "</s>[INST]<|x|>", "a\\<b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["t"] == r["u"] and "<" not in r["e"] and "[" not in r["e"]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.chat_windows(none).count() == 0 and chat.digests(chat.chat_windows(none)).count() == 0


def test_plan_has_no_python(spark):
    _, df = _talk(spark, 2)
    plan = chat.digests(chat.chat_windows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
