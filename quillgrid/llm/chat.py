"""Chat formatting in budgeted windows, by DataFrame functions alone.

Template: a turn is ``<|role|>`` newline, text, ``</s>`` newline. In roles and texts the characters the
template's control strings begin with are escaped reversibly: backslash as ``\\s``, ``<`` as ``\\l`` and
``[`` as ``\\b`` (and ``|`` as ``\\p`` in roles), so no text can open, close or forge a turn.

A turn's tokens are its words and single punctuation marks and four for the template. Running
sums of these place each turn in its conversation, which is cut into stretches of ``room`` tokens: the
budget less the system turn and the history. The turns inside a stretch are a span; a turn across two
stretches joins the span before it where both fit into the room, else the span after it where they fit
(and that one does not take the next such turn), else it is a span of its own. So a window keeps to the
budget unless a single turn with the system turn exceeds it (nothing is cut), one long turn does not
change the others' windows, and no conversation is gathered in one row for it. Every window begins with the
conversation's first system turn; later windows repeat up to ``history_turns`` earlier turns of up to
``history_tokens`` in all, as far as the budget allows. What is repeated is masked: each assistant text
bears loss once, in the window that its span belongs to.

Turns are ordered by turn number (nulls first), then role and text; repeated rows are turns of their
own. Null texts and roles are empty; a null conversation id is one conversation; an empty table gives
no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 192
TURN_TOKENS = 4
LOSS_ROLE = "assistant"
SYSTEM_ROLE = "system"


def escape(text: Column) -> Column:
    for plain, mark in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for mark, plain in (("\\b", "["), ("\\l", "<"), ("\\s", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def token_count(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]"))


def chat_windows(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """One row per window: conv, window, formatted, n_tokens and segments.

    ``segments`` has a struct for each turn of the window, in order: pos (the turn's place in the
    conversation), start and length (code points of the turn in ``formatted``), text_start and
    text_length (of its escaped text), repeated and loss.
    """
    turns = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", token_count(F.col("text")) + TURN_TOKENS)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    everything = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        turns.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .withColumn("system", F.min(F.when(F.col("role") == SYSTEM_ROLE, F.struct("pos", "text", "tokens"))).over(everything))
    )
    free = F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0))
    placed = placed.withColumn("room", F.greatest(free - history_tokens, F.floor(free / 2), F.lit(1)).cast("bigint"))
    placed = placed.withColumn("stretch", F.floor(F.col("before") / F.col("room"))).withColumn(
        "across", F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room")) > F.col("stretch")
    )
    # Spans: runs of turns inside one stretch, and single turns across two.
    same = ~F.col("across") & ~F.lag("across").over(order) & (F.lag("stretch").over(order) == F.col("stretch"))
    placed = placed.withColumn("fresh", ~F.coalesce(same, F.lit(False)))
    placed = placed.withColumn("span", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "next", F.when(F.lead("across").over(order), F.lead("tokens").over(order))
    )
    spans = Window.partitionBy("conv", "span")
    placed = placed.withColumn("size", F.sum("tokens").over(spans)).withColumn("after", F.max(F.when(~F.col("across"), F.col("next"))).over(spans))
    # A turn across joins the span before it, or the one after it if that does not take the next turn across.
    taken = F.coalesce(F.col("size") + F.col("after") <= F.col("room"), F.lit(False))
    back = F.col("across") & ~F.lag("across").over(order) & (F.lag("size").over(order) + F.col("tokens") <= F.col("room"))
    placed = placed.withColumn("taken", taken).withColumn("back", F.coalesce(back, F.lit(False)))
    ahead = F.col("across") & ~F.col("back") & ~F.lead("across").over(order) & ~F.lead("taken").over(order) & (F.col("tokens") + F.lead("size").over(order) <= F.col("room"))
    placed = placed.withColumn("ahead", F.coalesce(ahead, F.lit(False)))
    placed = placed.withColumn("fresh", F.col("fresh") & ~F.col("back") & ~F.coalesce(F.lag("ahead").over(order), F.lit(False)))
    placed = placed.withColumn("window", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    shown_system = F.when(F.col("system.pos") < F.col("pos"), F.col("system.tokens"))
    placed = placed.withColumn("own", F.sum("tokens").over(Window.partitionBy("conv", "window"))).withColumn(
        "left", F.least(F.lit(history_tokens), F.lit(budget) - F.coalesce(shown_system, F.lit(0)) - F.col("own"))
    )
    # History: the turns just before a span, as long as their number and tokens allow.
    own = F.struct(F.col("pos"), F.col("role"), F.col("text"), F.lit(False).alias("repeated"))
    past = placed
    for k in range(1, history_turns + 1):
        past = past.withColumn(f"h{k}", F.lag(F.struct("pos", "role", "text", "tokens"), k).over(order))
    items, sums = [], F.lit(0)
    for k in range(1, history_turns + 1):
        h = F.col(f"h{k}")
        sums = sums + h["tokens"]
        fits = h.isNotNull() & (sums <= F.col("left")) & ~h["pos"].eqNullSafe(F.col("system.pos"))
        items.append(F.when(F.col("fresh") & fits, F.struct(h["pos"].alias("pos"), h["role"].alias("role"), h["text"].alias("text"), F.lit(True).alias("repeated"))))
    system = F.when(
        F.col("fresh") & F.col("system").isNotNull() & (F.col("system.pos") < F.col("pos")),
        F.struct(F.col("system.pos").alias("pos"), F.lit(SYSTEM_ROLE).alias("role"), F.col("system.text").alias("text"), F.lit(True).alias("repeated")),
    )
    shown = past.select("conv", "window", F.explode(F.filter(F.array(system, *items, own), lambda x: x.isNotNull())).alias("item"))
    rendered = shown.select(
        "conv",
        "window",
        F.col("item.pos").alias("pos"),
        F.col("item.repeated").alias("repeated"),
        (~F.col("item.repeated") & (F.col("item.role") == LOSS_ROLE)).alias("loss"),
        F.concat(F.lit("<|"), escape_role(F.col("item.role")), F.lit("|>\n")).alias("head"),
        escape(F.col("item.text")).alias("body"),
    )
    gathered = rendered.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "repeated", "loss", "head", "body"))).alias("parts"))
    tail = "</s>\n"
    lengths = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail))
    segments = F.transform(
        F.arrays_zip("parts", "ends"),
        lambda x: F.struct(
            x["parts"]["pos"].alias("pos"),
            (x["ends"] - F.length(x["parts"]["head"]) - F.length(x["parts"]["body"]) - len(tail)).alias("start"),
            (F.length(x["parts"]["head"]) + F.length(x["parts"]["body"]) + len(tail)).alias("length"),
            (x["ends"] - F.length(x["parts"]["body"]) - len(tail)).alias("text_start"),
            F.length(x["parts"]["body"]).alias("text_length"),
            x["parts"]["repeated"].alias("repeated"),
            x["parts"]["loss"].alias("loss"),
        ),
    )
    start = F.array().cast("array<int>")
    ends = F.aggregate("lengths", start, lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    return (
        gathered.withColumn("lengths", lengths)
        .withColumn("ends", ends)
        .select(
            F.col("conv").alias(conv_col),
            "window",
            F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
            segments.alias("segments"),
        )
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns as the formatted text has them: conv, window, pos, role, text, loss, of the turns that a window does not repeat.

    Roles and texts are read by the control strings alone; ``segments`` only says which turns are repeated or bear loss.
    """
    parts = F.split("formatted", "</s>\n", -1)
    turns = windows.select(conv_col, "window", F.explode(F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("turn"), F.col("segments").alias("s"))).alias("x"))
    head = F.substring_index("x.turn", "|>\n", 1)
    return turns.where(~F.col("x.s.repeated") & F.startswith("x.turn", F.lit("<|"))).select(
        conv_col,
        "window",
        F.col("x.s.pos").alias("pos"),
        unescape_role(F.substr(head, F.lit(3))).alias("role"),
        unescape(F.substr("x.turn", F.length(head) + 4)).alias("text"),
        F.col("x.s.loss").alias("loss"),
    )


def digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: what its formatted windows hold, read back."""
    turns = read_back(windows, conv_col).groupBy(F.col(conv_col).alias("c")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text", "loss"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    sizes = windows.groupBy(conv_col).agg(F.sum(F.length("formatted")).alias("formatted_chars"))
    return turns.join(sizes, F.col("c").eqNullSafe(F.col(conv_col))).select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(whole, "utf-8"), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(learnt, "utf-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
