"""Chat formatting in budgeted windows: DataFrame functions only.

A turn is written as `### role ###`, a new line, its text, `</turn>` and a new line. Inside roles and texts a backslash goes before every
backslash, every # that follows another and the / of every `</turn>`, so that neither control string can occur there; taking
one backslash away before each character gives the text back.

Prefix sums of the turns' tokens choose the windows: a window takes whole turns in order as long as they fit the budget beside what it repeats, which is the
conversation's opening system turn and the last turns before the window, up to `history` tokens. A turn that is larger than the budget by itself still
goes in whole, in a window marked `over`. The loss mask covers each target text once: repeated turns are masked out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialize, small

OPEN, SHUT, END = "### ", " ###\n", "</turn>\n"
# What counts as a token where no column of counts is given: runs of letters, digits or signs of limited length, with the space before them.
PIECE = r" ?\p{L}{1,6}| ?\p{N}{1,3}| ?[^\x09-\x0D \p{L}\p{N}]{1,3}|[\x09-\x0D ]+"
# Conversations of more bytes (ROW_BYTES a row besides the texts) are cut into blocks of BLOCK budgets.
HOT_BYTES, ROW_BYTES, BLOCK, CHUNK = 1 << 20, 32, 16, 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|(?<=<)/(?=turn>)|(?<=#)#", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def pieces(body: Column) -> Column:
    """How many pieces a text has: each becomes one letter."""
    return F.char_length(F.regexp_replace(body, PIECE, "x"))


def rendered(turns: DataFrame, tokens: str | None, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id and t: a turn's place in order (turn, role, body), tokens n, and the characters before, of and in its text."""
    who, said = escaped(F.coalesce(F.col(role).cast("string"), F.lit(""))), escaped(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit(OPEN), who, F.lit(SHUT))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.concat(head, said, F.lit(END)).alias("body"), F.char_length(head).alias("head"), F.char_length(said).alias("chars"), *([F.col(tokens).cast("long").alias("given")] if tokens else []))
    counted = F.greatest(F.coalesce(F.col("given"), F.lit(1)), F.lit(1)) if tokens else pieces(F.col("body"))
    return rows.withColumn("n", counted.cast("long")).drop("given")


_ORDER = ("turn", "role", "body")
_TURN = ("pos", "p", "n", "role", "body", "head", "chars")


def _system(first: Column, system: str) -> Column:
    """The turn that all windows repeat: a conversation's first, if it is the system's."""
    return F.when(first["role"] == system, first)


def _whole(rows: DataFrame, system: str) -> DataFrame:
    """One block a conversation."""
    w = Window.partitionBy("conv_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("pos", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("p", F.sum("n").over(w) - F.col("n"))
    got = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_TURN, F.lit(True).alias("own")))).alias("turns"))
    return got.select("conv_id", F.lit(0).cast("long").alias("block"), "turns", _system(F.element_at("turns", 1), system).alias("sys"))


def _cut(rows: DataFrame, system: str, budget: int, history: int, max_broadcast_rows: int) -> DataFrame:
    """Blocks of BLOCK budgets. Prefix sums come in two steps, over chunks of CHUNK turn numbers and within them, so that no task has a whole conversation;
    turns that the next block may repeat go to it too."""
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    sums = rows.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n_sum"), F.count("*").alias("n_rows"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("n_sum").over(before), F.lit(0)).alias("base_p"), F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base_pos"))
    w = Window.partitionBy("conv_id", "chunk").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k")))
    placed = placed.withColumn("pos", F.col("base_pos") + F.row_number().over(w)).withColumn("p", F.col("base_p") + F.sum("n").over(w) - F.col("n"))
    size = budget * BLOCK
    own = F.floor(F.col("p") / size)
    copies = F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.when(F.col("p") >= (own + 1) * size - history, F.struct((own + 1).alias("block"), F.lit(False).alias("own"))))
    dealt = placed.withColumn("b", F.explode(F.array_compact(copies))).groupBy("conv_id", F.col("b.block").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*_TURN, F.col("b.own").alias("own")))).alias("turns"))
    first = rows.groupBy("conv_id").agg(F.min(F.struct(*_ORDER, "head", "chars", "n")).alias("f"))
    heads = first.select(F.col("conv_id").alias("h"), F.struct(F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("p"), "f.n", "f.role", "f.body", "f.head", "f.chars", F.lit(True).alias("own")).alias("one"))
    got = dealt.join(small(heads, max_broadcast_rows), F.col("conv_id").eqNullSafe(F.col("h")), "left")
    # What was copied for a block that has no turn of its own isn't needed.
    return got.select("conv_id", "block", "turns", _system(F.col("one"), system).alias("sys")).where(F.exists("turns", lambda t: t["own"]))


def _windows(blocks: DataFrame, budget: int, history: int, target: str) -> DataFrame:
    turns, sys, end = F.col("turns"), F.col("sys"), len(END)
    zero = F.lit(0).cast("long")
    repeats = lambda t: sys.isNotNull() & (t["pos"] > 1)
    whole = lambda t: t["head"] + t["chars"] + end

    def step(acc: Column, i: Column) -> Column:
        t = F.element_at(turns, i)
        kept = F.when(repeats(t), sys["n"]).otherwise(zero)
        limit = F.least(F.lit(history), F.greatest(zero, budget - kept - t["n"]))
        back = F.size(F.filter(turns, lambda x: (x["pos"] < t["pos"]) & (x["p"] >= t["p"] - limit) & (sys.isNull() | (x["pos"] > 1))))
        history_n = t["p"] - F.element_at(turns, i - back)["p"]
        more = (F.size(acc["w"]) > 0) & (acc["used"] + t["n"] <= budget)
        begun = F.struct(F.concat(acc["w"], F.array(F.struct(i.alias("at"), back.alias("back")))).alias("w"), (kept + history_n + t["n"]).alias("used"))
        return F.when(more, F.struct(acc["w"].alias("w"), (acc["used"] + t["n"]).alias("used"))).otherwise(begun)

    own_from = F.size(F.filter(turns, lambda t: ~t["own"])) + 1
    none = F.struct(F.array().cast("array<struct<at:int,back:int>>").alias("w"), zero.alias("used"))
    chosen = blocks.withColumn("w", F.aggregate(F.sequence(own_from, F.size(turns)), none, step)["w"])

    def window(k: Column) -> Column:
        one = F.element_at("w", k)
        last = F.when(k < F.size("w"), F.element_at("w", F.least(k + 1, F.size("w")))["at"] - 1).otherwise(F.size(turns))
        at, back = one["at"], one["back"]
        first, until = F.element_at(turns, at), F.element_at(turns, last)
        inside = F.slice(turns, at - back, last - at + back + 1)
        again = repeats(first)
        start = F.struct(F.when(again, whole(sys)).otherwise(F.lit(0)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
        span = lambda acc, t: F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["chars"]).alias("end")))
        counted = lambda acc, t: (t["role"] == target) & (t["pos"] >= first["pos"])
        mask = F.aggregate(inside, start, lambda acc, t: F.struct((acc["at"] + whole(t)).alias("at"), F.when(counted(acc, t), F.concat(acc["mask"], span(acc, t))).otherwise(acc["mask"]).alias("mask")))["mask"]
        n = until["p"] + until["n"] - F.element_at(turns, at - back)["p"] + F.when(again, sys["n"]).otherwise(zero)
        return F.struct(
            (k - 1).alias("window"), first["pos"].alias("first_turn"), until["pos"].alias("last_turn"), (back + again.cast("int")).alias("repeated"), n.alias("n_tokens"), (n > budget).alias("over"),
            F.concat(F.when(again, sys["body"]).otherwise(F.lit("")), F.array_join(F.transform(inside, lambda t: t["body"]), "")).alias("text"), mask.alias("mask"),
        )

    return chosen.select("conv_id", "block", F.inline(F.transform(F.sequence(F.lit(1), F.size("w")), window)))


def format_windows(
    turns: DataFrame, budget: int = 1024, history: int = 256, target: str = "assistant", system: str = "system", tokens: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hot_bytes: int = HOT_BYTES, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """One row a window: conv_id, block, window (its order within), first_turn, last_turn (from 1; new turns, not repeated ones), repeated (turns at its
    beginning that an earlier window has), n_tokens, over, text, mask (spans of code points in text that count for the loss).

    `tokens` names a column of token counts for each turn; without it the pieces of the written turn are counted. Turns of a conversation go
    by turn number, null first, ties by role and then text; repeated rows are turns of their own. Null roles and texts count as empty. Rows without conv_id are one
    conversation. Only a system turn that comes first is repeated; later ones are turns like others. A conversation of more than `hot_bytes` is cut into blocks of 16 budgets
    where windows begin anew; rows of one turn number (in 256) of such a conversation are sorted in one task. Texts of any length are
    taken whole. An empty table gives no rows; other columns aren't read.
    """
    size = F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + ROW_BYTES)
    hot = materialize(turns.groupBy(F.col(conv_id).alias("h")).agg(size.alias("size")).where(F.col("size") > hot_bytes).select("h"), "hot-conversations")
    on, known = F.col(conv_id).eqNullSafe(F.col("h")), small(hot, max_broadcast_rows)
    cold = _whole(rendered(turns.join(known, on, "left_anti"), tokens, conv_id, turn, role, text), system)
    blocks = [cold]
    if hot.limit(1).count():
        blocks.append(_cut(rendered(turns.join(known, on, "left_semi"), tokens, conv_id, turn, role, text), system, budget, history, max_broadcast_rows))
    return reduce(DataFrame.unionByName, [_windows(b, budget, history, target) for b in blocks])


def read_turns(windows: DataFrame) -> DataFrame:
    """windows with turns (array of role and text, without repeated ones) and loss (the unescaped text under the mask), both from the text alone."""
    parts = F.split("text", END)
    own = F.slice(parts, F.col("repeated") + 1, F.size(parts) - 1 - F.col("repeated"))

    def turn(part: Column) -> Column:
        shut, begin = F.locate(SHUT, part, len(OPEN) + 1), len(OPEN) + 1
        return F.struct(unescaped(F.substring(part, F.lit(begin), shut - begin)).alias("role"), unescaped(F.substring(part, shut + len(SHUT), F.char_length(part))).alias("text"))

    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"])))
    return windows.withColumn("turns", F.transform(own, turn)).withColumn("loss", F.array_join(loss, ""))


def digest(windows: DataFrame) -> DataFrame:
    """One row a conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest needs its conversation's text as one string."""
    read = read_turns(windows).select("conv_id", "block", "window", F.size("turns").alias("n"), F.char_length("text").alias("formatted"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "loss")
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("formatted").alias("formatted_chars"), F.sum(F.char_length("loss")).alias("loss_chars"), F.sort_array(F.collect_list(F.struct("block", "window", "said", "loss"))).alias("all"))
    text = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long"), F.sha2(text("said"), 256).alias("turns_sha256"), F.col("loss_chars").cast("long"), F.sha2(text("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


def with_odd_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts are control strings."""
    said = F.lit("\\### Assistant: </turn> ok")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(odd)
