"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are numbered and summed by prefix sums (inside blocks of turn numbers first, so a very long conversation is no single
task). The token place at which a turn begins says which window it is new in, so windows are cut at turns. A window repeats the
system turn and the last turns before it, as many as the history budget holds; repeated turns are outside the loss mask.

`<|turn|>role` or `<|repeat|>role`, a line feed, the text, `<|end|>` and a line feed make a turn. Inside roles and texts `&`,
`<` and `[` are written as `&amp;`, `&lt;` and `&#91;`, so no control string of this or another template can occur in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, REPEAT, END = "<|turn|>", "<|repeat|>", "<|end|>\n"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"  # a word, or one other mark
TURN_TOKENS = 4  # that the template itself takes for a turn
BLOCK = 64  # turn numbers of one conversation summed together
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))  # the last in roles only


def escape(c: Column, role: bool = False) -> Column:
    for plain, written in ESCAPES if role else ESCAPES[:3]:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for plain, written in reversed(ESCAPES if role else ESCAPES[:3]):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """`conv_id, window, formatted, loss, tokens, over_budget` from `conv_id, turn, role, text`, one row per window.

    Turns are ordered by number (null first), then role, then text; null roles and texts are empty; repeated rows are turns of
    their own; a null conv_id is a conversation; other columns are ignored. The first turn is the system turn if that is its
    role. loss lists (start, length) in code points of every assistant text that is new in the window, empty ones too. A window
    holds `budget` tokens at most unless the system turn or one turn is too long for that: then it is kept whole and marked.
    """
    spoken = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block"),
    )
    spoken = spoken.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS)
    inside = Window.partitionBy("key", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    spoken = spoken.withColumns({"idx": F.count("tokens").over(inside), "begin": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    blocks = spoken.groupBy("key", "block").agg(F.count("*").alias("rows"), F.sum("tokens").alias("sum"), F.min(F.struct("turn", "role", "text", "tokens")).alias("first"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.first("first").over(Window.partitionBy("key").orderBy("block"))
    blocks = blocks.select(
        "key", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_before"),
        F.when(opening["role"] == "system", opening["tokens"]).otherwise(0).alias("system_tokens"),
    )
    step = F.greatest(F.lit(history), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2))
    placed = spoken.join(blocks, ["key", "block"]).select(
        "conv_id", "key", "role", "text", "tokens", (F.col("idx") + F.col("rows_before")).alias("idx"), (F.col("begin") + F.col("sum_before")).alias("begin"), step.alias("step")
    )
    placed = placed.withColumn("window", F.floor(F.col("begin") / F.col("step")))
    system = (F.col("idx") == 0) & (F.col("role") == "system")
    windows = placed.groupBy("key", "window").agg(F.min("begin").alias("opens"))
    following = Window.partitionBy("key").orderBy("window")
    windows = windows.withColumns({"next": F.lead("window").over(following), "next_opens": F.lead("opens").over(following)})
    # history <= step, so a turn is in reach of no window after the next one.
    both = placed.join(windows.drop("opens"), ["key", "window"])
    again = F.col("next").isNotNull() & ~system & (F.col("next_opens") - F.col("begin") <= history)
    new = F.struct("window", F.lit(False).alias("repeated"))
    copies = both.select("conv_id", "key", "role", "text", "tokens", "idx", F.explode(F.when(again, F.array(new, F.struct(F.col("next").alias("window"), F.lit(True).alias("repeated")))).otherwise(F.array(new))).alias("at"))
    copies = copies.select("conv_id", "key", "role", "text", "tokens", "idx", "at.window", "at.repeated")
    kept = placed.where(system).withColumnRenamed("window", "own").join(windows.select("key", "window"), "key").where("window <> own")
    copies = copies.unionByName(kept.select("conv_id", "key", "role", "text", "tokens", "idx", "window", F.lit(True).alias("repeated")))

    head = F.concat(F.when(F.col("repeated"), REPEAT).otherwise(TURN), escape(F.col("role"), True), F.lit("\n"))
    pieces = copies.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("key", "window").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    target = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct("start", F.length("body").cast("long").alias("length")))
    grouped = pieces.groupBy("key", "window").agg(
        F.any_value("conv_id").alias("conv_id"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("idx", F.concat("head", "body", F.lit(END)).alias("piece")))).alias("pieces"), F.array_sort(F.collect_list(target)).alias("loss"),
    )
    return grouped.select("conv_id", "window", F.array_join("pieces.piece", "").alias("formatted"), "loss", "tokens", (F.col("tokens") > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """`conv_id, window, turns, loss_text` of formatted windows: new turns as (role, text) in order, and all text under the mask."""
    parts = F.slice(F.split("formatted", r"<\|end\|>\n"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("formatted", r"<\|end\|>\n")) - 1))
    new = F.transform(F.filter(parts, lambda p: p.startswith(TURN)), lambda p: F.substring(p, len(TURN) + 1, 2_147_483_647))
    turn = F.transform(new, _turn)
    masked = F.transform("loss", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return windows.select("conv_id", "window", turn.alias("turns"), unescape(F.array_join(masked, "")).alias("loss_text"), F.length("formatted").alias("chars"))


def _turn(p: Column) -> Column:
    role = F.substring_index(p, "\n", 1)
    return F.struct(unescape(role, True).alias("role"), unescape(F.substr(p, F.length(role) + 2)).alias("text"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what is read back from its windows; only here is a conversation put together again, for its hash."""
    back = read_back(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), "loss_text", "chars")
    whole = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "said", "loss_text"))).alias("w"))
    said, loss = F.array_join("w.said", ""), F.array_join("w.loss_text", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
