"""Chat formatting in budgeted windows with a loss mask, in DataFrame functions only.

Each turn becomes `<|role|>`, newline, text, `<|end|>`, newline; inside roles and texts `\\`, `<` and `[`, and in roles `|`
too, are escaped as `\\\\`, `\\l`, `\\b` and `\\p`, so no control string of any usual template can occur there, and the escape
is reversible. A window has a budget of tokens. The conversation's first system turn is kept in every window after it; the
rest of the budget is the stride in which prefix sums of turn tokens choose turn-aligned spans: the turns that lie whole in
one stride are a span, and one that crosses into the next is a span by itself. Earlier turns are repeated before a span as
room remains, the nearest first, `history` at most. Only assistant texts of the span itself are targets, so that each is
one exactly once and repeated ones are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.llm.scratch import materialize

#: Tokens that a turn's marks count as.
TURN_COST = 4
#: Tokens of a window.
BUDGET = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Inverse of escape: cut at escaped backslashes from the left, then undo the others in each piece."""
    pieces = F.split(text, r"\\\\")
    undo = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(pieces, undo), "\\")


def head(role: Column) -> Column:
    """Mark of a turn; role as it is."""
    return F.concat(F.lit("<|"), F.replace(escape(role), F.lit("|"), F.lit("\\p")), F.lit("|>\n"))


TAIL = "<|end|>\n"
TURN = "struct<i:int,role:string,text:string,tokens:int>"


def format_windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = 2) -> DataFrame:
    """One row per window: conv_id, win, n_context (turns repeated in front), tokens (of all its turns), text, loss_spans
    array<struct<start, length>> (code points of text from 0).

    Tokens are words and TURN_COST a turn. No window is over the budget, but those in which one turn with the system turn
    is: such a turn stands alone with it, as turns are never cut. Rows are turns (conv_id, turn, role, text) in the order of
    turn, role, text, nulls first; null role or text counts as empty. A repeated row is a turn of its own; a null conv_id is
    a conversation. Only assistant texts are targets. Of several system turns the first is kept, wherever it stands. Other
    columns are ignored; an empty table gives an empty one.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    none = F.array().cast(f"array<{TURN}>")
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + TURN_COST).withColumn("i", F.row_number().over(order) - 1)
    rows = rows.withColumn("end", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("turn_", F.struct("i", "role", "text", "tokens"))
    of_system = F.when(F.col("role") == "system", F.struct("i", "tokens"))
    rows = rows.withColumn("system_tokens", F.coalesce(F.min(of_system).over(W.partitionBy("conv_id"))["tokens"], F.lit(0)))
    stride = F.greatest(F.lit(budget) - F.col("system_tokens"), F.lit(1))
    first_in, last_in = F.floor((F.col("end") - F.col("tokens")) / stride), F.floor((F.col("end") - 1) / stride)
    # Spans in order: twice the stride that a span lies in, plus one if it is a turn that crosses into a later one.
    rows = rows.withColumn("win", 2 * first_in + F.when(first_in != last_in, 1).otherwise(0))
    before = order.rowsBetween(-history, -1) if history else None
    rows = rows.withColumn("before", F.collect_list("turn_").over(before) if history else none)
    rows = rows.withColumn("opening", F.first(F.when(F.col("role") == "system", F.col("turn_")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    starts = F.lag("win").over(order)
    lead = F.when(starts.isNull() | (starts != F.col("win")), F.struct(F.col("before"), F.col("opening")))
    rows = rows.withColumn("lead", lead)
    by = rows.groupBy("conv_id", "win").agg(F.array_sort(F.collect_list("turn_")).alias("span"), F.first("lead", ignorenulls=True).alias("lead"), F.sum("tokens").alias("own"))
    system = F.when(F.col("lead.opening").isNotNull(), F.array("lead.opening")).otherwise(none)
    room = budget - F.col("own") - F.coalesce(F.col("lead.opening.tokens"), F.lit(0))
    # Of the turns before, but the system turn: those from which on all fit in the room.
    others = F.filter("lead.before", lambda t: F.col("lead.opening").isNull() | (t["i"] != F.col("lead.opening.i")))
    by = by.withColumn("others", others).withColumn("system", system).withColumn("room", room)
    size = lambda a: F.aggregate(a, F.lit(0), lambda x, t: x + t["tokens"])
    fits = F.filter("others", lambda t, k: size(F.slice(F.col("others"), k + 1, F.size("others"))) <= F.col("room"))
    by = by.withColumn("context", F.concat("system", fits)).withColumn("n_context", F.size("context").cast("long"))
    by = by.withColumn("context", F.array_sort("context")).withColumn("all_tokens", (F.col("own") + size(F.col("context"))).cast("long"))
    marked = F.concat(
        F.transform("context", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(False).alias("target"))),
        F.transform("span", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == "assistant").alias("target"))),
    )
    parts = F.transform(marked, lambda t: F.struct(head(t["role"]).alias("head"), escape(t["text"]).alias("body"), t["target"].alias("target")))
    by = by.select("conv_id", F.col("win").cast("long").alias("win"), "n_context", F.col("all_tokens").alias("tokens"), parts.alias("parts"))
    by = by.withColumn("sizes", F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(TAIL)))
    at = F.transform("parts", lambda p, k: F.struct(
        (F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, x: a + x) + F.length(p["head"])).cast("long").alias("start"),
        F.length(p["body"]).cast("long").alias("length"), p["target"].alias("target"),
    ))
    spans = F.transform(F.filter(at, lambda x: x["target"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    return by.select("conv_id", "win", "n_context", "tokens", whole.alias("text"), spans.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    mark = r"<\|([^<\[|]*)\|>\n([^<\[]*)<\|end\|>\n"
    role, body = F.regexp_extract_all("text", F.lit(mark), F.lit(1)), F.regexp_extract_all("text", F.lit(mark), F.lit(2))
    df = windows.withColumn("turns", F.arrays_zip(role.alias("role"), body.alias("body")))
    new = F.slice("turns", (F.col("n_context") + 1).cast("int"), F.greatest(F.size("turns") - F.col("n_context").cast("int"), F.lit(0)))
    said = F.array_join(F.transform(new, lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("text", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    df = df.select("conv_id", "win", F.size(new).cast("long").alias("n"), said.alias("said"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    by = df.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("win", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    said, loss = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.loss"), "")
    return by.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def format_and_read(conversations: DataFrame, **options) -> DataFrame:
    return read_back(materialize(format_windows(conversations, **options), "chat_windows"))
