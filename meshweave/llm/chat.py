"""Chat formatting with budgeted, turn-aligned windows, in DataFrame functions only.

A running sum of turn tokens cuts a conversation into spans of whole turns. Each span becomes one
formatted window: the latest system turn before it again and whole, a bounded suffix of the turns before
it as history, then the span. Span and history have budgets, so a window is bounded unless a single turn,
of the span or the system's, is longer than that. The loss mask covers the assistant texts of the span only, so a turn
repeated as history is never a target twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SPAN_TOKENS = 1024
HISTORY_TOKENS = 256
TURN_OVERHEAD = 4
TURN = "struct<idx:int,role:string,text:string>"


def escape(text: Column) -> Column:
    """No control string survives in the result; unescape() gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def turn_tokens(role: Column, text: Column) -> Column:
    """What a token is here: each four bytes of a formatted turn, rounded up, and TURN_OVERHEAD for the template's own."""
    return (F.floor((F.octet_length(escape_role(role)) + F.octet_length(escape(text)) + 3) / 4) + TURN_OVERHEAD).cast("long")


def _within(turn: Column, tokens: int) -> Column:
    """The turn, its text cut at about so many tokens if it is longer (at its own average of bytes a character)."""
    role, text = turn.getField("role"), turn.getField("text")
    chars = F.floor(F.length(text) * (4.0 * tokens) / F.greatest(F.octet_length(escape(text)), F.lit(1))).cast("int")
    cut = F.when(turn_tokens(role, text) > tokens, F.substring(text, F.lit(1), chars)).otherwise(text)
    return F.struct(turn.getField("idx").alias("idx"), role.alias("role"), cut.alias("text"))


def windows(turns: DataFrame, span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS, system_tokens: int | None = None) -> DataFrame:
    """(conv_id, window, n_turns, n_context, formatted, loss): loss is an array of (start, length) code points.

    Turns are ordered by turn (nulls first), role, text; null roles and texts count as empty;
    repeated rows stay repeated turns; rows with a null conv_id form one conversation; other
    columns are left out; an empty table gives no windows. A window's span holds at most
    span_tokens unless one turn alone is longer, its history at most history_tokens in whole turns;
    the system turn is repeated whole. system_tokens, where given, cuts what is repeated of a longer
    system turn to about so many tokens, for callers whose windows must not grow with it.
    """
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = span_tokens // 2
    long = F.col("tokens") > half
    rows = base.select("*", F.row_number().over(order).alias("idx"), F.sum("tokens").over(upto).alias("cum"))
    rows = rows.withColumn("before", F.col("cum") - F.col("tokens"))
    # a turn of more than half a span stands alone, so what shares a step of half a span fits a span
    by_place = Window.partitionBy("conv_id").orderBy("before")
    edge = long.cast("int") + F.coalesce(F.lag(long.cast("int")).over(by_place), F.lit(0))
    rows = rows.withColumn("edge", edge).withColumn("step", F.floor(F.col("before") / half))
    fresh = (F.col("edge") > 0) | F.coalesce(F.lag("step").over(by_place) < F.col("step"), F.lit(True))
    rows = rows.withColumn("first", fresh).withColumn("window", F.sum(F.col("first").cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    turn = F.struct("idx", "role", "text")
    back = by_place.rangeBetween(-history_tokens, -1)
    system = F.last(F.when(F.col("role") == "system", turn), ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("history", F.when(F.col("first"), F.collect_list(turn).over(back))).withColumn("system", system)
    made = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(turn)).alias("span"), F.max(F.when(F.col("first"), F.struct(F.col("idx"), F.col("history"), F.col("system")))).alias("lead"),
    )
    repeated = F.col("lead.system") if system_tokens is None else _within(F.col("lead.system"), system_tokens)
    opening = F.when(F.col("lead.system").isNull(), F.array().cast(f"array<{TURN}>")).otherwise(F.array(repeated))
    history = F.filter(F.coalesce("lead.history", F.array().cast(f"array<{TURN}>")), lambda t: F.col("lead.system").isNull() | (t["idx"] != F.col("lead.system.idx")))
    made = made.select("conv_id", "window", "span", F.concat(opening, history).alias("context"))

    def show(t):
        return F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))

    parts = F.transform(F.concat("context", "span"), show)
    made = made.withColumn("parts", parts).withColumn("n_context", F.size("context"))
    lead = F.aggregate(F.slice("parts", 1, F.col("n_context")), F.lit(0).cast("long"), lambda a, p: a + F.length(p))

    def mark(acc, t):
        size = F.length(show(t)).cast("long")
        body = F.length(escape(t["text"])).cast("long")
        at = acc["at"] + size - body - len(END) - 1
        hit = F.array(F.struct(at.alias("start"), body.alias("length")))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    loss = F.aggregate("span", F.struct(lead.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")), mark)["out"]
    return made.select("conv_id", F.col("window").cast("long").alias("window"), F.size("span").cast("long").alias("n_turns"), F.col("n_context").cast("long").alias("n_context"), F.array_join("parts", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the windows' own text and masks say: turns, loss text, characters."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context").cast("int") + 2, F.greatest(F.col("n_turns").cast("int"), F.lit(1)))

    def plain(s):
        role = F.substring_index(s, "\n", 1)
        body = F.substring(s, F.length(role) + 2, F.length(s) - F.length(role) - 2 - len(END))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(body), F.lit("\n"))

    turns = F.array_join(F.transform(segments, plain), "")
    masked = F.array_join(F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    rows = formatted.select("conv_id", "window", "n_turns", turns.alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("chars"))
    whole = rows.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "masked"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    text, loss = F.array_join("w.turns", ""), F.array_join("w.masked", "")
    return whole.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
