"""Chat formatting from event logs, in DataFrame functions alone.

A log has events of conversations: `message` opens a message, `delta` appends to one, `edit` replaces its text, `regenerate` empties it
and takes back the messages opened between it and the event. Folded messages are rendered with marks; strings that act as
control strings here or in common templates are escaped inside texts, and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?INST\]|/?<?/?SYS>>"


def escaped(text: Column) -> Column:
    """One more backslash behind the first sign of each control string, escaped ones included."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def escaped_role(role: Column) -> Column:
    """As escaped(), and on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescaped(F.replace(lines, F.lit("\\\\"), F.lit("\\")))


def folded(events: DataFrame) -> DataFrame:
    """events(conv_id, seq long, op, message long, role, text) -> (conv_id, message, role, text), a row for each final message.

    message is the seq of the event that opened the message; of a `message` event itself it is ignored. Events count by seq,
    those with equal seq by op and text. Several `message` events of one seq open one message, whose text is that of the
    last of them, by text. Unknown ops and events on messages never opened are ignored, a null text is
    empty, a null role stays null, a null conv_id is a conversation of its own. No events: no rows.
    """
    own = events.select(
        "conv_id", "seq", "op", F.when(F.col("op") == "message", F.col("seq")).otherwise(F.col("message")).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).where(F.col("op").isin("message", "delta", "edit", "regenerate") & F.col("message").isNotNull())
    resets = F.col("op") != "delta"
    said = F.when(F.col("op") == "regenerate", "").otherwise(F.col("text"))
    step = F.struct("seq", (~resets).alias("later"), "op", said.alias("said"))
    # First by message, so that a long conversation's stream of deltas is spread over tasks.
    by_message = own.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(step)).alias("steps"),
        F.max_by("role", F.col("op") == "message").alias("role"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("redone"),
        F.bool_or(F.col("op") == "message").alias("opened"),
    ).where("opened")
    last = F.size("steps") - F.expr("array_position(reverse(transform(steps, x -> NOT x.later)), true)").cast("int")
    text = F.array_join(F.transform(F.slice("steps", last + 1, F.size("steps")), lambda x: x["said"]), "")
    texts = by_message.select("conv_id", "message", "role", "redone", text.alias("text"))
    # A message is taken back if one before it was regenerated after it: by the latest regeneration among all earlier messages.
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    alive = texts.withColumn("_undone", F.max("redone").over(earlier)).where("_undone IS NULL OR _undone < message")
    return alive.select("conv_id", "message", "role", "text")


def formatted(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """messages(conv_id, message, role, text) -> (conv_id, formatted, loss_spans array<struct<start, length>>), a row a conversation.

    loss_spans are the code points of the texts of learn_role, as they stand in formatted, in order. A null role is rendered as
    empty, a null text too. Messages with equal `message` follow by role and text. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    rows = messages.select("conv_id", "message", role.alias("role"), head.alias("head"), escaped(text).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    long = F.length("head") + F.length("body") + len(END)
    placed = rows.withColumn("at", F.coalesce(F.sum(long).over(order), F.lit(0)))
    piece = F.concat("head", "body", F.lit(END))
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    every = F.sort_array(F.collect_list(F.struct("at", "message", piece.alias("piece"), (F.col("role") == learn_role).alias("learn"), span.alias("span"))))
    return placed.groupBy("conv_id").agg(every.alias("all")).select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["learn"]), lambda x: x["span"]).alias("loss_spans"),
    )


def read_back(chats: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """formatted() -> (conv_id, turns array<struct<role, text>>, loss_texts array<string>), from the formatted text and the spans alone; keep: its columns to keep."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(body, F.length(role) + 2)).alias("text"))

    said = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", *(keep or []), F.transform(pieces, turn).alias("turns"), said.alias("loss_texts"))


def events_of(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as an event log: each opens a message, in order of turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("long").alias("message"), "role", "text")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(CONTROL)', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(CONTROL)', '\1\\\2\3', 'g')) + 12 + 1 + 11 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("CONTROL", _CONTROL)
