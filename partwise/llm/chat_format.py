"""Operator 7, chat formatting: event-sourced reconstruction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwise.llm.shared import table, typed

END = "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    r"""\ becomes \\, # becomes \h and < becomes \l (in roles also : to \c), so no text can hold a mark of the template."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    """The inverse of escaped. As escaped texts have no # of their own, it can stand for a backslash meanwhile."""
    out = F.replace(text, F.lit("\\\\"), F.lit("#"))
    out = F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.translate(F.replace(out, F.lit("\\h"), F.lit("\\")), "#\\", "\\#")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of events (conv_id, message, seq, kind, role, text).

    Events of a message are taken by seq (ties: by kind, role and text). A
    delta adds its text; edit and regenerate start the message anew with
    theirs; a message whose last event is delete is left out. Null texts are
    empty; the role is that of the event which the final text begins with.
    """
    at_end = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    log = typed(events, conv_id="long", message="long", seq="long", kind="string", role="string", text="string")
    log = log.groupBy("conv_id", "message").agg(at_end.alias("log")).where(F.element_at("log", -1)["kind"].isNull() | (F.element_at("log", -1)["kind"] != "delete"))
    resets = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] == "delta", 0).otherwise(i + 1)))
    last = F.slice("log", F.greatest(resets, F.lit(1)), F.size("log"))
    return log.select("conv_id", "message", last.alias("last")).select(
        "conv_id", "message", F.coalesce(F.col("last")[0]["role"], F.lit("")).alias("role"), F.array_join(F.transform("last", lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of messages: conv_id, formatted, loss (spans of formatted: start from 0, length).

    Each message becomes `### role: text</turn>` and a line end, in order of message.
    """
    head = F.concat(F.lit("### "), escaped(F.col("role"), role=True), F.lit(": "))
    body = escaped(F.col("text"))
    shown = messages.select("conv_id", "message", head.alias("head"), body.alias("body"), (F.col("role") == loss_role).alias("learn"))
    long = F.char_length("head") + F.char_length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("message")
    shown = shown.withColumn("until", F.sum(long).over(order))
    span = F.struct((F.col("until") - len(END) - F.char_length("body")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    row = F.struct("message", F.concat("head", "body", F.lit(END)).alias("part"), F.when(F.col("learn"), span).alias("span"))
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), F.array_compact(F.transform("parts", lambda p: p["span"])).alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), unescaped, of a formatted conversation."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    at = lambda p: F.locate(": ", p)
    return F.transform(parts, lambda p: F.struct(unescaped(p.substr(F.lit(5), F.instr(p, ": ") - 5)).alias("role"), unescaped(p.substr(F.instr(p, ": ") + 2, F.length(p))).alias("text")))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A delta that starts a message of its own for each row (conv_id, turn, role, text), numbered by turn.

    Ties and repeated rows are turns of their own, in order of role and text; null turns come first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = typed(conversations, conv_id="long", turn="long", role="string", text="string").withColumn("message", F.row_number().over(order))
    return rows.select("conv_id", "message", F.col("message").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss spans of every conversation; an empty table gives no rows."""
    return render(fold_events(conversation_events(conversations)))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output, by conversation."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    turns = turns.withColumn("learned", learned)
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = typed(table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    return digests(chat_format(rows.unionByName(extra)))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), grown AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')) AS text_chars,
         length(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c')) AS role_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + role_chars + text_chars) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id
"""
