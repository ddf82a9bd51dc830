"""Chat formatting by event-sourced reconstruction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from orbweave.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

# Every control string (of this template or of another) starts with "<" or "[".
# A backslash after each "<", "[" and backslash keeps all of them out of the texts.


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def escape_role(c: Column) -> Column:
    """A role is one line: a line feed becomes "<n>", which escape() never makes."""
    return F.replace(escape(c), F.lit("\n"), F.lit("<n>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<n>"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages: (conv_id, message_id, role, text).

    `events`: conv_id, message_id, seq, kind, role, text. Within a message, by seq:
    kind "delta" appends its text, "edit" replaces what the message holds, and
    "regenerate" drops it and starts anew with its own text. A null or unknown kind is a
    delta; a null text is empty; a null seq sorts first; events tied on seq sort by kind,
    role and text. The message's role is that of its last event that has one, else "".
    Messages hash on both keys, so one long conversation spreads over tasks.
    """
    e = F.struct(F.col("seq").alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(e)).alias("e"))
    resets = F.filter(F.sequence(F.lit(1), F.size("e")), lambda i: F.get("e", i - 1)["kind"].isin("edit", "regenerate"))
    m = m.withColumn("from", F.coalesce(F.array_max(resets), F.lit(1)))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    live = F.slice("e", F.col("from"), F.size("e"))
    return m.select("conv_id", "message_id", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render_turns(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, message_id, rendered, and the loss span.

    loss_start and loss_end are code points in the conversation's formatted text (end
    exclusive), null where the model isn't trained on the message. Messages order by
    message_id (nulls first), then role and text.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    t = messages.select("conv_id", "message_id", "role", "text", head.alias("head"), body.alias("body"))
    t = t.withColumn("rendered", F.concat("head", "body", F.lit(CLOSE + "\n")))
    order = W.partitionBy("conv_id").orderBy("message_id", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.length("rendered")).over(order)
    t = t.withColumn("position", F.count(F.lit(1)).over(order)).withColumn("end", end)
    start = F.col("end") - F.length("rendered") + F.length("head")
    loss = F.col("role") == "assistant"
    return t.select("conv_id", "message_id", "position", "rendered", F.when(loss, start).alias("loss_start"), F.when(loss, start + F.length("body")).alias("loss_end"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of spans).

    The row holds the whole conversation, so a conversation must fit in one row; use
    render_turns() where it doesn't. Rows with a null conv_id form one conversation.
    """
    turns = render_turns(messages)
    span = F.when(F.col("loss_start").isNotNull(), F.struct(F.col("loss_start").alias("start"), F.col("loss_end").alias("end")))
    rows = F.sort_array(F.collect_list(F.struct("position", "rendered", span.alias("span"))))
    g = turns.groupBy("conv_id").agg(rows.alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull())
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests that are read from the formatted text and its mask alone."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turn = F.transform(parts, lambda x: F.substring(x, len(OPEN) + 1, 2**31 - 1))
    both = F.transform(turn, lambda x: F.concat(unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))), F.lit("\n")))
    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    d = formatted.select("conv_id", "formatted", parts.alias("parts"), F.array_join(both, "").alias("turns"), F.array_join(loss, "").alias("loss"))
    return d.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Each stored row as a message of one delta; equal turns stay messages of their own."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", n.cast("long").alias("message_id"), F.lit(0).cast("long").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


PROBE_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", conv.schema["conv_id"].dataType), T.StructField("turn", conv.schema["turn"].dataType), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], schema)
    messages = fold_events(conversation_events(conv.union(probe)))
    return read_back(format_conversations(messages))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
