"""Conversations: history windows, sequences, turn pairs and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import strip, text_or_empty, title


def with_context(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """Messages with their context row, if any."""
    return messages.join(contexts, "message_id", "left")


def recent_history(messages: DataFrame, last: int = 6, size: int = 200) -> DataFrame:
    """Of each conversation the last ``last`` messages of user or assistant that say something, each cut to ``size`` characters."""
    said = messages.where(F.col("role").isin("user", "assistant") & (strip(text_or_empty("content")) != ""))
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("sequence")))
    return said.withColumn("_back", back).where(F.col("_back") <= last).select("conversation_id", "sequence", "role", F.substring(strip("content"), 1, size).alias("content"))


def history_text(messages: DataFrame, last: int = 6, size: int = 200) -> DataFrame:
    """(conversation_id, history): the recent messages as "role: content" lines in order."""
    line = F.concat_ws(": ", "role", "content")
    kept = recent_history(messages, last, size).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("sequence", line.alias("l")))).alias("h"))  # at most ``last``
    return kept.select("conversation_id", F.array_join(F.transform("h", lambda x: x["l"]), "\n").alias("history"))


def next_sequence(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg((F.max("sequence") + 1).alias("next_sequence"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Each user message with the assistant message right after it; null where another user message or nothing follows."""
    w = Window.partitionBy("conversation_id").orderBy("sequence")
    talk = messages.where(F.col("role").isin("user", "assistant"))
    ahead = talk.withColumn("_role", F.lead("role").over(w)).withColumn("_content", F.lead("content").over(w))
    return ahead.where("role = 'user'").select("conversation_id", "sequence", F.col("content").alias("question"), F.when(F.col("_role") == "assistant", F.col("_content")).alias("answer"))


def titles(messages: DataFrame, default: str = "New conversation") -> DataFrame:
    """(conversation_id, title): of the first user message."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "sequence").alias("content"))
    return first.select("conversation_id", title("content", default).alias("title"))
