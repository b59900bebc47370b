"""Chat history, transcripts and the choice of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(column: str, by: str = "turn") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(by, column))), lambda x: x[column])


def history_turns(messages: DataFrame, most: int = 8) -> DataFrame:
    """The turns that are sent along: conv_id, no, role (user or model), text.

    Of (conv_id, turn, role, text, is_error) system messages and failed answers are dropped, the last ``most`` kept, leading
    answers dropped, neighbours of one role merged, a trailing question dropped.
    """
    usable = messages.where("role <> 'system' AND NOT (role = 'assistant' AND (coalesce(is_error, false) OR text LIKE 'Error:%'))")
    late = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = usable.withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= most).withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise("user"))
    early = Window.partitionBy("conv_id").orderBy("turn")
    asked = last.withColumn("_asked", F.max(F.when(F.col("role") == "user", 1).otherwise(0)).over(early)).where("_asked = 1")
    new = F.coalesce((F.lag("role").over(early) != F.col("role")).cast("int"), F.lit(1))
    island = asked.withColumn("_new", new).withColumn("no", F.sum("_new").over(early))
    merged = island.groupBy("conv_id", "no", "role").agg(F.array_join(_ordered("text"), "\n\n").alias("text"))
    end = F.max("no").over(Window.partitionBy("conv_id"))
    return merged.withColumn("_end", end).where("NOT (no = _end AND role = 'user')").select("conv_id", F.col("no").cast("bigint").alias("no"), "role", "text")


def last_messages(messages: DataFrame, most: int = 100) -> DataFrame:
    """The last ``most`` messages of each conversation."""
    late = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= most).drop("_r")


def transcripts(messages: DataFrame, most: int = 100) -> DataFrame:
    """Each conversation as Markdown: conv_id, transcript."""
    name = F.when(F.col("role") == "assistant", "Assistant").when(F.col("role") == "system", "System").otherwise("You")
    parts = last_messages(messages, most).withColumn("part", F.concat(F.lit("## "), name, F.lit("\n\n"), F.col("text")))
    return parts.groupBy("conv_id").agg(F.array_join(_ordered("part"), "\n\n---\n\n").alias("transcript"))


def stream_text(lines: DataFrame) -> DataFrame:
    """The text of event-stream lines (stream_id, at, line): stream_id, text, error. Lines that aren't ``data:`` JSON say nothing."""
    body = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    parsed = lines.withColumn("_j", F.nullif(body, F.lit("")))
    gemini = F.get_json_object("_j", "$.candidates[0].content.parts[0].text")
    other = F.get_json_object("_j", "$.choices[0].delta.content")
    parsed = parsed.withColumn("part", F.coalesce(gemini, other)).withColumn("err", F.coalesce(F.get_json_object("_j", "$.error.message"), F.get_json_object("_j", "$.promptFeedback.blockReason")))
    return parsed.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("at", "part")))), lambda x: x["part"]), "").alias("text"), F.max("err").alias("error"))
