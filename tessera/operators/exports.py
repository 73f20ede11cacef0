"""Sessions, evaluations and settings written out for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_rows(messages: DataFrame) -> DataFrame:
    """Question and answer pairs of a session: session_id, turn, query, response, chars. messages: session_id, turn, role, text."""
    asked = messages.where("role = 'user'").select("session_id", F.col("turn").alias("asked"), F.col("text").alias("query"))
    said = messages.where("role = 'assistant'").select(F.col("session_id").alias("s"), F.col("turn").alias("turn"), F.col("text").alias("response"))
    pairs = asked.join(said, (F.col("session_id") == F.col("s")) & (F.col("turn") == F.col("asked") + 1))
    return pairs.select("session_id", F.col("asked").alias("turn"), "query", "response", F.length("response").alias("chars"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


def without_session(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """messages without the sessions named in gone (session_id)."""
    return messages.join(gone.select("session_id"), "session_id", "left_anti")


def pdf_time(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS and what may follow, as a timestamp; null if it is none."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(text, "^D:", ""), 1, 14), F.lit("yyyyMMddHHmmss"))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])
