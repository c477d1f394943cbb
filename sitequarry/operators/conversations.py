"""Conversation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions.text import cut


def last_messages(log: DataFrame, n: int = 9, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """WIN1: the last n messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def prompt_history(log: DataFrame, n: int = 9, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """WIN1 and FLT14: of the last n messages, those that aren't tool calls of the assistant."""
    last = last_messages(log, n, session, order)
    if "tool_calls" in log.columns:
        last = last.where(~((F.col("role") == "assistant") & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)))
    return last


def insights(log: DataFrame, n: int = 10, chars: int = 200, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """WIN2: in the last n messages, the first of the assistant's that is of a kind, cut."""
    last = last_messages(log, n, session, order)
    said = lambda p: (F.col("role") == "assistant") & F.col(text).rlike(f"(?i){p}")
    first = {k: F.min_by(F.when(said(p), cut(F.col(text), chars)), F.when(said(p), F.col(order))).alias(k) for k, p in S.INSIGHTS.items()}
    return last.groupBy(session).agg(*first.values())


def tagged(log: DataFrame, text: str = "text") -> DataFrame:
    """SCO11, FLT13: language and injection flag of each message."""
    return log.withColumns({"language": S.language(F.col(text)), "injection": S.is_injection(F.col(text))})


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """WIN13: sessions by inactivity."""
    return events.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("w")


def turns_with_demo(turns: DataFrame, demos: DataFrame) -> DataFrame:
    """JOI9: turns of demos that aren't disabled; the demo's row is null where it's unknown."""
    known = demos.select(F.col("id").alias("_id"), *[F.col(c).alias(f"demo_{c}") for c in demos.columns if c != "id"])
    out = turns.join(known, F.col("demo_id") == F.col("_id"), "left").drop("_id")
    return out.where(F.coalesce(F.col("demo_enabled"), F.lit(True)))


def without_sessions(log: DataFrame, cleared: DataFrame, session: str = "conv_id") -> DataFrame:
    """SNK12: the log without cleared conversations."""
    return log.join(cleared.select(session), session, "left_anti")


def dynamic_context(base: Column, found: Column) -> Column:
    """FUN6: default lines of a vertical, overlaid by what the conversation said."""
    from ..functions.text import overlaid

    return overlaid(base, found)
