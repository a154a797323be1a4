"""Conversation windows and audit summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    at = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(at)).where(F.col("back") <= n).drop("back")


def summary(turns: DataFrame, n: int = 3, limit: int = 600) -> DataFrame:
    """Per conversation the last ``n`` turns as "role: text" lines, each text cut at ``limit``."""
    line = F.concat(F.col("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, limit))
    lines = last_turns(turns, n).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("summary"))


def condensed(question: Column, rewrite: Column) -> Column:
    """A model's rewriting of a question, unless it is empty or 300 characters long and more."""
    return F.when((F.length(F.trim(rewrite)) > 0) & (F.length(rewrite) < 300), F.trim(rewrite)).otherwise(question)


def is_local(host: Column) -> Column:
    """Hosts that don't leave the site: none, loopback, and two private ranges by their first digits."""
    h = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    return (h == "") | h.isin("localhost", "0.0.0.0", "::1") | h.startswith("127.") | h.startswith("192.168.") | h.startswith("10.")


def audit_totals(events: DataFrame) -> DataFrame:
    out = events.agg(F.count("*").alias("events"), F.count_if("is_local").alias("local_events"), F.count_if(~F.col("is_local")).alias("external_events"))
    return out.withColumn("compliant", F.col("external_events") == 0)


def audit_last(events: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` events (a report: sorted to the first n of every partition, then of all)."""
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)
