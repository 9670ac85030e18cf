"""Event logs: typed parsing, pairing of calls with results, counters, profile reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspan.functions.text import profile_function, profile_percentage

KINDS = ("session_start", "llm_request", "llm_response", "tool_call", "tool_result", "error", "session_end")


def known(events: DataFrame, column: str = "event") -> DataFrame:
    """Events of the kinds there are; others are dropped."""
    return events.where(F.col(column).isin(*KINDS))


def first_model(events: DataFrame, key: str, line: str) -> DataFrame:
    """The model of each log whose first line is a session's start; a later start doesn't count."""
    first = F.min_by(F.struct("event", "model"), F.col(line)).alias("first")
    return events.groupBy(key).agg(first).where(F.col("first.event") == "session_start").select(key, F.col("first.model").alias("model"))


def pair(calls: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Calls with their results; calls without a result and results without a call stay."""
    return calls.join(results, list(keys), "full_outer")


def counters(events: DataFrame, key: str, used: Column, allowed: int) -> DataFrame:
    """Calls used and left of those allowed, and whether the limit is reached."""
    n = F.count(F.when(used, 1))
    return events.groupBy(key).agg(n.alias("used"), F.greatest(F.lit(allowed) - n, F.lit(0)).alias("remaining"), (n >= allowed).alias("limit_reached"))


def iterations(events: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Running number of requests in each log."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("iteration", F.coalesce(F.sum(F.when(starts, 1)).over(w), F.lit(0)))


def profile(lines: DataFrame, k: int = 10, column: str = "value") -> DataFrame:
    """The hottest functions of a report: function, percentage."""
    line = F.col(column)
    rows = lines.where((F.trim(line) != "") & ~F.startswith(F.ltrim(line), F.lit("#")))
    rows = rows.select(profile_function(line).alias("function"), profile_percentage(line).alias("percentage")).where((F.col("function") != "") & F.col("percentage").isNotNull())
    return rows.orderBy(F.desc("percentage"), "function").limit(k)


def profile_samples(top: DataFrame) -> DataFrame:
    return top.agg(F.greatest(F.coalesce(F.sum((F.col("percentage") * 100).cast("long")), F.lit(0)), F.lit(1)).alias("total_samples"))
