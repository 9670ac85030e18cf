"""Ranking of entries from their runs: gate, best of sources, best per model, progression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspan.operators import topk


def entries(names: DataFrame, column: str = "entry_dir") -> DataFrame:
    """Entry folders: no hidden ones, no build output."""
    return names.where(~F.startswith(column, F.lit(".")) & (F.col(column) != "target"))


def passing(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("recall_passed") & (F.col("qps") > 0))


def best_of_sources(candidates: DataFrame, key: str, score: str, priority: str) -> DataFrame:
    """The candidate with the greatest score of each key; the earlier source wins ties."""
    others = [c for c in candidates.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(priority))).alias("_best")
    return candidates.groupBy(key).agg(best).select(key, "_best.*")


def best_per(runs: DataFrame, key: str, score: str, position: str, passed: Column) -> DataFrame:
    """The passing run with the greatest score of each key; the first wins ties."""
    others = [c for c in runs.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(position))).alias("_best")
    return runs.where(passed).groupBy(key).agg(best).select(key, "_best.*")


def ranked(board: DataFrame, *order: Column) -> DataFrame:
    """The board with its ranks, in ranges of the order."""
    return topk.ranked(board, *order)


def progression(runs: DataFrame, key: str, order: list[str], score: Column) -> DataFrame:
    """Each run's place in its entry and its score, 0 where it can't be read."""
    w = Window.partitionBy(key).orderBy(*order)
    return runs.withColumn("iteration", F.row_number().over(w)).withColumn("score", F.coalesce(score, F.lit(0.0)))


def models_in_order(runs: DataFrame, model: str, position: str) -> DataFrame:
    return runs.groupBy(model).agg(F.min(position).alias("first_seen"))


def append(board: DataFrame, entry: DataFrame) -> DataFrame:
    return board.unionByName(entry, allowMissingColumns=True)
