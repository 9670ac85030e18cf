"""Live event logs: counts by kind, pairing of calls with results, lists that grow with new vectors.

Producers roll files in a folder; each file is read once. State lives in the checkpoint folder, so a query goes on after a stop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcspan.operators import ivf


def source(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def counts(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, column: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), column).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def paired(calls: DataFrame, results: DataFrame, call_time: str, result_time: str, key: str, wait: str = "10 minutes") -> DataFrame:
    """Calls with their results; a call without one comes out when the watermark has passed its wait."""
    left = calls.withWatermark(call_time, wait)
    right = results.withColumnRenamed(key, "_key").withWatermark(result_time, wait)
    within = (F.col(key) == F.col("_key")) & (F.col(result_time) >= F.col(call_time)) & (F.col(result_time) <= F.col(call_time) + F.expr(f"INTERVAL {wait}"))
    return left.join(right, within, "left_outer").drop("_key")


def pair_log(events: DataFrame, is_call: Column, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Calls paired with results as they come, in whatever order, under ``path``; see :func:`pairs_of`.

    A batch joins its rows with those that wait from before, writes the pairs, and writes anew what still waits, so state is as large
    as the calls and results that are open. Each batch has folders of its own, which a repeated batch replaces.
    """

    def settle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        others = [c for c in rows.columns if c not in keys]
        rows = rows.select(*keys, F.struct(*others).alias("_event"), is_call.alias("_call"))
        if batch:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/waiting/batch={batch - 1}"))
        side = lambda call, name: rows.where(F.col("_call") == call).select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("_event").alias(name))
        same = reduce(and_, [F.col(f"_call_{k}").eqNullSafe(F.col(f"_result_{k}")) for k in keys])
        both = side(True, "call").join(side(False, "result"), same, "full_outer")
        both = both.select(*[F.when(F.col("call").isNotNull(), F.col(f"_call_{k}")).otherwise(F.col(f"_result_{k}")).alias(k) for k in keys], "call", "result")
        whole = F.col("call").isNotNull() & F.col("result").isNotNull()
        both.where(whole).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch}")
        waits = both.where(~whole).select(*keys, F.coalesce("call", "result").alias("_event"), F.col("call").isNotNull().alias("_call"))
        waits.write.mode("overwrite").parquet(f"{path}/waiting/batch={batch}")

    return events.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pairs_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, call, result) of :func:`pair_log`: all pairs, and then the calls and results that still wait, with null for the other."""
    pairs = spark.read.parquet(f"{path}/pairs").drop("batch")
    waiting = spark.read.parquet(f"{path}/waiting")
    waiting = waiting.join(F.broadcast(waiting.agg(F.max("batch").alias("batch"))), "batch")  # what waits after the last batch
    alone = waiting.select(*keys, F.when(F.col("_call"), F.col("_event")).alias("call"), F.when(~F.col("_call"), F.col("_event")).alias("result"))
    return pairs.unionByName(alone)


def maintain(new_rows: DataFrame, index: ivf.Index, path: str, checkpoint: str) -> StreamingQuery:
    """Assign vectors as they come and append them to the postings under ``path``. A batch that is repeated replaces its own files."""

    def append(rows: DataFrame, batch: int) -> None:
        grown = ivf.add(ivf.Index(index.centroids, rows.sparkSession.createDataFrame([], "cluster_id long, id long, vector array<float>")), rows)
        grown.postings.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return new_rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_change(rows: DataFrame, told: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "complete") -> StreamingQuery:
    """Call ``told`` with the table after each change, every ``every`` or until nothing is left."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.outputMode(mode).foreachBatch(told).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_events(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log: new rows go to new files, each batch once."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
