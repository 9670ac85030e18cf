"""Top rows by key and in all, ordinals, strides, prefixes and seeded orders. All are deterministic: ties fall to the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspan.operators.written import written


def top_per_key(df: DataFrame, key: str, k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; the plan limits groups before the shuffle."""
    if k < 0:
        raise ValueError("k is negative")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def with_ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """0, 1, ... in the order of a unique column, without gathering the table in one task.

    Ranges of the column are counted, and the counts of the ranges before (one row each) are added to the places inside them.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.stat.approxQuantile(order, [i / n for i in range(1, n)], 0.001) if n > 1 else []
    part = sum([(F.col(order) > b).cast("int") for b in sorted(set(bounds))], F.lit(0))
    split = df.withColumn("_part", part)
    before = split.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = split.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return placed.join(F.broadcast(before.drop("count")), "_part").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1, 2, ... in any order that tells all rows apart, without gathering the table in one task.

    The table is dealt by ranges of the order and written, since ranges are sampled anew each time; ranges are then counted, and the
    counts of those before (one row each) are added to the places inside them.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before.drop("count")), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def stride(df: DataFrame, n_rows: int, n: int, ordinal: str = "ordinal") -> DataFrame:
    """``n`` evenly spaced rows: those whose ordinal is floor(c * n_rows / n) for a c."""
    if n >= n_rows:
        return df.withColumn("pick", F.col(ordinal))
    # the least c with floor(c * rows / n) >= ordinal, if it hits the ordinal
    c = F.floor((F.col(ordinal) * n + n_rows - 1) / F.lit(n_rows)).cast("long")
    return df.withColumn("pick", c).where((F.floor(F.col("pick") * n_rows / F.lit(n)) == F.col(ordinal)) & (F.col("pick") < n))


def prefix(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    """The first ``n`` of an ordinal column; 0 is all."""
    return df if n == 0 else df.where(F.col(ordinal) < n)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """The same order for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def sampled(df: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed."""
    return shuffled(df, seed, key).limit(n)
