"""Hash buckets by a seeded projection. Searches read every bucket, so results are exact; buckets only spread the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.vectors import as_double
from arcspan.operators.knn import exact_knn


def bucketed(base: DataFrame, buckets: int = 64, seed: int = 42) -> DataFrame:
    """``base`` with the bucket of each vector's projection on seeded signs."""
    sign = F.transform(as_double("vector"), lambda x, i: F.when(F.pmod(F.xxhash64(F.lit(seed), i), F.lit(2)) == 0, x).otherwise(-x))
    projected = F.aggregate(sign, F.lit(0.0), lambda t, x: t + x)
    return base.withColumn("bucket", F.pmod(F.xxhash64(projected), F.lit(buckets)).cast("int"))


def search(queries: DataFrame, base: DataFrame, k: int, buckets: int = 64) -> DataFrame:
    return exact_knn(queries, bucketed(base, buckets).repartition("bucket").select("id", "vector"), k)
