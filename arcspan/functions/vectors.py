"""Distances and set measures as column expressions. Vectors are cast to double before they are subtracted, and sums run in
order of the dimensions, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_norm(a: Column | str) -> Column:
    return _sum(F.transform(as_double(a), lambda x: x * x))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def divide(a: Column | str, by: Column) -> Column:
    return F.transform(as_double(a), lambda x: x / by)


def fit_width(v: Column | str, width: int) -> Column:
    """Cut to ``width`` or fill up with zeros."""
    v = F.col(v) if isinstance(v, str) else v
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two id sets; 0 if both are empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union == 0, 1).otherwise(union))


def recall_at(found: Column | str, truth: Column | str, k: int = 10) -> Column:
    """Share of the first ``k`` true ids among the first ``k`` found ones; the denominator is always ``k``."""
    found, truth = (F.slice(F.col(x) if isinstance(x, str) else x, 1, k) for x in (found, truth))
    return F.size(F.array_intersect(found, truth)) / F.lit(k)


def qps(n: Column | str, seconds: Column | str) -> Column:
    n, seconds = (F.col(x) if isinstance(x, str) else x for x in (n, seconds))
    return F.when(seconds <= 0, 0.0).otherwise(n / F.when(seconds <= 0, 1.0).otherwise(seconds))


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long")


def register(spark: SparkSession) -> None:
    """The measures as SQL functions, usable in ``spark.sql``."""
    body = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (t, x) -> t + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_squared(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt({body})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jaccard(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE RETURN CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END")
