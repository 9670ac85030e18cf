"""Whether a search's results differ enough between queries. Up to 500 pairs are compared whole; beyond that, 500 evenly spaced
pairs in the order of query ids, found by integer offsets of the pair triangle's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.vectors import jaccard
from arcspan.operators.topk import with_ordinal
from arcspan.operators.written import written

MOST_PAIRS, THRESHOLD = 500, 0.8
# Messages of the verdict, and those of no results and of empty ones.
WITHIN = "OK: Average Jaccard similarity %.4f is within threshold %.2f. Unique IDs: %d/%d total."
OVER = "SUSPICIOUS: Average Jaccard similarity %.4f exceeds threshold %.2f. Unique IDs: %d/%d total. Possible hardcoded results detected."
EMPTY = ("No results to analyze.", "All result sets are empty.")


def numbered(results: DataFrame) -> DataFrame:
    """Nested results (query_id, neighbors) with i, their place in the order of ids."""
    return with_ordinal(written(results), "query_id", "i")


def pairs(results: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(i, j, similarity) of the compared pairs."""
    spark = results.sparkSession
    rows = numbered(results)
    n = rows.count()
    total = n * (n - 1) // 2
    a, b = rows.select("i", F.col("neighbors").alias("x")), rows.select(F.col("i").alias("j"), F.col("neighbors").alias("y"))
    if total <= most:
        chosen = a.join(b, F.col("i") < F.col("j"))
    else:
        sample = spark.range(most).select(F.floor(F.col("id") * F.lit(total) / F.lit(most)).cast("long").alias("p"))
        # row i of the triangle begins at i * n - i * (i + 1) / 2; the root gives i but for rounding, settled by the offsets
        root = F.floor(F.lit(n - 0.5) - F.sqrt(F.pow(F.lit(n - 0.5), F.lit(2)) - 2 * F.col("p"))).cast("long")
        begin = lambda i: (i * F.lit(n) - F.floor(i * (i + 1) / 2)).cast("long")
        found = sample.withColumn("r", root).withColumn("i", F.when(begin(F.col("r")) > F.col("p"), F.col("r") - 1).when(begin(F.col("r") + 1) <= F.col("p"), F.col("r") + 1).otherwise(F.col("r")))
        index = found.select("i", (F.col("i") + 1 + F.col("p") - begin(F.col("i"))).alias("j"))
        chosen = index.join(a, "i").join(b, "j")
    return chosen.select("i", "j", jaccard("x", "y").alias("similarity"))


def verdict(results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """passed, avg_similarity, unique_ids, total_results, message. No results pass; the message says why."""
    results = written(results)
    ids = results.select(F.explode("neighbors").alias("id")).agg(F.count_distinct("id").alias("unique_ids"), F.count("*").alias("total_results"))
    mean = pairs(results).agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("avg_similarity"))
    out = mean.crossJoin(F.broadcast(ids)).withColumn("passed", F.col("avg_similarity") <= threshold)  # one row each
    empty = F.lit(EMPTY[0] if results.isEmpty() else EMPTY[1])
    numbers = (F.bround("avg_similarity", 4), F.lit(float(threshold)), F.col("unique_ids"), F.col("total_results"))
    said = F.when(F.col("passed"), F.format_string(WITHIN, *numbers)).otherwise(F.format_string(OVER, *numbers))
    return out.withColumn("message", F.when(F.col("total_results") == 0, empty).otherwise(said))
