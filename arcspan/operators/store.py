"""The vector store as tables: widths, inserts, batches, shards, resumed work."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.vectors import fit_width
from arcspan.operators.knn import ground_truth
from arcspan.operators.topk import with_ordinal
from arcspan.operators.written import written


def conform(vectors: DataFrame, width: int, mode: str = "drop", column: str = "vector") -> DataFrame:
    """Vectors of one width: others are dropped, refused, or cut and filled up."""
    if mode == "drop":
        return vectors.where(F.size(column) == width)
    if mode == "pad":
        return vectors.withColumn(column, fit_width(column, width))
    if mode == "fail":
        wrong = F.raise_error(F.format_string("a vector has %d numbers instead of %d", F.size(column), F.lit(width)))
        return vectors.withColumn(column, F.when(F.size(column) == width, F.col(column)).otherwise(wrong))
    raise ValueError(mode)


def append(store: DataFrame, *more: DataFrame) -> DataFrame:
    for x in more:
        store = store.unionByName(x)
    return store


def upsert(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key: one partial aggregate, no sort."""
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.col(sequence)).alias("_last")
    return rows.groupBy(key).agg(last).select(key, "_last.*")


def inserted(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("inserted"))


def batches(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    """Rows in each batch of ``size`` by ordinal."""
    return rows.groupBy(F.floor(F.col(ordinal) / size).alias("batch")).agg(F.count("*").alias("inserted"))


def load(rows: DataFrame, path: str, ordinal: str, size: int) -> DataFrame:
    """Load rows into the store under ``path`` in batches of ``size`` by ordinal, a folder each; (batch, inserted) of what it then has.

    All batches are written by one job. A batch that is loaded again replaces itself, so a load that broke off can be repeated.
    """
    marked = rows.withColumn("batch", F.floor(F.col(ordinal) / size))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(marked.schema).parquet(path).groupBy("batch").agg(F.count("*").alias("inserted"))


def shards(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    """``rows`` with the number of the shard file they go to."""
    return rows.withColumn("shard", F.floor(F.col(ordinal) / size))


def write_shards(rows: DataFrame, path: str, ordinal: str, size: int) -> int:
    """JSON lines: one file if the rows fit in a shard, else one folder a shard. Gives the number of shards."""
    n = rows.agg(F.max(ordinal)).first()[0]
    n = 0 if n is None else int(n) + 1
    if n <= size:
        rows.repartition(1).sortWithinPartitions(ordinal).write.mode("overwrite").json(path)
        return min(n, 1)
    marked = shards(rows, ordinal, size)
    marked.repartition("shard").sortWithinPartitions("shard", ordinal).write.mode("overwrite").partitionBy("shard").json(path)
    return -(-n // size)


def write_queries(rows: DataFrame, path: str, order: str, column: str = "vector") -> None:
    """Query vectors as JSON lines {id, vector}: the place in the order is the id."""
    with_ordinal(rows.select(order, column), order, "id").select("id", F.col(column).alias("vector")).write.mode("overwrite").json(path)


def write_truth(rows: DataFrame, path: str, order: str, column: str = "neighbors") -> None:
    """True neighbours as JSON lines {query_id, neighbors}: the place in the order is the query's id."""
    with_ordinal(rows.select(order, column), order, "query_id").select("query_id", F.col(column).alias("neighbors")).write.mode("overwrite").json(path)


TRUTH = "query_id long, neighbors array<long>"


def sound_chunks(chunks: DataFrame, work: DataFrame, k: int) -> DataFrame:
    """(chunk) of the stored chunks that are whole: as many queries as the work has for them, each once, with ``k`` neighbours each
    and nothing that doesn't parse."""
    stored = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.min(F.coalesce(F.size("neighbors"), F.lit(-1))).alias("least"), F.max(F.coalesce(F.size("neighbors"), F.lit(-1))).alias("most"))
    asked = work.groupBy("chunk").agg(F.count("*").alias("asked"))
    whole = (F.col("n") == F.col("asked")) & (F.col("ids") == F.col("asked")) & (F.col("least") == k) & (F.col("most") == k)
    return stored.join(asked, "chunk").where(whole).select("chunk")


def resume_truth(queries: DataFrame, base: DataFrame, path: str, k: int, size: int) -> tuple[DataFrame, int]:
    """True neighbours by chunks of ``size`` query ids, kept under ``path`` as JSON lines, a folder a chunk.

    Chunks that are there and whole are skipped; missing and corrupt ones are computed and replaced. Gives the merged table and the
    number of queries that were computed.
    """
    spark = queries.sparkSession
    work = queries.withColumn("chunk", F.floor(F.col("query_id") / size))
    schema = f"{TRUTH}, chunk long"
    try:
        there = spark.read.schema(schema).json(path)
        done = written(sound_chunks(there, work, min(k, base.count())))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = spark.createDataFrame([], "chunk long")
    left = written(unfinished(work, done, "chunk"))
    n = left.count()
    if n:
        found = ground_truth(left.select("query_id", "vector"), base, k).withColumn("chunk", F.floor(F.col("query_id") / size))
        found.repartition("chunk").sortWithinPartitions("chunk", "query_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").json(path)
    return merged(spark.read.schema(schema).json(path), queries.count()), n


def merged(chunks: DataFrame, expected: int) -> DataFrame:
    """(query_id, neighbors) of all chunks in order; another number of queries than expected is told by a warning."""
    n = chunks.count()
    if n != expected:
        warnings.warn(f"merged {n} queries but expected {expected}", stacklevel=2)
    return chunks.select("query_id", "neighbors").orderBy("query_id")


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The chunks that aren't done."""
    return work.join(done.select(key), key, "left_anti")


def numbered(rows: DataFrame, order: str, name: str = "sequence") -> DataFrame:
    """1, 2, ... in the order of a unique column."""
    return with_ordinal(rows, order, name).withColumn(name, F.col(name) + 1)
