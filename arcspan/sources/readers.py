"""JSON and text inputs with set schemas, and the sinks that belong to them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.functions.text import run_file, run_number
from arcspan.operators.written import written

VECTORS = "id long, vector array<float>"
TRUTH = "query_id long, neighbors array<long>"
RUN = "qps double, total_queries long, duration_secs double, avg_latency_ms double, p50_latency_ms double, p95_latency_ms double, p99_latency_ms double, recall double, recall_threshold double, recall_passed boolean, concurrency long, comparison struct<previous_qps:double,qps_change_pct:double,previous_recall:double,recall_change_pct:double>"
BOARD = "model_name string, entry_dir string, qps double, recall double, recall_passed boolean, tool_calls_used int, result_source string, timestamp timestamp"
EVENT = "event string, timestamp string, model string, iteration long, tool string, tool_call_id string, arguments string, result string, message string"


def _array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array each: a file is one task, as an array can't be split."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def vectors(spark: SparkSession, path: str, name: str = "base_vectors", lines: bool = False) -> DataFrame:
    """{id, vector}: the single file if it is there, else all its shards, whatever gaps their numbers have.

    Files are JSON arrays, or with ``lines`` JSON lines, which split into as many tasks as their size asks for.
    """
    read = (lambda p: spark.read.schema(VECTORS).json(p)) if lines else (lambda p: _array(spark, p, VECTORS))
    try:
        return read(f"{path}/{name}.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return read(f"{path}/{name}_*.json")


def shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Shards of JSON lines as one table, in whatever folders they are."""
    return spark.read.schema(VECTORS).option("recursiveFileLookup", True).json(list(paths))


def truth(spark: SparkSession, path: str) -> DataFrame:
    return _array(spark, path, TRUTH)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all entries: entry_dir, run_no, the run's fields. Files that don't parse are left out."""
    read = spark.read.schema(RUN + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path}/*/benchmarks/benchmark_*.json")
    file = F.col("_metadata.file_path")
    read = read.withColumn("entry_dir", F.element_at(F.split(file, "/"), -3)).withColumn("run_no", run_number(file))
    return read.where(F.col("_corrupt_record").isNull() & F.col("qps").isNotNull()).drop("_corrupt_record")


def board(spark: SparkSession, path: str) -> DataFrame:
    return _array(spark, path, BOARD)


def events(spark: SparkSession, path: str) -> DataFrame:
    """An event log, a JSON object a line; blank and broken lines are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where(F.col("event").isNotNull())


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_run(run: DataFrame, path: str, number: int) -> str:
    """A run's file under its number, three digits at least."""
    name = run.sparkSession.range(1).select(run_file(F.lit(number))).first()[0]
    run.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    return name


def write_board(rows: DataFrame, path: str) -> None:
    """A board's rows as JSON lines, best first."""
    rows.orderBy(F.desc("qps"), F.desc("recall"), "entry_dir").write.mode("overwrite").json(path)


def append_board(entry: DataFrame, path: str) -> DataFrame:
    """Add rows to the board under ``path``, if there is one, and write it anew in order; gives the board.

    The old board is copied to the shared folder first, so that what is overwritten is no longer read.
    """
    spark = entry.sparkSession
    try:
        old = spark.read.schema(BOARD).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], BOARD)
    whole = old.unionByName(entry, allowMissingColumns=True)
    write_board(written(whole.select(*old.columns)), path)
    return spark.read.schema(BOARD).json(path)
