"""Queries over files and sinks: what is written is read back, each with SQL that gives the same rows. Files go to the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.functions import text, vectors
from arcspan.operators import ivf, kmeans, knn, leaderboard, logs, metrics, store, topk
from arcspan.operators.written import new_path
from arcspan.plans.queries import ASKED, C0, EVERY, K, LISTS, OUT, E, _drained, _stream, asked, base, knn_sql, load, query, rounded
from arcspan.sources import readers, vecs
from arcspan.streaming import live

_NORM = "round(list_sum(list_transform({0}::DOUBLE[], lambda x: x * x)), 6) AS squared_norm"


def _norm(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round(vectors.squared_norm("vector"), 6).alias("squared_norm"))


# --- vectors ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, {_NORM.format('embedding')} FROM embeddings WHERE vec_id % {EVERY} = 0")
def sink_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors under their places as ids."""
    path = new_path(spark, "queries")
    store.write_queries(asked(spark, sf_dir), path, "query_id")
    return _norm(spark.read.schema(readers.VECTORS).json(path))


@query(f"WITH {E}, {knn_sql()}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS query_id FROM e q WHERE {ASKED}) SELECT o.query_id, string_agg(knn.id::VARCHAR, ',' ORDER BY rank) AS neighbors FROM knn JOIN o ON o.id = knn.query_id GROUP BY 1")
def sink_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "truth")
    store.write_truth(knn.ground_truth(asked(spark, sf_dir), base(spark, sf_dir), K), path, "query_id")
    read = spark.read.schema(readers.TRUTH).json(path)
    return read.select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH {E}, {knn_sql()} SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS neighbors, (SELECT count(*) FILTER (WHERE id // 100 <> 1) FROM e q WHERE {ASKED}) AS computed FROM knn GROUP BY query_id")
def resumed_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks are there, of which one is corrupt; the rest and the corrupt one are computed, and all are merged."""
    q, rows, path = asked(spark, sf_dir), base(spark, sf_dir), new_path(spark, "chunks")
    store.resume_truth(q.where("query_id < 200"), rows, path, K, 100)
    broken = spark.read.schema(f"{readers.TRUTH}, chunk long").json(path).where("chunk = 0").withColumn("neighbors", F.slice("neighbors", 1, 3))
    lines = broken.select(F.to_json(F.struct("query_id", "neighbors")).alias("value")).collect()  # one chunk
    spark.createDataFrame(lines, "value string").write.mode("overwrite").text(f"{path}/chunk=0")
    found, computed = store.resume_truth(q, rows, path, K, 100)
    return found.select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"), F.lit(computed).cast("long").alias("computed"))


@query("SELECT vec_id // 64 AS batch, count(*) AS inserted FROM embeddings GROUP BY 1")
def load_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load(base(spark, sf_dir), new_path(spark, "store"), "id", 64)


@query(f"SELECT vec_id AS id, {_NORM.format('embedding')}, ceil((SELECT count(*) FROM embeddings) / 100)::BIGINT AS shards FROM embeddings")
def shards_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 100 vectors as JSON lines, read as one table."""
    path = new_path(spark, "shards")
    n = store.write_shards(base(spark, sf_dir), path, "id", 100)
    return _norm(readers.shards(spark, path)).withColumn("shards", F.lit(n).cast("long"))


@query(f"SELECT vec_id AS id, {_NORM.format('embedding')}, 1::BIGINT AS shards FROM embeddings")
def shard_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    n = store.write_shards(base(spark, sf_dir), f"{path}/base_vectors.json", "id", 1 << 40)
    return _norm(readers.vectors(spark, path, lines=True)).withColumn("shards", F.lit(n).cast("long"))


@query(f"WITH {E}, {knn_sql()} SELECT row_number() OVER (ORDER BY query_id) - 1 AS id, string_agg(knn.id::VARCHAR, ',' ORDER BY rank) AS neighbors FROM knn GROUP BY query_id")
def ivecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ivecs")
    truth = knn.ground_truth(asked(spark, sf_dir), base(spark, sf_dir), K)
    vecs.write_parts(truth.select(F.col("query_id").alias("id"), F.col("neighbors").alias("vector")), path, "i")
    vecs.register(spark)
    read = spark.read.format("vecs").option("kind", "i").option("path", path).load()
    return read.select("id", F.array_join(F.col("vector").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH {E}, {knn_sql()} {OUT} knn")
def scan_under_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the least number of rows a search scans, whatever the index has."""
    rows = base(spark, sf_dir)
    index = ivf.build(rows.where("id % 2 = 0"), LISTS)
    return rounded(ivf.search_or_scan(asked(spark, sf_dir), rows, index, K, 1, least_rows=1 << 30), "distance")


@query(f"WITH {E}, {C0} SELECT cid AS cluster_id, n FROM (SELECT {LISTS} AS cid, 0::BIGINT AS n) UNION ALL SELECT cid, -1 FROM c0")
def kmeans_empty_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centroid that no row is nearest to stays as it is: n is the part of it that moved."""
    rows = base(spark, sf_dir)
    far = spark.createDataFrame([(LISTS, [100.0] * 64)], "cluster_id long, centroid array<double>")
    fitted, _ = kmeans.fit(rows, kmeans.init_stride(rows, LISTS).unionByName(far), 1)
    moved = F.size(F.filter("centroid", lambda x: x != 100.0)).cast("long")
    return fitted.select("cluster_id", F.when(F.col("cluster_id") == LISTS, moved).otherwise(-1).alias("n"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures called from SQL."""
    vectors.register(spark)
    load(spark, sf_dir, "embeddings").createOrReplaceTempView("arcspan_embeddings")
    return spark.sql("SELECT /*+ BROADCAST(q) */ b.vec_id AS id, round(l2_distance(CAST(b.embedding AS ARRAY<DOUBLE>), CAST(q.embedding AS ARRAY<DOUBLE>)), 6) AS distance FROM arcspan_embeddings b JOIN arcspan_embeddings q ON q.vec_id = 0")


# --- runs, boards, logs ----------------------------------------------------------------------------------------------------


@query("SELECT event_type AS entry_dir, (1 + row_number() OVER (ORDER BY event_type))::INTEGER AS run_no, round(count(*) / (sum(value) / 1000), 4) AS qps, count(*) AS total_queries FROM events GROUP BY 1")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as one JSON file each, in the folder of their entry, and a file that doesn't parse beside them."""
    path = new_path(spark, "runs")
    rows = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total_queries"), (F.sum("value") / 1000).alias("duration_secs"))
    rows = rows.withColumn("qps", vectors.qps("total_queries", "duration_secs")).orderBy("event_type").collect()  # a few kinds
    system, root = vecs.store(path)
    for i, r in enumerate(rows, 2):
        folder = f"{root}/{r.event_type}/benchmarks"
        system.create_dir(folder, recursive=True)
        for number, said in ((i, json.dumps(r.asDict(), indent=2)), (99, "{broken")):
            with system.open_output_stream(f"{folder}/benchmark_{number:03d}.json") as f:
                f.write(said.encode())
    return rounded(readers.runs(spark, path).select("entry_dir", "run_no", "qps", "total_queries"), "qps").withColumn("qps", F.round("qps", 4))


@query("SELECT model_name, round(qps, 2) AS qps, rank FROM (SELECT *, row_number() OVER (ORDER BY qps DESC, recall DESC, entry_dir) AS rank FROM (SELECT o_orderpriority AS model_name, o_orderpriority AS entry_dir, max(o_totalprice) AS qps, 1.0 AS recall FROM orders GROUP BY 1 UNION ALL SELECT c_mktsegment, c_mktsegment, max(c_acctbal), 0.9 FROM customer GROUP BY 1))")
def board_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board that is loaded, grown, put in order and written anew."""
    path = new_path(spark, "board")
    row = lambda name, score, recall: [F.col(name).alias("model_name"), F.col(name).alias("entry_dir"), F.max(score).alias("qps"), F.lit(recall).alias("recall")]
    best = lambda t, name, score, recall: load(spark, sf_dir, t).groupBy(name).agg(*row(name, score, recall)[2:]).select(*row(name, "qps", recall)[:2], "qps", "recall")
    readers.append_board(best("customer", "c_mktsegment", "c_acctbal", 0.9), path)
    board = readers.append_board(best("orders", "o_orderpriority", "o_totalprice", 1.0), path)
    return leaderboard.ranked(board, F.desc("qps"), F.desc("recall"), F.col("entry_dir")).select("model_name", F.round("qps", 2).alias("qps"), F.col("rank").cast("long"))


_EVENT = "CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'error' ELSE 'else' END"


@query(f"SELECT event, count(*) AS n, sum(iteration)::BIGINT AS iterations FROM (SELECT {_EVENT} AS event, user_id AS iteration FROM events) WHERE event <> 'else' GROUP BY 1")
def event_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log as JSON lines, with blank and broken lines and events of no known kind, which are left out."""
    path = new_path(spark, "log")
    line = F.to_json(F.struct(F.expr(_EVENT).alias("event"), F.col("user_id").alias("iteration")))
    lines = load(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit(""), F.lit('{"event": '))).alias("value"))
    lines.write.text(path)
    return logs.known(readers.events(spark, path)).groupBy("event").agg(F.count("*").alias("n"), F.sum("iteration").alias("iterations"))


@query("SELECT *, sum((percentage * 100)::BIGINT) OVER ()::BIGINT AS total_samples FROM (SELECT n_name AS \"function\", (n_nationkey * 7 % 25) + 0.25::DOUBLE AS percentage FROM nation ORDER BY 2 DESC LIMIT 10)")
def profile_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile report as text, of which the ten hottest functions are read."""
    path = new_path(spark, "report")
    hot = F.format_string("%6.2f%%  search  [.] %s", (F.col("n_nationkey") * 7 % 25) + F.lit(0.25), F.col("n_name"))
    load(spark, sf_dir, "nation").select(F.explode(F.array(hot, F.lit("# a comment"), F.lit(""))).alias("value")).write.text(path)
    top = logs.profile(readers.report(spark, path))
    return top.crossJoin(F.broadcast(logs.profile_samples(top)))  # one row


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, round((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 1e6, 3) AS seconds FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", text.rfc3339(F.col("ts")).alias("at"), text.file_stamp(F.col("ts")).alias("stamp"), F.round(text.seconds_between(F.lit("2020-01-01").cast("timestamp"), F.col("ts")), 3).alias("seconds"))


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty, event_type AS raw FROM events")
def json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", text.pretty_json(F.col("props")).alias("pretty"), text.pretty_json(F.col("event_type")).alias("raw"))


@query("SELECT c_custkey, replace(c_name, '#', '-') AS name, 'http://host/' || c_custkey AS url, least(greatest(c_custkey, 10), 100)::BIGINT AS clamped, CASE WHEN c_custkey <= 1 THEN 1 ELSE 1 << ceil(log2(c_custkey))::INTEGER END::BIGINT AS power FROM customer")
def names_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = load(spark, sf_dir, "customer"), F.col("c_custkey")
    slashed = F.replace(F.replace("c_name", F.lit("#"), F.lit("/")), F.lit("//"), F.lit("/"))
    url = F.concat(F.lit("http://host/"), key.cast("string"), F.lit("//"))
    return rows.select("c_custkey", text.sanitised(slashed).alias("name"), text.without_trailing_slash(url).alias("url"), vectors.clamp(key, 10, 100).cast("long").alias("clamped"), vectors.next_power_of_two(key).alias("power"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 NOT IN (1, 2) AND o_orderstatus = 'F' AND o_totalprice > 0")
def entries_that_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry folders without hidden ones and build output, and of those the runs that pass."""
    kind = F.col("o_orderkey") % 5
    name = F.when(kind == 1, F.lit(".hidden")).when(kind == 2, F.lit("target")).otherwise(F.concat(F.lit("entry-"), F.col("o_orderkey").cast("string")))
    rows = load(spark, sf_dir, "orders").withColumn("entry_dir", name).withColumn("recall_passed", F.col("o_orderstatus") == "F").withColumn("qps", F.col("o_totalprice"))
    return leaderboard.passing(leaderboard.entries(rows)).select("o_orderkey")


@query("SELECT count(*) AS n, true AS same_again, true AS another_seed_differs, true AS all_there FROM embeddings")
def shuffle_is_an_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seed gives the same order, another one another, and no row is lost. Orders are told apart by place and id."""
    rows = base(spark, sf_dir).select("id")
    order = lambda seed: topk.ranked(rows.withColumn("_h", F.xxhash64(F.lit(seed), "id")), F.col("_h"), F.col("id"), name="place").drop("_h")
    told = lambda r: r.agg(F.sum(F.xxhash64("place", "id").cast("decimal(38,0)")), F.count_distinct("id")).first()
    first, again, other, n = told(order(42)), told(order(42)), told(order(43)), rows.count()
    return spark.createDataFrame([(n, first == again, first[0] != other[0], first[1] == n)], "n long, same_again boolean, another_seed_differs boolean, all_there boolean")


# --- streams ---------------------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1)::BIGINT AS call_turn, coalesce(length(c.text), -1) AS call_chars, coalesce(length(r.text), -1) AS result_chars
FROM (SELECT * FROM conversations WHERE role = 'user') c FULL JOIN (SELECT * FROM conversations WHERE role = 'assistant') r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1""")
def stream_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results that come in several batches, in no order; those without the other stay."""
    path = new_path(spark, "stream")
    rows = load(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    rows = rows.select("conv_id", (F.col("turn").cast("long") - F.when(F.col("role") == "user", 0).otherwise(1)).alias("call_turn"), "role", F.length("text").cast("long").alias("chars"))
    rows.repartition(4, F.xxhash64("conv_id", "call_turn", "role")).write.parquet(f"{path}/in")
    live.pair_log(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), F.col("role") == "user", ["conv_id", "call_turn"], f"{path}/out", f"{path}/state").awaitTermination()
    found = live.pairs_of(spark, f"{path}/out", ["conv_id", "call_turn"])
    return found.select("conv_id", "call_turn", F.coalesce("call.chars", F.lit(-1)).cast("long").alias("call_chars"), F.coalesce("result.chars", F.lit(-1)).cast("long").alias("result_chars"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events appended to a log of JSON lines, which is then read."""
    path = new_path(spark, "stream")
    live.append_events(_stream(spark, sf_dir, "events").select("event_id", "event_type"), f"{path}/log", f"{path}/state").awaitTermination()
    return live.counts(spark.read.schema("event_id long, event_type string").json(f"{path}/log"), "event_type")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS began, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, which end after an hour without an event."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = live.sessions(events, "ts", "user_id", "1 hour", "0 seconds")
    rows = found.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm").alias("began"), "n")
    return _drained(spark, rows, "complete", "user_id long, began string, n long")


@query("SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) >= 3")
def metrics_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.summary(load(spark, sf_dir, "events"), "value", F.sum("value") / 1000, F.lit(1.0), 0.8, "user_id").where("total_queries >= 3")
    return rows.select("user_id", F.round("avg_latency_ms", 6).alias("mean"))
