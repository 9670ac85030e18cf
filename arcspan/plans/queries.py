"""The queries on offer, each with SQL that gives the same rows.

Stand-ins: runs are ``events`` (user as entry, time and id as order, value as score), the board is ``orders`` (customer as model,
price as score, status F as passed), logs are ``events`` and ``conversations``, base vectors and queries are ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.functions import text, vectors
from arcspan.operators import anticheat, buckets, ivf, kmeans, knn, leaderboard, logs, metrics, store, topk
from arcspan.operators.written import new_path, written
from arcspan.sources import vecs
from arcspan.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The stated query set has every id divisible by EVERY. Neighbours, lists, and the recall that probes are chosen for.
EVERY, K, LISTS, RECALL = 20, 10, 16, 0.95


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- SQL parts -------------------------------------------------------------------------------------------------------------


def D(a: str, b: str) -> str:  # noqa: N802
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings)"


ASKED = f"q.id % {EVERY} = 0"


def knn_sql(k: int = K, where: str = ASKED, base_where: str = "true") -> str:
    return f"""knn AS (SELECT query_id, rk AS rank, id, sqrt(d2) AS distance FROM (
      SELECT q.id AS query_id, b.id AS id, {D("q.v", "b.v")} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {D("q.v", "b.v")}, b.id) AS rk
      FROM e q, e b WHERE {where} AND {base_where}) WHERE rk <= {k})"""


C0 = f"c0 AS (SELECT c.range AS cid, e.v AS cv FROM range({LISTS}) c JOIN e ON e.o = (c.range * (SELECT count(*) FROM e)) // {LISTS})"


def assign_sql(name: str, c: str) -> str:
    return f"{name} AS (SELECT id, v, o, cid FROM (SELECT e.id, e.v, e.o, c.cid, row_number() OVER (PARTITION BY e.id ORDER BY {D('e.v', 'c.cv')}, c.cid) AS rk FROM e, {c} c) WHERE rk = 1)"


C1 = f"""m1 AS (SELECT cid, list(m ORDER BY p) AS mv FROM (SELECT cid, p, avg(v[p]) AS m FROM a0, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM e))) AS p) GROUP BY cid, p) GROUP BY cid),
c1 AS (SELECT c0.cid, coalesce(mv, cv) AS cv FROM c0 LEFT JOIN m1 ON c0.cid = m1.cid)"""
INDEX = f"{E}, {C0}, {assign_sql('a0', 'c0')}, {C1}, {assign_sql('a1', 'c1')}"


def probe_sql() -> str:
    """Ranks of all lists, true neighbours, the fewest probes that reach the recall, and the probes."""
    return f"""allpr AS (SELECT q.id AS query_id, q.v AS qv, c1.cid, row_number() OVER (PARTITION BY q.id ORDER BY {D('q.v', 'c1.cv')}, c1.cid) AS rk FROM e q, c1 WHERE {ASKED}),
{knn_sql()}, found AS (SELECT allpr.rk AS p, count(*) AS n FROM knn JOIN a1 ON knn.id = a1.id JOIN allpr ON allpr.query_id = knn.query_id AND allpr.cid = a1.cid GROUP BY 1),
byp AS (SELECT p, sum(n) OVER (ORDER BY p) / sum(n) OVER () AS recall FROM found), np AS (SELECT min(p) AS p FROM byp WHERE recall >= {RECALL}),
pr AS (SELECT * FROM allpr WHERE rk <= (SELECT p FROM np))"""


def ivf_sql(postings: str = "a1") -> str:
    return f"ivf AS (SELECT query_id, rk AS rank, id, sqrt(d2) AS distance FROM (SELECT query_id, id, {D('qv', 'v')} AS d2, row_number() OVER (PARTITION BY query_id ORDER BY {D('qv', 'v')}, id) AS rk FROM pr JOIN {postings} p ON pr.cid = p.cid) WHERE rk <= {K})"


OUT = "SELECT query_id, rank, id, round(distance, 6) AS distance FROM "


# --- nearest neighbours ----------------------------------------------------------------------------------------------------


@query(f"WITH {E}, {knn_sql()} {OUT} knn")
def knn_exact_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact_knn(asked(spark, sf_dir), base(spark, sf_dir), K), "distance")


@query(f"WITH {E}, {knn_sql()} {OUT} knn")
def knn_exact_top10_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact_knn(asked(spark, sf_dir), base(spark, sf_dir), K, "sql"), "distance")


@query(f"WITH {E}, {knn_sql(100)} SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS neighbors, count(*) AS n FROM knn GROUP BY query_id")
def knn_ground_truth_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.ground_truth(asked(spark, sf_dir), base(spark, sf_dir), 100)
    return found.select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"), F.size("neighbors").cast("long").alias("n"))


@query(f"WITH {E} SELECT b.id, round(sqrt({D('q.v', 'b.v')}), 6) AS distance FROM e q, e b WHERE q.id = 20 ORDER BY {D('q.v', 'b.v')}, b.id LIMIT 25")
def knn_full_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = asked(spark, sf_dir).where("query_id = 20")
    near = topk.top(knn.distances(one, base(spark, sf_dir)), 25, "d2", "id")
    return near.select("id", F.round(F.sqrt("d2"), 6).alias("distance"))


@query(f"WITH {E}, {knn_sql(10, base_where='b.id < 5')} {OUT} knn")
def knn_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact_knn(asked(spark, sf_dir), base(spark, sf_dir).where("id < 5"), 10), "distance")


@query(f"WITH {E}, {knn_sql(1, base_where='q.id <> b.id')} SELECT query_id, id, round(distance, 6) AS distance FROM knn")
def knn_all_nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other row of every row that is asked."""
    found = knn.exact_knn(asked(spark, sf_dir), base(spark, sf_dir), 2).where("id <> query_id")
    return rounded(topk.top_per_key(found.drop("rank"), "query_id", 1, "distance", "id").drop("rank"), "distance")


@query(f"WITH {E}, {knn_sql()} {OUT} knn")
def bucket_search_equals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(buckets.search(asked(spark, sf_dir), base(spark, sf_dir), K), "distance")


# --- vectors and store -----------------------------------------------------------------------------------------------------


@query("SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * p[2])), 6) AS dot, round(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x)), 6) AS squared_norm FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def vec_dot_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    one = rows.where("id = 0").select(F.col("vector").alias("_one"))
    return rows.crossJoin(F.broadcast(one)).select("id", F.round(vectors.dot("vector", "_one"), 6).alias("dot"), F.round(vectors.squared_norm("vector"), 6).alias("squared_norm"))


@query(f"SELECT a.label AS label_a, b.label AS label_b, count(*) AS pairs, round(avg(sqrt({D('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')})), 6) AS mean_distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2")
def vec_pairwise_label_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the asked rows of one label to all rows of another."""
    rows = load(spark, sf_dir, "embeddings")
    a = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"), F.col("label").alias("label_a"))
    b = rows.select(F.col("vec_id").alias("j"), F.col("embedding").alias("y"), F.col("label").alias("label_b"))
    pairs = b.join(F.broadcast(a), F.col("i") != F.col("j"))
    return pairs.groupBy("label_a", "label_b").agg(F.count("*").alias("pairs"), F.round(F.avg(vectors.l2_distance("x", "y")), 6).alias("mean_distance"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], embedding::DOUBLE[]), lambda p: (p[1] + p[2]) / 4)), 6) AS half_sum FROM embeddings")
def vec_add_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = vectors.divide(vectors.add("vector", "vector"), F.lit(4.0))
    return base(spark, sf_dir).select("id", F.round(F.aggregate(half, F.lit(0.0), lambda t, x: t + x), 6).alias("half_sum"))


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.slice("vector", 1, 40)
    return base(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 7 == 0, short).otherwise(F.col("vector")))


@query("SELECT vec_id AS id, len(embedding) AS width FROM embeddings WHERE vec_id % 7 <> 0 AND len(embedding) = 64")
def store_dim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.conform(_ragged(spark, sf_dir), 64).select("id", F.size("vector").cast("long").alias("width"))


@query("SELECT vec_id AS id, 64 AS width, round(list_sum(list_transform(CASE WHEN vec_id % 7 = 0 THEN embedding[1:40] ELSE embedding END, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def store_pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.conform(_ragged(spark, sf_dir), 64, "pad")
    return rows.select("id", F.size("vector").alias("width"), F.round(F.aggregate(vectors.as_double("vector"), F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, round(CASE WHEN vec_id % 3 = 0 THEN embedding[2] ELSE embedding[1] END, 6) AS first FROM embeddings")
def store_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = base(spark, sf_dir).select("id", F.lit(1).alias("version"), F.col("vector")[0].alias("first"))
    new = base(spark, sf_dir).where("id % 3 = 0").select("id", F.lit(2).alias("version"), F.col("vector")[1].alias("first"))
    return rounded(store.upsert(store.append(old, new), "id", "version"), "first")


@query("SELECT 2 * count(*) AS inserted FROM embeddings")
def store_append_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.inserted(store.append(base(spark, sf_dir), base(spark, sf_dir)))


@query("SELECT vec_id // 64 AS batch, count(*) AS inserted FROM embeddings GROUP BY 1")
def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.batches(base(spark, sf_dir), "id", 64)


@query("SELECT vec_id // 100 AS shard, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n FROM embeddings GROUP BY 1")
def store_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.shards(base(spark, sf_dir), "id", 100).groupBy("shard").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id // 50 NOT IN (SELECT vec_id // 50 FROM embeddings WHERE vec_id < 200)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = base(spark, sf_dir).select("id", F.floor(F.col("id") / 50).alias("chunk"))
    return store.unfinished(work, work.where("id < 200").select("chunk").distinct(), "chunk").select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id < 37")
def query_prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.prefix(base(spark, sf_dir), 37, "id").select("id")


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS distinct_ids FROM embeddings")
def shuffle_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.shuffled(base(spark, sf_dir), 42, "id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"))


@query(f"WITH {E} SELECT c.range AS pick, e.id FROM range(50) c JOIN e ON e.o = (c.range * (SELECT count(*) FROM e)) // 50")
def sample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return topk.stride(topk.with_ordinal(rows, "id"), rows.count(), 50).select("pick", "id")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squared_norm, len(embedding)::INTEGER AS width FROM embeddings")
def fvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as parts of an fvecs file in the shared folder and read back by the data source."""
    path = new_path(spark, "fvecs")
    vecs.write_parts(base(spark, sf_dir), path)
    vecs.register(spark)
    return spark.read.format("vecs").option("kind", "f").option("path", path).load().select("id", F.round(vectors.squared_norm("vector"), 6).alias("squared_norm"), F.size("vector").alias("width"))


# --- clustering and inverted lists -----------------------------------------------------------------------------------------


@query(f"WITH {E}, {C0} SELECT cid AS cluster_id, round(list_sum(cv), 6) AS total FROM c0")
def init_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.init_stride(base(spark, sf_dir), LISTS).select("cluster_id", F.round(F.aggregate("centroid", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@query(f"WITH {E}, {C0}, {assign_sql('a0', 'c0')} SELECT id, cid AS cluster_id FROM a0")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    return kmeans.assign(rows, kmeans.init_stride(rows, LISTS)).select("id", "cluster_id")


@query(f"WITH {E}, {C0}, {assign_sql('a0', 'c0')}, {C1} SELECT cid AS cluster_id, p, round(cv[p], 6) AS x FROM c1, (SELECT unnest(range(1, 65)) AS p)")
def kmeans_one_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    centroids, _ = kmeans.fit(rows, kmeans.init_stride(rows, LISTS), 1)
    return centroids.select("cluster_id", F.posexplode("centroid").alias("p", "x")).select("cluster_id", (F.col("p") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


def lloyd_sql(rounds: int) -> str:
    out = []
    for i in range(rounds):
        out.append(assign_sql(f"a{i}", f"c{i}").replace(" AS (", " AS MATERIALIZED (", 1))
        out.append(f"m{i + 1} AS (SELECT cid, list(m ORDER BY p) AS mv FROM (SELECT cid, p, avg(v[p]) AS m FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM e))) AS p) GROUP BY cid, p) GROUP BY cid)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce(mv, cv) AS cv FROM c{i} LEFT JOIN m{i + 1} ON c{i}.cid = m{i + 1}.cid)")
    return ", ".join(out)


@query(f"WITH {E}, {C0}, {lloyd_sql(5)} SELECT cid AS cluster_id, (p - 1)::INTEGER AS p, round(cv[p], 6) AS x FROM c5, (SELECT unnest(range(1, 65)) AS p)")
def kmeans_lloyd_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    centroids, _ = kmeans.fit(rows, kmeans.init_stride(rows, LISTS), 5)
    return centroids.select("cluster_id", F.posexplode("centroid").alias("p", "x")).select("cluster_id", "p", F.round("x", 6).alias("x"))


#: Indexes and their probes by application and folder: postings are written once and read by all queries of a session.
_built: dict[tuple[str, str], tuple[ivf.Index, int]] = {}


def indexed(spark: SparkSession, sf_dir: str) -> tuple[ivf.Index, int]:
    """The index of a folder's embeddings and its probes, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        index = ivf.build(base(spark, sf_dir), LISTS, 1, path=new_path(spark, "postings"))
        _built[key] = index, ivf.probes_for(asked(spark, sf_dir), base(spark, sf_dir), index, K, RECALL)
    return _built[key]


def _index(spark: SparkSession, sf_dir: str) -> ivf.Index:
    return indexed(spark, sf_dir)[0]


def _probes(spark: SparkSession, sf_dir: str) -> int:
    return indexed(spark, sf_dir)[1]


@query(f"WITH {INDEX} SELECT c1.cid AS cluster_id, count(a1.id) AS n FROM c1 LEFT JOIN a1 ON c1.cid = a1.cid GROUP BY 1")
def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.list_sizes(_index(spark, sf_dir))


@query(f"WITH {INDEX}, s AS (SELECT c1.cid, count(a1.id) AS n FROM c1 LEFT JOIN a1 ON c1.cid = a1.cid GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM s")
def ivf_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ivf.size_stats(_index(spark, sf_dir)), "mean")


@query(f"WITH {INDEX}, {probe_sql()} SELECT query_id, cid AS cluster_id, rk AS probe_rank FROM pr")
def ivf_probe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.probes(asked(spark, sf_dir), _index(spark, sf_dir).centroids, _probes(spark, sf_dir)).drop("_q")


@query(f"WITH {INDEX}, {probe_sql()}, {ivf_sql()} {OUT} ivf")
def ivf_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ivf.search(asked(spark, sf_dir), _index(spark, sf_dir), K, _probes(spark, sf_dir)), "distance")


@query(f"WITH {INDEX}, {probe_sql()}, {ivf_sql()} {OUT} ivf")
def ivf_search_top10_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ivf.search(asked(spark, sf_dir), _index(spark, sf_dir), K, _probes(spark, sf_dir), "sql"), "distance")


@query(f"WITH {INDEX}, {probe_sql()}, {ivf_sql()}, r AS (SELECT count(i.id) / count(*) AS recall FROM knn k LEFT JOIN ivf i ON k.query_id = i.query_id AND k.id = i.id) SELECT ivf.query_id, ivf.rank, ivf.id, (SELECT p FROM np) AS nprobe, round(recall::DOUBLE, 6) AS recall, recall >= {RECALL} AS reached FROM ivf, r")
def ivf_search_recall95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with the fewest probes that reach the recall, beside the recall that its results have."""
    q, nprobe = asked(spark, sf_dir), _probes(spark, sf_dir)
    found = written(ivf.search(q, _index(spark, sf_dir), K, nprobe).drop("distance"))
    recall = metrics.recall_mean(knn.nested(found), knn.ground_truth(q, base(spark, sf_dir), K)).select(F.round("recall", 6).alias("recall"), (F.col("recall") >= RECALL).alias("reached"))
    return found.join(F.broadcast(recall)).select("query_id", "rank", "id", F.lit(nprobe).cast("long").alias("nprobe"), "recall", "reached")


@query(f"WITH {INDEX}, {probe_sql()} SELECT p AS nprobe, round(recall::DOUBLE, 6) AS recall FROM byp")
def ivf_recall_by_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir)
    truth = knn.exact_knn(q, base(spark, sf_dir), K).select("query_id", "id")
    return rounded(ivf.recall_by_probes(ivf.list_ranks(q, _index(spark, sf_dir), truth)), "recall")


@query(f"WITH n AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT least(greatest(n // 2048, 128), 512) AS l FROM n) SELECT (CASE WHEN l > 256 THEN 512 WHEN l > 128 THEN 256 ELSE 128 END)::BIGINT AS lists, (CASE WHEN l > 256 THEN 16 WHEN l > 128 THEN 14 ELSE 12 END)::BIGINT AS probes FROM l")
def ivf_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, probes = ivf.adaptive(base(spark, sf_dir).count())
    return spark.createDataFrame([(lists, probes)], "lists long, probes long")


@query(f"WITH {E}, {knn_sql()} SELECT step, builds, query_id, rank, id FROM knn, (VALUES ('built', 1), ('grown', 1), ('rebuilt', 2)) t(step, builds)")
def ivf_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built by the first search, grown by an insert, and built anew after an insert that made it stale, all lists probed."""
    q, rows, out = asked(spark, sf_dir), base(spark, sf_dir), []
    late = rows.where("id % 4 = 1")
    grown = ivf.Store(rows.where("id % 4 <> 1"), new_path(spark, "store"), "incremental", threshold=1, lists=LISTS)
    stale = ivf.Store(rows.where("id % 4 <> 1"), new_path(spark, "store"), "always", threshold=1, lists=LISTS)
    whole = ivf.Store(rows, new_path(spark, "store"), "always", threshold=1, lists=LISTS, eager=True)
    for store_, step in ((whole, "built"), (grown, "grown"), (stale, "rebuilt")):
        store_.ready()
        if store_ is not whole:
            store_.insert(late)
        found = store_.search(q, K, LISTS)
        out.append(found.select(F.lit(step).alias("step"), F.lit(store_.builds).alias("builds"), "query_id", "rank", "id"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {E}, {knn_sql()} {OUT} knn")
def ivf_search_all_probes_equals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ivf.search(asked(spark, sf_dir), _index(spark, sf_dir), K, LISTS), "distance")


@query(f"""WITH {INDEX}, {probe_sql()}, pool AS (SELECT cid, id, v FROM a1 WHERE id % 10 <> 0 OR id < 100),
cand AS (SELECT query_id, id, {D('qv', 'v')} AS d2 FROM pr JOIN pool ON pr.cid = pool.cid UNION ALL SELECT q.id, b.id, {D('q.v', 'b.v')} FROM e q, e b WHERE {ASKED} AND b.id % 10 = 0 AND b.id >= 100)
SELECT query_id, rank, id, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM cand) WHERE rank <= {K}""")
def ivf_with_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, waits = _index(spark, sf_dir), "id % 10 = 0 AND id >= 100"
    index = ivf.stage(ivf.Index(whole.centroids, whole.postings.where(f"NOT ({waits})")), base(spark, sf_dir).where(waits))
    return rounded(ivf.search(asked(spark, sf_dir), index, K, _probes(spark, sf_dir)), "distance")


@query(f"WITH {INDEX}, {probe_sql()}, {ivf_sql()} {OUT} ivf")
def ivf_incremental_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added to built lists are found like rows that were there."""
    whole, late = _index(spark, sf_dir), "id % 5 = 0"
    index = ivf.add(ivf.Index(whole.centroids, whole.postings.where(f"NOT ({late})")), base(spark, sf_dir).where(late))
    return rounded(ivf.search(asked(spark, sf_dir), index, K, _probes(spark, sf_dir)), "distance")


@query(f"SELECT vec_id AS id, (vec_id * 7) % {LISTS} AS cluster_id FROM embeddings")
def ivf_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.round_robin(base(spark, sf_dir), LISTS, "id").select("id", "cluster_id")


# --- evaluation ------------------------------------------------------------------------------------------------------------

_NESTED = f"{INDEX}, {probe_sql()}, {ivf_sql()}, r AS (SELECT k.query_id, count(i.id) / {K}.0 AS recall FROM knn k LEFT JOIN ivf i ON k.query_id = i.query_id AND k.id = i.id GROUP BY 1)"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = asked(spark, sf_dir)
    return knn.nested(ivf.search(q, _index(spark, sf_dir), K, _probes(spark, sf_dir))), knn.ground_truth(q, base(spark, sf_dir), 100)


@query(f"WITH {_NESTED} SELECT query_id, round(recall::DOUBLE, 6) AS recall FROM r")
def recall_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recall_per_query(*_both(spark, sf_dir)), "recall")


@query(f"WITH {_NESTED} SELECT round(avg(recall)::DOUBLE, 6) AS recall FROM r")
def recall_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recall_mean(*_both(spark, sf_dir)), "recall")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.percentiles(load(spark, sf_dir, "events"), ["event_type"], "value", 50, 95, 99), "p50", "p95", "p99")


_RECALL = "avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END)"


@query(f"""SELECT user_id, count(*) AS total_queries, round(avg(value), 6) AS avg_latency_ms, round(quantile_cont(value, 0.5), 6) AS p50_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms,
round(quantile_cont(value, 0.99), 6) AS p99_latency_ms, round(sum(value) / 1000, 6) AS duration_secs, round({_RECALL}, 6) AS recall, round(CASE WHEN sum(value) / 1000 <= 0 THEN 0 ELSE count(*) / (sum(value) / 1000) END, 4) AS qps, {_RECALL} >= 0.8 AS recall_passed FROM events GROUP BY 1""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall = F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0))
    out = metrics.summary(load(spark, sf_dir, "events"), "value", F.sum("value") / 1000, recall, 0.8, "user_id")
    return rounded(out, "avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "duration_secs", "recall").withColumn("qps", F.round("qps", 4))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 150000 THEN 0 ELSE o_totalprice END::DOUBLE AS score FROM orders")
def recall_gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select("o_orderkey", metrics.gated_score(price, price, 150000.0).alias("score"))


_SIMILAR = "len(list_intersect(a.ids, b.ids)) / (len(a.ids) + len(b.ids) - len(list_intersect(a.ids, b.ids)))::DOUBLE"


def pairs_sql(most: int) -> str:
    """Sets of results, and the pairs (i, j): all if they are at most ``most``, else as many evenly spaced ones."""
    return f"""{E}, {knn_sql()}, s AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, ids FROM (SELECT query_id, list(id) AS ids FROM knn GROUP BY query_id)),
ij AS (SELECT a.i AS i, b.i AS j, row_number() OVER (ORDER BY a.i, b.i) - 1 AS p FROM s a JOIN s b ON a.i < b.i), total AS (SELECT count(*) AS t FROM ij),
pick AS (SELECT DISTINCT CASE WHEN t <= {most} THEN r.range ELSE (r.range * t) // {most} END AS p FROM range({most}) r, total WHERE r.range < t),
chosen AS (SELECT ij.i, ij.j, {_SIMILAR} AS similarity FROM pick JOIN ij USING (p) JOIN s a ON a.i = ij.i JOIN s b ON b.i = ij.j)"""




@query(f"WITH {pairs_sql(500)} SELECT i, j, round(similarity, 6) AS similarity FROM chosen")
def jaccard_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of results while they are 500 at most."""
    return rounded(anticheat.pairs(knn.ground_truth(asked(spark, sf_dir), base(spark, sf_dir), K)), "similarity")


@query(f"WITH {pairs_sql(100)} SELECT i, j, round(similarity, 6) AS similarity FROM chosen")
def jaccard_sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anticheat.pairs(knn.ground_truth(asked(spark, sf_dir), base(spark, sf_dir), K), 100), "similarity")


_SAID = "CASE WHEN x <= 0.8 THEN printf('OK: Average Jaccard similarity %.4f is within threshold %.2f. Unique IDs: %d/%d total.', x, 0.8, u, t) ELSE printf('SUSPICIOUS: Average Jaccard similarity %.4f exceeds threshold %.2f. Unique IDs: %d/%d total. Possible hardcoded results detected.', x, 0.8, u, t) END"


@query(f"WITH {pairs_sql(500)}, m AS (SELECT avg(similarity) AS x, (SELECT count(DISTINCT id) FROM knn) AS u, (SELECT count(*) FROM knn) AS t FROM chosen) SELECT round(x, 6) AS avg_similarity, x <= 0.8 AS passed, u AS unique_ids, t AS total_results, {_SAID} AS message FROM m")
def anti_cheat_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anticheat.verdict(knn.ground_truth(asked(spark, sf_dir), base(spark, sf_dir), K)), "avg_similarity")


@query("SELECT 'none' AS kind, true AS passed, 0::BIGINT AS total_results, 'No results to analyze.' AS message UNION ALL SELECT 'empty', true, 0, 'All result sets are empty.'")
def anti_cheat_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "query_id long, neighbors array<long>")
    empty = asked(spark, sf_dir).select("query_id", F.array().cast("array<long>").alias("neighbors"))
    told = lambda rows, kind: anticheat.verdict(rows).select(F.lit(kind).alias("kind"), "passed", "total_results", "message")
    return told(none, "none").unionByName(told(empty, "empty"))


@query("SELECT user_id, recall >= 0.8 AS passed, CASE WHEN recall >= 0.8 THEN printf('Correctness test PASSED: recall %.4f >= threshold %.4f', recall, 0.8) ELSE printf('Correctness test FAILED: recall %.4f < threshold %.4f', recall, 0.8) END AS message FROM (SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall FROM events GROUP BY 1)")
def correctness_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("recall"))
    return metrics.correctness(runs, "recall", 0.8).drop("recall")


@query("""SELECT event_id, user_id, value, prev AS previous_value, CASE WHEN prev IS NULL THEN NULL WHEN prev > 0 THEN round((value - prev) / prev * 100, 2) ELSE 0 END::DOUBLE AS value_change_pct
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def run_comparison_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return metrics.compared(rows, "user_id", ["ts", "event_id"], "value").drop("ts")


@query("""SELECT event_id, user_id, best, coalesce(own > coalesce(earlier, -1e308), false) AS improved FROM (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS own,
max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best,
max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM events)""")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    return metrics.best_so_far(rows, "user_id", ["ts", "event_id"], "value", F.col("event_type") != "error").select("event_id", "user_id", "best", "improved")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, CASE WHEN event_type = 'error' THEN 0 ELSE value END::DOUBLE AS score FROM events")
def qps_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_type") != "error", F.col("value"))
    return leaderboard.progression(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], score).select("user_id", "iteration", "score")


@query("SELECT event_id, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS iteration FROM events")
def iteration_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.iterations(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "iteration")


# --- board -----------------------------------------------------------------------------------------------------------------

_PASSED = "o_orderstatus = 'F'"


@query(f"SELECT o_orderkey, CASE WHEN {_PASSED} THEN o_totalprice ELSE 0 END::DOUBLE AS score, row_number() OVER (ORDER BY CASE WHEN {_PASSED} THEN o_totalprice ELSE 0 END DESC, o_totalprice DESC, o_orderkey) AS rank FROM orders")
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = load(spark, sf_dir, "orders").withColumn("score", F.when(F.expr(_PASSED), F.col("o_totalprice")).otherwise(0.0))
    return leaderboard.ranked(board, F.desc("score"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "score", "rank")


@query(f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders WHERE {_PASSED}) WHERE rk = 1")
def best_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return leaderboard.best_per(rows, "o_custkey", "o_totalprice", "o_orderkey", F.expr(_PASSED)).select("o_custkey", "o_orderkey", "o_totalprice")


_SOURCES = "(SELECT o_custkey, max(o_totalprice) AS score, 1 AS priority FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, max(o_totalprice), 2 FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal, 3 FROM customer)"


@query(f"SELECT o_custkey, score, priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, priority) AS rk FROM {_SOURCES}) WHERE rk = 1")
def best_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    best = lambda rows, p: rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("score")).withColumn("priority", F.lit(p))
    last = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("score"), F.lit(3).alias("priority"))
    return leaderboard.best_of_sources(best(orders.where(_PASSED), 1).unionByName(best(orders, 2)).unionByName(last), "o_custkey", "score", "priority")


@query("SELECT o_custkey, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def models_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.models_in_order(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT count(*) + (SELECT count(*) FROM customer) AS n, sum(o_totalprice)::DECIMAL(18, 2)::VARCHAR AS total FROM orders")
def board_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("score"))
    more = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = leaderboard.append(board, more)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("score").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("total"))


@query("SELECT c_custkey, 'entry-' || c_mktsegment AS model, (c_custkey % 12)::INTEGER AS turn, 'entry-' || c_mktsegment || ' (Turn ' || (c_custkey % 12) || ')' AS label FROM customer")
def turn_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("entry-"), "c_mktsegment", F.lit("-turn-"), (F.col("c_custkey") % 12).cast("string"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.model_name(entry).alias("model"), text.turn_number(entry).alias("turn"), text.turn_label(entry).alias("label"))


@query("SELECT (max(c_custkey) + 1)::BIGINT AS next_run, printf('benchmark_%03d.json', max(c_custkey) + 1) AS file FROM customer")
def next_round_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select(text.run_file(F.col("c_custkey")).alias("path"))
    return metrics.next_run(rows, text.run_number(F.col("path")).cast("long")).select("next_run", text.run_file(F.col("next_run")).alias("file"))


# --- logs ------------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.counts(load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error")), "event_type")


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def log_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("""SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1)::BIGINT AS call_turn, coalesce(length(c.text), -1) AS call_chars, coalesce(length(r.text), -1) AS result_chars
FROM (SELECT * FROM conversations WHERE role = 'user') c FULL JOIN (SELECT * FROM conversations WHERE role = 'assistant') r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1""")
def tool_call_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    calls = rows.where("role = 'user'").select("conv_id", F.col("turn").cast("long").alias("call_turn"), F.length("text").cast("long").alias("call_chars"))
    results = rows.where("role = 'assistant'").select("conv_id", (F.col("turn").cast("long") - 1).alias("call_turn"), F.length("text").cast("long").alias("result_chars"))
    return logs.pair(calls, results, "conv_id", "call_turn").fillna(-1, ["call_chars", "result_chars"])


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS used, greatest(3 - count(*) FILTER (WHERE role = 'user'), 0) AS remaining, count(*) FILTER (WHERE role = 'user') >= 3 AS limit_reached FROM conversations GROUP BY 1")
def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.counters(load(spark, sf_dir, "conversations"), "conv_id", F.col("role") == "user", 3)


@query("SELECT conv_id, max(length(text)) FILTER (WHERE turn = 0) AS model FROM conversations GROUP BY 1 HAVING max(role) FILTER (WHERE turn = 0) = 'system'")
def first_line_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "session_start").otherwise("llm_request").alias("event"), F.length("text").cast("long").alias("model"))
    return logs.first_model(rows, "conv_id", "turn")


_PROFILE = ["# Samples: 9K", "", "    55.50%  search  [.] nearest", "    20.25%  search  [.] scan<f32>", " 1.10%  search  [k] page_fault [x]", "    not a row", "0.07%  sh  [k] read", "    20.25%  search  [.] merge"]


@query("SELECT * FROM (VALUES ('nearest', 55.5, 9717), ('merge', 20.25, 9717), ('scan<f32>', 20.25, 9717), ('page_fault [x]', 1.1, 9717), ('read', 0.07, 9717)) AS t(\"function\", percentage, total_samples)")
def profile_parse_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = logs.profile(spark.createDataFrame([(x,) for x in _PROFILE], "value string"))
    return top.crossJoin(F.broadcast(logs.profile_samples(top)))


@query("SELECT doc_id, CASE WHEN strlen(text) > 200 THEN 1 ELSE 0 END AS cut, CASE WHEN strlen(text) > 200 THEN left(text, 40) ELSE text END AS head FROM documents")
def truncate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.truncated(F.col("text"), 200)
    cut = F.endswith(out, F.lit("... [truncated]"))
    return load(spark, sf_dir, "documents").select("doc_id", cut.cast("int").alias("cut"), F.when(cut, F.left(out, F.lit(40))).otherwise(out).alias("head"))


# --- streams ---------------------------------------------------------------------------------------------------------------


def _drained(spark: SparkSession, rows: DataFrame, mode: str, schema: str) -> DataFrame:
    """What a stream has given when all its input is read. Tables go to the checkpoint folder."""
    path = new_path(spark, "stream")

    def told(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    live.each_change(rows, told, f"{path}/state", mode=mode).awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files. Only as a pattern may a stream's path be a file."""
    return spark.readStream.schema(load(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, live.counts(_stream(spark, sf_dir, "events"), "event_type"), "complete", "event_type string, n long")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = live.windowed_counts(events, "ts", "event_type").select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "n")
    return _drained(spark, rows, "complete", "event_type string, minute string, n long")


@query(f"WITH {E}, {C0}, {assign_sql('a0', 'c0')} SELECT id, cid AS cluster_id FROM a0")
def stream_ivf_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that come as a stream, assigned to strided centroids."""
    path = new_path(spark, "stream")
    index = ivf.Index(kmeans.init_stride(base(spark, sf_dir), LISTS), spark.createDataFrame([], "cluster_id long, id long, vector array<float>"))
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    live.maintain(rows, index, f"{path}/postings", f"{path}/state").awaitTermination()
    return spark.read.schema("cluster_id long, id long, vector array<float>").option("recursiveFileLookup", True).parquet(f"{path}/postings").select("id", "cluster_id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_exact_top10(spark, sf_dir)
