"""Inverted lists: rows grouped by their nearest centroid, and searches that read only the nearest lists.

An index is two tables. Postings are written partitioned by cluster, so a search reads the files of its probes alone; new rows are
assigned to the centroids there are and appended, or wait as a staging table that searches read as well. How many lists to probe
follows from the recall that is asked: a true neighbour is found exactly if its list is probed, so the ranks of the true neighbours'
lists give the recall of any number of probes (:func:`probes_for`).

:class:`Store` is the life of an index: rows are inserted, the index goes stale or takes new rows in, and it is built when a search
needs it or when the table reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspan.functions.vectors import l2_squared
from arcspan.operators import kmeans
from arcspan.operators.knn import Best, candidates, exact_d2, exact_knn, finish, matrix, query_blocks
from arcspan.operators.topk import top_per_key
from arcspan.operators.written import written


@dataclass(frozen=True)
class Index:
    centroids: DataFrame  # cluster_id, centroid
    postings: DataFrame  # cluster_id, id, vector
    staging: DataFrame | None = None  # id, vector


def default_lists(n: int) -> int:
    return max(1, int(n**0.5))


def adaptive(n: int) -> tuple[int, int]:
    """Lists, a power of two from 128 to 512, and probes by them."""
    lists = 1 << (min(max(n // 2048, 128), 512) - 1).bit_length()
    return lists, 16 if lists >= 512 else 14 if lists >= 256 else 12


def build(base: DataFrame, lists: int | None = None, rounds: int = 1, sample: int | None = None, path: str | None = None, method: str = "arrow") -> Index:
    """Train on ``sample`` evenly spaced rows (all if none), then assign every row. With ``path``, postings are written there."""
    n = base.count()
    lists = min(lists or default_lists(n), max(n, 1))
    train = kmeans.training_sample(base, sample) if sample and sample < n else base
    start = kmeans.init_stride(train, lists)
    centroids = kmeans.lloyd(train, start, rounds) if method == "sql" else kmeans.fit(train, start, rounds)[0] if rounds else start
    postings = kmeans.assign(base, centroids, method).select("cluster_id", "id", "vector")
    if path:
        # a list may hold most rows: it is written by as many tasks as it has files' worth
        postings = written(postings, "assigned")
        files = written(postings.groupBy("cluster_id").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files")), "files")
        tasks = files.agg(F.sum("files")).first()[0] or 1
        dealt = postings.join(F.broadcast(files), "cluster_id").repartition(tasks, "cluster_id", F.pmod(F.xxhash64("id"), F.col("files"))).drop("files")
        dealt.sortWithinPartitions("cluster_id", "id").write.mode("overwrite").partitionBy("cluster_id").parquet(path)
        postings = base.sparkSession.read.schema("id long, vector array<float>, cluster_id long").parquet(path).select("cluster_id", "id", "vector")
        centroids = written(centroids, "centroids")
    return Index(centroids, postings)


#: Rows of a list in a file, about. (Lists are at most as many as a broadcast model has centroids.)
FILE_ROWS = 1 << 20


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, vector, cluster_id, probe_rank) of the nearest lists."""
    far = queries.crossJoin(F.broadcast(centroids)).withColumn("c2", l2_squared("vector", "centroid"))
    return top_per_key(far, "query_id", nprobe, "c2", "cluster_id", rank="probe_rank").select("query_id", F.col("vector").alias("_q"), "cluster_id", "probe_rank")


def _nearest_lists(q: np.ndarray, c: np.ndarray, nprobe: int) -> np.ndarray:
    """Places of the nearest centroids of each query, in no order; of equals the first ones.

    A matrix product may differ from the sums over dimensions in the last bits, so where it can't tell the last list probed from the
    first one left out, the sums decide.
    """
    if nprobe >= len(c):
        return np.broadcast_to(np.arange(len(c)), (len(q), len(c)))
    own = (c * c).sum(1)
    near = own[None] - 2.0 * (q @ c.T)
    order = np.argpartition(near, [nprobe - 1, nprobe], axis=1)
    edge = np.take_along_axis(near, order[:, nprobe - 1 : nprobe + 1], axis=1)
    unsure = np.flatnonzero(edge[:, 1] - edge[:, 0] < 1e-9 * (1.0 + (q * q).sum(1) + own.max()))
    out = order[:, :nprobe]
    for i in unsure.tolist():
        out[i] = np.argsort(exact_d2(np.broadcast_to(q[i], c.shape), c), kind="stable")[:nprobe]
    return out


def _probed(queries: DataFrame, index: Index, k: int, nprobe: int) -> DataFrame:
    """Candidates (query_id, id, d2) in arrays: blocks of queries are broadcast with their lists, as in an exact search; a task holds
    the rows of a list against the queries that probe it, keeps the best ``k`` of each, and only those are shuffled."""
    spark = index.postings.sparkSession
    cluster, c = kmeans.model(index.centroids)
    out = None
    queries = queries.where("vector IS NOT NULL")
    for ids, rows in query_blocks(queries, c.shape[1] if c.size else 1):
        near = _nearest_lists(rows, c, nprobe)
        asked = {int(cluster[at]): np.flatnonzero((near == at).any(1)) for at in np.unique(near)}
        sent = spark.sparkContext.broadcast((ids, rows, asked))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q, asked = sent.value
            best = Best(q, k)
            for batch in batches:
                lists, own, b = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), q.shape[1])
                for one in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == one)
                    best.see(own[at], b[at], asked[one])
            yield best.rows(names)

        part = index.postings.where(F.col("cluster_id").isin(sorted(asked))).select(F.col("cluster_id").cast("long"), F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, d2 double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, d2 double")


def search(queries: DataFrame, index: Index, k: int, nprobe: int, method: str = "arrow") -> DataFrame:
    """(query_id, rank, id, distance) of the nearest rows among the probed lists and the staging rows."""
    if method == "sql":
        found = probes(queries, index.centroids, nprobe).join(index.postings, "cluster_id").select("query_id", "id", l2_squared("_q", "vector").alias("d2"))
    else:
        found = _probed(queries, index, k, nprobe)
    if index.staging is not None:
        found = found.unionByName(candidates(queries, index.staging, k, method))
    return finish(found, k)


def list_ranks(queries: DataFrame, index: Index, truth: DataFrame) -> DataFrame:
    """(query_id, id, probe_rank) of true neighbours (query_id, id): how many lists a search probes before it has each."""
    lists = index.postings.select("id", "cluster_id").join(truth, "id")
    every = probes(queries, index.centroids, 1 << 30).select("query_id", "cluster_id", "probe_rank")
    return lists.join(every, ["query_id", "cluster_id"]).select("query_id", "id", "probe_rank")


def recall_by_probes(ranks: DataFrame) -> DataFrame:
    """(nprobe, recall): the share of the true neighbours that so many probes find."""
    by = ranks.groupBy(F.col("probe_rank").cast("long").alias("nprobe")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return by.select("nprobe", (F.sum("n").over(Window.orderBy("nprobe")) / total).alias("recall"))  # a row for each number of probes


def probes_for(queries: DataFrame, base: DataFrame, index: Index, k: int, recall: float) -> int:
    """The fewest probes whose recall at ``k`` on these queries, measured against exact search, is at least ``recall``."""
    truth = written(exact_knn(queries, base, k).select("query_id", "id"), "truth")
    found = recall_by_probes(list_ranks(queries, index, truth)).where(F.col("recall") >= recall).agg(F.min("nprobe")).first()[0]
    return int(found) if found is not None else 1


def search_or_scan(queries: DataFrame, base: DataFrame, index: Index | None, k: int, nprobe: int, least_rows: int = 10_000) -> DataFrame:
    """Exact search where a table is too small for lists to pay."""
    if index is None or base.limit(least_rows).count() < least_rows:
        return exact_knn(queries, base, k)
    return search(queries, index, k, nprobe)


def add(index: Index, rows: DataFrame, method: str = "arrow") -> Index:
    """Assign new rows to the centroids there are; nothing else is touched."""
    return replace(index, postings=index.postings.unionByName(kmeans.assign(rows, index.centroids, method).select("cluster_id", "id", "vector")))


def stage(index: Index, rows: DataFrame) -> Index:
    return replace(index, staging=rows if index.staging is None else index.staging.unionByName(rows))


class Store:
    """A vector table and its index, which is built when it has to be.

    ``rebuild`` says what an insert does to a built index: ``"always"`` makes it stale, so that the next search builds it anew, and
    ``"incremental"`` assigns the new rows to the lists there are. Under ``threshold`` rows there is no index and searches scan.
    With ``eager``, an insert that reaches the threshold builds at once; otherwise the first search does.
    """

    def __init__(self, base: DataFrame, path: str, rebuild: str = "always", threshold: int = 10_000, eager: bool = False, lists: int | None = None, rounds: int = 1) -> None:
        if rebuild not in ("always", "incremental"):
            raise ValueError(rebuild)
        self.base, self.path, self.rebuild, self.threshold, self.eager, self.lists, self.rounds = base, path, rebuild, threshold, eager, lists, rounds
        self.index: Index | None = None
        self.dirty, self.builds, self.rows = True, 0, base.count()

    def insert(self, rows: DataFrame) -> int:
        """Append rows; gives how many."""
        n = rows.count()
        self.base, self.rows = self.base.unionByName(rows), self.rows + n
        if self.index is not None and self.rebuild == "incremental":
            self.index = add(self.index, rows)
        else:
            self.dirty = True
        if self.eager:
            self.ready()
        return n

    def ready(self) -> Index | None:
        """The index, built if it is missing or stale and the table is large enough."""
        if self.rows < self.threshold:
            self.index = None
        elif self.dirty or self.index is None:
            self.builds += 1
            self.index = build(self.base, self.lists or adaptive(self.rows)[0], self.rounds, path=f"{self.path}/build={self.builds}")
            self.dirty = False
        return self.index

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        index = self.ready()
        return exact_knn(queries, self.base, k) if index is None else search(queries, index, k, nprobe or adaptive(self.rows)[1])


def round_robin(rows: DataFrame, lists: int, ordinal: str) -> DataFrame:
    """Lists for rows before any centroid is there."""
    return rows.withColumn("cluster_id", F.pmod(F.col(ordinal) * 7, F.lit(lists)))


def list_sizes(index: Index) -> DataFrame:
    """(cluster_id, n), empty lists included."""
    sizes = index.postings.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return index.centroids.select("cluster_id").join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def size_stats(index: Index) -> DataFrame:
    return list_sizes(index).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
