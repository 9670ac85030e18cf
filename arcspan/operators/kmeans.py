"""Lloyd's k-means with a set order of everything: strided or seeded start, ties to the least cluster, empty clusters keep their
centroid, stop when nothing changes. Centroids are a bounded model (clusters x width) and are broadcast; rows never move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspan.functions.vectors import l2_squared
from arcspan.operators.knn import exact_d2, matrix
from arcspan.operators.topk import sampled, stride, with_ordinal

#: Bytes of centroids that may be broadcast.
MOST_MODEL_BYTES = 256 << 20


def init_stride(base: DataFrame, k: int) -> DataFrame:
    """(cluster_id, centroid): the rows of ordinals floor(c * n / k), ordered by id."""
    n = base.count()
    picked = stride(with_ordinal(base, "id"), n, min(k, n))
    return picked.select(F.col("pick").cast("long").alias("cluster_id"), F.col("vector").cast("array<double>").alias("centroid"))


def init_seeded(base: DataFrame, k: int, seed: int) -> DataFrame:
    rows = sampled(base, seed, "id", k)
    return with_ordinal(rows, "id", "cluster_id").select("cluster_id", F.col("vector").cast("array<double>").alias("centroid"))


def training_sample(base: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced rows."""
    return stride(with_ordinal(base, "id"), base.count(), n).drop("pick", "ordinal")


def model(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cluster ids and centroids as arrays; a model over the bound is refused."""
    rows = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if rows[0] * (rows[1] or 0) * 8 > MOST_MODEL_BYTES:
        raise ValueError("the centroids are too large to broadcast")
    got = centroids.orderBy("cluster_id").collect()
    return np.array([r["cluster_id"] for r in got], np.int64), np.array([r["centroid"] for r in got], np.float64)


def nearest(b: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's nearest centroid and its exact squared distance; the first of equals."""
    near = (b * b).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2.0 * (b @ centroids.T)
    slack = 1e-9 * (1.0 + (b * b).sum(1) + float((centroids * centroids).sum(1).max()))
    row, col = np.nonzero(near <= (near.min(1) + slack)[:, None])
    d2 = exact_d2(b[row], centroids[col])
    order = np.lexsort((col, d2, row))
    first = order[np.searchsorted(row[order], np.arange(len(b)))]
    return col[first], d2[first]


def assign(base: DataFrame, centroids: DataFrame, method: str = "arrow") -> DataFrame:
    """``base`` (id, vector) with cluster_id."""
    if method == "sql":
        best = F.min(F.struct(l2_squared("vector", "centroid").alias("d2"), "cluster_id")).alias("best")
        pairs = base.crossJoin(F.broadcast(centroids))
        return pairs.groupBy("id").agg(best, F.first("vector").alias("vector")).select("id", "vector", F.col("best.cluster_id").alias("cluster_id"))
    sent = base.sparkSession.sparkContext.broadcast(model(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = sent.value
        for batch in batches:
            if batch.num_rows:
                at, _ = nearest(matrix(batch.column(1), c.shape[1]), c)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[at])], names=["id", "vector", "cluster_id"])

    read = base.where("vector IS NOT NULL").select("id", "vector")
    return read.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema) + ", cluster_id long")


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Mean of each cluster; clusters without rows keep their centroid."""
    cells = assigned.select("cluster_id", F.posexplode(F.col("vector").cast("array<double>")).alias("p", "x"))
    means = cells.groupBy("cluster_id", "p").agg(F.avg("x").alias("m")).groupBy("cluster_id")
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("mean"))
    return centroids.join(means, "cluster_id", "left").select("cluster_id", F.coalesce("mean", "centroid").alias("centroid"))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks, sorted by cluster and task, added up by cluster."""
    total: dict[int, list] = {}
    for batch in batches:
        for place, n, check, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), matrix(batch.column(4)), strict=True):
            own = total.setdefault(place, [0, 0, 0.0])
            own[0], own[1], own[2] = own[0] + n, own[1] + check, own[2] + sums
    rows = list(total.values())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["place", "n", "check_sum", "sums"])


def fit(base: DataFrame, centroids: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """Lloyd's rounds in arrays: each task sums its rows by cluster, sums are added by cluster in order of the tasks, so that results
    don't depend on which ends first, and the model stays on the driver.

    Gives the centroids and the rounds done; it stops early when no assignment changes, told by the assignments' check sum.
    """
    spark = base.sparkSession
    ids, c = model(centroids)
    before, done = None, 0
    for done in range(1, rounds + 1):  # noqa: B007
        sent = spark.sparkContext.broadcast((ids, c))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, c = sent.value
            sums, counts, check = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for batch in batches:
                if batch.num_rows:
                    b = matrix(batch.column(1), c.shape[1])
                    at, _ = nearest(b, c)
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[at[order][first]] += np.add.reduceat(b[order], first)
                    counts += np.bincount(at, minlength=len(c))
                    np.add.at(check, at, (batch.column(0).to_numpy().astype(np.int64) * 2654435761) & 0x3FFFFFFF)
            seen = np.flatnonzero(counts)
            task = pa.array(np.full(len(seen), TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([pa.array(seen), task, pa.array(counts[seen]), pa.array(check[seen]), pa.array(list(sums[seen]), pa.list_(pa.float64()))], names=["place", "task", "n", "check_sum", "sums"])

        parts = base.where("vector IS NOT NULL").select("id", "vector").mapInArrow(run, "place long, task long, n long, check_sum long, sums array<double>")
        got = parts.repartition("place").sortWithinPartitions("place", "task").mapInArrow(_added, "place long, n long, check_sum long, sums array<double>").collect()
        state = {(r["place"], r["n"], r["check_sum"]) for r in got}
        for r in got:
            c[r["place"]] = np.array(r["sums"]) / r["n"]
        if state == before:
            break
        before = state
    out = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, c, strict=True)], "cluster_id long, centroid array<double>")
    return out, done


def lloyd(base: DataFrame, centroids: DataFrame, rounds: int) -> DataFrame:
    """Lloyd's rounds as DataFrame steps, for small tables and checks."""
    for _ in range(rounds):
        centroids = update(assign(base, centroids, "sql"), centroids)
    return centroids
