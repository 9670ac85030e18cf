"""Exact nearest neighbours of a stated set of queries.

``sql``: a broadcast nested loop over the queries with fused expressions and a group limit. A part of the rows is searched first; the
``k``-th row found there bounds what can be among the ``k`` nearest of all, so few pairs are left to sort. ``arrow``: blocks of queries are
broadcast, each task keeps the best ``k`` of its rows for every query of the block, and only those are shuffled. A matrix product
finds candidates; their distances are then summed in order of the dimensions, so both methods give the same bits and ranks.
Blocks bound what is broadcast, however many queries there are. Queries and rows without a vector are left out; vectors of unlike
widths are an error, never mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspan.functions.vectors import as_double, l2_squared
from arcspan.operators.topk import top_per_key

#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Distances that are worked out at once.
MOST_CELLS = 1 << 22
#: Widths up to which ``sql`` writes a distance out term by term. Longer code would no longer be compiled by the JVM.
MOST_TERMS = 64


def exact_d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices, summed in order of the columns."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        step = a[:, j] - b[:, j]
        total += step * step
    return total


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of one width as a matrix of doubles. Null vectors, null numbers and other widths are errors."""
    if not len(column):
        return np.zeros((0, width or 0))
    if column.null_count:
        raise ValueError("a vector is null")
    sizes = column.value_lengths().to_numpy()
    width = int(sizes[0]) if width is None else width
    if (sizes != width).any():
        raise ValueError(f"a vector has {int(sizes[sizes != width][0])} numbers instead of {width}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null number")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


class Best:
    """The ``k`` nearest rows of each query so far. Candidates are gathered and put in order from time to time, by :meth:`settle`."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.q, self.k = queries, k
        self.norms = (queries * queries).sum(1)
        self.limit = np.full(len(queries), np.inf)
        self.row, self.id, self.d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def see(self, ids: np.ndarray, b: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Rows to be held against all queries, or against those at the places ``asked``."""
        n = len(self.q) if asked is None else len(asked)
        if not n or not self.k:
            return
        step = max(1, MOST_CELLS // n)
        for at in range(0, len(b), step):
            self._see(ids[at : at + step], b[at : at + step], asked)

    def _see(self, ids: np.ndarray, b: np.ndarray, asked: np.ndarray | None) -> None:
        q, norms, limit = (self.q, self.norms, self.limit) if asked is None else (self.q[asked], self.norms[asked], self.limit[asked])
        own = (b * b).sum(1)
        near = q @ b.T
        near *= -2.0
        near += norms[:, None]
        near += own[None]
        slack = 1e-9 * (1.0 + np.abs(norms) + float(own.max()))
        if b.shape[0] > self.k:
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero(near <= (limit + slack)[:, None])
        self.held.append((row if asked is None else asked[row], ids[col], exact_d2(q[row], b[col])))
        self.waiting += len(row)
        if self.waiting > max(1 << 16, self.k * len(self.q)):
            self.settle()

    def settle(self) -> None:
        """Keep the ``k`` nearest of each query, with ties to the least id."""
        row, ids, d2 = (np.concatenate(x) for x in zip((self.row, self.id, self.d2), *self.held, strict=True))
        self.held, self.waiting = [], 0
        order = np.lexsort((ids, d2, row))
        sorted_ = row[order]
        place = np.arange(len(row)) - np.searchsorted(sorted_, sorted_)
        order = order[place < self.k]
        self.row, self.id, self.d2 = row[order], ids[order], d2[order]
        ends = np.searchsorted(self.row, np.arange(len(self.q)), "right")
        full = ends - np.searchsorted(self.row, np.arange(len(self.q))) == self.k
        self.limit[full] = self.d2[ends[full] - 1]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        """(query_id, id, d2) of what was kept."""
        self.settle()
        return pa.RecordBatch.from_arrays([pa.array(names[self.row].astype(np.int64)), pa.array(self.id), pa.array(self.d2)], names=["query_id", "id", "d2"])


def query_blocks(queries: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    most = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    ids, rows = [], []
    for r in queries.select("query_id", "vector").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield np.array(ids), matrix(pa.array(rows, pa.list_(pa.float64())), width)
            ids, rows = [], []
    if ids:
        yield np.array(ids), matrix(pa.array(rows, pa.list_(pa.float64())), width)


def _arrow(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    spark = base.sparkSession
    queries, base = queries.where("vector IS NOT NULL"), base.where("vector IS NOT NULL")
    first = queries.select(F.size("vector")).first()
    out = None
    for ids, rows in query_blocks(queries, first[0] if first else 1):
        sent = spark.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best = Best(q, k)
            for batch in batches:
                best.see(batch.column(0).to_numpy(), matrix(batch.column(1), q.shape[1]))
            yield best.rows(names)

        part = base.select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, d2 double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, d2 double")


def distances(queries: DataFrame, base: DataFrame) -> DataFrame:
    """All distances of a stated query set: query_id, id, d2. Rows without a vector have none; unlike widths are an error."""
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").alias("_q"))
    wrong = F.raise_error(F.format_string("a vector has %d numbers instead of %d", F.size("vector"), F.size("_q"))).cast("double")
    d2 = F.when(F.size("vector") == F.size("_q"), l2_squared("_q", "vector")).otherwise(wrong)
    return base.where("vector IS NOT NULL").crossJoin(F.broadcast(q)).select("query_id", "id", d2.alias("d2"))


def _fitting(width: int) -> Column:
    """The vector as doubles, and an error for other widths and null numbers."""
    wrong = F.raise_error(F.format_string("a vector has %d numbers instead of %d", F.size("vector"), F.lit(width)))
    null = F.raise_error(F.lit("a vector has a null number"))
    kind = "array<double>"
    return F.when(F.size("vector") != width, wrong.cast(kind)).when(F.exists("vector", lambda x: x.isNull()), null.cast(kind)).otherwise(as_double("vector"))


def _pairs(q: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(query_id, id, d2) and the other columns of ``q``, of all pairs."""
    if 0 < width <= MOST_TERMS:
        steps = [F.get("_q", F.lit(i)) - F.get("_v", F.lit(i)) for i in range(width)]
        d2 = reduce(add, [x * x for x in steps])
    else:
        d2 = l2_squared("_q", "_v")
    more = [c for c in q.columns if c not in ("query_id", "_q")]
    # a filter isn't moved below a projection with a partition's number, where it would work out each distance twice, in code too long
    return b.crossJoin(F.broadcast(q)).select("query_id", "id", d2.alias("d2"), *more, F.spark_partition_id().alias("_part"))


def _sql(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    queries, base = queries.where("vector IS NOT NULL"), base.where("vector IS NOT NULL")
    first, n = queries.select(F.size("vector")).first(), base.count()
    if first is None:
        return distances(queries, base)
    width = first[0]
    q = queries.select("query_id", _fitting(width).alias("_q"))
    # dealt anew, as a small file is one task's
    b = base.select("id", _fitting(width).alias("_v")).repartition(max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    share = int((n / max(k, 1)) ** 0.5)
    if k < 1 or share < 2:
        return _pairs(q, b, width).select("query_id", "id", "d2")
    # of about k * share rows each query is bounded by its k-th, so that about k * share of all are left
    some = top_per_key(_pairs(q, b.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), width), "query_id", k, "d2", "id").where(F.col("rank") == k)
    bounds = some.select(F.col("query_id").alias("_of"), F.col("d2").alias("_d2"), F.col("id").alias("_id"))
    q = q.join(bounds, F.col("query_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    d2, most = F.col("d2"), F.col("_d2")
    near = most.isNull() | (d2 < most) | ((d2 == most) & (F.col("id").isNull() | (F.col("id") <= F.col("_id"))))
    return _pairs(q, b, width).where(near & (F.col("_part") >= 0)).select("query_id", "id", "d2")


def exact_knn(queries: DataFrame, base: DataFrame, k: int, method: str = "arrow") -> DataFrame:
    """(query_id, rank, id, distance) of queries (query_id, vector) over base (id, vector)."""
    if k < 0:
        raise ValueError("k is negative")
    return finish(candidates(queries, base, k, method), k)


def candidates(queries: DataFrame, base: DataFrame, k: int, method: str = "arrow") -> DataFrame:
    """(query_id, id, d2) with at least the ``k`` nearest rows of each query."""
    return _sql(queries, base, k) if method == "sql" else _arrow(queries, base, k)


def finish(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query among candidates (query_id, id, d2)."""
    return top_per_key(found, "query_id", k, "d2", "id").select("query_id", "rank", "id", F.sqrt("d2").alias("distance"))


def nested(results: DataFrame) -> DataFrame:
    """One row for each query: ids in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return results.groupBy("query_id").agg(F.transform(rows, lambda x: x["id"]).alias("neighbors"))


def ground_truth(queries: DataFrame, base: DataFrame, k: int = 100, method: str = "arrow") -> DataFrame:
    return nested(exact_knn(queries, base, k, method))
