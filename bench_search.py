"""

    python bench_search.py FOLDER [ROWS] [QUERIES]

Vectors are made here (seeded, in clusters) and written to FOLDER. BENCH_CPUS threads, 4 if it is unset.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.operators import ivf, knn, metrics
from arcspan.operators.written import written

WIDTH, CENTRES, SPREAD, RECALL, K = 128, 2000, 0.6, 0.95, 10


def make(folder: str, name: str, n: int, seed: int) -> str:
    path = f"{folder}/{name}-{n}"
    if not os.path.isdir(path):
        os.makedirs(path)
        centres = np.random.default_rng(1).normal(size=(CENTRES, WIDTH))
        rng = np.random.default_rng(seed)
        for a in range(0, n, 62_500):
            m = min(62_500, n - a)
            rows = (centres[rng.integers(0, CENTRES, m)] + SPREAD * rng.normal(size=(m, WIDTH))).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m * WIDTH + 1, WIDTH, dtype=np.int32)), pa.array(rows.reshape(-1)))
            pq.write_table(pa.table({"id": np.arange(a, a + m), "vector": flat}), f"{path}/part-{a:08d}.parquet")
    return path


def timed(df: DataFrame) -> tuple[float, DataFrame]:
    began = time.time()
    out = written(df)
    return time.time() - began, out


def main() -> None:
    folder, n, m = [*sys.argv[1:], *["", "1000000", "10000"][len(sys.argv) - 1 :]][:3]
    n, m = int(n), int(m)
    cpus = os.environ.get("BENCH_CPUS", "4")
    os.environ["OPENBLAS_NUM_THREADS"] = "1"
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"{folder}/shared").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    base = spark.read.parquet(make(folder, "base", n, 2))
    queries = spark.read.parquet(make(folder, "queries", m, 3)).withColumnRenamed("id", "query_id")
    lists, adaptive = ivf.adaptive(n)
    began = time.time()
    index = ivf.build(base, lists, 2, path=f"{folder}/lists-{n}")
    build = time.time() - began
    some = queries.where(F.col("query_id") % 20 == 0)
    nprobe = ivf.probes_for(some, base, index, K, RECALL)
    timed(ivf.search(some, index, K, nprobe))  # starts Python workers
    seconds, found = timed(ivf.search(queries, index, K, nprobe))
    scan, truth = timed(knn.exact_knn(queries, base, K))
    recall = metrics.recall_mean(knn.nested(found), knn.nested(truth), K).first()[0]
    print(json.dumps({"rows": n, "queries": m, "width": WIDTH, "cpus": int(cpus), "lists": lists, "nprobe": nprobe, "build_sec": round(build, 1), "list_search_sec": round(seconds, 2), "list_search_qps": round(m / seconds, 1), "recall_at_10": round(recall, 4), "scan_sec": round(scan, 2), "scan_qps": round(m / scan, 1), "adaptive_probes": adaptive}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
