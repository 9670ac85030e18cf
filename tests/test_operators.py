"""Operators on small tables: known values, edges, and properties that ties cannot break."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcspan.functions import text, vectors
from arcspan.operators import anticheat, buckets, ivf, kmeans, knn, leaderboard, logs, metrics, store, topk
from arcspan.plans import queries as plans
from arcspan.sources import readers, vecs
from arcspan.streaming import live


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def points(spark, n=200, width=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, width)).astype(np.float32)
    return rows, table(spark, [(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vector array<float>").repartition(5)


def queries_of(base, n):
    return base.where(F.col("id") < n).withColumnRenamed("id", "query_id")


# --- measures --------------------------------------------------------------------------------------------------------------


def test_distances(spark):
    a, b = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))
    assert value(spark, vectors.l2_squared(a, b)) == 25 and value(spark, vectors.l2_distance(a, b)) == 5
    assert value(spark, vectors.dot(a, b)) == 0 and value(spark, vectors.squared_norm(b)) == 16
    vectors.register(spark)
    assert spark.sql("SELECT l2_distance(array(0D, 3D), array(4D, 0D)), jaccard(array(1L, 2L), array(2L, 3L))").first()[:] == (5.0, 1 / 3)


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 0.0), ([1], [], 0.0), ([1, 2], [1, 2], 1.0), ([1, 2], [3, 4], 0.0), ([1, 2, 3], [2, 3, 4], 0.5), ([1, 1, 2], [2, 2, 1], 1.0)])
def test_jaccard(spark, a, b, want):
    df = table(spark, [(a, b)], "a array<long>, b array<long>")
    assert df.select(vectors.jaccard("a", "b")).first()[0] == want


def test_numbers(spark):
    assert [value(spark, vectors.next_power_of_two(F.lit(n))) for n in (1, 2, 3, 512, 513)] == [1, 2, 4, 512, 1024]
    assert [value(spark, vectors.clamp(F.lit(n), 2, 5)) for n in (1, 3, 9)] == [2, 3, 5]
    assert value(spark, vectors.qps(F.lit(100), F.lit(0.0))) == 0 and value(spark, vectors.qps(F.lit(100), F.lit(2.0))) == 50


def test_percentiles(spark):
    rows = table(spark, [(float(x),) for x in range(1, 11)], "x double")
    got = one(rows.agg(*[metrics.percentile("x", p).alias(f"p{p}") for p in (0, 50, 95, 100)]))
    assert got == {"p0": 1.0, "p50": 5.5, "p95": pytest.approx(9.55), "p100": 10.0}
    assert one(rows.limit(0).agg(metrics.percentile("x", 50).alias("p"))) == {"p": 0.0}


def test_recall(spark):
    truth = table(spark, [(0, list(range(10))), (1, list(range(10, 30))), (2, [1])], "query_id long, neighbors array<long>")
    found = table(spark, [(0, list(range(10))), (1, list(range(10, 15)) + [99] * 5), (2, []), (7, [1])], "query_id long, neighbors array<long>")
    got = {r.query_id: r.recall for r in metrics.recall_per_query(found, truth).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: 0.0}
    assert one(metrics.recall_mean(found, truth))["recall"] == 0.5
    assert one(metrics.recall_mean(found.limit(0), truth))["recall"] == 0.0


def test_gate_and_change(spark):
    gate = lambda r: value(spark, metrics.gated_score(F.lit(r), F.lit(100.0), 0.95))
    assert (gate(0.94), gate(0.95), gate(0.99)) == (0.0, 100.0, 100.0)
    runs = table(spark, [("a", 1, 100.0), ("a", 2, 150.0), ("a", 3, 0.0), ("a", 4, 5.0)], "e string, i int, qps double")
    got = [(r.previous_qps, r.qps_change_pct) for r in metrics.compared(runs, "e", ["i"], "qps").orderBy("i").collect()]
    assert got == [(None, None), (100.0, 50.0), (150.0, -100.0), (0.0, 0.0)]
    best = metrics.best_so_far(runs, "e", ["i"], "qps", F.col("i") != 2).orderBy("i").collect()
    assert [(r.best, r.improved) for r in best] == [(100.0, True), (100.0, False), (100.0, False), (100.0, False)]


# --- anti-cheat ------------------------------------------------------------------------------------------------------------


def results(spark, lists):
    return table(spark, list(enumerate(lists)), "query_id long, neighbors array<long>")


def test_verdicts(spark):
    same, apart = [[1, 2, 3]] * 5, [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(5)]
    got = one(anticheat.verdict(results(spark, same)))
    assert not got["passed"] and got["avg_similarity"] == 1.0 and got["unique_ids"] == 3 and got["total_results"] == 15
    assert one(anticheat.verdict(results(spark, apart)))["passed"]
    assert one(anticheat.verdict(results(spark, same[:1])))["avg_similarity"] == 0.0
    assert one(anticheat.verdict(results(spark, same).limit(0)))["passed"]
    assert one(anticheat.verdict(results(spark, same), 1.0))["passed"]


@pytest.mark.parametrize("n", [33, 60, 101])
def test_sampled_pairs(spark, n):
    got = [(r.i, r.j) for r in anticheat.pairs(results(spark, [[i] for i in range(n)])).orderBy("i", "j").collect()]
    whole = [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert got == [whole[s * len(whole) // 500] for s in range(500)]


# --- nearest neighbours ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["sql", "arrow"])
@pytest.mark.parametrize("k", [1, 7, 200, 500])
def test_exact_neighbours(spark, method, k):
    rows, base = points(spark)
    found = knn.exact_knn(queries_of(base, 6), base, k, method).collect()
    for q in range(6):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        d2 = ((rows.astype(np.float64) - rows[q]) ** 2).sum(1)
        assert len(mine) == min(k, 200) and [r.rank for r in mine] == list(range(1, len(mine) + 1))
        inside = {r.id for r in mine}
        worst = max(d2[i] for i in inside)
        assert all(d2[i] >= worst - 1e-9 for i in range(200) if i not in inside)
        assert np.allclose([r.distance for r in mine], np.sqrt(np.sort(d2)[:k]))


def test_methods_agree_bit_by_bit(spark):
    _, base = points(spark, 300, 64, 3)
    q = queries_of(base, 20)
    a, b = (sorted(knn.exact_knn(q, base, 10, m).collect()) for m in ("sql", "arrow"))
    assert a == b


def test_few_pairs_are_left_to_sort(spark):
    """F1 of round 2: all pairs of rows and queries were sorted. Here half of the rows are copies of one vector."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(4000, 8)).astype(np.float32)
    rows[::2] = rows[0]
    base = table(spark, [(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vector array<float>")
    q = queries_of(base, 20)
    assert 200 <= knn.candidates(q, base, 10, "sql").count() < 4000 * 20 / 4
    a, b = (sorted(knn.exact_knn(q, base, 10, m).collect()) for m in ("sql", "arrow"))
    assert a == b and len(a) == 200


def test_sql_refuses_null_numbers(spark):
    base = table(spark, [(0, [1.0, 0.0]), (1, [None, 0.0])], "id long, vector array<float>")
    with pytest.raises(Exception, match="null number"):
        knn.exact_knn(queries_of(base, 1), base, 1, "sql").collect()


def test_ties_go_to_the_least_id(spark):
    base = table(spark, [(i, [1.0, 0.0]) for i in (5, 3, 9, 1)] + [(7, [0.0, 0.0])], "id long, vector array<float>").repartition(3)
    q = table(spark, [(0, [0.0, 0.0])], "query_id long, vector array<float>")
    for method in ("sql", "arrow"):
        assert [r.id for r in knn.exact_knn(q, base, 3, method).orderBy("rank").collect()] == [7, 1, 3]
    assert knn.exact_knn(q, base, 0).count() == 0 and knn.exact_knn(q, base.limit(0), 3).count() == 0
    assert knn.exact_knn(q.limit(0), base, 3).count() == 0
    with pytest.raises(ValueError):
        knn.exact_knn(q, base, -1)


def test_many_blocks_of_queries(spark, monkeypatch):
    _, base = points(spark, 120, 8, 5)
    whole = sorted(knn.exact_knn(queries_of(base, 50), base, 4).collect())
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 8 * 7)
    assert sorted(knn.exact_knn(queries_of(base, 50), base, 4).collect()) == whole


def test_lists(spark, tmp_path):
    rows, base = points(spark, 400, 8, 2)
    q = queries_of(base, 15)
    exact = sorted(knn.exact_knn(q, base, 5).collect())
    index = ivf.build(base, 10, 3, path=str(tmp_path / "postings"))
    assert sorted(ivf.search(q, index, 5, 10).collect()) == exact
    some = ivf.search(q, index, 5, 3)
    assert one(metrics.recall_mean(knn.nested(some), knn.nested(knn.exact_knn(q, base, 10))))["recall"] <= 0.5
    assert ivf.list_sizes(index).agg(F.sum("n")).first()[0] == 400
    late = base.where("id >= 300")
    part = ivf.Index(index.centroids, index.postings.where("id < 300"))
    assert sorted(ivf.search(q, ivf.stage(part, late), 5, 10).collect()) == exact
    assert sorted(ivf.search(q, ivf.add(part, late), 5, 10).collect()) == exact
    assert sorted(ivf.search_or_scan(q, base, index, 5, 2).collect()) == exact
    assert sorted(buckets.search(q, base, 5).collect()) == exact
    assert ivf.default_lists(1_000_000) == 1000 and ivf.adaptive(1 << 20)[0] == 512
    assert [ivf.adaptive(n)[0] for n in (1, 300_000, 10**9)] == [128, 256, 512]


def test_kmeans(spark):
    rows, base = points(spark, 150, 4, 6)
    start = kmeans.init_stride(base, 5)
    assert [r.centroid for r in start.orderBy("cluster_id").collect()] == [[float(x) for x in rows[i * 150 // 5]] for i in range(5)]
    by = lambda m: sorted((r.id, r.cluster_id) for r in kmeans.assign(base, start, m).collect())
    assert by("sql") == by("arrow")
    a = {r.cluster_id: r.centroid for r in kmeans.lloyd(base, start, 2).collect()}
    b = {r.cluster_id: r.centroid for r in kmeans.fit(base, start, 2)[0].collect()}
    assert all(np.allclose(a[c], b[c]) for c in a)
    _, rounds = kmeans.fit(base, start, 100)
    assert rounds < 100
    far = start.unionByName(table(spark, [(99, [1e6] * 4)], "cluster_id long, centroid array<double>"))
    assert {r.cluster_id: r.centroid for r in kmeans.fit(base, far, 1)[0].collect()}[99] == [1e6] * 4
    assert kmeans.init_seeded(base, 5, 42).count() == 5
    assert kmeans.training_sample(base, 30).count() == 30


def test_ordinals_and_top(spark):
    rows = table(spark, [(i * 3, i % 4) for i in range(97)], "id long, g int").repartition(6)
    assert [(r.id, r.ordinal) for r in topk.with_ordinal(rows, "id").orderBy("id").collect()] == [(i * 3, i) for i in range(97)]
    assert [r.ordinal for r in topk.stride(topk.with_ordinal(rows, "id"), 97, 10).orderBy("ordinal").collect()] == [c * 97 // 10 for c in range(10)]
    assert topk.top_per_key(rows, "g", 2, "id").count() == 8 and topk.prefix(rows, 0, "id").count() == 97
    first = [r.id for r in topk.shuffled(rows, 1, "id").collect()]
    assert first == [r.id for r in topk.shuffled(rows, 1, "id").collect()] != [r.id for r in topk.shuffled(rows, 2, "id").collect()]


# --- store -----------------------------------------------------------------------------------------------------------------


def test_store(spark, tmp_path):
    rows = table(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "id long, vector array<float>")
    assert [r.id for r in store.conform(rows, 2).collect()] == [1]
    assert [r.vector for r in store.conform(rows, 2, "pad").orderBy("id").collect()] == [[1.0, 2.0], [1.0, 0.0], [1.0, 2.0]]
    with pytest.raises(Exception, match="numbers instead of 2"):
        store.conform(rows, 2, "fail").collect()
    versions = table(spark, [(1, "old", 1), (1, "new", 2), (2, "only", 1)], "id long, v string, seq int")
    assert sorted((r.id, r.v) for r in store.upsert(versions, "id", "seq").collect()) == [(1, "new"), (2, "only")]
    numbered = rows.withColumn("o", F.col("id") - 1)
    store.write_shards(numbered, str(tmp_path / "shards"), "o", 2)
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1"]


# --- files -----------------------------------------------------------------------------------------------------------------


def test_vector_files(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    floats, ints = rng.normal(size=(500, 16)).astype("<f4"), rng.integers(-5, 5, (40, 3)).astype("<i4")
    (tmp_path / "a.fvecs").write_bytes(vecs.encode(floats))
    (tmp_path / "a.ivecs").write_bytes(vecs.encode(ints, "i"))
    vecs.register(spark)
    for read in (lambda p, k: spark.read.format("vecs").option("kind", k).load(p), lambda p, k: vecs.read_vecs(spark, p, k)):
        got = read(str(tmp_path / "a.fvecs"), "f").orderBy("id").collect()
        assert [r.id for r in got] == list(range(500)) and np.array_equal(np.array([r.vector for r in got], "f4"), floats)
        assert [r.vector for r in read(str(tmp_path / "a.ivecs"), "i").orderBy("id").collect()] == ints.tolist()
    monkeypatch.setattr(vecs, "SPLIT_BYTES", 1000)
    reader = vecs._Reader({"path": str(tmp_path / "a.fvecs")})
    splits = reader.partitions()
    assert len(splits) > 10 and [s.begin for s in splits[1:]] == [s.end for s in splits[:-1]]
    assert [i for s in splits for b in reader.read(s) for i in b.column(0).to_pylist()] == list(range(500))
    vecs.write_vecs(spark.createDataFrame([(1, [2.0]), (0, [1.0])], "id long, vector array<float>"), str(tmp_path / "b.fvecs"))
    assert (tmp_path / "b.fvecs").read_bytes() == struct.pack("<ififi"[:5], 1, 1.0, 1, 2.0)


@pytest.mark.parametrize("data", [b"", b"\x01\x00", struct.pack("<i", 0), struct.pack("<i", -3), struct.pack("<if", 2, 1.0), struct.pack("<ififf", 1, 1.0, 2, 1.0, 2.0), struct.pack("<ifffiff", 3, 1.0, 2.0, 3.0, 2, 1.0, 2.0)])
def test_broken_vector_files(tmp_path, data):
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(ValueError):
        r = vecs._Reader({"path": str(tmp_path / "x")})
        [list(r.read(p)) for p in r.partitions()]
    with pytest.raises(FileNotFoundError):
        vecs._Reader({"path": str(tmp_path / "none")})


def test_json_inputs(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for name, ids in (("base_vectors_0", [0, 1]), ("base_vectors_2", [2])):
        (tmp_path / "v" / f"{name}.json").write_text("[" + ",".join(f'{{"id": {i}, "vector": [{i}, 1.5]}}' for i in ids) + "]")
    assert sorted(r.id for r in readers.vectors(spark, str(tmp_path / "v")).collect()) == [0, 1, 2]
    (tmp_path / "v" / "base_vectors.json").write_text('[{"id": 9, "vector": [1]}]')
    assert [r.id for r in readers.vectors(spark, str(tmp_path / "v")).collect()] == [9]
    runs = tmp_path / "r" / "e1-turn-2" / "benchmarks"
    runs.mkdir(parents=True)
    (runs / "benchmark_001.json").write_text('{"qps": 5.5, "recall": 0.97, "recall_passed": true}')
    (runs / "benchmark_012.json").write_text('{"qps": 7.5, "recall": 0.9, "recall_passed": false}')
    (runs / "benchmark_002.json").write_text("{broken")
    got = readers.runs(spark, str(tmp_path / "r"))
    assert sorted((r.entry_dir, r.run_no, r.qps) for r in got.collect()) == [("e1-turn-2", 1, 5.5), ("e1-turn-2", 12, 7.5)]
    assert [r.qps for r in leaderboard.passing(got).collect()] == [5.5]
    assert one(metrics.next_run(got, F.col("run_no")))["next_run"] == 13
    (tmp_path / "log.jsonl").write_text('{"event": "session_start", "model": "m"}\n\nnot json\n{"event": "tool_call", "tool_call_id": "1"}\n')
    assert sorted(r.event for r in logs.known(readers.events(spark, str(tmp_path / "log.jsonl"))).collect()) == ["session_start", "tool_call"]
    assert readers.write_run(spark.range(1), str(tmp_path / "out"), 7) == "benchmark_007.json"


# --- text, logs, boards ----------------------------------------------------------------------------------------------------


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.turn_label(F.lit("m-x-turn-10"))) == "m-x (Turn 10)" and v(text.turn_label(F.lit("plain"))) == "plain"
    assert v(text.run_number(F.lit("/a/benchmark_018.json"))) == 18 and v(text.run_number(F.lit("x.json"))) is None
    assert v(text.sanitised(F.lit("a/b/c"))) == "a-b-c" and v(text.without_trailing_slash(F.lit("http://x//"))) == "http://x"
    for limit in range(1, 8):
        whole = "aéß日x"
        kept = whole.encode()[:limit].decode(errors="ignore")
        assert v(text.truncated(F.lit(whole), limit, "!")) == kept + "!"
    assert v(text.truncated(F.lit("short"), 5)) == "short"
    assert v(text.pretty_json(F.lit("{ \"a\" : 1 }"))) == '{\n  "a": 1\n}' and v(text.pretty_json(F.lit("{no"))) == "{no"
    assert v(text.seconds_between(F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-01 00:00:01.5")))) == 1.5


def test_profile(spark):
    lines = table(spark, [(x,) for x in ("# head", "", " 55.50% db [.] near [k] odd", "1.25% db [k] fault", "no", "2% db")], "value string")
    top = logs.profile(lines)
    assert [(r.function, r.percentage) for r in top.collect()] == [("near [k] odd", 55.5), ("fault", 1.25)]
    assert one(logs.profile_samples(top)) == {"total_samples": 5675}
    assert one(logs.profile_samples(top.limit(0))) == {"total_samples": 1}


def test_log_relations(spark):
    calls = table(spark, [("s", "1", "a"), ("s", "2", "b")], "session string, id string, tool string")
    done = table(spark, [("s", "2", "ok"), ("s", "3", "lost")], "session string, id string, result string")
    got = sorted((r.id, r.tool, r.result) for r in logs.pair(calls, done, "session", "id").collect())
    assert got == [("1", "a", None), ("2", "b", "ok"), ("3", None, "lost")]
    events = table(spark, [("l", 1, "llm_request", "x"), ("l", 2, "session_start", "late"), ("k", 1, "session_start", "m")], "log string, line int, event string, model string")
    assert [(r.log, r.model) for r in logs.first_model(events, "log", "line").collect()] == [("k", "m")]
    used = logs.counters(events, "log", F.col("event") == "session_start", 1).orderBy("log").collect()
    assert [(r.used, r.remaining, r.limit_reached) for r in used] == [(1, 0, True), (1, 0, True)]


def test_boards(spark):
    rows = table(spark, [("m", "a", 5.0, 1), ("m", "b", 5.0, 2), ("n", "c", 7.0, 3)], "model string, run string, qps double, pos int")
    best = leaderboard.best_per(rows, "model", "qps", "pos", F.lit(True))
    assert sorted((r.model, r.run) for r in best.collect()) == [("m", "a"), ("n", "c")]
    assert [r.run for r in leaderboard.ranked(rows, F.desc("qps"), "run").orderBy("rank").collect()] == ["c", "a", "b"]
    names = table(spark, [("a",), (".git",), ("target",)], "entry_dir string")
    assert [r[0] for r in leaderboard.entries(names).collect()] == ["a"]


# --- streams ---------------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    schema = "id string, ts timestamp, kind string"
    stamp = lambda m: f"2024-01-01T00:{m:02d}:00"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(f'{{"id": "{i}", "ts": "{stamp(i)}", "kind": "{"ab"[i % 2]}"}}' for i in range(6)))
    rows = live.source(spark, str(tmp_path / "in"), schema)
    seen = []
    live.each_change(live.counts(rows, "kind"), lambda df, n: seen.append({r.kind: r.n for r in df.collect()}), str(tmp_path / "s1")).awaitTermination()
    assert seen[-1] == {"a": 3, "b": 3}
    # new files go on from the state
    (tmp_path / "in" / "2.json").write_text(f'{{"id": "5", "ts": "{stamp(6)}", "kind": "a"}}')
    live.each_change(live.counts(rows, "kind"), lambda df, n: seen.append({r.kind: r.n for r in df.collect()}), str(tmp_path / "s1")).awaitTermination()
    assert seen[-1] == {"a": 4, "b": 3}
    unique = []
    live.each_change(live.without_repeats(rows, "ts", "id"), lambda df, n: unique.extend(r.id for r in df.collect()), str(tmp_path / "s2"), mode="append").awaitTermination()
    assert sorted(unique) == ["0", "1", "2", "3", "4", "5"]
    live.append_events(rows, str(tmp_path / "log"), str(tmp_path / "s3")).awaitTermination()
    assert spark.read.schema(schema).json(str(tmp_path / "log")).count() == 7
    calls, done = rows.where("kind = 'a'").select("id", F.col("ts").alias("t1")), rows.where("kind = 'b'").select("id", F.col("ts").alias("t2"))
    pairs = []
    live.each_change(live.paired(calls, done, "t1", "t2", "id", "1 minute"), lambda df, n: pairs.extend(r.id for r in df.collect()), str(tmp_path / "s4"), mode="append").awaitTermination()
    assert set(pairs) <= {"0", "2", "4", "5"}
    sessions = live.sessions(rows, "ts", "kind").select("kind", "n")
    total = []
    live.each_change(sessions, lambda df, n: total.append(sum(r.n for r in df.collect())), str(tmp_path / "s5"), mode="complete").awaitTermination()
    assert total[-1] == 7


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_folders_of_part_files(spark, tmp_path, files):
    """F2 of round 2: a table that is a folder gave an empty stream, and so no postings."""
    vectors_ = table(spark, [(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    vectors_.repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    table(spark, [(i, "ab"[i % 2]) for i in range(9)], "event_id long, event_type string").repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.id: r.cluster_id for r in plans.stream_ivf_add(spark, str(tmp_path)).collect()}
    assert got == {r.id: r.cluster_id for r in plans.kmeans_assign(spark, str(tmp_path)).collect()} and len(got) == 40
    assert sorted(map(tuple, plans.stream_event_counts(spark, str(tmp_path)).collect())) == [("a", 5), ("b", 4)]


# --- faults and edges of the second kind -----------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_vectors_of_unlike_widths_are_never_mixed(spark, method):
    base = table(spark, [(0, [1.0]), (1, [2.0, 2.0, 2.0])], "id long, vector array<float>").coalesce(1)
    asked = table(spark, [(0, [1.0, 2.0])], "query_id long, vector array<float>")
    with pytest.raises(Exception, match="numbers instead of"):
        knn.exact_knn(asked, base, 1, method).collect()
    nulls = table(spark, [(0, None), (1, [1.0, 2.0]), (2, None)], "id long, vector array<float>").coalesce(1)
    assert [(r.id, r.distance) for r in knn.exact_knn(asked, nulls, 5, method).collect()] == [(1, 0.0)]
    assert knn.exact_knn(table(spark, [(0, None)], "query_id long, vector array<float>"), base, 1, method).count() == 0


def test_null_numbers_are_an_error(spark):
    base = table(spark, [(0, [1.0, None])], "id long, vector array<float>")
    with pytest.raises(Exception, match="null number"):
        knn.exact_knn(table(spark, [(0, [1.0, 2.0])], "query_id long, vector array<float>"), base, 1).collect()


@pytest.mark.parametrize(("n", "want"), [(0, (128, 12)), (300_000, (256, 14)), (600_000, (512, 16)), (1 << 40, (512, 16))])
def test_adaptive_lists(n, want):
    assert ivf.adaptive(n) == want


def test_searches_of_lists_agree(spark, tmp_path):
    _, base = points(spark, 300)
    index = ivf.build(base, 10, path=f"{tmp_path}/lists")
    q = queries_of(base, 40)
    rows = lambda found: sorted(tuple(r) for r in found.select("query_id", "rank", "id", "distance").collect())
    for nprobe in (1, 3, 10):
        assert rows(ivf.search(q, index, 5, nprobe)) == rows(ivf.search(q, index, 5, nprobe, "sql"))
    assert rows(ivf.search(q, index, 5, 10)) == rows(knn.exact_knn(q, base, 5))
    some = ivf.stage(ivf.Index(index.centroids, index.postings.where("id % 3 <> 0")), base.where("id % 3 = 0"))
    assert rows(ivf.search(q, some, 5, 10)) == rows(knn.exact_knn(q, base, 5))
    for recall in (0.5, 0.9, 1.0):
        p = ivf.probes_for(q, base, index, 5, recall)
        of = lambda n: metrics.recall_mean(knn.nested(ivf.search(q, index, 5, n)), knn.ground_truth(q, base, 5), 5).first()[0]
        assert of(p) >= recall and (p == 1 or of(p - 1) < recall)


def test_a_hot_list_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "FILE_ROWS", 50)
    rows = table(spark, [(i, [1.0, 1.0] if i < 400 else [9.0, float(i)]) for i in range(420)], "id long, vector array<float>")
    index = ivf.build(rows, 2, path=f"{tmp_path}/lists")
    assert max(len(list(p.glob("*.parquet"))) for p in tmp_path.joinpath("lists").iterdir() if p.is_dir()) > 3
    assert index.postings.count() == 420


def test_life_of_an_index(spark, tmp_path):
    _, base = points(spark, 120)
    q = queries_of(base, 5)
    want = [r.id for r in knn.exact_knn(q, base, 3).orderBy("query_id", "rank").collect()]
    got = lambda s: [r.id for r in s.search(q, 3, 4).orderBy("query_id", "rank").collect()]
    lazy = ivf.Store(base.where("id < 100"), f"{tmp_path}/a", "always", threshold=110, lists=4)
    assert lazy.index is None and lazy.ready() is None and lazy.search(q, 3).count() == 15 and lazy.builds == 0
    assert lazy.insert(base.where("id >= 100")) == 20 and lazy.builds == 0
    assert got(lazy) == want and lazy.builds == 1 and got(lazy) == want and lazy.builds == 1
    lazy.insert(base.limit(0))
    assert lazy.dirty and got(lazy) == want and lazy.builds == 2
    eager = ivf.Store(base.where("id < 100"), f"{tmp_path}/b", "incremental", threshold=100, eager=True, lists=4)
    eager.insert(base.where("id >= 100 AND id < 110"))
    assert eager.builds == 1 and not eager.dirty
    eager.insert(base.where("id >= 110"))
    assert eager.builds == 1 and got(eager) == want


def test_percentiles_of_keys(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0], [900, 100]), None: rng.random(7), "one": np.array([5.0]), "big": np.exp(rng.normal(size=500) * 9)}
    rows = table(spark, [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("none", None)], "k string, v double").repartition(7)
    got = {r.k: r for r in metrics.percentiles(rows, ["k"], "v", 0, 50, 95, 99.5, 100).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        for p in (0, 50, 95, 99.5, 100):
            assert abs(got[k][f"p{p:g}"] - np.percentile(v, p)) <= 1e-9 * max(1, abs(np.percentile(v, p))), (k, p)
    whole = np.concatenate(list(values.values()))
    assert abs(metrics.percentiles(rows, [], "v", 50).first()[0] - np.median(whole)) < 1e-9
    assert {r.k: r.p50_latency_ms for r in metrics.summary(rows, "v", F.lit(1.0), F.lit(1.0), 0.8, "k").collect()}["none"] == 0


def test_ranks_in_ranges(spark):
    rows = table(spark, [(i, (i * 37) % 11) for i in range(400)], "id long, score int").repartition(9)
    got = {r.id: r["rank"] for r in topk.ranked(rows, F.desc("score"), F.col("id")).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-((i * 37) % 11), i) for i in range(400)), 1)}
    assert got == want and topk.ranked(rows.limit(0), F.col("id")).count() == 0


def test_parts_of_vector_files(spark, tmp_path):
    rows, base = points(spark, 100)
    assert vecs.write_parts(base, f"file://{tmp_path}/parts") == 100
    vecs.register(spark)
    read = spark.read.format("vecs").option("kind", "f").option("path", f"{tmp_path}/parts").load().orderBy("id").collect()
    assert [r.id for r in read] == list(range(100)) and (np.array([r.vector for r in read], np.float32) == rows).all()
    whole = b"".join(p.read_bytes() for p in sorted(tmp_path.joinpath("parts").glob("part-*")))
    assert whole == vecs.encode(rows) and not list(tmp_path.joinpath("parts").glob("_task*"))
    with pytest.raises(Exception, match="no vectors|NotFound|not found|FileNotFound"):
        spark.read.format("vecs").option("path", f"{tmp_path}/nothing").load().collect()


def test_truth_is_resumed(spark, tmp_path):
    _, base = points(spark, 60)
    q, path = queries_of(base, 30), f"{tmp_path}/chunks"
    want = {r.query_id: r.neighbors for r in knn.ground_truth(q, base, 4).collect()}
    read = lambda found: {r.query_id: r.neighbors for r in found.collect()}
    found, n = store.resume_truth(q, base, path, 4, 10)
    assert read(found) == want and n == 30
    found, n = store.resume_truth(q, base, path, 4, 10)
    assert read(found) == want and n == 0
    chunk = next(tmp_path.joinpath("chunks", "chunk=1").glob("*.json"))
    chunk.write_text(chunk.read_text()[: -len(chunk.read_text()) // 3])
    for crc in chunk.parent.glob(".*.crc"):
        crc.unlink()
    found, n = store.resume_truth(q, base, path, 4, 10)
    assert read(found) == want and n == 10
    with pytest.warns(UserWarning, match="merged 30 queries but expected 31"):
        store.merged(spark.read.schema("query_id long, neighbors array<long>").json(path), 31)


def test_pretty_json(spark):
    import json

    for raw in ('{"a":{"b":[1,2,{"c":null}],"d":[],"e":{}},"f":"x, : {} \\" [y]","g":-1.5,"h":true}', "[]", "{}", "[1,[2]]", '"x"', "7"):
        assert value(spark, text.pretty_json(F.lit(raw))) == json.dumps(json.loads(raw), indent=2)
    assert value(spark, text.pretty_json(F.lit("not json {"))) == "not json {" and value(spark, text.pretty_json(F.lit(None).cast("string"))) is None


def test_times(spark):
    assert value(spark, text.rfc3339(F.expr("timestamp '2024-05-06 07:08:09.123456'"))) == "2024-05-06T07:08:09.123456+00:00"
    assert len(value(spark, text.utc_now())) == 32


def test_messages(spark):
    runs = table(spark, [(0.95,), (0.9499,)], "recall double")
    assert [r.message for r in metrics.correctness(runs).collect()] == ["Correctness test PASSED: recall 0.9500 >= threshold 0.9500", "Correctness test FAILED: recall 0.9499 < threshold 0.9500"]
    same = table(spark, [(i, [1, 2, 3]) for i in range(4)], "query_id long, neighbors array<long>")
    told = one(anticheat.verdict(same))
    assert not told["passed"] and told["message"] == "SUSPICIOUS: Average Jaccard similarity 1.0000 exceeds threshold 0.80. Unique IDs: 3/12 total. Possible hardcoded results detected."
    assert one(anticheat.verdict(same.limit(0)))["message"] == "No results to analyze."
    alone = table(spark, [(7, [1, 2])], "query_id long, neighbors array<long>")
    assert one(anticheat.verdict(alone))["message"] == "OK: Average Jaccard similarity 0.0000 is within threshold 0.80. Unique IDs: 2/2 total."


def test_board_is_grown(spark, tmp_path):
    entry = lambda name, score: table(spark, [(name, name, score, 1.0)], "model_name string, entry_dir string, qps double, recall double")
    for name, score in (("b", 2.0), ("a", 1.0), ("c", 3.0)):
        board = readers.append_board(entry(name, score), f"{tmp_path}/board")
    assert sorted((r.model_name, r.qps) for r in board.collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_live_pairs_of_several_batches(spark, tmp_path):
    rows = [(1, "c", "call", 10), (1, "c", "result", 11), (1, "d", "result", 20), (1, "d", "call", 21), (1, "e", "call", 30), (2, "f", "result", 40)]
    for k, r in enumerate(rows):
        table(spark, [r], "log int, id string, kind string, at int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("log int, id string, kind string, at int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.pair_log(events, F.col("kind") == "call", ["log", "id"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r.log, r.id, r.call and r.call.at, r.result and r.result.at) for r in live.pairs_of(spark, f"{tmp_path}/out", ["log", "id"]).collect())
    assert got == [(1, "c", 10, 11), (1, "d", 21, 20), (1, "e", 30, None), (2, "f", None, 40)]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from arcspan.operators.written import shared_dir

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {"spark.checkpoint.dir": ""}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
