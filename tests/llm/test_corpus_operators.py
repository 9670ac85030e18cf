"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcspan.llm import chat_format, jaccard_join, line_dedup, packing, pii, piece_lattice, quality_model, quality_rules, substring_dedup, webp
from arcspan.llm.common import Text, Words, as_bytes, grams, slices, whole_runs
from arcspan.llm.components import components

WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kind string, rk long, n long, unit string"


def docs(spark, texts, parts=5):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "own", 1, 2, "u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORDS, t or "")


def some_texts(seed, n=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß日", k=rng.randint(1, 6))) for _ in range(150)] + ["The", "A,b", "x\x0by", "#", "$%", "1.2"]
    out = [None, "", " \n\t ", "a", "A", "é", "one two", "word " * 400, "x" * 5000]
    while len(out) < n:
        if rng.random() < 0.5:
            out.append(rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, k=rng.randint(1, 130))))
        else:
            base = words(rng.choice([t for t in out if t])) + ["z"]
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            out.append(" ".join(base))
    return out


# --- word parsing ----------------------------------------------------------------------------------------------------------


def test_words_and_hashes_do_not_depend_on_the_slice():
    texts = [t or "" for t in some_texts(1)]
    column = as_bytes(pa.array(texts))
    whole = Text(column, 0, len(texts))
    parts = [Text(column, i, j) for i, j in slices(column, 300)]
    assert len(parts) > 5
    assert (np.concatenate([p.words() for p in parts]) == whole.words()).all()
    got = [whole.data[s:e].tobytes().decode() for s, e in zip(whole.ws, whole.we, strict=True)]
    assert got == [w for t in texts for w in words(t)]
    by_hash = collections.defaultdict(set)
    for h, w in zip(whole.words().tolist(), got, strict=True):
        by_hash[h].add(w)
    assert all(len(s) == 1 for s in by_hash.values()) and len(by_hash) == len(set(got))


def test_runs_of_words_stay_in_their_row():
    column = as_bytes(pa.array(["a b c", "", "d", "e f g h", "i j"]))
    t = Text(column, 0, 5)
    assert whole_runs(t.first, t.n_words, 3).tolist() == [True, False, False, False, True, True, False, False]
    assert len(grams(t.words(), 3)) == 8


# --- 1 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_sentencepiece_equals_the_library(spark, most):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.vocabulary())
    rng = random.Random(3)
    alphabet = [*"abcdeghinorstu ", "  ", "   ", "\n", "\t", "\r", "é", "日", "🙂", "▁", "the ", "ing", ",", "1", "\x00", "ﬁ"]
    texts = [None, "", " ", "  ", "a" * 300, "thethe" * 60] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(150)]
    encoded = piece_lattice.encode(docs(spark, texts), most=most).cache()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in piece_lattice.decode(encoded.select("doc_id", "ids")).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert piece_lattice.encode(empty(spark)).count() == 0


def test_query_decodes_the_ids_it_made(spark, tmp_path):
    texts = [None, "", "two  words", "a▁b é 日 🙂\n\x00", "hello unusual", "hello unusual"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.doc_id: r.ids for r in piece_lattice.encode(docs(spark, texts)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids[i]), sha(np.array(ids[i], "<u4").tobytes()), sha((t or "").replace("▁", " ").encode())) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in piece_lattice.query(spark, str(tmp_path)).collect()) == want


def test_query_takes_one_worker_a_task(spark, tmp_path):
    """op1 of round 2: ids went from one Python worker to another in the same task, and memory went over its limit."""
    docs(spark, ["a text of words"]).write.parquet(str(tmp_path / "documents.parquet"))
    plan = piece_lattice.query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(i for i, x in enumerate(plan) if "Sort" in x)
    assert sum("MapInArrow" in x for x in plan[:last]) == 1


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, [230]), (2, [0]), (3, [1, 2]), (4, [99999999, -4]), (5, None), (6, []), (7, [None])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in piece_lattice.decode(rows).collect()}
    assert got == {1: "\ufffd", 2: "\u2047 ", 3: "", 4: "\ufffd\ufffd", 5: "", 6: "", 7: "\ufffd"}
    with pytest.raises(ValueError, match="bits"):
        piece_lattice.model(piece_lattice.BPE, [("a", 1 << 24, 0.0, piece_lattice.NORMAL)])


def test_units_never_cut_a_piece():
    m = piece_lattice.load()
    pieces = [p.replace(piece_lattice.SPACE, " ") for p, _, _, k in m.rows if k == piece_lattice.NORMAL]
    texts = [*pieces, *[f"x{p}z" for p in pieces]]
    u = piece_lattice.Units(pa.array([t.encode() for t in texts], pa.large_binary()), 0, len(texts), piece_lattice._apart(m))
    starts = set(u.s.tolist())
    for t, at, lead in zip(texts, u.off[:-1].tolist(), [1] * len(pieces) + [2] * len(pieces), strict=True):
        size = len(t.encode()) - (lead == 2) * 2
        assert not starts & set(range(at + lead + 1, at + lead + size)), t
    assert u.data.tobytes().decode() == "".join(" " + t for t in texts)


def test_units_do_not_depend_on_stretches(monkeypatch):
    texts = [t or "" for t in some_texts(13, 40)]
    apart = piece_lattice._apart(piece_lattice.load())
    column = as_bytes(pa.array(texts))
    whole = piece_lattice.Units(column, 0, len(texts), apart).keys.tolist()
    monkeypatch.setattr(piece_lattice, "STRETCH", 7)
    assert piece_lattice.Units(column, 0, len(texts), apart).keys.tolist() == whole


def test_repeated_rows_are_encoded_each(spark):
    rows = docs(spark, ["hello unusual", "x"])
    got = piece_lattice.encode(rows.unionByName(rows), most=1).collect()
    assert len(got) == 4 and len({tuple(r.ids) for r in got}) == 2


def test_viterbi_equals_brute_force(spark):
    rows = [("<unk>", 0, 0.0, 2), ("▁", 1, -2.0, 1)] + [(p, i + 2, -1.0 - (i * 7 % 11) / 3, 1) for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "abab"])]
    m = piece_lattice.model(piece_lattice.UNIGRAM, rows)
    score = {p: s for p, _, s, k in rows if k == 1}
    name = {p: i for p, i, _, k in rows if k == 1}
    low = min(score.values()) - 10.0

    def best(u):
        ways = [(0.0, [])]
        for e in range(1, len(u) + 1):
            found = [(ways[s][0] + score[u[s:e]], ways[s][1] + [name[u[s:e]]]) for s in range(e) if u[s:e] in score]
            if u[e - 1] not in score:
                found.append((ways[e - 1][0] + low, ways[e - 1][1] + [0]))
            ways.append(max(found, key=lambda x: x[0]))
        return ways[-1]

    units = ["▁" + "".join(x) for n in range(0, 6) for x in itertools.product("abc", repeat=n)]
    got = {r.unit: r.ids for r in piece_lattice.encode_units(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), m).collect()}
    total = lambda ids: sum({i: s for p, i, s, k in rows}[i] if i else low for i in ids)
    for u in units:
        assert abs(total(got[u]) - best(u)[0]) < 1e-9, u


# --- 2 ---------------------------------------------------------------------------------------------------------------------


def brute_model(texts, order=quality_model.ORDER):
    """log P(c | context) by interpolated modified Kneser-Ney smoothing, from dictionaries."""
    counts = collections.Counter(p[i : i + order] for t in texts for p in [quality_model.BEGIN * (order - 1) + t] for i in range(len(t)))
    tables = [counts]
    for _ in range(order - 1):
        tables.append(collections.Counter(g[1:] for g in tables[-1]))
    stats = []
    for t in tables:
        n = [sum(c == k for c in t.values()) for k in range(6)]
        d = [0, 0.5, 0.75, 0.9]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [0, *(max(0.05, min(k - 0.05, k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 1))) for k in (1, 2, 3))]
        by = collections.defaultdict(list)
        for g, c in t.items():
            by[g[:-1]].append(c)
        stats.append((t, d, by))

    def p(g, level=0):
        if level == order:
            return 1 / (len(tables[-1]) + 1)
        t, d, by = stats[level]
        lower = p(g[1:], level + 1)
        if g[:-1] not in by:
            return lower
        own = by[g[:-1]]
        return max(t.get(g, 0) - d[min(t.get(g, 0), 3)], 0) / sum(own) + sum(d[min(c, 3)] for c in own) / sum(own) * lower

    return p


def test_perplexity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(quality_model, "PIECE", 500)
    texts = [t for t in some_texts(21, 40) if t] + ["a\0\0b\0", "\0\0\0\0\0\0", "🙂🙂 é", "never seen Ω symbols"]
    train = {"x": texts[:20], None: texts[15:30]}
    rows = [(t, lang) for lang, ts in train.items() for t in ts] + [(None, "x")]
    model = quality_model.train(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(i, t, lang) for i, (t, lang) in enumerate([(t, lang) for t in texts for lang in ("x", None, "none")] + [(None, "x"), ("", None)])]
    got = {r.doc_id: r for r in quality_model.score(spark.createDataFrame(asked, "doc_id long, text string, lang string").repartition(3), model).collect()}
    assert len(got) == len(asked)
    order = quality_model.ORDER
    for i, t, lang in asked:
        if lang == "none" or not t:
            assert got[i].perplexity is None
            continue
        p = brute_model(train[lang]) if i < 3 else p_of[lang]
        if i < 3:
            p_of = {**(p_of if i else {}), lang: p}
        padded = quality_model.BEGIN * (order - 1) + t
        want = np.exp(-np.mean([np.log(p(padded[k : k + order])) for k in range(len(t))]))
        assert abs(got[i].perplexity / want - 1) < 1e-6, (i, t, lang)
        assert got[i].n_bytes == len(t.encode())


def test_probabilities_sum_to_one():
    p = brute_model(["abracadabra", "banana bread"])
    alphabet = {*"abracadabra banana bread"}
    for context in ("abra", "\x02\x02\x02\x02", "nana", "zzzz"):
        assert abs(sum(p(context + c) for c in alphabet) + p(context + "?") - 1) < 1e-9


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_limits_come_from_documents_held_out(spark, monkeypatch, most):
    monkeypatch.setattr(quality_model, "MOST_IDS", most)
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["river", "stone", "walks", "over", "green", "hill"], k=40)) for _ in range(120)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    held = [r.doc_id for r in table.where(quality_model._held_out()).collect()]
    model = quality_model.train(table.where(~quality_model._held_out()))
    of = {r.doc_id: r.perplexity for r in quality_model.score(table, model).collect()}
    out = quality_model.classify(table, labels, quantile=1.0, margin=1.0).collect()
    assert 0 < len(held) < 60 and {r.max_perplexity for r in out} == {max(of[i] for i in held)}
    twice = quality_model.classify(table.unionByName(table), labels)
    assert twice.count() == 240


def test_classifier_keeps_clean_text_and_rejects_noise(spark):
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choices(["the", "and", "river", "stone", "walks", "over", "green"], k=80))
    noise = lambda: "".join(rng.choices("qxzjkv#$%@|", k=400))
    texts = [clean() for _ in range(60)] + [noise() for _ in range(10)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] * 2 + [(None, 1, 0), (60, 0, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, texts)
    out = {r.doc_id: r for r in quality_model.classify(table, labels).collect()}
    assert all(out[i].kept for i in range(60)) and not any(out[i].kept for i in range(60, 72))
    assert quality_model.classify(empty(spark), labels).count() == 0
    other = table.withColumn("lang", F.lit(None).cast("string"))
    assert quality_model.classify(other, labels.limit(0)).where("kept").count() == 70


# --- 3 ---------------------------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = words("".join(c.lower() if c.isascii() else c for c in (t or "")))
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)])


def brute_components(texts):
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in range(len(sets))}


@pytest.mark.parametrize(("seed", "part", "leaders"), [(1, 1500, 8), (2, 64, 8), (3, 12, 2), (4, 5, 1)])
def test_jaccard_join(spark, monkeypatch, seed, part, leaders):
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    rng = random.Random(seed)
    texts = some_texts(seed, 150)
    base = words(texts[20]) + ["q"] * 3 + rng.choices(["u", "v", "w"], k=60)
    for _ in range(60):  # a chain of near copies
        base = list(base)
        base[rng.randrange(len(base))] = f"w{rng.randrange(9)}"
        texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_dedup_keeps_one_row_of_each_component(spark):
    texts = some_texts(9, 60)
    rows = docs(spark, texts)
    kept = jaccard_join.dedup(rows.unionByName(rows))
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_components(texts).values()})
    assert jaccard_join.join(empty(spark)).count() == 0
    nulls = docs(spark, ["a b c d e f", "a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.component_id for r in jaccard_join.join(nulls).collect()] == [None, None]


#: Tables without repeats, without words, of one row, and of good rows beside a partition of nulls.
PLAIN = {"none": [], "null": [None], "blank": [" ", "", "\n"], "one": ["a b c d e f"], "unlike": [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)], "beside": [" ".join(f"w{i % 40}x{k}" for k in range(60)) for i in range(80)] + [None]}


@pytest.mark.parametrize("name", PLAIN)
@pytest.mark.parametrize("width", [1, 8, 211])
def test_jaccard_join_of_plain_tables(spark, name, width):
    texts = PLAIN[name]
    rows = docs(spark, texts, max(1, len(texts))) if texts else empty(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        want = brute_components(texts)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect()} == want
        if width == 8:
            assert sorted(r.doc_id for r in jaccard_join.dedup(rows).collect()) == sorted({c for _, c in want.values()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_of_a_great_share_are_named(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "KEYS", 3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 500 + [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (0, 1, 58, 59)] * 60 + [f"own words {i} of this" for i in range(30)] + [None] * 20
    rows = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(rows.unionByName(rows)).collect()}
    assert got == {i: 0 if i < 740 else i for i in range(len(texts))}
    assert jaccard_join.join(rows.unionByName(rows)).count() == 2 * len(texts)


def test_dedup_keeps_one_row_where_rows_share_an_id(spark):
    base = [f"w{i}" for i in range(100)]
    rows = spark.createDataFrame([(5, " ".join(base), 1), (5, " ".join([*base[:-1], "x"]), 2), (5, "other words here", 3), (None, " ".join([*base[1:], "y"]), 4)], "doc_id long, text string, row_key int")
    kept = jaccard_join.dedup(rows).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {5} and 3 in {r.row_key for r in kept}


def test_words_of_long_rows_are_parsed_in_pieces(monkeypatch):
    from arcspan.llm import common

    texts = ["a bb " * 300, "x" * 3000 + " y" + "z" * 900, " " * 2000, "one"]
    column = as_bytes(pa.array(texts))
    whole = [common.Text(column, i, i + 1, True).words().tolist() for i in range(4)]
    monkeypatch.setattr(common, "SLICE_BYTES", 100)
    for i in range(4):
        w = common.Words(column, i, i + 1, True)
        assert w.words().tolist() == whole[i] and w.n_words.tolist() == [len(whole[i])]


def test_trie_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(40):
            s = set((base if rng.random() < 0.7 else rng.choice(400, 50)).tolist())
            for _ in range(rng.integers(0, 9)):
                s ^= {int(rng.integers(0, 400))}
            sets.append(np.array(sorted(s), np.uint64))
        got = dict(jaccard_join.join_sets(list(range(40)), sets))
        up = list(range(40))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in itertools.combinations(range(40), 2):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
        assert [got.get(i, i) for i in range(40)] == [top(i) for i in range(40)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    up = list(range(400))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    w = words(t)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_long_texts_are_measured_alike(monkeypatch):
    texts = some_texts(11) + ["a b\na b\n\n c\na b", "l\nl\n", " l\nl", "é " * 99 + "\n#"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = lambda: [tuple(r.values()) for b in quality_rules.measure(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr("arcspan.llm.common.SLICE_BYTES", 64)  # a text over it is a slice of its own
    whole = rows()
    monkeypatch.setattr(quality_rules, "LONG", 65)
    monkeypatch.setattr(quality_rules, "SLICE_BYTES", 10)
    assert rows() == whole and len(whole) == len(texts)


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    texts = [t or "" for t in some_texts(3, 30)] + ["日本" * 40, ""]
    column = as_bytes(pa.array(texts))
    tags = np.zeros(len(texts), np.uint64)

    def all_hashes():
        out = collections.defaultdict(list)
        for points, at, rows in quality_model.ngrams(column):
            for r, h in zip(rows.tolist(), quality_model.hashes(points, at, tags[rows]).tolist(), strict=True):
                out[r].append(h)
        return [out[i] for i in range(len(texts))]

    whole = all_hashes()
    assert [len(whole[i]) for i in range(len(texts))] == [len(t) for t in texts]
    monkeypatch.setattr(quality_model, "PIECE", 37)
    assert all_hashes() == whole


def test_quality_rules(spark):
    texts = some_texts(11) + ["a b\na b\n\n c\na b", "x y z x y z x", "\n\n", "l\nl\n", " l\nl", "".join(chr(random.Random(k).randrange(33, 700)) for k in range(9000)), "word " * 1000 + " ".join(map(str, range(900)))]
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        raw = (t or "").encode()
        squeeze = lambda x: len(x) / len(quality_rules.zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x))
        band = lambda x, bands: next(a <= squeeze(x) <= b for n, a, b in bands if len(x) <= n)
        chunks = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        wrong = [x for x in chunks if not band(x, quality_rules.CHUNK_BANDS)]
        assert (r.n_chunks, r.n_bad_chunks) == (len(chunks), len(wrong)) and r.whole_ratio == (squeeze(raw) if raw else 0)
        fails = bool(raw) and (not band(raw, quality_rules.WHOLE_BANDS) or sum(map(len, wrong)) > 0.34 * len(raw))
        assert r.kept == (not r.base_failed and not fails)
    kept = quality_rules.reject(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.judge(empty(spark)).count() == 0


def test_bands_reject_noise_and_repetition():
    rng = random.Random(1)
    natural = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900))
    compressor = quality_rules.zstandard.ZstdCompressor(level=3, write_content_size=False)
    bad = lambda x: quality_rules.outside(len(x), *quality_rules.ratios(x, compressor))
    assert not bad(natural.encode())
    assert bad(bytes(rng.randrange(256) for _ in range(6000))) and bad(b"again and " * 900)
    mixed = natural.encode() + bytes(rng.randrange(256) for _ in range(8192))
    assert bad(mixed)


# --- 5 ---------------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(8)
    texts = []
    for i in range(90):
        lines = [f"line {rng.randrange(10**9)}" for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["  all rights reserved", "all rights reserved\t"]))
        if i % 9 == 0:
            lines.append("")
        texts.append("\n".join(lines))
    texts += [None, "", "\n"]
    rows = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 2, None).otherwise(F.col("source")))
    host = [None if i % 3 == 2 else f"src{i % 3}" for i in range(len(texts))]
    pages, hits = collections.Counter(host), collections.Counter()
    for h, t in zip(host, texts, strict=True):
        hits.update({(h, x.strip(" \t\r")) for x in (t or "").split("\n") if x.strip(" \t\r")})
    gone = {k for k, n in hits.items() if n >= 5 and pages[k[0]] >= 20 and n > 0.05 * pages[k[0]]}
    assert gone
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in gone) for i, (h, t) in enumerate(zip(host, texts, strict=True))}
    out = line_dedup.drop(rows)
    assert out.columns == rows.columns
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert all(r.n_chars == len(want[r.doc_id]) for r in out.where("text is not null").collect())
    digest = {r.doc_id: r for r in line_dedup.digests(rows).collect()}
    assert all(digest[i].kept_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items())
    assert line_dedup.drop(empty(spark)).count() == 0
    urls = spark.createDataFrame([("https://M.example.net/en?x=1",), ("no url",), (None,)], "u string")
    assert [r[0] for r in urls.select(line_dedup.page_host(F.col("u"))).collect()] == ["m.example.net", None, None]


# --- 6 ---------------------------------------------------------------------------------------------------------------------


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_rules():
    rng = random.Random(2)
    alphabet = [*"a1234560.@-+ ()é%_", "42", "255", "4111111111111111", "a.b@c.de", "+1 (202) 555-0147"]
    for _ in range(4000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == brute_spans(t), t


def test_pii(spark):
    texts = some_texts(4, 40) + ["é mail a.b@c.example.com now", "call +1 (202) 555-0147 or (202) 555-0199.", "4111 1111 1111 1111 and 10.0.0.1", "write to bob [at] example [dot] com please", "version 1.2.3.4 of 2024", "1." * 5000, "@" * 2000 + "9" * 20000]
    got = {r.doc_id: r for r in pii.digests(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(filter(None, got[i].spans.split(",")))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[0] == k for x in base) for k in pii.KINDS[:4])
        assert got[i].n_added == len(list(filter(None, got[i].spans.split(",")))) - len(base)
    masked = {r.doc_id: r for r in pii.mask(docs(spark, texts)).collect()}
    assert masked[40].text == "é mail [EMAIL] now" and masked[40].n_chars == len(masked[40].text)
    assert masked[42].text == "[CARD] and [IP]" and masked[0].text is None
    assert all(masked[i].text == t for i, t in enumerate(texts[:40]) if not got[i].spans)
    assert pii.digests(empty(spark)).count() == 0


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.6
    right = (0.95, 0.9, 0.85, 0.5, 0.8, 0.7)
    votes = np.stack([np.where(rng.random(20000) < p, truth, ~truth) for p in right], 1)
    v, n = np.unique(np.where(votes, pii.FOR, pii.AGAINST), axis=0, return_counts=True)
    p, theta = pii.reliabilities(np.zeros(len(v), int), v, n.astype(float))
    learned = theta[:, 1, pii.FOR]
    assert np.abs(learned - right).max() < 0.03
    beta = pii.train(np.zeros(len(v), int), v, n.astype(float), p)
    own = np.array([sum(int(x) << 2 * i for i, x in enumerate(row)) for row in v])
    said = dict(zip(own.tolist(), [pii.accepted(beta, 0, int(c)) for c in own], strict=True))
    codes = (np.where(votes, pii.FOR, pii.AGAINST) << (2 * np.arange(pii.N_LABELERS))).sum(1)
    assert np.mean([said[int(c)] == t for c, t in zip(codes, truth, strict=True)]) > 0.93


def test_added_spans_against_labels(spark):
    """Held against spans that were planted as personal data or as something that looks like it."""
    rng = random.Random(14)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    name = lambda: "".join(rng.choices("abcdefghij", k=6))

    def card(sep):
        while True:
            d = "4" + digits(15)
            if pii.luhn(d):
                return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    own = [lambda: ("mail me at ", f"{name()} [at] {name()} [dot] com"), lambda: ("call ", f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)}"), lambda: ("token = ", hexes(40)), lambda: ("password: ", hexes(32)), lambda: ("visa card ", card(".")), lambda: ("my host ", ":".join(hexes(4) for _ in range(8)))]
    decoys = [lambda: ("invoice no ", f"{digits(3)} {digits(3)}-{digits(4)}"), lambda: ("commit ", hexes(40)), lambda: ("version ", "/".join(digits(4) for _ in range(4))), lambda: ("checksum sha256 ", hexes(64))]
    texts, wanted = [], []
    for i in range(900):
        parts, at, mine = [], 0, set()
        for make, real in ((rng.choice(own), True), (rng.choice(decoys), False)):
            lead, span = make()
            piece = f"{name()} {name()} {lead}{span} {name()}\n"
            if real:
                begin = at + piece.index(lead) + len(lead)
                mine.add((begin, begin + len(span)))
            parts.append(piece)
            at += len(piece)
        # some are base spans, as in any corpus
        parts.append(f"mail {name()}@{name()}.com or +1 (202) 555-{digits(4)}\n" if i % 2 else "")
        texts.append("".join(parts))
        wanted.append(mine)
    got = {r.doc_id: r.spans for r in pii.digests(docs(spark, texts)).collect()}
    hit = false = 0
    for i, t in enumerate(texts):
        base = {(s, e) for _, s, e in brute_spans(t)}
        added = {(int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, got[i].split(","))} - base
        hit += len(added & wanted[i])
        false += len(added - wanted[i])
    total = sum(len(w) for w in wanted)
    assert hit > 0.9 * total and hit > 0.9 * (hit + false), (hit, false, total)


def test_personal_data_of_long_texts_takes_linear_time():
    import time

    t = "\n".join(f"call +1 (202) 555-{k:04d} or (202) 555-{k:04d}, a{k}@example.com" for k in range(9999))
    pii.candidates(t[: len(t) // 8])
    began = time.process_time()
    some = pii.candidates(t[: len(t) // 4])
    quarter = time.process_time() - began
    began = time.process_time()
    assert len(pii.candidates(t)) > 3.9 * len(some)
    assert time.process_time() - began < 8 * quarter


def test_given_gazetteers(spark):
    g = pii.gazetteers(domains=spark.createDataFrame([(".corp",), (None,)], "x string"), reserved=spark.createDataFrame([("8.0.0.0/8",)], "x string"))
    assert g.domain("corp") and not g.domain("com") and not g.personal([8, 8, 8, 8]) and g.personal([10, 0, 0, 1])
    assert pii.DEFAULT.domain("com") and pii.DEFAULT.issuer("4" * 16) and not pii.DEFAULT.issuer("9" * 16) and not pii.DEFAULT.personal([172, 20, 0, 1])


# --- 7 ---------------------------------------------------------------------------------------------------------------------


def test_stored_payloads_come_back():
    rng = random.Random(1)
    for t in (b"", b"abc", "é日".encode() * 70, b"x" * 64, bytes(rng.randrange(256) for _ in range(3 << 19))):
        payload = webp.padded(t)
        assert len(payload) % 64 == 0 and payload
        assert b"".join(p.astype("<u4").tobytes() for p in webp.load(webp.store(payload))) == payload


@pytest.mark.parametrize("cache", [0, 1, 5, 11])
@pytest.mark.parametrize("references", [False, True])
def test_webp_tools_round_trip(cache, references):
    rng = np.random.default_rng(cache)
    for trial in range(15):
        h, w = rng.integers(1, 26, 2)
        colours = int(rng.integers(1, [3, 5, 17, 200, 400][trial % 5]))
        p = rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (h, w))]
        bits = 2 + trial % 3
        size = ((h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits)
        modes = (rng.integers(0, 14, size).astype(np.uint32) << 8) | np.uint32(0xFF000000)
        cross = rng.integers(0, 2**24, size).astype(np.uint32)
        for steps in ((), ((webp.PREDICTOR, bits, modes),), ((webp.CROSS_COLOUR, bits, cross), (webp.SUBTRACT_GREEN,)), ((webp.PREDICTOR, bits, modes), (webp.CROSS_COLOUR, bits, cross), (webp.SUBTRACT_GREEN,)), ((webp.PALETTE,),) if colours <= 256 else ()):
            assert (webp.decode(webp.encode(p, steps, cache, references)) == p).all()


def test_unpacking_at_once_equals_symbol_by_symbol(monkeypatch):
    rng = np.random.default_rng(12)
    files, pictures = [], []
    for k in range(40):
        h, w = (int(x) for x in rng.integers(1, 40, 2))
        p = rng.integers(0, (3, 40, 1 << 32)[k % 3], (h, w), np.uint64).astype(np.uint32)
        p[h // 2 :] = p[: h - h // 2]
        files.append(webp.encode(p, (), (0, 1, 6, 9, None)[k % 5], bool(k % 2)))
        pictures.append(p)
    at_once = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "unpack", None)
    monkeypatch.setattr(webp, "AT_ONCE", 1 << 60)
    for p, a, f in zip(pictures, at_once, files, strict=True):
        assert (a == p).all() and (webp.decode(f) == p).all()


def test_texts_are_stored_with_the_tools_that_shorten_them(monkeypatch):
    rng = random.Random(2)
    plain = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300))
    texts = {"plain": plain, "words": "abcd" * 3 + "abcdefgh" * 200, "few": " ".join(rng.choices(["yes", "no!"], k=500)), "runs": "".join(c * rng.randint(30, 90) for c in rng.choices("abcdefghij", k=60)), "rows": "".join(f"{rng.randrange(10**9):032d}{'x' * 32}" for _ in range(40)), "copies": plain + "." * (-len(plain) % 4) + plain}
    used = collections.defaultdict(set)
    raw_plan, raw_matches, now = webp.plan, webp.matches, []

    def seen(what, said):
        used[now[-1]].update(said(what))
        return what

    monkeypatch.setattr(webp, "plan", lambda p: seen(raw_plan(p), lambda steps: {k[0] for k in steps}))
    monkeypatch.setattr(webp, "matches", lambda p: seen(raw_matches(p), lambda found: {"copies"} if found else set()))
    for name, t in texts.items():
        now.append(name)
        payload = webp.padded(t.encode())
        stored = webp.store(payload)
        assert b"".join(p.astype("<u4").tobytes() for p in webp.load(stored)) == payload
        assert len(stored) < len(payload)
    assert webp.PALETTE in used["few"] and "copies" in used["copies"]
    assert {webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN} & set.union(*used.values())


def test_webp_predictors_and_faults():
    rng = np.random.default_rng(7)
    p = rng.integers(0, 2**32, (9, 11), dtype=np.uint32)
    for mode in range(14):
        modes = np.full((3, 3), mode << 8, np.uint32)
        assert (webp.decode(webp.encode(p, ((webp.PREDICTOR, 2, modes),))) == p).all()
    data = webp.encode(p)
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + data[4:])
    with pytest.raises(ValueError):
        webp.decode(data[:16] + (20).to_bytes(4, "little") + data[20:41])
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)


def test_media_digests(spark):
    texts = some_texts(6, 30)
    got = {r.doc_id: r for r in webp.digests(docs(spark, texts)).collect()}
    files = {r.doc_id: bytes(r.media) for r in webp.to_media(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(files[i]) and r.media_sha256 == hashlib.sha256(files[i]).hexdigest()
    assert got[0].feature == got[1].feature
    assert webp.digests(empty(spark)).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    texts = some_texts(5, 60) + ["word " * 3000, "<|endoftext|> THE <|ENDOFTEXT|>.", "İΣ́ e.", "12,3.a b,c"]
    rows = docs(spark, texts)
    placed = packing.packed(rows.unionByName(rows)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in placed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, k * 2048, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want * 2), t
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    total = sum(r.length for r in placed)
    assert len(by_sequence) <= 1.05 * total / 2048 + 2
    assert packing.packed(empty(spark)).count() == 0
    whole = packing.sequences(rows).collect()
    assert sum(len(r.ids) for r in whole) == total // 2


def test_bins_choose_the_best_fit():
    rng = random.Random(1)
    for most in (1, 3, 50):
        bins, free, opened = packing.Bins(100, most), {}, []
        for _ in range(500):
            n = rng.randint(1, 100)
            fits = [f for b, f in free.items() if f >= n]
            b, offset = bins.place(n)
            if fits:
                assert free[b] == min(fits) and offset == 100 - free[b]
            else:
                assert b not in opened and offset == 0
                opened.append(b)
                if len(free) == most:
                    fullest = min(free, key=free.get)
                    if free[fullest] < 100 - n:
                        low = free[fullest]
                        gone = next(x for x in sorted(free, reverse=True) if free[x] == low and x not in itertools.chain(*bins.by_free))
                        del free[gone]
                    else:
                        continue
                free[b] = 100
            free[b] -= n
            if not free[b]:
                del free[b]
            assert sorted(free.values()) == sorted(f for f, x in enumerate(bins.by_free) for _ in x) and bins.open == len(free) <= most


# --- 9 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1 << 22, 5, 1])
def test_turns_come_back(monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE", piece)
    rng = random.Random(3)
    pieces = ["\\", "#", "##", "###", "<", "</turn>", "</turn>\n", "\n", ":", ": ", "é", "日", "a", "", "### assistant: "]
    for _ in range(200):
        n = rng.randint(0, 12)
        roles = [rng.choice(["user", "assistant", "system", "", "a:b", "x###", None, "assistant\\"]) for _ in range(n)]
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randint(0, 10))) for _ in range(n)]
        out, _, mask = chat_format.assemble(as_bytes(pa.array(roles, pa.string())), as_bytes(pa.array(texts, pa.string())))
        got = chat_format.parse(out, mask)
        assert [(a, b) for a, b, _, _ in got] == [((r or "").encode(), (t or "").encode()) for r, t in zip(roles, texts, strict=True)]
        assert [c for _, _, c, _ in got] == [(t or "").encode() if r == "assistant" else b"" for r, t in zip(roles, texts, strict=True)]
        assert sum(x[3] for x in got) == len(out.tobytes().decode())


def test_conversations(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é ### x", "\\</turn>", "plain"])) for c in [1, 2, None, 5] for t in range(rng.randint(1, 9))]
    rows += [(9, t, "assistant", "long é " * 50) for t in range(500)] + [(2, 0, "user", "again")] * 2
    table = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn int, role string, text string, formatted string").repartition(4)
    got = {r.conv_id: r for r in chat_format.digests(table).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = chat_format.formatted(table)
    chars = {r.conv_id: r.n for r in whole.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert chars == {c: r.formatted_chars for c, r in got.items()}
    assert chat_format.digests(table.limit(0)).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------------


def brute_kept(texts, k):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(d[i : i + k]) for d in split for i in range(len(d) - k + 1))
    out = []
    for d in split:
        gone = {i + n for i in range(len(d) - k + 1) if seen[tuple(d[i : i + k])] > 1 for n in range(k)}
        out.append([w for i, w in enumerate(d) if i not in gone])
    return split, out


@pytest.mark.parametrize(("k", "alphabet"), [(5, "ab"), (6, "abcd"), (35, "abcdefgh")])
@pytest.mark.parametrize(("group", "hot", "most", "shard"), [(1 << 23, 256, 60_000, 20_000), (400, 256, 60_000, 20_000), (400, 2, 60_000, 300), (400, 3, 200, 100), (700, 3, 0, 100)])
def test_substring_dedup(spark, monkeypatch, k, alphabet, group, hot, most, shard):
    for name, value in (("GROUP_BYTES", group), ("HOT", hot), ("MOST_PASSAGE_WORDS", most), ("SHARD_WORDS", shard)):
        monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(k)
    base = [rng.choice(alphabet) for _ in range(400)]
    texts = [None, "", "   ", "a " * 50]
    for _ in range(50):
        d = [rng.choice(alphabet * 3 + "xyz") for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 300)
            d[len(d) // 2 : len(d) // 2] = base[a : a + rng.randint(1, 80)]
        texts.append(rng.choice([" ", "\n"]).join(d))
    texts += texts[5:9]
    got = {r.doc_id: r for r in substring_dedup.digests(docs(spark, texts), k).collect()}
    for i, (whole, kept) in enumerate(zip(*brute_kept(texts, k), strict=True)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(whole), len(whole) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_substring_removal_and_reference(spark):
    rng = random.Random(6)
    passage = " ".join(rng.choices("abcdefghijk", k=40))
    texts = [f"one {passage} two", f"three\n{passage}", "short é text", None, passage[:20]]
    out = {r.doc_id: r.text for r in substring_dedup.remove(docs(spark, texts)).collect()}
    assert out == {0: "one two", 1: "three", 2: "short é text", 3: None, 4: passage[:20]}
    twice = docs(spark, [" ".join(map(str, range(40)))])
    assert [r.text for r in substring_dedup.remove(twice.unionByName(twice)).collect()] == ["", ""]
    reference = spark.createDataFrame([(passage,), (None,)], "text string")
    out = {r.doc_id: r.text for r in substring_dedup.remove_reference(docs(spark, texts), reference).collect()}
    assert out[0] == "one two" and out[1] == "three" and out[2] == "short é text" and out[4] == passage[:20]
    with pytest.raises(ValueError):
        substring_dedup.remove_reference(docs(spark, texts), reference, most_words=5)
    assert substring_dedup.digests(empty(spark)).count() == 0


def test_one_common_phrase_removes_nothing_else(spark, monkeypatch):
    """Windows that differ around one phrase, the anchor of all of them, in batches of their own."""
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 4000)
    rng = random.Random(8)
    phrases = [[f"p{i}q{k}" for k in range(18)] for i in range(4000)]
    column = as_bytes(pa.array([" ".join(x) for x in phrases]))
    phrase = phrases[int(np.argmin([grams(Words(column, i, i + 1).words(), 18)[0] for i in range(4000)]))]
    texts = [" ".join([f"{i}a{k}" for k in range(17)] + phrase + [f"{i}b{k}" for k in range(17)]) for i in range(3000)]
    passage = [f"s{k}" for k in range(60)]
    for i in rng.sample(range(3000), 700):  # beside it a passage that does repeat
        texts[i] += " " + " ".join(passage)
    got = {r.doc_id: r.n_removed for r in substring_dedup.digests(docs(spark, texts)).collect()}
    assert got == {i: 60 if "s59" in t else 0 for i, t in enumerate(texts)}


def test_line_dedup_keeps_columns_with_the_names_of_helpers(spark):
    rows = spark.createDataFrame([(i, f"menu\nown {i}", "s", "h", "l", 1, i, 2) for i in range(30)], "doc_id long, text string, source string, _host string, _lines string, page_host int, common_lines int, Kept_Lines int")
    out = line_dedup.drop(rows)
    assert out.columns == rows.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"own {i}", "s", "h", "l", 1, i, 2) for i in range(30)]


@pytest.mark.parametrize(("pages", "hits", "dropped"), [(19, 19, False), (20, 20, True), (100, 4, False), (100, 5, False), (100, 6, True)])
def test_small_hosts_lose_nothing(spark, pages, hits, dropped):
    rows = spark.createDataFrame([(i, "menu" if i < hits else f"own {i}", "s") for i in range(pages)], "doc_id long, text string, source string")
    assert line_dedup.drop(rows).where("text = ''").count() == (hits if dropped else 0)
    if pages == 19:
        assert line_dedup.drop(rows, min_pages=1, min_hits=1).where("text = ''").count() == 19


def test_packing_with_another_vocabulary_and_long_texts(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, world. It's fine", "  two\n\nlines ", None, "", "a.b,c", "<|endoftext|> x"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in packing.pieces(docs(spark, texts), path, ids=True).collect()}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    t = Tokenizer.from_file(packing.vocabulary())
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    e = packing.Encoder(packing.vocabulary())
    texts = [" ".join(x for x in some_texts(5) if x), "x" * 900, "a " * 400, "é, b. " * 99 + "end"]
    column = as_bytes(pa.array(texts))
    for i, x in enumerate(texts):
        flat, n = packing.rows_of_ids(e, column, i, i + 1)
        assert flat.tolist() == [*t.encode(x, add_special_tokens=False).ids, 0] and n.tolist() == [len(flat)]


def test_columns_with_the_names_of_helpers(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, passage, "k", "r", 7, 8), (2, passage, "k", "r", 7, 8)], "doc_id long, text string, row_key string, Repeats string, _rk int, _spans int")
    out = substring_dedup.remove(rows)
    assert out.columns == rows.columns and sorted(tuple(r) for r in out.collect()) == [(1, "", "k", "r", 7, 8), (2, "", "k", "r", 7, 8)]


def test_windows_of_one_anchor_are_told_apart_by_all_their_bits(spark):
    passage = " ".join(f"w{i}" for i in range(34))
    texts = [f"{passage} x40893", f"{passage} x140502", f"{passage} x18517", f"{passage} x91288"]
    _, _, anchor, key = substring_dedup.windows(Words(as_bytes(pa.array(texts)), 0, 4), 35)
    assert len(set(anchor.tolist())) == 1 and len(set(key.tolist())) == 4 and len(set((key >> np.uint64(32)).tolist())) == 2
    assert [r.n_removed for r in substring_dedup.digests(docs(spark, texts)).collect()] == [0] * 4


def test_automaton_counts_occurrences():
    rng = random.Random(1)
    for _ in range(50):
        sequences = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        weights = [rng.randint(1, 3) for _ in sequences]
        a = substring_dedup.Automaton()
        for s, w in zip(sequences, weights, strict=True):
            a.add(s, w)
        a.finish()
        for probe in sequences:
            marked = {i for s, e in a.spans(probe, 3, 3) for i in range(s, e)}
            want = set()
            for s, e in itertools.combinations(range(len(probe) + 1), 2):
                n = sum(w * sum(q[i : i + e - s] == probe[s:e] for i in range(len(q) - (e - s) + 1)) for q, w in zip(sequences, weights, strict=True))
                if e - s >= 3 and n >= 3:
                    want |= set(range(s, e))
            assert marked == want


# --- all of them -----------------------------------------------------------------------------------------------------------

#: Extra columns with the names that operators use inside.
ODD = "_rk long, _spans string, rk long, rid long, row_key string, root long, block long, blob string, is_block int, kind string, unit string, h long, place int, found string, page_host string, kept_lines string, ids string, n_words long, kept string, perplexity string, limit_lang string"
PER_ROW = {
    "sentencepiece": lambda d: piece_lattice.encode(d).select("doc_id", "ids"),
    "model": lambda d: quality_model.classify(d, d.sparkSession.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).select("doc_id", "n_bytes", "kept"),
    "jaccard": lambda d: jaccard_join.join(d).select("doc_id", "n_shingles", "component_id"),
    "rules": quality_rules.judge,
    "lines": line_dedup.digests,
    "pii": pii.digests,
    "webp": webp.digests,
    "packing": lambda d: packing.pieces(d).select("doc_id", "piece", "length", "ids_crc32"),
    "substrings": substring_dedup.digests,
}
KEEPING = {"rules": quality_rules.reject, "lines": line_dedup.drop, "jaccard": jaccard_join.dedup, "pii": pii.mask, "substrings": substring_dedup.remove}


@pytest.mark.parametrize("name", PER_ROW)
def test_repeated_rows_each_get_their_result(spark, name):
    texts = [None, "", " ", "call +1 (202) 555-0147 now", "one two three four five six " * 12, "Ein Wort, noch ein Wort.\nmenu\n"]
    rows = docs(spark, texts)
    got = collections.Counter(str(r.asDict()) for r in PER_ROW[name](rows.unionByName(rows)).collect())
    assert got and all(n % 2 == 0 for n in got.values())
    ids = collections.Counter(r.doc_id for r in PER_ROW[name](rows.unionByName(rows)).collect())
    assert set(ids) == set(range(len(texts)))


@pytest.mark.parametrize("name", PER_ROW)
def test_columns_of_any_name_do_no_harm(spark, name):
    names = [c.split()[0] for c in ODD.split(", ")]
    texts = ["call +1 (202) 555-0147 now", "one two three four five six " * 12, None]
    plain = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    odd = spark.createDataFrame([(i, t, "en", "s", *[1 if c.split()[1] in ("long", "int") else "x" for c in ODD.split(", ")]) for i, t in enumerate(texts)], f"doc_id long, text string, lang string, source string, {ODD}")
    assert sorted(map(str, PER_ROW[name](odd).collect())) == sorted(map(str, PER_ROW[name](plain).collect()))
    if name in KEEPING:
        out = KEEPING[name](odd)
        assert out.columns == odd.columns and all([r[c] for c in names] == [1 if c.split()[1] in ("long", "int") else "x" for c in ODD.split(", ")] for r in out.collect())


def test_a_text_of_a_megabyte_beside_short_ones(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=180_000)) + "\n" + "x" * 40_000 + " \n" + "é" * 40_000, "short text", None]
    rows = docs(spark, texts, 2)
    assert len(texts[0].encode()) > 1 << 20
    want = brute_rules(texts[0])
    got = {r.doc_id: r for r in quality_rules.judge(rows).collect()}[0]
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
    assert {r.doc_id: r.component_id for r in jaccard_join.join(rows).collect()} == {0: 0, 1: 1, 2: 2}
    _, kept = brute_kept(texts, 35)
    assert {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.digests(rows).collect()} == {i: len(k) for i, k in enumerate(kept)}
    payload = webp.padded(texts[0].encode())
    assert {r.doc_id: r.payload_sha256 for r in webp.digests(rows).collect()}[0] == hashlib.sha256(payload).hexdigest()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.vocabulary())
    assert {r.doc_id: r.ids for r in piece_lattice.encode(rows).collect()}[0] == library.encode(texts[0])
