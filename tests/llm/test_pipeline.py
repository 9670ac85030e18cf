"""The corpus pipeline on small tables, and the registry."""

import collections
import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
from arcspan.llm import packing, quality_rules, queries
from arcspan.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = corpus_pipeline.cut(out)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids
    assert all(r.length <= 2048 for r in rows)


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
    assert docs.count() == 0


def test_near_duplicates_are_of_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = [*words], [*words]
    for k in (30, 60):  # 5-word shingles 86 of 106, 4-word shingles 89 of 105
        near[k] = f"x{k}"
    for k in (20, 50, 80):  # 81 of 111
        far[k] = f"y{k}"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, near, far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2]


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def _brute(rows):
    """All stages but the last by plain Python, on (doc_id, text, source) without candidates for added spans: id to text."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    squeeze = lambda x: len(x) / len(quality_rules.zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x))
    inside = lambda x, bands: next(a <= squeeze(x) <= b for n, a, b in bands if len(x) <= n)

    def good(t):
        w, raw = split(t), (t or "").encode()
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        if len(w) < 50 or 100 * len(covered) > 50 * len(w) or not inside(raw, quality_rules.WHOLE_BANDS):
            return False
        wrong = sum(len(x) for a in range(0, len(raw), 4096) if not inside(x := raw[a : a + 4096], quality_rules.CHUNK_BANDS))
        return wrong <= 0.34 * len(raw)

    kept = [r for r in rows if good(r[1])]
    pages = collections.Counter(s for _, _, s in kept)
    hits = collections.Counter((s, x) for _, t, s in kept for x in {y.strip(" \t\r") for y in t.split("\n")} if x)
    common = {(s, x) for (s, x), n in hits.items() if pages[s] >= 20 and n >= 5 and n > 0.05 * pages[s]}
    kept = [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in common), s) for i, t, s in kept]

    def shingles(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in split(t)]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, group = [shingles(t) for _, t, _ in kept], list(range(len(kept)))
    for a, b in itertools.combinations(range(len(kept)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for k, (i, _, _) in enumerate(kept):
        key = group[k] if sets[k] else ("alone", i)
        least[key] = min(least.get(key, i), i)
    kept = [r for r in kept if r[0] in least.values()]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    return {i: phone.sub("[PHONE]", email.sub("[EMAIL]", t)) for i, t, _ in kept}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(600)]
    prose = lambda n: "".join(w + rng.choice([" ", " ", " ", ". ", "\n"]) for w in rng.choices(vocabulary, k=n))
    rows = []
    for i in range(120):
        kind = i % 12
        t = prose(rng.randint(60, 900))
        if kind == 0:
            t = prose(20)
        elif kind == 1:
            t = "buy now " * 200
        elif kind == 2 and rows:
            t = rng.choice(rows)[1] or ""
        elif kind == 3 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        elif kind == 4:
            t += f"\nwrite to person{i}@mail.example.com\nor call +1 (202) 555-01{i % 90 + 10}\n"
        elif kind == 5:
            t = "".join(chr(rng.randrange(33, 0x2000)) for _ in range(3000))
        elif kind == 6:
            t = None if i % 24 == 6 else ""
        if t and (i // 2) % 3 == 0:
            t = "Home | News | About us\n" + t + "\n All rights reserved \n"
        rows.append((i, t, "en", f"src{i % 2}", len(t or "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = _brute([(i, t, s) for i, t, _, s, _ in rows])
    assert 40 < len(want) < 100 and sum("[EMAIL]" in t for t in want.values()) > 5 and not any("All rights" in t for t in want.values())

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    expected = {}
    for i, t in want.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for piece, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            expected[i, piece] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
