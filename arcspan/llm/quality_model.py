"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and perplexity limits by language.

The n-grams are of :data:`ORDER` characters (code points, case kept; a text begins with begin marks), with an open vocabulary, so
the model grows with the trusted text. Everything is tables joined in shards:

1. Training (:func:`train`). Tasks count the n-grams of their trusted texts; the counts are summed by (language, n-gram). The
   lower orders are continuation counts, taken from the distinct n-grams of the next order. Each order has its own discounts from
   its counts of counts, by language. The model is a table for each order of the probabilities of seen n-grams, interpolated, and
   one of the backoff weights of seen contexts.
2. Requests (:func:`_ask`). Blocks of documents ask for their distinct n-grams, once each.
3. Count joins (:func:`looked_up`). The distinct n-grams of all blocks are joined with the tables of all orders, which gives the
   log-probability of each, and these are joined with the requests and go back to their blocks.
4. Perplexity (:func:`_score`). Blocks sum the log-probabilities of their documents' n-grams.

A document is kept when its perplexity is at most its language's limit: the :data:`QUANTILE` quantile of trusted documents that were
held out of training (one in :data:`HELD_OUT`, by a hash of the id), times :data:`MARGIN`; of those trained on, where a language has
no held-out document.

Documents travel to their log-probabilities once, in compressed blocks. Trusted ids are broadcast up to :data:`MOST_IDS` of them. A long text is read in pieces; a block takes memory for its
bytes and about 20 bytes for each distinct n-gram.

Defined results: null and empty texts have no perplexity and are not kept; documents in languages without trusted text are
scored by nothing and kept; a null language is one of its own; a perplexity equal to its limit is kept; repeated rows each get a
row, repeated labels count once; an empty table gives an empty table; other columns are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import PLACES, as_bytes, block_name, cut, in_blocks, kinds_of, lean, mix, offsets, pack_arrays, pressed, runs, shards, slices, table, unpack_arrays, unpressed

ORDER = 4
QUANTILE, MARGIN, HELD_OUT = 0.99, 1.1, 10
#: Bytes of text in a block; characters of a long text that are read at once.
BLOCK_BYTES, PIECE = 1 << 23, 1 << 19
#: The begin mark, written so that any text may contain it.
BEGIN = "\x02"
#: Trusted ids that are broadcast to all tasks; beyond them documents and ids are shuffled to each other.
MOST_IDS = 1_000_000


def ngrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (large binary) in parts: code points with marks before each row, the n-grams' first places, and their rows."""
    before = ORDER - 1
    marks = np.full(before, ord(BEGIN), np.uint32)
    for i, j in slices(column, PIECE):
        off = offsets(column)[i : j + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8, int(off[-1])) if off[-1] > off[0] else np.zeros(0, np.uint8)
        if j == i + 1:
            text = raw[off[0] : off[-1]].tobytes().decode()
            for a in range(0, len(text), PIECE):
                points = np.frombuffer(text[max(0, a - before) : a + PIECE].encode("utf-32-le"), np.uint32)
                n = min(PIECE, len(text) - a)
                points = np.concatenate([marks[: before + n - len(points)], points])
                yield points, np.arange(n), np.full(n, i)
            continue
        points = np.frombuffer(raw[off[0] : off[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        count = np.diff(np.concatenate([[0], np.cumsum((raw[off[0] : off[-1]] & 0xC0) != 0x80)])[off - off[0]])
        rows = np.repeat(np.arange(j - i), count)
        place = np.arange(len(points)) + before * (rows + 1)
        out = np.full(len(points) + before * (j - i), ord(BEGIN), np.uint32)
        out[place] = points
        yield out, place - before, rows + i


def hashes(points: np.ndarray, at: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams at these places, with a number for the language of each."""
    mixed, n = mix(points + PLACES[80]), len(points) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        out += mixed[k : k + n] * PLACES[k]
    return mix(out[at] + tags * PLACES[ORDER])


def _tag(lang: str | None) -> str:
    return "" if lang is None else "=" + lang


def _distinct(langs: list[str | None], column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts: the hashes of their distinct n-grams in order, their counts, and their keys (language and n-gram)."""
    kinds = {x: k for k, x in enumerate(dict.fromkeys(langs))}
    tag = np.array([kinds[x] for x in langs], np.uint64)
    names = [_tag(x) for x in kinds]
    hash_, count, key = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
    parts, held = [], 0
    for points, at, rows in ngrams(column):
        h, one, which = kinds_of(hashes(points, at, tag[rows]))
        n = np.bincount(which, minlength=len(h))
        parts.append((h, n, points[at[one][:, None] + np.arange(ORDER)], tag[rows[one]].astype(np.int64)))
        held += len(h)
        if held > 1_000_000:
            parts, held = [_merged(parts)], 0
    if parts:
        hash_, count, grams, kind = _merged(parts)
        grams = np.ascontiguousarray(grams).view(f"<U{ORDER}").reshape(-1)
        # a string that ends in NUL characters would lose them
        key = [names[k] + g + "\0" * (ORDER - len(g)) for k, g in zip(kind.tolist(), grams.tolist(), strict=True)]
    return hash_, count, pa.array(key, pa.string())


def _merged(parts: list[tuple]) -> tuple:
    h, n, grams, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    h, one, which = kinds_of(h)
    return h, np.bincount(which, n, len(h)).astype(np.int64), grams[one], kind[one]


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (key, n): the distinct n-grams of a batch's texts."""
    for batch in in_blocks(batches, size):
        _, n, key = _distinct(batch.column(0).to_pylist(), as_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([key, pa.array(n)], names=["key", "n"])


def _discount(lang_counts: DataFrame, order: int) -> DataFrame:
    """(tag, d1, d2, d3): modified Kneser-Ney discounts of an order's counts, by language."""
    ns = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]
    t = lang_counts.groupBy("tag").agg(*ns)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ratio = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(1.0)
    spare = (0.5, 0.75, 0.9)
    sound = (F.col("n1") > 0) & (F.col("n2") > 0)
    d = [F.when(sound, F.greatest(F.lit(0.05), F.least(k - (k + 1) * y * ratio(k), F.lit(k - 0.05)))).otherwise(spare[k - 1]).alias(f"d{k}") for k in range(1, 4)]
    return t.select("tag", *d)


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on, of a table with lang and text: (tag, gram, p) of seen n-grams and (tag, gram, weight) of seen contexts."""
    size = BLOCK_BYTES
    counts = trusted.select(F.col("lang").cast("string"), "text").mapInArrow(lean(lambda b: _count(b, size)), "key string, n long")
    counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
    orders = [cut(counts.select(F.expr(f"left(key, length(key) - {ORDER})").alias("tag"), F.expr(f"right(key, {ORDER})").alias("gram"), "n"))]
    for _ in range(ORDER - 1):
        orders.append(cut(orders[-1].groupBy("tag", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count("*").alias("n"))))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, t in enumerate(reversed(orders), 1):
        context = F.substring("gram", 1, k - 1).alias("context")
        of = [F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2)]
        stats = t.groupBy("tag", context).agg(F.sum("n").alias("total"), *of, F.count(F.when(F.col("n") > 2, 1)).alias("n3"), F.count("*").alias("kinds"))
        stats = stats.join(_discount(t, k), "tag").withColumn("weight", sum(F.col(f"d{i}") * F.col(f"n{i}") for i in (1, 2, 3)) / F.col("total"))
        stats = cut(stats)
        own = F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = t.select("tag", "gram", context, "n").join(stats.drop("n1", "n2", "n3"), ["tag", "context"])
        if k == 1:  # one more kind stands for all characters not seen
            lower = seen.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            shorter = out[-1][0].select("tag", F.col("gram").alias("end"), F.col("p").alias("lower"))
            lower = seen.withColumn("end", F.substring("gram", 2, k - 1)).join(shorter, ["tag", "end"])
        p = lower.select("tag", "gram", (own / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
        weight = F.col("weight") / (F.col("kinds") + 1) if k == 1 else F.col("weight")
        out.append((cut(p), stats.select("tag", F.col("context").alias("gram"), weight.alias("weight"))))
    return out


def looked_up(keys: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, logp) of distinct keys: the longest end of the n-gram that was seen, times the weights of the longer contexts that were.

    Null in languages without a model. The weight of the empty context is the probability of a character not seen.
    """
    found = keys.withColumn("tag", F.expr(f"left(key, length(key) - {ORDER})")).withColumn("gram", F.expr(f"right(key, {ORDER})"))
    for k, (p, weight) in reversed([*enumerate(model, 1)]):
        end, context = F.substring("gram", ORDER - k + 1, k), F.substring("gram", ORDER - k + 1, k - 1)
        found = found.withColumn("end", end).withColumn("context", context)
        found = found.join(p.select("tag", F.col("gram").alias("end"), F.col("p").alias(f"p{k}")), ["tag", "end"], "left")
        found = found.join(weight.select("tag", F.col("gram").alias("context"), F.col("weight").alias(f"w{k}")), ["tag", "context"], "left").drop("end", "context")

    def back(value: Column, k: int) -> Column:
        return F.coalesce(F.log(f"p{k}"), F.coalesce(F.log(f"w{k}"), F.lit(0.0)) + value)

    return found.select("key", reduce(back, range(2, ORDER + 1), F.coalesce(F.log("p1"), F.log("w1"))).alias("logp"))


def _ask(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) to requests of blocks: the distinct n-grams, by place in the order of their hashes."""
    for batch in in_blocks(batches, size):
        _, _, key = _distinct(batch.column(1).to_pylist(), as_bytes(batch.column(2)))
        block = block_name(batch)
        for a in range(0, len(key), 1 << 16):
            part = key.slice(a, 1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(a, a + len(part)), pa.int32()), part], names=["block", "place", "key"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, logp) to one blob of answers for each block and stretch of rows."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, place, logp = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in range(3))
        order = np.argsort(block, kind="stable")
        block, place, logp = block[order], place[order].astype(np.uint32), logp[order].astype(np.float32)
        cuts, ends = runs(block)
        blobs = [pack_arrays(place[a:b], logp[a:b]) for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([False] * len(cuts)), pa.array(blobs, pa.binary())], names=["block", "is_block", "blob"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 1 << 20:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, the answers and then the block: doc_id, lang, n_bytes, perplexity."""
    now, held, logp = None, [], None
    for batch in batches:
        for block, is_block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if block != now:
                now, held, logp = block, [], None
            if not is_block:
                held.append(unpack_arrays(blob.as_buffer().to_pybytes(), np.uint32, np.float32))
                continue
            if logp is None:
                logp = np.zeros(1 + max((int(p.max()) for p, _ in held if len(p)), default=-1))
                for place, value in held:
                    logp[place] = value
                held = []
            yield _scored(unpressed(blob), logp)


def _scored(batch: pa.RecordBatch, logp: np.ndarray) -> pa.RecordBatch:
    langs, column = batch.column(1).to_pylist(), as_bytes(batch.column(2))
    kinds = {x: k for k, x in enumerate(dict.fromkeys(langs))}
    tag = np.array([kinds[x] for x in langs], np.uint64)
    parts = []
    for points, at, rows in ngrams(column):
        h, _, which = kinds_of(hashes(points, at, tag[rows]))
        parts.append((h, which.astype(np.int32), rows.astype(np.int32)))
    order = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h, _, _ in parts]]))
    if len(order) != len(logp):
        raise ValueError("the documents came in other blocks than those that asked")
    total, n = np.zeros(len(langs)), np.zeros(len(langs), np.int64)
    for h, which, rows in parts:
        total += np.bincount(rows, logp[np.searchsorted(order, h)][which], len(langs))
        n += np.bincount(rows, minlength=len(langs))
    mean = -total / np.maximum(n, 1)
    out = pa.array(np.exp(mean), mask=(n == 0) | np.isnan(mean))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets(column))), out], names=["doc_id", "lang", "n_bytes", "perplexity"])


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], scan: bool = False) -> DataFrame:
    """Per document: doc_id, lang, n_bytes, perplexity (null without a model or a text).

    The documents are read twice and must come in the same blocks. With ``scan``, they do, as ``docs`` only reads files; otherwise
    they are written to a table first. Other blocks than those that asked are an error, never a wrong score.
    """
    width, size = shards(docs), BLOCK_BYTES
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("lang").cast("string"), "text")
    read = read if scan else cut(read)
    asked = cut(read.mapInArrow(lean(lambda b: _ask(b, size)), "block long, place int, key string"))
    told = cut(looked_up(asked.select("key").distinct(), model))
    answers = asked.join(told, "key").select("block", "place", F.coalesce("logp", F.lit(float("nan"))).alias("logp"))
    rows = "block long, is_block boolean, blob binary"
    both = answers.mapInArrow(lean(_told), rows).unionByName(read.mapInArrow(lean(lambda b: pressed(b, size)), rows))
    dealt = both.repartition(width, "block").sortWithinPartitions("block", "is_block")
    return dealt.mapInArrow(lean(_score), f"doc_id {kind}, lang string, n_bytes long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of quality 1, marked to be broadcast if they are :data:`MOST_IDS` at most, and else left to a shuffle."""
    ids = labels.where("quality = 1").select("doc_id")
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def trusted_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "text").join(trusted_ids(labels), "doc_id", "left_semi")


def _held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, scan: bool = False) -> DataFrame:
    """Per document: doc_id, lang, n_bytes, perplexity, its language's limit, kept."""
    scored = cut(score(docs, train(trusted_docs(docs, labels).where(~_held_out())), scan))
    ids = trusted_ids(labels)
    of = lambda part: F.percentile_approx(F.when(part, F.col("perplexity")), quantile, 10000)
    limits = scored.join(ids, "doc_id", "left_semi").groupBy("lang").agg((F.coalesce(of(_held_out()), of(F.lit(True))) * margin).alias("max_perplexity"))
    limits = cut(limits.select(F.coalesce("lang", F.lit("\0")).alias("limit_lang"), "max_perplexity"))
    joined = scored.withColumn("limit_lang", F.coalesce("lang", F.lit("\0"))).join(limits, "limit_lang", "left").drop("limit_lang")
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("max_perplexity"), F.lit(True))
    return joined.withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scan=True)
