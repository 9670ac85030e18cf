r"""SentencePiece encoding and decoding: a relational lattice.

Texts are written with ``▁`` for spaces and one before the text, and cut into units that no piece crosses: between two characters
that stand side by side in no piece, which is known from the last byte of one and the first byte of the other. Each distinct unit
is encoded once: its substrings up to the longest piece's length are exploded and equi-joined with the piece table (a model's size, broadcast by the planner); the joined edges are
grouped by unit and folded with Spark's ``aggregate``. The fold is Viterbi for unigram models (:func:`viterbi`): best score to each
place, from the edges that end there. The public vocabulary is of the BPE kind, where the greatest sum of scores is not the
library's answer; for it the same lattice is folded by merges (:func:`merge`): the neighbouring pair whose edge has the best score,
the leftmost of equals, until no pair has an edge. Characters without a piece become byte pieces, or the unknown piece if the
model has none. Cuts are the bits of a long. Units over
:data:`MOST_FOLDED` characters, which a fold would also take quadratic time for, are merged with a heap.

Tasks send the distinct units of a group of texts with counts, by shard. When all units are encoded, the most frequent ones, at
most :data:`MOST_KNOWN`, are broadcast. Blocks of texts ask for the others, each distinct one once; what they ask is joined with the
encoded units, and answers and compressed blocks meet again by the block's name, a hash of its texts. So texts must come in the same
blocks when they are read again: with ``scan`` they do, as the table only reads files; otherwise they are written to one first. Other
blocks than those that asked are an error. Decoding gathers the pieces' bytes by id in one pass.

Defined results: null and empty texts have no ids; repeated rows each get a row; an empty table gives an empty table; of equal
scores the leftmost merge comes first; only the key and the text are read, so other columns may have any name. Long texts are cut
into units like others; a long unit is merged with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import BYTES, PLACES, as_bytes, block_name, by_shard, cut, in_blocks, kinds_of, lean, mix, offsets, pack_arrays, powers, pressed, runs, shards, slices, table, unpack_arrays, unpressed

SPACE = "▁"
MOST_FOLDED = 60
#: Units that are broadcast, and their bytes there; bytes of text whose units are counted before they are sent, and of a block.
MOST_KNOWN, KNOWN_BYTES, GROUP_BYTES, BLOCK_BYTES = 500_000, 1 << 25, 1 << 23, 1 << 22
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass(frozen=True)
class Model:
    """A piece table and how to fold it. ``joined``: 256 times the last byte of a character plus the first byte of the next, of all
    neighbours inside a piece."""

    kind: int
    rows: tuple[tuple[str, int, float, int], ...]
    longest: int
    joined: tuple[int, ...]
    unknown: int
    bytes: tuple[int, ...]

    def pieces(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, kind, rank), rank 0 for the best score and the same for equal ones."""
        place = {x: i for i, x in enumerate(sorted({r[2] for r in self.rows}, reverse=True))}
        return spark.createDataFrame([(*r, place[r[2]]) for r in self.rows], "piece string, id int, score double, kind int, rank long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path or vocabulary(), "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models without normalisation are supported")
    return model(m.trainer_spec.model_type, [(p.piece, i, float(p.score), int(p.type)) for i, p in enumerate(m.pieces)])


def model(kind: int, rows: list[tuple[str, int, float, int]]) -> Model:
    normal = [p for p, _, _, k in rows if k == NORMAL]
    written = [p.replace(SPACE, " ") for p in normal]
    joined = {256 * a.encode()[-1] + b.encode()[0] for p in written for a, b in zip(p, p[1:], strict=False)}
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("a piece crosses words")
    if rows and max(i for _, i, _, _ in rows) >> ID_BITS:
        raise ValueError(f"ids must have {ID_BITS} bits at most")
    by_byte = {p: i for p, i, _, k in rows if k == BYTE}
    unknown = next((i for _, i, _, k in rows if k == UNKNOWN), 0)
    return Model(kind, tuple(rows), max(map(len, normal), default=1), tuple(sorted(joined)), unknown, tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)) if len(by_byte) == 256 else ())


def lattice(words: DataFrame, pieces: DataFrame, longest: int, least: int, edge: Column, most: int = 1 << 30) -> DataFrame:
    """(unit, n, edges) of words (unit, n): the pieces of ``least`` characters or more that stand in each unit from place s to place
    e, as ``edge`` writes them from (s, e, id, score, rank), in order. Units over ``most`` characters have none; a column ``long_ids``
    is carried on.

    Words that are dealt by unit are grouped again without another shuffle."""
    size = F.length("unit")
    more = [c for c in words.columns if c == "long_ids"]
    starts = F.when((size >= least) & (size <= most), F.sequence(F.lit(0), size - least))
    spans = words.select("unit", "n", *more, size.alias("size"), F.explode_outer(starts).alias("s"))
    lengths = F.when(F.col("s").isNotNull(), F.sequence(F.lit(least), F.least(F.lit(longest), F.col("size") - F.col("s"))))
    spans = spans.select("unit", "n", *more, "s", F.explode_outer(lengths).alias("l"))
    spans = spans.select("unit", "n", *more, "s", "l", F.substring("unit", F.col("s") + 1, F.col("l")).alias("piece"))
    # joined by a 64-bit hash, as a table with a long key is probed fastest, and then compared
    known = pieces.where((F.col("kind") == NORMAL) & (F.length("piece") >= least)).select(F.xxhash64("piece").alias("h"), F.col("piece").alias("same"), "id", "score", "rank")
    found = spans.withColumn("h", F.xxhash64("piece")).join(F.broadcast(known), "h", "left").withColumn("id", F.when(F.col("piece") == F.col("same"), F.col("id")))
    found = found.where(f"id IS NOT NULL OR s IS NULL OR s = 0 AND l = {least}").withColumn("e", F.col("s") + F.col("l"))
    return found.groupBy("unit").agg(F.max("n").alias("n"), *[F.any_value(c).alias(c) for c in more], F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("edges"))


#: An edge in a long, best first: rank of its score, s, e (six bits each), id (:data:`ID_BITS`). And its parts, with bits for its
#: ends and the places inside it.
ID_BITS = 24
CODE = f"(rank << {ID_BITS + 12}) + (cast(s AS bigint) << {ID_BITS + 6}) + (cast(e AS bigint) << {ID_BITS}) + id"


def _bit(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), c)


def _decoded(codes: Column) -> Column:
    def one(c: Column) -> Column:
        s, e = (F.call_function("shiftright", c, F.lit(n)).bitwiseAND(F.lit(63)).cast("int") for n in (ID_BITS + 6, ID_BITS))
        return F.struct(s.alias("s"), e.alias("e"), c.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("id"), _bit(s).bitwiseOR(_bit(e)).alias("ends"), (_bit(e) - _bit(s + 1)).alias("inside"))

    return F.transform(codes, one)


#: Set beside the cuts when no pair is left.
DONE = 1 << 62


def merge(unit: Column, edges: Column) -> Column:
    """Cuts of a unit after all merges, a bit for each place between its pieces, both ends included. Edges come best first."""
    n = F.length(unit)

    def step(cuts: Column, _: Column) -> Column:
        # an edge joins two neighbours if its ends are cuts and one cut is inside it
        pair = lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inside"])) == 1)
        best = F.get(F.filter(edges, pair), F.lit(0))
        merged = F.when(best.isNull(), cuts.bitwiseOR(F.lit(DONE))).otherwise(cuts.bitwiseAND(F.bitwise_not(best["inside"])))
        return F.when(cuts >= DONE, cuts).otherwise(merged)

    most = F.least(n - 1, F.size(edges))
    rounds = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1, step).bitwiseAND(F.lit(DONE - 1))


def viterbi(unit: Column, edges: Column, unknown_score: float) -> Column:
    """Cuts of a unit along the path of greatest score; ties go to the longer last piece. Characters without a piece cost
    ``unknown_score``."""
    empty = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts")))

    def step(best: Column, e: Column) -> Column:
        def reach(x: Column) -> Column:
            from_ = F.get(best, x["s"])
            return F.struct((from_["score"] + x["score"]).alias("score"), (-x["s"]).alias("first"), F.concat(from_["cuts"], F.array(e)).alias("cuts"))

        ending = F.filter(edges, lambda x: x["e"] == e)
        single = F.exists(ending, lambda x: x["s"] == e - 1)
        last = F.get(best, e - 1)
        spare = F.struct((last["score"] + F.lit(unknown_score)).alias("score"), (-(e - 1)).alias("first"), F.concat(last["cuts"], F.array(e)).alias("cuts"))
        ways = F.concat(F.transform(ending, reach), F.when(single, F.array().cast("array<struct<score:double,first:int,cuts:array<int>>>")).otherwise(F.array(spare)))
        top = F.array_max(ways)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["cuts"].alias("cuts"))))

    folded = F.aggregate(F.sequence(F.lit(1), F.length(unit)), empty, step)
    return F.element_at(folded, -1)["cuts"]


def spare_ids(char: Column, m: Model) -> Column:
    """The ids of a character that no longer piece took: its own piece, its bytes, or the unknown piece."""
    own = {p: i for p, i, _, k in m.rows if k == NORMAL and len(p) == 1}
    near = F.array(*[F.lit(own.get(chr(c))).cast("int") for c in range(0x250)])
    far = [x for c, i in own.items() if ord(c) >= 0x250 for x in (F.lit(c), F.lit(i))]
    far = F.try_element_at(F.create_map(*far), char) if far else F.lit(None).cast("int")
    found = F.when(F.ascii(char) < 0x250, F.get(near, F.ascii(char))).otherwise(far)
    if m.bytes:
        code = F.hex(F.encode(char, "utf-8"))
        pairs = F.transform(F.sequence(F.lit(0), F.octet_length(char) - 1), lambda k: F.conv(F.substring(code, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))
        spare = F.transform(pairs, lambda b: F.get(F.array(*[F.lit(x) for x in m.bytes]), b))
    else:
        spare = F.array(F.lit(m.unknown))
    return F.when(found.isNotNull(), F.array(found)).otherwise(spare)


def ids(unit: Column, chosen: Column, places: Column, m: Model) -> Column:
    """The ids between the places of cuts, from the chosen edges (s, id) and the characters between them."""

    def one(k: Column) -> Column:
        found = F.get(F.filter(chosen, lambda x: x["s"] == k), F.lit(0))["id"]
        return F.when(found.isNotNull(), F.array(found)).otherwise(spare_ids(F.substring(unit, k + 1, F.lit(1)), m))

    return F.flatten(F.transform(F.slice(places, 1, F.size(places) - 1), one))


def merge_long(unit: str, scores: dict[str, float], longest: int) -> list[int]:
    """The cuts of :func:`merge`, with a heap: for long units."""
    n = len(unit)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and end[b] - a <= longest and (score := scores.get(unit[a : end[b]])) is not None:
            heapq.heappush(heap, (-score, a, end[a], end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, middle, e = heapq.heappop(heap)
        if not alive[a] or end[a] != middle or middle >= n or not alive[middle] or end[middle] != e:
            continue
        alive[middle], end[a], after[a] = False, e, after[middle]
        if after[a] < n:
            before[after[a]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    return [a for a in range(n) if alive[a]] + [n]


def _long(m: Model):
    """(unit, n) to (unit, n, long_ids), the ids of long units and null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, names = {p: s for p, _, s, k in m.rows if k == NORMAL}, {p: i for p, i, _, k in m.rows if k == NORMAL}
        for batch in batches:
            size, out = pc.utf8_length(batch.column(0)).to_numpy(), [None] * batch.num_rows
            for at in np.flatnonzero(size > MOST_FOLDED).tolist():
                unit = batch.column(0)[at].as_py()
                cuts, out[at] = merge_long(unit, scores, m.longest), []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    i = names.get(unit[a:b])
                    out[at] += [i] if i is not None else [m.bytes[x] for x in unit[a:b].encode()] if m.bytes else [m.unknown]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=["unit", "n", "long_ids"])

    return run


def encode_units(words: DataFrame, m: Model) -> DataFrame:
    """(unit, n, ids) of distinct units (unit, n)."""
    spark = words.sparkSession
    unit, edges = F.col("unit"), F.col("edges")
    if m.kind != BPE:
        found = lattice(words, m.pieces(spark), m.longest, 1, F.struct("s", "e", "score", "id"))
        lowest = min((s for _, _, s, k in m.rows if k == NORMAL), default=0.0)
        found = found.withColumn("cuts", viterbi(unit, edges, lowest - 10.0))
        pairs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("s"), F.get("cuts", i + 1).alias("e")))
        chosen = F.filter(edges, lambda x: F.array_contains(pairs, F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        return found.select("unit", "n", ids(unit, F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))), F.col("cuts"), m).alias("ids"))
    if "long_ids" not in words.columns:
        words = words.mapInArrow(lean(_long(m)), LONG)
    found = lattice(words, m.pieces(spark), m.longest, 2, F.expr(CODE), MOST_FOLDED).withColumn("edges", _decoded(edges))
    bits = F.col("cuts")
    chosen = F.filter("edges", lambda x: (bits.bitwiseAND(x["ends"]) == x["ends"]) & (bits.bitwiseAND(x["inside"]) == 0))
    done = found.withColumn("cuts", merge(unit, edges)).withColumn("chosen", F.array_sort(F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))))
    places = F.filter(F.sequence(F.lit(0), F.length(unit)), lambda k: F.getbit(bits, k) == 1)
    known = F.size("chosen") == F.bit_count(bits) - 1
    folded = F.when(known, F.transform("chosen", lambda x: x["id"])).otherwise(ids(unit, F.col("chosen"), places, m))
    return done.select("unit", "n", F.when(F.col("long_ids").isNotNull(), F.col("long_ids")).otherwise(folded).alias("ids"))


LONG = "unit string, n long, long_ids array<int>"


#: Bytes whose hashes are worked out at once.
STRETCH = 1 << 20


class Units:
    """Rows of a large binary column as units: their places, hashes and rows. Spaces stand for the model's space."""

    def __init__(self, column: pa.Array, i: int, j: int, apart: np.ndarray) -> None:
        off = offsets(column)[i : j + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        full = np.diff(off) > 0
        # one space before each text
        size = np.where(full, np.diff(off) + 1, 0)
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.data = np.full(int(self.off[-1]), 32, np.uint8)
        inner = np.ones(len(self.data), bool)
        inner[self.off[:-1][full]] = False
        self.data[inner] = raw
        d = self.data
        start = np.zeros(len(d), bool)
        if len(d):
            start[1:] = apart[d[:-1].astype(np.uint16) << 8 | d[1:]]
            start[self.off[:-1][full]] = True
        self.s = np.flatnonzero(start)
        self.e = np.append(self.s[1:], len(d)) if len(self.s) else self.s
        self.first = np.searchsorted(self.s, self.off)
        self.keys = np.zeros(len(self.s), np.uint64)
        first = 0
        while first < len(self.s):  # in stretches of whole units, as a row may be long
            last = max(first + 1, int(np.searchsorted(self.e, self.s[first] + STRETCH, "right")))
            a = self.s[first]
            s, e = self.s[first:last] - a, self.e[first:last] - a
            part = d[a : a + e[-1]]
            p, inverse = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTES[part] * p[: len(part)], out=sums[1:])
            self.keys[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * PLACES[70])
            first = last

    def cut(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the units ``at``, and their lengths."""
        return gather(self.data, self.s[at], self.e[at] - self.s[at])


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(length)
    return data[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], length


def _strings(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """Units as strings, with the model's space."""
    off = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(off), pa.py_buffer(data.tobytes()))
    return pc.replace_substring(flat, " ", SPACE)


def _texts(column: pa.Array) -> pa.Array:
    """A text column as large binary where the model's space is a space."""
    return as_bytes(pc.replace_substring(column, SPACE, " "))


def _apart(m: Model) -> np.ndarray:
    """For two bytes: whether a unit ends between them. Bytes inside a character are never parted."""
    out = np.ones((256, 256), bool)
    out[:, 0x80:0xC0] = False
    out = out.reshape(-1)
    out[list(m.joined)] = False
    return out


def _ask(m: Model, width: int):
    """Texts to blobs by shard: the distinct units of a group of texts with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, press = _apart(m), zstandard.ZstdCompressor(level=6)
        for batch in batches:
            column = as_bytes(batch.column(0))
            for i, j in slices(column, GROUP_BYTES):
                part, found = _texts(batch.column(0).slice(i, j - i)), []
                for a, b in slices(part):
                    u = Units(part, a, b, apart)
                    keys, at, which = kinds_of(u.keys)
                    found.append((keys, np.bincount(which, minlength=len(keys)), *u.cut(at)))
                keys, n, data, length = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(keys):
                    continue
                keys, at, back = kinds_of(keys)
                n = np.bincount(back, n).astype(np.int64)
                begin = np.cumsum(length) - length
                shard = (mix(keys) % np.uint64(width)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
                blobs = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                    mine = at[order[a:b]]
                    bytes_, lengths = gather(data, begin[mine], length[mine])
                    blobs.append(press.compress(pack_arrays(n[order[a:b]].astype(np.uint32), lengths.astype(np.uint32), bytes_)))
                yield pa.RecordBatch.from_arrays([pa.array(shard[order[cuts]], pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return run


def _count(blobs: list[bytes]) -> pa.Table:
    got = [unpack_arrays(zstandard.decompress(b), np.uint32, np.uint32, np.uint8) for b in blobs]
    n, length, data = (np.concatenate(x) for x in zip(*got, strict=True))
    return pa.table({"unit": _strings(data, length.astype(np.int64)), "n": n.astype(np.int64)}).group_by("unit").aggregate([("n", "sum")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by shard to (unit, n)."""
    for _, found in by_shard(batches, _count):
        for batch in found.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([batch.column("unit").cast(pa.string()), batch.column("n_sum")], names=["unit", "n"])


def vocabulary_of(docs: DataFrame, m: Model) -> DataFrame:
    """(unit, n, ids) of all distinct units of the texts, written to the checkpoint folder."""
    width = shards(docs)
    asked = docs.select("text").mapInArrow(lean(_ask(m, width)), "shard int, blob binary")
    # counted and merged by one worker: each more of a task's takes memory of its own
    work, schema = (lambda b: _long(m)(_counted(b)), LONG) if m.kind == BPE else (_counted, "unit string, n long")
    words = asked.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(lean(work), schema)
    return cut(encode_units(words.repartition(4 * width, "unit"), m))


def unit_keys(units: pa.Array) -> np.ndarray:
    """Hashes of units, as :class:`Units` has them."""
    column = as_bytes(pc.replace_substring(units, SPACE, " "))
    off = offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and off[-1] else np.zeros(0, np.uint8)
    keys = np.zeros(len(column), np.uint64)
    for a in range(0, len(column), 1 << 15):  # in parts, as powers are kept for short texts
        o = off[a : a + (1 << 15) + 1]
        d = data[o[0] : o[-1]]
        p, inverse = powers(len(d) + 1)
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(BYTES[d] * p[: len(d)], out=sums[1:])
        o = o - o[0]
        keys[a : a + len(o) - 1] = mix((sums[o[1:]] - sums[o[:-1]]) * inverse[o[:-1]] + np.diff(o).astype(np.uint64) * PLACES[70])
    return keys


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, n, ids) to the unit's hash and its ids in bytes of seven bits."""
    for batch in batches:
        ids = batch.column(2)
        data, size = varints(ids.flatten().to_numpy().astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])]
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(unit_keys(batch.column(0)).astype(np.int64)), packed.cast(pa.binary())], names=["h", "ids"])


class Known:
    """The frequent units of a corpus by hash: a bounded table."""

    def __init__(self, rows: pa.Table) -> None:
        keys, ids = unit_keys(_whole(rows["unit"])), _whole(rows["ids"])
        self.flat = ids.flatten().to_numpy().astype(np.int32)
        self.length = ids.value_lengths().to_numpy().astype(np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.keys, self.slots = keys, None

    def _build(self) -> None:
        """Open addressing, two to four slots a unit. Built where it is needed: what is broadcast stays small."""
        keys = self.keys
        self.mask = np.uint64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        self.slots, self.place = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
        left, step = np.arange(len(keys)), np.uint64(0)
        while len(left):
            at = (keys[left] + step) & self.mask
            free = self.place[at] == 0
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.slots[at[won]], self.place[at[won]] = keys[left[won]], left[won] + 1
            left, step = left[~won], step + np.uint64(1)
        self.tries = int(step)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """1 + place in the table, 0 for units that aren't there."""
        if self.slots is None:
            self._build()
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for step in range(self.tries):
            at = (keys[left] + np.uint64(step)) & self.mask
            place = self.place[at]
            same = (place > 0) & (self.slots[at] == keys[left])
            out[left[same]] = place[same]
            left = left[(place > 0) & ~same]
            if not len(left):
                break
        return out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2 ** 28 in bytes of seven bits, low ones first; the bytes of each."""
    n = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = n > k
        out[(ends - n + k)[has]] = ((x[has] >> 7 * k) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, n


def unvarints(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last) + 1
    if not len(ends):
        return np.zeros(0, np.int64)
    start = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(start, ends - start)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, start)


def _missing(m: Model, known):
    """(key, id, text) to (block, h): the distinct units of each block of texts that aren't broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, table_ = _apart(m), known.value
        for batch in in_blocks(batches, BLOCK_BYTES):
            texts, found = batch.column(2), []
            for i, j in slices(as_bytes(texts)):
                u = Units(_texts(texts.slice(i, j - i)), 0, j - i, apart)
                found.append(np.unique(u.keys[table_.find(u.keys) == 0]))
            keys, block = np.unique(np.concatenate(found)), block_name(batch)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part.view(np.int64))], names=["block", "h"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h, ids) to one blob of answers for each block and stretch of rows."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable")))
        block, h, ids = t["block"].to_numpy(), t["h"].to_numpy(), as_bytes(_whole(t["ids"]))
        off = offsets(ids)
        data = np.frombuffer(ids.buffers()[2], np.uint8)
        cuts, ends = runs(block)
        press = zstandard.ZstdCompressor(level=3)
        blobs = [press.compress(pack_arrays(h[a:b], np.diff(off[a : b + 1]).astype(np.uint32), data[off[a] : off[b]])) for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([False] * len(cuts)), pa.array(blobs, pa.binary())], names=["block", "is_block", "blob"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 1 << 19:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _assemble(m: Model, known, digest: bool):
    """Rows by block, the answers and then the block, to ids, with their number and digest if asked."""

    def texts(batch: pa.RecordBatch, told: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, apart = known.value, _apart(m)
        h, start_of, flat = told
        column = batch.column(2)
        for i, j in slices(as_bytes(column)):
            u = Units(_texts(column.slice(i, j - i)), 0, j - i, apart)
            place = t.find(u.keys) - 1
            start, length = (x[place].astype(np.int64) if len(x) else np.zeros(len(place), np.int64) for x in (t.start, t.length))
            holes = np.flatnonzero(place < 0)
            if len(holes):
                at = np.minimum(np.searchsorted(h, u.keys[holes]), len(h) - 1) if len(h) else holes
                if not len(h) or (h[at] != u.keys[holes]).any():
                    raise ValueError("the documents came in other blocks than those that asked")
                start[holes], length[holes] = start_of[at] + len(t.flat), start_of[at + 1] - start_of[at]
            ids = _Two(t.flat, flat).gather(start, length)
            ends = np.concatenate([[0], np.cumsum(length)])[u.first]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            if digest:
                more = [pa.array(np.diff(ends)), pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), lists, *more], names=["doc_id", "ids", "n_tokens", "ids_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i), lists], names=["doc_id", "rk", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, told = None, [], None
        for batch in batches:
            for block, is_block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    now, held, told = block, [], None
                if not is_block:
                    held.append(unpack_arrays(zstandard.decompress(blob.as_buffer().to_pybytes()), np.int64, np.uint32, np.uint8))
                    continue
                if told is None:
                    told, held = _joined(held), []
                yield from texts(unpressed(blob), told)

    return run


def _joined(held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Answers in order: hashes, where each one's ids begin (and the end), ids."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
    h, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
    h = h.view(np.uint64)
    order = np.argsort(h)
    size = size.astype(np.int64)
    data, size = gather(data, (np.cumsum(size) - size)[order], size[order])
    ends = np.concatenate([[0], np.cumsum(data < 128)])[np.concatenate([[0], np.cumsum(size)])]
    return h[order], ends, unvarints(data).astype(np.int32)


class _Two:
    """Two arrays read as one, without a copy of the first."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = a, b

    def gather(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        late = at >= len(self.a)
        out = self.a[np.where(late, 0, at)] if len(self.a) else np.zeros(len(at), np.int32)
        out[late] = self.b[at[late] - len(self.a)]
        return out


def encode(docs: DataFrame, m: Model | None = None, digest: bool = False, most: int = MOST_KNOWN, scan: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, rk, ids): the ids of each row's text, in order; with ``digest`` (doc_id, ids, n_tokens, ids_sha256), and with
    ``decoded`` too (doc_id, n_tokens, ids_sha256, text): what :func:`decode` makes of the ids, worked out by the same worker."""
    m = m or load()
    spark = docs.sparkSession
    words = vocabulary_of(docs, m)
    # the most frequent units while they fit, by sixteenths of a power of two: about 1,000 rows whatever the corpus
    least, total, size = 1 << 62, 0, 0
    band = F.floor(16 * F.log2("n") + 1e-9).alias("band")
    for _, k, n, flat in sorted(words.groupBy(band).agg(F.min("n"), F.count("*"), F.sum(F.size("ids"))).collect(), reverse=True):
        total, size = total + n, size + 16 * n + 4 * flat
        if total > most or size > KNOWN_BYTES:
            break
        least = k
    frequent = F.col("n") >= least
    known = spark.sparkContext.broadcast(Known(words.where(frequent).select("unit", "ids", "n").toArrow().sort_by([("n", "descending")])))
    kind, width = docs.schema["doc_id"].dataType.simpleString(), shards(docs)
    read = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    read = read if scan else cut(read)
    rest = words.where(~frequent).mapInArrow(lean(_hashed), "h long, ids binary")
    missing = read.mapInArrow(lean(_missing(m, known)), "block long, h long")
    rows = "block long, is_block boolean, blob binary"
    answers = missing.join(rest, "h").select("block", "h", "ids").mapInArrow(lean(_answers), rows)
    both = answers.unionByName(read.mapInArrow(lean(lambda b: pressed(b, BLOCK_BYTES)), rows))
    dealt = both.repartition(width, "block").sortWithinPartitions("block", "is_block")
    if digest and decoded:
        sent, order = spark.sparkContext.broadcast(_spellings(m)), ["doc_id", "n_tokens", "ids_sha256", "ids"]
        work = lambda b: _spelled(sent)(batch.select(order) for batch in _assemble(m, known, True)(b))
        return dealt.mapInArrow(lean(work), f"doc_id {kind}, n_tokens long, ids_sha256 string, text string")
    return dealt.mapInArrow(lean(_assemble(m, known, digest)), f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string" if digest else f"doc_id {kind}, rk long, ids array<int>")


#: What stands for the unknown piece, as in the library, and for ids without a piece.
UNKNOWN_TEXT, NO_TEXT = " \u2047 ", "\ufffd"


def _spellings(m: Model) -> list[bytes]:
    """The bytes of each id, and at the end those of ids without a piece."""
    told = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: UNKNOWN_TEXT.encode()}
    by_id = {i: told[k](p) if k in told else b"" for p, i, _, k in m.rows}
    return [by_id.get(i, NO_TEXT.encode()) for i in range(max(by_id, default=-1) + 1)] + [NO_TEXT.encode()]


def _spelled(sent):
    """Rows with ids in the last column to rows with the text there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = np.array([len(x) for x in sent.value])
        data, start = np.frombuffer(b"".join(sent.value), np.uint8), np.cumsum(length) - length
        for batch in batches:
            out = []
            for x in batch.column(batch.num_columns - 1):
                at = (x.values if x.is_valid else pa.array([], pa.int64())).fill_null(-1).to_numpy().astype(np.int64)
                at = np.where((at < 0) | (at >= len(length)), len(length) - 1, at)
                text = gather(data, start[at], length[at])[0].tobytes().decode(errors="replace")
                out.append(text.removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def decode(encoded: DataFrame, m: Model | None = None, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``keep`` columns, text) of (key, ids), in one pass: the pieces' bytes are gathered by id.

    The space that encoding puts before a text goes. The unknown piece becomes :data:`UNKNOWN_TEXT`, control pieces nothing, an id
    without a piece (or null) :data:`NO_TEXT`, and bytes that are no UTF-8 become replacement characters. Null ids are an empty text.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(_spellings(m or load()))
    rows = encoded.select(key, *keep, "ids")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(_spelled(sent)), schema + "text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, digest of the ids, digest of the text that they decode to."""
    told = encode(table(spark, sf_dir, "documents"), digest=True, scan=True, decoded=True)
    return told.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("text_sha256"))
