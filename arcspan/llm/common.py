"""Helpers that the corpus operators share: table access, checkpoints and vectorised word parsing.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; word parsing works on UTF-8 bytes with numpy.
Hashes are 64-bit: a random byte table and a polynomial over prefix sums, finished by a bijective mixer, so that the
hash of any span of a text costs O(1).
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import io
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are parsed at once. :class:`Text` takes about 40 bytes for each of them, :class:`Words` for those of one piece.
SLICE_BYTES = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arcspan-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the checkpoint folder and go on from that: shared by all executors, no lineage.

    The files stay until the application's owner empties the folder, since results that are still lazy read them.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/arcspan-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions that the session asks of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text to a shard, which one task holds as a whole.
SHARD_BYTES = 1 << 23


def shards(docs: DataFrame, text: str = "text") -> int:
    """Shards for tables made from these texts: at least the partitions of the session, and more as the texts grow."""
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-n // SHARD_BYTES))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys``, into as many partitions as the session asks."""
    return df.repartition(parts(df.sparkSession), *[F.col(k) for k in keys])


def lean(work: Callable) -> Callable:
    """An Arrow function that gives memory back to the system when its partition is done, since Python workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not on every C library
            ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(fold: bool) -> np.ndarray:
    t = mix((np.arange(1, 257, dtype=np.uint64)) * _MULT)
    if fold:
        t[65:91] = t[97:123]
    return t


_PLAIN, _FOLDED = _table(False), _table(True)
#: The random numbers that stand for bytes.
BYTES = _PLAIN
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers = _inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse modulo 2 ** 64."""
    global _powers, _inverses
    if len(_powers) < n:
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, SLICE_BYTES + 64), base, np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        _powers, _inverses = found
    return _powers, _inverses


#: Odd multipliers, one for each place in an n-gram.
PLACES = mix(np.arange(101, 201, dtype=np.uint64) * _MULT) | np.uint64(1)


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as large binary, null as empty."""
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or of one row."""
    most = most or SLICE_BYTES
    off = offsets(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


class Text:
    """Rows ``i`` to ``j`` of a large binary column, parsed."""

    def __init__(self, column: pa.Array, i: int, j: int, fold: bool = False) -> None:
        off = offsets(column)[i : j + 1]
        a, b = int(off[0]), int(off[-1])
        whole = column.buffers()[2]
        self.data = np.frombuffer(whole, np.uint8, b - a, a) if b > a else np.zeros(0, np.uint8)
        self.off = off - a
        self.n = j - i
        n = b - a
        p, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        v = (_FOLDED if fold else _PLAIN)[self.data]
        v *= p[:n]
        np.cumsum(v, out=self.sums[1:])
        inside = IS_WORD[self.data]
        first = self.off[:-1][self.off[:-1] < self.off[1:]]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[first] = inside[first]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        last = self.off[1:][self.off[:-1] < self.off[1:]] - 1
        end[last] = inside[last]
        self.inside = inside
        #: First byte of each word, and the byte after it.
        self.ws, self.we = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: First word of each row, and the end.
        self.first = np.searchsorted(self.ws, self.off)
        self.n_words = np.diff(self.first)

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashes of the spans of bytes from ``s`` to ``e``."""
        raw = (self.sums[e] - self.sums[s]) * self.inverse[s]
        return mix(raw + (e - s).astype(np.uint64) * _MULT)

    def words(self) -> np.ndarray:
        return self.spans(self.ws, self.we)

    def rows_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes' flags are set in each row."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.off))


class Words:
    """Rows ``i`` to ``j`` of a large binary column as hashes of words: 8 bytes a word, however long a row is."""

    def __init__(self, column: pa.Array, i: int, j: int, fold: bool = False) -> None:
        off = offsets(column)[i : j + 1]
        self.n = j - i
        if j - i > 1 or off[-1] - off[0] <= 2 * SLICE_BYTES:
            t = Text(column, i, j, fold)
            self.hashes, self.first, self.n_words = t.words(), t.first, t.n_words
            return
        found, at, end = [], int(off[0]), int(off[1])
        data = np.frombuffer(column.buffers()[2], np.uint8, end, 0)
        while at < end:
            to = at
            while True:  # a piece ends at a blank
                to = min(to + SLICE_BYTES, end)
                blanks = np.flatnonzero(~IS_WORD[data[at:to]]) if to < end else ()
                if to == end or len(blanks):
                    break
            to = end if to == end else at + int(blanks[-1]) + 1
            found.append(Text(pa.array([data[at:to].tobytes()], pa.large_binary()), 0, 1, fold).words())
            at = to
        self.hashes = np.concatenate(found)
        self.n_words = np.array([len(self.hashes)])
        self.first = np.array([0, len(self.hashes)])

    def words(self) -> np.ndarray:
        return self.hashes

    def rows_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)


def kinds_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and which one stands where. (A plain sort takes a fraction of a stable one's time.)"""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    return h[one], one, which


def runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return [], []
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return start, [*start[1:], len(x)]


def whole_runs(first: np.ndarray, n_words: np.ndarray, k: int) -> np.ndarray:
    """Of the runs of ``k`` words, those that lie in one row: a mask."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    if n and k > 1:
        # a run that starts in the last k-1 words of a row crosses its end
        edge = np.zeros(total + 1, np.int32)
        lo = np.maximum(first[1:] - (k - 1), first[:-1])
        np.add.at(edge, lo, 1)
        np.add.at(edge, first[1:], -1)
        ok = np.cumsum(edge)[:n] == 0
    return ok


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob; :func:`unpack_arrays` needs their types."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack_arrays(blob: bytes, *kinds: type) -> list[np.ndarray]:
    counts = np.frombuffer(blob, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(counts.tolist(), kinds, strict=True):
        a = np.frombuffer(blob, kind, n, at)
        out.append(a)
        at += a.nbytes
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words by running sums, whatever row they are in."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


def by_shard(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[tuple[int, object]]:
    """Rows sorted by shard in the first column, a blob in the second: ``work`` of each shard's blobs, one shard in memory."""
    now, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != now and blobs:
                yield now, work(blobs)
                blobs = []
            now = shard
            blobs.append(blob.as_buffer().to_pybytes())
    if blobs:
        yield now, work(blobs)


def in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows, the text last, in batches of about ``size`` bytes of text."""
    held, have = [], 0
    for batch in batches:
        column = as_bytes(batch.column(batch.num_columns - 1))
        off = offsets(column)
        for i, j in slices(column, size):
            held.append(batch.slice(i, j - i))
            have += int(off[j] - off[i])
            if have >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, have = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]


def block_name(batch: pa.RecordBatch) -> int:
    """A block's name: a 64-bit hash of its texts and of the column before them, so that the same block has the same name wherever
    it is read."""
    told = hashlib.blake2b(repr(batch.column(batch.num_columns - 2).to_pylist()).encode(), digest_size=8)
    column = as_bytes(batch.column(batch.num_columns - 1))
    off = offsets(column)
    told.update(np.diff(off).tobytes())
    if off[-1] > off[0]:
        told.update(column.buffers()[2][int(off[0]) : int(off[-1])])
    return int.from_bytes(told.digest(), "little", signed=True)


def pressed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, compressed: block, is_block, blob."""
    for batch in in_blocks(batches, size):
        whole = io.BytesIO()
        with pa.ipc.new_stream(whole, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
            w.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([block_name(batch)]), pa.array([True]), pa.array([whole.getvalue()], pa.binary())], names=["block", "is_block", "blob"])


def unpressed(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
