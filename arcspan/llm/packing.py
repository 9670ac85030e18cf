"""Best-fit packing: bounded-space online best-fit.

Documents become token ids (a public vocabulary, given by path) and an end id; documents over the capacity are cut into pieces
of it. Pieces are dealt to packing tasks by hash, each about :data:`SEQUENCES` sequences, so that the number of tasks follows the
data and what a task leaves open is a small share. A task streams its pieces through a fixed number of open bins, kept by free
space: a bitset has a bit for each free space that an open bin has, so the best fit, the smallest free space that holds the
piece, is one shift and the lowest set bit. When nothing fits and all bins are open, the fullest closes first.

Words between ASCII white space, less the dots and commas about them, are tokenised once for each Python worker and remembered,
about :data:`REMEMBERED` words at most, since the tokenizer of the default vocabulary never joins tokens across such places and
ignores case. With any other vocabulary whole texts are tokenised.

Only lengths and check sums are shuffled for packing, never texts. Pieces are written to the checkpoint folder, as the number of
tasks needs their total. Any task can be repeated: its pieces are sorted first, so it packs them alike.

Defined results: null and empty texts are one piece, the end id; repeated rows are packed each; of bins with equal free space the
one opened last is taken; an empty table gives an empty table; other columns are not read, so they may have any name. A long text is
tokenised in pieces cut at white space (whole with another vocabulary) and takes memory for its ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import SLICE_BYTES, Text, as_bytes, cut, lean, offsets, slices, table

CAPACITY, END_ID = 2048, 0
#: Bins open at once; sequences a packing task makes, about; words that a task remembers.
OPEN_BINS, SEQUENCES, REMEMBERED = 512, 16384, 1 << 20
#: Packing tasks at most; beyond them each makes more sequences.
MOST_TASKS = 20_000


def vocabulary() -> str:
    """The public vocabulary that packing takes unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: 1 for ASCII letters and digits, 2 for the dot and the comma.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KINDS[[44, 46]] = 2


def parsed(column: pa.Array, i: int, j: int) -> Text:
    """The rows with hashes that ignore the case of ASCII letters, as the vocabulary does, unless they may hold a special token."""
    t = Text(column, i, j, fold=True)
    angle = np.flatnonzero(t.data == 60)
    if len(angle) and (t.data[np.minimum(angle + 1, len(t.data) - 1)] == 124).any():
        t = Text(column, i, j)
    return t


class Encoder:
    """Token ids of parsed texts, word by word, with an end id after each text."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.by_word = os.path.samefile(path, vocabulary())
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64)
        self.old, self.new = (none, none.astype(np.int32)), (none, none.astype(np.int32))  # sorted hashes and their words
        self.ids = np.full(1 << 20, self.end_id, np.uint32)  # word 0: the end id
        self.start, self.length = np.zeros(1 << 16, np.int32), np.ones(1 << 16, np.int32)
        self.n, self.used = 1, 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Words by hash, -1 for new ones."""
        out = np.full(len(keys), -1, np.int32)
        for known, word in (self.old, self.new):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, word[at], out)
        return out

    def learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Remember the ids of new words, given with their hashes."""
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, counts = np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(words)] = self.used + np.cumsum(counts) - counts
        self.length[self.n : self.n + len(words)] = counts
        new = np.arange(self.n, self.n + len(words), dtype=np.int32)
        self.new = _merged(self.new, (keys, new))
        if 8 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = _merged(self.old, self.new), (self.new[0][:0], self.new[1][:0])
        self.n += len(words)
        self.used += len(ids)
        return new

    def encode(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end ids included, and how many each text has."""
        if self.n > REMEMBERED:
            self.clear()
        s, e, first = t.ws, t.we, t.first
        if len(t.data) > 1:  # the tokenizer always parts a dot or comma from a letter or digit
            kind = _KINDS[t.data]
            cuts = np.flatnonzero(kind[:-1] * kind[1:] == 2) + 1
            cuts = cuts[~np.isin(cuts, t.off)]
            s, e = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
            first = np.searchsorted(s, t.off)
        keys, one, inverse = np.unique(t.spans(s, e), return_index=True, return_inverse=True)
        found = self.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = t.data.tobytes()
            found[new] = self.learn(keys[new], [raw[a:b].decode() for a, b in zip(s[one[new]].tolist(), e[one[new]].tolist(), strict=True)])
        words = np.insert(found[inverse], first[1:], 0)
        lengths = self.length[words].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.start[words] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        until = ends[first[1:] + np.arange(t.n)]
        return ids, np.diff(until, prepend=0)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables of hashes and words as one."""
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def rows_of_ids(e: Encoder, column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows of a large binary column, end ids included, and how many each row has."""
    off = offsets(column)
    if not e.by_word:
        found = [np.array([*x.ids, e.end_id], np.uint32) for x in e.tokenizer.encode_batch([column[k].as_py().decode() for k in range(i, j)], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found])
    if off[j] - off[i] <= 4 * SLICE_BYTES:
        return e.encode(parsed(column, i, j))
    text, at, out = column[i].as_py(), 0, []  # one long row
    while at < len(text):
        to = min(len(text), at + SLICE_BYTES)
        if to < len(text):  # a word stays whole
            m = _BLANK.search(text, to)
            to = m.start() if m else len(text)
        out.append(e.encode(parsed(pa.array([text[at:to]], pa.large_binary()), 0, 1))[0][:-1])
        at = to
    flat = np.concatenate([*out, np.array([e.end_id], np.uint32)])
    return flat, np.array([len(flat)])


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and with ``ids`` the ids themselves."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, end_id)
        for batch in batches:
            column = as_bytes(batch.column(1))
            for i, j in slices(column):
                flat, counts = rows_of_ids(e, column, i, j)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                begin = (np.cumsum(counts) - counts)[row] + start
                parts = [flat[a : a + k] for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                arrays = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


class Bins:
    """Open bins by free space. Gives each piece a bin and an offset."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest < left:
                    self._take(fullest)
                else:
                    return b, self.capacity - free  # itself the fullest: it closes
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.capacity - free


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, sequences: int = SEQUENCES) -> DataFrame:
    """Pieces, at most ``capacity`` long each, with a sequence_id and an offset. ``parts`` is read twice."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, round(total / (capacity * sequences))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, high = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            more = [pa.array([high | b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    keys = ["doc_id", "piece", "ids_crc32", "length"]
    # rows that are alike go to several tasks, by the place they are read from
    dealt = parts.repartition(tasks, *keys, F.spark_partition_id()).sortWithinPartitions(F.xxhash64(*keys), *keys)
    return dealt.mapInArrow(lean(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(cut(pieces(docs, path)))


def sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, ids. A sequence has ``CAPACITY`` ids at most."""
    placed = pack(cut(pieces(docs, path, ids=True)))
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
