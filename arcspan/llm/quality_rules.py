"""Quality rules: compression bands.

A document is rejected when its zstandard ratio leaves the band that its length allows, over the whole text or over fixed chunks
that hold more than :data:`CHUNK_SHARE` of its bytes: too high a ratio is repetitive text, too low a ratio is noise. All bytes are
in a chunk; the last one, or the only one, is as short as it comes. The ratio of short texts is dominated by the frame header, so
all limits depend on the length. Base rules (word count, share of repeated three-word windows) come first.

Everything is computed in one pass over the scan by :func:`measure`: no shuffle, and any task can be repeated. Memory is bounded by
the batch and the longest text: texts over :data:`LONG` bytes are read in pieces, with about 60 bytes a word.

Defined results: a null or empty text has 0 words and no chunk, and fails the base rules; a ratio on a limit is inside the band;
repeated rows each get their own result; an empty table gives an empty table; other columns are kept by :func:`reject` and not read
otherwise, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import IS_WORD, PLACES, SLICE_BYTES, Text, Words, as_bytes, lean, mix, offsets, slices, table

#: (bytes up to, least ratio, greatest ratio) of whole texts; the last band has no end.
WHOLE_BANDS = ((512, 0.95, 2.6), (2048, 1.2, 2.4), (8192, 1.3, 2.55), (32768, 1.4, 2.75), (1 << 62, 1.4, 3.5))
#: The same of chunks, the last band for full ones; bytes of a full chunk; the share of a text's bytes in chunks that may leave it.
CHUNK_BANDS = ((64, 0.0, 1.7), (128, 0.6, 2.0), (256, 0.8, 2.2), (512, 0.95, 2.4), (1024, 1.1, 2.4), (2048, 1.2, 2.5), (4096, 1.3, 2.6))
CHUNK_BYTES, CHUNK_SHARE = 4096, 0.34
#: Bytes of a text that is read in pieces.
LONG = 1 << 22
MIN_WORDS, MAX_REPEAT = 50, 50
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, n_chunks long, n_bad_chunks long, band_failed boolean"


def repeated_words(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 3) -> np.ndarray:
    """Per row, words that lie in windows of ``k`` words found twice or more in the row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    h = rows[:n].astype(np.uint64) * PLACES[k]
    for i in range(k):
        h = h + words[i : i + n] * PLACES[i]
    h = mix(h)
    own = rows[:n] == rows[k - 1 :]
    s = np.sort(h[own])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(n_rows, np.int64)
    found = own & (twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    covered = np.zeros(len(words), bool)
    for i in range(k):
        covered[i : i + n] |= found
    return np.bincount(rows[covered], minlength=n_rows)


def repeated_lines(t: Text) -> np.ndarray:
    """Per row, lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(t.data == 10)
    s = np.sort(np.concatenate([t.off[:-1], breaks + 1]))
    row = np.searchsorted(t.off, s, "right") - 1  # of empty rows and of breaks at a row's end, the next row's
    ends = np.sort(np.concatenate([t.off[1:], breaks]))
    full = np.searchsorted(t.ws, s) < np.searchsorted(t.ws, ends)
    s, ends, row = s[full], ends[full], row[full]
    if not len(s):
        return np.zeros(t.n, np.int64)
    key = mix(t.spans(s, ends) + row.astype(np.uint64) * PLACES[0])
    _, at = np.unique(key, return_index=True)
    return np.bincount(row, minlength=t.n) - np.bincount(row[at], minlength=t.n)


def inside(n_bytes: int, ratio: float, bands: tuple[tuple[int, float, float], ...]) -> bool:
    """Whether a ratio is in the band of its length."""
    return next(least <= ratio <= greatest for most, least, greatest in bands if n_bytes <= most)


def ratios(text: bytes, c: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Ratio of the whole text, its chunks, chunks that leave their band, bytes in those."""
    if not text:
        return 0.0, 0, 0, 0
    whole = len(text) / len(c.compress(text))
    bad, lost, view = 0, 0, memoryview(text)
    for i in range(0, len(text), CHUNK_BYTES):
        part = view[i : i + CHUNK_BYTES]
        r = whole if len(part) == len(text) else len(part) / len(c.compress(part))
        if not inside(len(part), r, CHUNK_BANDS):
            bad, lost = bad + 1, lost + len(part)
    return whole, -(-len(text) // CHUNK_BYTES), bad, lost


def outside(n_bytes: int, whole: float, chunks: int, bad: int, lost: int) -> bool:
    """Whether the ratios leave the band of the text's length."""
    return not inside(n_bytes, whole, WHOLE_BANDS) or lost > CHUNK_SHARE * n_bytes


def _counts(t: Text) -> list[np.ndarray]:
    """Per row: code points in words, symbols, repeated lines."""
    points = (t.data & 0xC0) != 0x80
    return [t.per_row(points & t.inside), t.per_row(_IS_SYMBOL[t.data]), repeated_lines(t)]


def _long_counts(text: bytes) -> list[np.ndarray]:
    """The same of one long text, in pieces."""
    d, out = np.frombuffer(text, np.uint8), [0, 0, 0]
    for a in range(0, len(d), SLICE_BYTES):
        part = d[a : a + SLICE_BYTES]
        out[0] += int(np.count_nonzero(((part & 0xC0) != 0x80) & IS_WORD[part]))
        out[1] += int(np.count_nonzero(_IS_SYMBOL[part]))
    seen: set[int] = set()
    at = 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            key = hash(line)
            out[2] += key in seen
            seen.add(key)
        at = end + 1
    return [np.array([x]) for x in out]


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First columns as they are, the last one a text: the measures of :data:`SCHEMA` in its place."""
    c = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    for batch in batches:
        column = as_bytes(batch.column(batch.num_columns - 1))
        for i, j in slices(column):
            off = (offsets(column)[i : j + 1] - offsets(column)[i]).tolist()
            if off[-1] > LONG:
                raw, t = column[i].as_py(), Words(column, i, j)
                more = _long_counts(raw)
            else:
                t = Text(column, i, j)
                raw, more = t.data.tobytes(), _counts(t)
            found = [ratios(raw[a:b], c) for a, b in zip(off, off[1:], strict=False)]
            out = [t.n_words, *more, repeated_words(t.words(), t.rows_of_words(), t.n)]
            arrays = [pa.array(x.astype(np.int64)) for x in out]
            arrays += [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
            arrays.append(pa.array([outside(b - a, *f) for a, b, f in zip(off, off[1:], found, strict=False)], pa.bool_()))
            keys = [x.slice(i, j - i) for x in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(keys + arrays, names=[*batch.schema.names[:-1], *[x.split()[0] for x in SCHEMA.split(", ")]])


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of each row: ``keep`` columns, :data:`SCHEMA`, ``base_failed``, ``kept``."""
    read = docs.select(*[F.col(c) for c in keep], F.col(text))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]] + [SCHEMA])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return read.mapInArrow(lean(measure), schema).withColumn("base_failed", base).withColumn("kept", ~base & ~F.col("band_failed"))


def _good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they are, the text last: those that pass."""
    for batch in batches:
        got = pa.Table.from_batches(list(measure(iter([batch.select([batch.num_columns - 1])]))))
        n, rep, bad = (got[c].to_numpy() for c in ("n_words", "n_repeat_words", "band_failed"))
        yield batch.filter(pa.array((n >= MIN_WORDS) & (100 * rep <= MAX_REPEAT * n) & ~bad))


def reject(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, all their columns unchanged; one pass, no shuffle."""
    names = docs.columns
    last = docs.select(*[c for c in names if c != text], text)
    return last.mapInArrow(lean(_good), last.schema).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
