"""Substring dedup: passages of ``min_words`` words or more that stand in more than one place are removed, each time they occur.

A window is ``min_words`` consecutive words of one document. A word goes if a window that covers it has a word sequence that
starts anywhere else too. The method is broadcast suffix automata of reference shards that documents are streamed through. With the
corpus as its own reference it has two parts, as all of a corpus cannot be broadcast:

* :func:`reference` finds the frequent repeated passages, bounded in words. They are broadcast, and each worker builds suffix
  automata of shards of them. Documents stream through; where a matching statistic reaches ``min_words``, the window is one of a
  passage, so it repeats. What a third of all documents share is settled here and never shuffled.
* The other windows go to the shard of their anchor, the least hash of the shorter runs of words in them, which depends on the
  window's words alone; so equal windows meet, and neighbours mostly stay together as runs. Where runs with one anchor differ, an
  automaton over the distinct runs, a symbol for each window, gives the maximal spans that occur twice or more; runs that all equal
  each other pass as one. Windows whose anchor is hot (many distinct windows around one common phrase) go by their own hash.

:func:`remove_reference` is the broadcast form for any reference whose size is checked against a bound.

Tasks settle what repeats within their own batch before they send anything, and send each distinct window once. Only hashes are
shuffled for the search; shards get their number from the size of the texts. Texts are shuffled once, by row, to meet their spans.

Windows are told apart by 128 bits between tasks: 64 of their anchor and 64 of their own, or by two hashes of 64 where the anchor is
hot; inside a group of :data:`GROUP_BYTES` by 64. Rows are known by a 64-bit hash of id and text.

Defined results: null and empty texts have no words; texts under ``min_words`` words lose nothing; rows repeated with the same id
and text lose all their windows, as each stands in both; an empty table gives an empty table; other columns, whatever their names,
are kept by :func:`remove` and not read otherwise. A long text is parsed in pieces; it takes about 100 bytes a word.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import PLACES, SLICE_BYTES, Words, as_bytes, by_shard, grams, lean, mix, pack_arrays, shards, slices, spare, table, unpack_arrays, whole_runs

MIN_WORDS = 35
#: Bytes of text in which repeats are settled before windows are sent.
GROUP_BYTES = 1 << 22
#: Stretches of windows, those that repeat in a group counted once there, that make an anchor hot, hot anchors at most, and words of the passages that are broadcast (0.5 MB).
HOT, MOST_HOT, MOST_PASSAGE_WORDS = 256, 200_000, 60_000
#: Words that a given reference may have, and words in each automaton.
MOST_REFERENCE_WORDS, SHARD_WORDS = 250_000, 20_000


class Automaton:
    """A suffix automaton of several sequences, with the number of places where each state's factors end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, steps: dict, link: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
            else:
                p, new = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                last = new
            self.count[last] += weight

    def finish(self) -> Automaton:
        """Carry the counts to the shorter factors."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]
        return self

    def statistics(self, sequence: list, times: int = 1) -> Iterator[int]:
        """Matching statistics: for each place the length of the longest factor that ends there and occurs ``times`` times or more."""
        state, matched = 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while state and self.count[state] < times:
                state = self.link[state]
                matched = self.length[state]
            yield matched

    def spans(self, sequence: list, least: int, times: int) -> list[tuple[int, int]]:
        """Maximal spans of ``least`` symbols or more, each covered by factors that occur ``times`` times or more: start, end."""
        out: list[list[int]] = []
        for i, matched in enumerate(self.statistics(sequence, times)):
            if matched >= least:
                start = i + 1 - matched
                if out and start <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([start, i + 1])
        return [(a, b) for a, b in out]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value in each window of ``width``."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    more = width - done
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def windows(t: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of ``k`` words: its row, its first word there, its anchor, its hash."""
    words = t.words()
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    inner = k // 2 + 1
    anchor = _least(grams(words, inner), k - inner + 1)
    at = np.flatnonzero(whole_runs(t.first, t.n_words, k))
    row = t.rows_of_words()[at]
    return row, at - t.first[row], anchor[at], grams(words, k)[at]


def _other(words: np.ndarray, k: int) -> np.ndarray:
    """A second hash of each window, independent of the first."""
    return grams(mix(words ^ PLACES[31]), k)


def _stretches(row: np.ndarray, start: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """First places of the stretches of consecutive windows of a row that agree in ``same``."""
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(start) != 1)
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _groups(batches: Iterator[pa.RecordBatch], k: int, group: int) -> Iterator[tuple]:
    """Row key and text to groups of texts: row keys, parsed parts with their first row, and the windows' rows, places, anchors, hashes."""
    for batch in batches:
        column, rk = as_bytes(batch.column(1)), batch.column(0).to_numpy()
        for i, j in slices(column, group):
            part = column.slice(i, j - i)
            parsed = [(a, Words(part, a, b)) for a, b in slices(part, SLICE_BYTES)]
            found = [(r + a, *rest) for a, t in parsed for r, *rest in [windows(t, k)]]
            row, start, anchor, key = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(row):
                yield rk[i:j], parsed, row, start, anchor, key


def _first(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a group are the first of their kind, and which have others of it."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    first, twice = np.empty(len(key), bool), np.empty(len(key), bool)
    first[order], twice[order] = ~same[:-1], same[:-1] | same[1:]
    return first, twice


def _anchors(batches: Iterator[pa.RecordBatch], k: int, group: int) -> Iterator[pa.RecordBatch]:
    """How many stretches of windows that its group sees first each anchor has."""
    for _, _, row, start, anchor, key in _groups(batches, k, group):
        at = np.flatnonzero(_first(key)[0])
        row, start, anchor = row[at], start[at], anchor[at]
        found, n = np.unique(anchor[_stretches(row, start, anchor)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["anchor", "n"])


def _hot_windows(batches: Iterator[pa.RecordBatch], k: int, group: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows with a hot anchor, by group: hash, how often, row key and place of the first by row key."""
    for rk, _, row, start, anchor, key in _groups(batches, k, group):
        at = np.flatnonzero(_within(anchor, hot))
        keys, owner, first = key[at], rk[row[at]], start[at]
        order = np.lexsort((first, owner, keys))
        found, one, n = np.unique(keys[order], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(owner[order][one]), pa.array(first[order][one])], names=["key", "n", "rk", "start"])


def _passages(batches: Iterator[pa.RecordBatch], k: int, places: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words of the passages that windows at ``places`` (row key: first words) cover."""
    for batch in batches:
        column = as_bytes(batch.column(1))
        for i, rk in enumerate(batch.column(0).to_pylist()):
            words, out = Words(column, i, i + 1).words(), []
            for at in places[rk]:
                if out and at + k - 1 == out[-1][1]:
                    out[-1][1] += 1
                else:
                    out.append([at, at + k])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([words[a:b].tobytes() for a, b in out], pa.binary())], names=["words"])


class Reference:
    """Frequent repeated passages, broadcast: suffix automata of shards of them, built by each worker that needs them."""

    def __init__(self, passages: list[bytes], hot: np.ndarray) -> None:
        self.passages, self.hot, self.built, self.shard = passages, hot, None, SHARD_WORDS

    def automata(self) -> list[Automaton]:
        if self.built is None:
            self.built, left = [], 0
            for p in self.passages:
                words = np.frombuffer(p, np.uint64).tolist()
                if left <= 0:
                    self.built.append(Automaton())
                    left = self.shard
                self.built[-1].add(words)
                left -= len(words)
            for a in self.built:
                a.finish()
        return self.built


def reference(docs: DataFrame, k: int) -> Reference:
    """The passages that are broadcast, and the hot anchors: those of :data:`HOT` stretches or more, the most frequent first.

    Windows with a hot anchor are counted, and the most frequent of those that repeat are taken while they have
    :data:`MOST_PASSAGE_WORDS` words in all. What is beyond the two bounds is settled by the shuffle like all other windows.
    """
    group = GROUP_BYTES
    read = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "text")
    counts = read.mapInArrow(lean(lambda b: _anchors(b, k, group)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= HOT).orderBy(F.desc("n"), "anchor").limit(MOST_HOT).collect()
    hot = np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    if not len(hot):
        return Reference([], hot)
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    found = read.mapInArrow(lean(lambda b: _hot_windows(b, k, group, sent.value)), "key long, n long, rk long, start long")
    found = found.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("rk", "start")).alias("at")).where("n >= 2")
    top = found.orderBy(F.desc("n"), "key").limit(MOST_PASSAGE_WORDS).select("at.rk", "at.start").collect()
    taken: dict[int, set[int]] = {}
    left = MOST_PASSAGE_WORDS
    for rk, start in top:  # a window that follows a taken one adds a word
        mine = taken.setdefault(rk, set())
        left -= 1 if start - 1 in mine or start + 1 in mine else k
        if left < 0:
            break
        mine.add(start)
    places = {rk: sorted(x) for rk, x in taken.items()}
    keys = docs.sparkSession.createDataFrame([(x,) for x in places], "rk long")
    texts = read.join(F.broadcast(keys), "rk", "left_semi").dropDuplicates(["rk"])
    return Reference([bytes(r[0]) for r in texts.mapInArrow(lean(lambda b: _passages(b, k, places)), "words binary").collect()], hot)


def _matched(found: Reference, parsed: list, row: np.ndarray, start: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the windows ``at``, those that the reference's automata have: matching statistics of each stretch of them."""
    out = np.zeros(len(at), bool)
    if not len(at) or not found.passages:
        return out
    s = _stretches(row[at], start[at])
    begins = [a for a, _ in parsed]
    for a, b in zip(s.tolist(), [*s[1:].tolist(), len(at)], strict=True):
        r = int(row[at[a]])
        first, t = parsed[bisect_right(begins, r) - 1]
        begin = int(t.first[r - first] + start[at[a]])
        words = t.words()[begin : begin + (b - a) + k - 1].tolist()
        for automaton in found.automata():
            out[a:b] |= np.array([n >= k for n in automaton.statistics(words)], bool)[k - 1 :]
    return out


def _requests(batches: Iterator[pa.RecordBatch], k: int, group: int, shards: int, found: Reference) -> Iterator[pa.RecordBatch]:
    """Row key and text to blobs by shard: runs of windows seen here first, and spans already known to repeat.

    Windows that the reference has are known. Others with a hot anchor go by their own hash and are told apart by their second one.
    """
    for rk, parsed, row, start, anchor, key in _groups(batches, k, group):
        first, twice = _first(key)
        hot = np.flatnonzero(_within(anchor, found.hot))
        matched = np.zeros(len(key), bool)
        matched[hot] = _matched(found, parsed, row, start, hot, k)
        known = np.flatnonzero(twice | matched)
        s = _stretches(row[known], start[known])
        settled = [rk[row[known[s]]], start[known[s]], np.diff(s, append=len(known))]
        hot = hot[~matched[hot]]
        if len(hot):
            second = np.concatenate([_other(t.words(), k)[whole_runs(t.first, t.n_words, k)] for _, t in parsed if len(t.words()) >= k])
            anchor, fp = anchor.copy(), key.copy()
            anchor[hot], fp[hot] = key[hot], second[hot]
        else:
            fp = key
        sent = np.flatnonzero(first & ~matched)
        r, f, m, w = row[sent], start[sent], anchor[sent], twice[sent]
        s = _stretches(r, f, m, w)
        n = np.diff(s, append=len(sent))
        fp = fp[sent]
        to = (mix(m[s]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        m, r, f, w, n, s, to = m[s][order], rk[r[s]][order], f[s][order], w[s][order], n[order], s[order], to[order]
        fp = fp[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])
        settled_to = np.mod(settled[0], shards)
        by = np.argsort(settled_to, kind="stable")
        settled, settled_to = [x[by] for x in settled], settled_to[by]
        ids, blobs = [], []
        for shard in np.union1d(to, settled_to).tolist():
            a, b = np.searchsorted(to, [shard, shard + 1])
            c, d = np.searchsorted(settled_to, [shard, shard + 1])
            ids.append(shard)
            blobs.append(pack_arrays(m[a:b], r[a:b], f[a:b].astype(np.uint32), (n[a:b].astype(np.uint32) << np.uint32(1)) | w[a:b], fp[ends[a] : ends[b]], settled[0][c:d], settled[1][c:d].astype(np.uint32), settled[2][c:d].astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


_BLOB = (np.uint64, np.int64, np.uint32, np.uint32, np.uint64, np.int64, np.uint32, np.uint32)


def _search(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated spans of a shard's runs: row key, first window, windows."""
    anchor, rk, start, packed, fp, done_rk, done_start, done_n = (np.concatenate(x) for x in zip(*[unpack_arrays(b, *_BLOB) for b in blobs], strict=True))
    n, known = (packed >> np.uint32(1)).astype(np.int64), (packed & np.uint32(1)).astype(bool)
    out = [(done_rk, done_start.astype(np.int64), done_n.astype(np.int64))]
    if len(anchor):
        begin = np.cumsum(n) - n
        place = np.arange(len(fp)) - np.repeat(begin, n)
        sign = np.add.reduceat(mix(fp + place.astype(np.uint64) * PLACES[7]), begin) + n.astype(np.uint64)
        order = np.lexsort((sign, anchor))
        g = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0]))
        size = np.diff(g, append=len(order))
        alike = np.minimum.reduceat(sign[order], g) == np.maximum.reduceat(sign[order], g)
        group = np.repeat(np.arange(len(g)), size)
        whole = ((size > 1) & alike)[group] & ~known[order]
        at = order[whole]
        out.append((rk[at], start[at].astype(np.int64), n[at]))
        for x in np.flatnonzero((size > 1) & ~alike).tolist():  # an automaton for each anchor whose runs differ
            seen: dict[int, list] = {}
            for r in order[g[x] : g[x] + size[x]].tolist():
                seen.setdefault(int(sign[r]), []).append(r)
            automaton, sequences = Automaton(), []
            for rows in seen.values():
                sequences.append((fp[begin[rows[0]] : begin[rows[0]] + n[rows[0]]].tolist(), [y for y in rows if not known[y]]))
                automaton.add(sequences[-1][0], sum(2 if known[y] else 1 for y in rows))
            automaton.finish()
            found = [(int(rk[y]), int(start[y]) + a, b - a) for sequence, rows in sequences if rows for a, b in automaton.spans(sequence, 1, 2) for y in rows]
            if found:
                out.append(tuple(np.array(c, np.int64) for c in zip(*found, strict=True)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (rk, start, n) in by_shard(batches, _search):
        for a in range(0, len(rk), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)], pa.int64()) for x in (rk, start, n)], names=["rk", "start", "n"])


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows that also stand elsewhere: rk (xxhash64 of id and text), first window, number of windows in a row."""
    width, group = shards(docs), GROUP_BYTES
    found = docs.sparkSession.sparkContext.broadcast(reference(docs, min_words))
    read = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "text")
    sent = read.mapInArrow(lean(lambda b: _requests(b, min_words, group, 2 * width, found.value)), "shard int, blob binary")
    return sent.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(lean(_spans), "rk long, start long, n long")


def _with_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` and, as the last column, what :func:`repeated` found in each row."""
    key, gone = spare(docs, "row_key", "repeats")
    spans = repeated(docs, min_words).groupBy("rk").agg(F.collect_list(F.struct("start", "n")).alias(gone)).withColumnRenamed("rk", key)
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(spans.hint("shuffle_hash"), key, "left").drop(key)


def _kept(text: bytes, spans: pa.Scalar, k: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not spans.is_valid:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int32)
    flat = spans.values
    start = flat.field("start").to_numpy()
    np.add.at(edge, start, 1)
    np.add.at(edge, start + flat.field("n").to_numpy() + k - 1, -1)
    return list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist())), len(words)


def digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: words, words removed, digest of the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
                kept, n = _kept(text.as_py(), spans, min_words)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs.select("doc_id", "text"), min_words).mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated passages: kept words joined by a space where something went, else the text as it is."""
    names = docs.columns
    found = _with_spans(docs, min_words)
    last = found.select(*[c for c in names if c != "text"], "text", found.columns[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            new = [b" ".join(_kept(t.as_py().encode(), s, min_words)[0]).decode() if s.is_valid else t.as_py() for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(new, pa.string())], names=batch.schema.names[:-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema.fields[:-1])
    return last.mapInArrow(lean(run), schema).select(*names)


def remove_reference(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS, most_words: int = MOST_REFERENCE_WORDS) -> DataFrame:
    """The documents without spans of ``min_words`` words or more that they share with ``reference`` (a text column).

    The reference is broadcast as hashes of words, and workers build suffix automata of about :data:`SHARD_WORDS` words, some 700
    bytes a word; a reference of more than ``most_words`` words is refused.
    """
    size = reference.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if size > most_words + 2 * (rows := reference.count()):
        raise ValueError(f"the reference has {size} words in {rows} texts; {most_words} can be broadcast")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_bytes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([Words(column, i, i + 1).words().tobytes() for i in range(len(column))], pa.binary())], names=["words"])

    passages = [bytes(r[0]) for r in reference.select("text").mapInArrow(lean(hashed), "words binary").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(Reference(passages, np.zeros(0, np.uint64)))
    names = docs.columns
    last = docs.select(*[c for c in names if c != "text"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, column = [], as_bytes(batch.column(batch.num_columns - 1))
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                words = Words(column, i, i + 1).words().tolist()
                gone = [s for a in sent.value.automata() for s in a.spans(words, min_words, 1)]
                keep = np.ones(len(words), bool)
                for a, b in gone:
                    keep[a:b] = False
                new.append(b" ".join(compress(column[i].as_py().split(), keep.tolist())).decode() if gone else x.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.string())], names=batch.schema.names)

    return last.mapInArrow(lean(run), last.schema).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
