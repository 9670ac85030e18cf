"""N-gram Jaccard join: a prefix-tree join over globally ordered n-gram sets.

A document's set holds its distinct ``size``-word shingles, lower-cased, or the whole word sequence if it is shorter. Two
documents link when 100 * intersection >= ``percent`` * union. The result is each document's component of links.

1. Order. Shards count in how many texts each shingle stands (the corpus is all counted; counts of one text in a batch are
   added up before they are sent) and answer each block of documents with the shingles that stand in two or more. The global
   order is: rare first, by power of two of the count, then by hash.
2. Routing. By the prefix bound, linked sets share one of the first n - ceil(t n) + 1 shingles. Each of those that isn't unique
   sends the set's id and size class to its shard; sets of a shard that share a shingle and have fitting sizes become candidates
   of one unit, by stars, never as pairs.
3. Join. A unit stores its sets, in the global order from its frequent end, in a path-compressed trie and traverses it with each
   set: sets that begin alike share the partial overlap, and a subtree is left when the overlap so far and the remaining lengths
   cannot reach the bound, or when all of it is already in the set's component. So a dense group of copies costs about one path
   each, and no pairs are listed. Units over :data:`PART` sets are split (:func:`_linked`): parts are joined by
   themselves and with a few leaders, which makes one component of a dense group; only sets outside the unit's largest component
   then visit the other parts. A group of n near copies costs n rows; m sets outside cost m * n / :data:`PART`.

Equal sets count as one set from the start of step 2 on. Shingles, sets and rows (by id and text) are known by 64-bit hashes: of
10 ** 11 rows some 270 pairs would share a key. Links and components are tables; the driver only sees counts and the total size
of the texts, from which shards get their number, so that none grows with the corpus.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; the component of
rows without ids is named by the least id it has, or null; repeated rows each get a row; an empty table gives an empty table;
other columns, whatever their names, are kept by :func:`dedup` and not read otherwise. A long text is parsed in pieces, and takes
memory for the hashes of its words, about 60 bytes a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import PLACES, Words, as_bytes, by_shard, checkpoint_dir, cut, grams, lean, mix, pack_arrays, runs, shards, slices, spare, table, unpack_arrays, whole_runs
from arcspan.llm.components import components

SHINGLE, PERCENT = 4, 85
GROUP_BYTES = 1 << 22
#: Sets and shingles of a unit beyond which it is split into parts of this size, and the sets of it that are joined with every part.
PART, PART_SHINGLES, LEADERS = 64, 1_500_000, 8
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingles(t: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within it, and the ends of the rows."""
    words = t.words()
    rows = t.rows_of_words()
    at = np.flatnonzero(whole_runs(t.first, t.n_words, size))
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < size))
    h, row = grams(words, size)[at], rows[at]
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = t.n_words[short] > k
            whole[has] += words[t.first[short[has]] + k] * PLACES[k]
        whole = mix(whole + t.n_words[short].astype(np.uint64) * PLACES[50])
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(t.n + 1))


def _keys(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the high half, the rest of the hash in the low half."""
    return ((h >> _32) % np.uint64(shards)) << _32 | (h & _LOW)


def _ask(batches: Iterator[pa.RecordBatch], size: int, shards: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Row key and text to blobs by shard: the shingles of each block of documents, one that a batch has often in a block twice."""
    for batch in batches:
        column, rk = as_bytes(batch.column(1)), batch.column(0).to_numpy()
        for i, j in slices(column, GROUP_BYTES):
            part = column.slice(i, j - i)
            keys, owner = [], []
            for a, b in slices(part):
                h, ends = shingles(Words(part, a, b, fold=True), size)
                keys.append(_keys(h, shards))
                owner.append(np.repeat(np.mod(rk[i + a : i + b], blocks), np.diff(ends)))
            key, block = np.concatenate(keys), np.concatenate(owner).astype(np.uint32)
            order = np.lexsort((key & _LOW, block, key >> _32))
            key, block = key[order], block[order]
            keep = np.ones(len(key), bool)
            keep[2:] = (key[2:] != key[:-2]) | (block[2:] != block[:-2])
            key, block = key[keep], block[keep]
            shard = (key >> _32).astype(np.int64)
            cuts, ends = runs(shard)
            blobs = []
            for a, b in zip(cuts, ends, strict=True):
                at, to = (np.array(x, np.int64) for x in runs(block[a:b]))
                blobs.append(pack_arrays(block[a:b][at], (to - at).astype(np.uint32), (key[a:b] & _LOW).astype(np.uint32)))
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _count(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shingles that stand twice or more: block, low half of the key, log2 of the count; by block and shingle."""
    block, n, low = (np.concatenate(x) for x in zip(*[unpack_arrays(b, np.uint32, np.uint32, np.uint32) for b in blobs], strict=True))
    both = low.astype(np.uint64) << _32 | np.repeat(block, n).astype(np.uint64)
    both.sort()
    low = both >> _32
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(first, append=len(low))
    times = np.repeat(count, count)
    keep = times >= 2
    keep[1:] &= both[1:] != both[:-1]
    both, times = both[keep], times[keep]
    block = (both & _LOW).astype(np.int64)
    order = np.argsort(block, kind="stable")
    return block[order], (both >> _32).astype(np.uint32)[order], np.log2(times[order]).astype(np.uint8)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, (block, low, times) in by_shard(batches, _count):
        cuts, ends = runs(block)
        blobs = [pack_arrays(np.array([shard], np.int64), low[a:b], times[a:b]) for a, b in zip(cuts, ends, strict=True)]
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def _size_class(n: int, percent: int) -> int:
    """Sets that link are in the same class or in neighbours."""
    return int(np.log(n) / np.log(100 / percent) + 1e-9)


#: Kinds of rows that :func:`_order` gives.
DOCS, ROUTES, SETS = range(3)


def _order(batches: Iterator[pa.RecordBatch], size: int, percent: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks, each its answers and then its documents: a row for each document, routes by shard, and each set that has routes."""
    now, answers, known, times, seen = None, [], None, None, set()
    for batch in batches:
        block, blob, rk = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        first = 0
        while first < len(block):
            if block[first] != now:
                now, answers, known, seen = block[first], [], None, set()
            last = first
            is_doc = not blob[first].is_valid
            while last < len(block) and block[last] == now and (not blob[last].is_valid) == is_doc:
                last += 1
            if not is_doc:
                answers += [blob[k].as_buffer().to_pybytes() for k in range(first, last)]
                first = last
                continue
            if known is None:
                got = [unpack_arrays(x, np.int64, np.uint32, np.uint8) for x in answers]
                known = np.concatenate([np.zeros(0, np.uint64), *[np.uint64(s[0]) << _32 | low.astype(np.uint64) for s, low, _ in got]])
                times = np.concatenate([np.zeros(0, np.uint8), *[t for _, _, t in got]])
                by = np.argsort(known)
                known, times, answers = known[by], times[by], []
            part = batch.slice(first, last - first)
            first = last
            column = as_bytes(part.column(4))
            for i, j in slices(column):
                h, ends = shingles(Words(column, i, j, fold=True), size)
                n = np.diff(ends)
                rows = np.repeat(np.arange(j - i), n)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ PLACES[60]), out=total[1:])
                rid = mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64) * PLACES[61]).astype(np.int64)
                key = _keys(h, shards)
                rank = np.zeros(len(h), np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    rank = np.where(known[at] == key, times[at], 0).astype(np.uint8)
                yield _rows(DOCS, part.column(3).type, doc_id=part.column(3).slice(i, j - i), rk=part.column(2).slice(i, j - i), rid=pa.array(rid, mask=n == 0), n=pa.array(n.astype(np.int64)))
                # The first shingles of a set: all that are unique come first, so only sets with few unique ones have routes.
                unique = np.bincount(rows[rank == 0], minlength=j - i)
                prefix = n - (percent * n + 99) // 100 + 1
                routes, sets = [], []
                for k in np.flatnonzero((n > 0) & (unique < prefix)).tolist():
                    r = int(rid[k])
                    if r in seen:
                        continue
                    seen.add(r)
                    own = h[ends[k] : ends[k + 1]]
                    places = rank[ends[k] : ends[k + 1]]
                    shared = np.lexsort((own, places))[unique[k] : prefix[k]]
                    routes.append((own[shared], r, _size_class(int(n[k]), percent)))
                    sets.append((r, int(n[k]), pack_arrays(own, places), k))
                if sets:
                    yield _rows(SETS, part.column(3).type, rid=pa.array([s[0] for s in sets], pa.int64()), rk=part.column(2).slice(i, j - i).take(pa.array([s[3] for s in sets])), n=pa.array([s[1] for s in sets], pa.int64()), blob=pa.array([s[2] for s in sets], pa.binary()))
                    token = np.concatenate([x[0] for x in routes])
                    counts = [len(x[0]) for x in routes]
                    ids, size_class = np.repeat([x[1] for x in routes], counts), np.repeat([x[2] for x in routes], counts).astype(np.uint8)
                    to = (mix(token) % np.uint64(shards)).astype(np.int64)
                    by = np.argsort(to, kind="stable")
                    cuts, ends = runs(to[by])
                    blobs = [pack_arrays(token[by[a:b]], ids[by[a:b]], size_class[by[a:b]]) for a, b in zip(cuts, ends, strict=True)]
                    yield _rows(ROUTES, part.column(3).type, n=pa.array(to[by[cuts]]), blob=pa.array(blobs, pa.binary()))


def _rows(kind: int, id_type: pa.DataType, **given: pa.Array) -> pa.RecordBatch:
    size = len(next(iter(given.values())))
    names = ["kind", "doc_id", "rk", "rid", "n", "blob"]
    kinds = [pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [given.get(name, pa.nulls(size, k)) if name != "kind" else pa.array([kind] * size, pa.int32()) for name, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links to each component's least node, of links (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    ids = nodes.tolist()
    return [(ids[x], ids[t]) for x in range(len(ids)) if (t := top(x)) != x]


def _meet(blobs: list[bytes]) -> list[tuple[int, int]]:
    """Sets that share a shingle of their prefixes and have fitting sizes, joined by stars."""
    token, rid, size = (np.concatenate(x) for x in zip(*[unpack_arrays(b, np.uint64, np.int64, np.uint8) for b in blobs], strict=True))
    order = np.lexsort((rid, size, token))
    token, rid, size = token[order], rid[order], size[order].astype(np.int64)
    new_token = np.concatenate([[True], token[1:] != token[:-1]])
    new = new_token.copy()
    new[1:] |= size[1:] != size[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    heads = np.flatnonzero(new)
    step = (~new_token[heads[1:]]) & (size[heads[1:]] - size[heads[:-1]] == 1)
    a, b = np.concatenate([rid[~new], rid[heads[1:]][step]]), np.concatenate([rid[first[~new]], rid[heads[:-1]][step]])
    other = a != b
    return _forest(a[other], b[other]) if other.any() else []


def _links(pairs: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for found in pairs:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


class _Node:
    __slots__ = ("segment", "next", "least", "most", "ends", "one", "uniform")

    def __init__(self, segment: np.ndarray, size: int, own: int) -> None:
        self.segment, self.next, self.least, self.most = segment, {}, size, size
        self.ends: list[int] = []
        self.one, self.uniform = own, True


class Trie:
    """Sets of ranks, each sorted, in a path-compressed prefix tree; links by an exact overlap bound; components as they grow."""

    def __init__(self, width: int, percent: int = PERCENT) -> None:
        self.root = _Node(np.zeros(0, np.int64), 0, -1)
        self.root.least = 1 << 60
        self.percent = percent
        self.mask = np.zeros(width, bool)
        self.up: list[int] = []
        self.sizes: list[int] = []

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def _enough(self, overlap: int, total: int) -> bool:
        return (100 + self.percent) * overlap >= self.percent * total

    def link(self, ranks: np.ndarray, own: int) -> None:
        """Join set ``own`` with the components of all stored sets that it links to."""
        mask, n = self.mask, len(ranks)
        mask[ranks] = True
        stack = [(c, 0, 0) for c in self.root.next.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if node.uniform and self.top(node.one) == self.top(own):
                continue
            overlap += int(np.count_nonzero(mask[node.segment]))
            depth += len(node.segment)
            rest = n - int(np.searchsorted(ranks, node.segment[-1], "right"))
            best = min(max(depth + rest, node.least), node.most)
            if not self._enough(overlap + min(rest, best - depth), n + best):
                continue
            if node.ends and self._enough(overlap, n + depth):
                a, b = self.top(node.ends[0]), self.top(own)
                self.up[max(a, b)] = min(a, b)
            stack += [(c, overlap, depth) for c in node.next.values()]
        mask[ranks] = False

    def add(self, ranks: np.ndarray, own: int) -> None:
        size, node, at, path = len(ranks), self.root, 0, [self.root]
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if at == size:
                node.ends.append(own)
                break
            child = node.next.get(int(ranks[at]))
            if child is None:
                child = node.next[int(ranks[at])] = _Node(ranks[at:], size, own)
                child.ends.append(own)
                break
            segment = child.segment
            m = min(len(segment), size - at)
            differ = np.flatnonzero(segment[:m] != ranks[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(segment):
                upper = _Node(segment[:same], child.least, child.one)
                upper.most, upper.uniform = child.most, child.uniform
                child.segment = segment[same:]
                upper.next[int(segment[same])] = child
                node.next[int(ranks[at])] = upper
                child = upper
            at += same
            node = child
            path.append(node)
        for node in reversed(path[1:]):
            if len(node.next) <= 64:
                tops = {self.top(c.one) for c in node.next.values()} | {self.top(e) for e in node.ends}
                node.one = node.ends[0] if node.ends else next(iter(node.next.values())).one
                node.uniform = len(tops) == 1 and all(c.uniform for c in node.next.values())
            else:
                node.uniform = node.uniform and self.top(node.one) == self.top(own)


def join_sets(rids: list[int], sets: list[np.ndarray], percent: int = PERCENT, guests: list[bool] | None = None, known: list[int] | None = None, places: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Prefix-tree join of sets: for each that links to others, a link to the first of its component.

    ``places`` gives each value's place in the global order, the same in all sets; the trie has the last ones, the most frequent
    values, first, so that sets which are alike begin alike. Guests are joined with the other sets, but neither of the two kinds among themselves. Sets with the same ``known`` component
    are linked already.
    """
    values, one, flat = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    place = np.concatenate(places)[one].astype(np.int64) if places else np.zeros(len(values), np.int64)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -place))] = np.arange(len(values))
    flat = rank[flat]
    trie, ends = Trie(len(values), percent), np.cumsum([len(s) for s in sets])
    first: dict[int, int] = {}
    trie.up = [first.setdefault(known[x], x) if known else x for x in range(len(sets))]
    for own in sorted(range(len(sets)), key=lambda x: guests[x]) if guests else range(len(sets)):
        ranks = np.sort(flat[ends[own] - len(sets[own]) : ends[own]])
        if not guests or guests[own]:
            trie.link(ranks, own)
        if not guests or not guests[own]:
            trie.add(ranks, own)
    return [(rids[x], rids[t]) for x in range(len(sets)) if (t := trie.top(x)) != x]


def _join(batches: Iterator[pa.RecordBatch], percent: int, visits: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: unit, rid, set, guest, known component."""

    def linked(sets: dict[int, tuple]) -> list[tuple[int, int]]:
        rows = list(sets.values())
        found = ([x[2] for x in rows], [x[3] for x in rows]) if visits else (None, None)
        return join_sets(list(sets), [x[0] for x in rows], percent, *found, [x[1] for x in rows]) if len(sets) > 1 else []

    def units() -> Iterator[list[tuple[int, int]]]:
        now, sets = None, {}
        for batch in batches:
            unit, rid, blob, guest, known = batch.columns
            for u, r, x, g, k in zip(unit.to_pylist(), rid.to_pylist(), blob, guest.to_pylist(), known.to_pylist(), strict=True):
                if u != now:
                    yield linked(sets)
                    now, sets = u, {}
                if r not in sets:
                    sets[r] = *unpack_arrays(x.as_buffer().to_pybytes(), np.uint64, np.uint8), g, k
        yield linked(sets)

    return _links(units())


def _units(rows: DataFrame, width: int, percent: int, visits: bool) -> DataFrame:
    """Links (a, b) of rows (unit, rid, blob, guest, known)."""
    dealt = rows.repartition(width, "unit").sortWithinPartitions("unit", "guest", "rid")
    return dealt.mapInArrow(lean(lambda b: _join(b, percent, visits)), "a long, b long")


def _linked(sets: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of sets (rid, rk, n, blob) within the units (node, root).

    A unit over :data:`PART` sets is split into that many parts, each joined by itself and with the unit's :data:`LEADERS`, sets of
    least hash. The sets outside the component that is then the unit's largest visit all parts, so any two sets that do not
    share a component by then have met.
    """
    # each block has given a set once; one of them is chosen by keys alone, so that those of a frequent set don't meet in one task
    one = sets.groupBy("rid").agg(F.min("rk").alias("rk")).join(candidates.withColumnRenamed("node", "rid"), "rid")
    sized = cut(sets.select("rid", "rk", "n", "blob").join(one, ["rid", "rk"]).select("root", "rid", "n", "blob"))
    unit = sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    g = F.greatest(F.ceil(F.col("sets") / PART), F.ceil(F.col("total") / PART_SHINGLES)).cast("int")
    unit = cut(unit.select("root", F.when(F.col("sets") <= 2, 1).otherwise(g).alias("g")))
    no = F.lit(False).alias("guest"), F.lit(0).cast("long").alias("known")
    sized = sized.join(unit, "root").withColumn("slot", F.pmod(F.xxhash64("rid"), F.col("g")).cast("int"))
    name = F.xxhash64("root", "slot").alias("unit")
    parted = sized.select(name, "rid", "blob", *no)
    if unit.where("g > 1").isEmpty():
        return _units(parted, width, percent, False)

    large = sized.where("g > 1")
    leaders = large.groupBy("root", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(LEADERS)).alias("h")).agg(F.min("rid").alias("rid"))
    leaders = large.join(leaders.select("rid"), "rid", "left_semi").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    links = cut(_units(parted.unionByName(leaders.select(name, "rid", "blob", *no)), width, percent, False))

    found = components(links)
    large = cut(large.join(found.select(F.col("node").alias("rid"), F.col("root").alias("c")), "rid", "left").withColumn("known", F.coalesce("c", "rid")).drop("c"))
    most = large.groupBy("root", "known").count().groupBy("root").agg(F.max_by("known", F.struct("count", "known")).alias("most"))
    others = large.join(cut(most), "root").where("known <> most").drop("most")
    visits = cut(others.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("v")))
    if visits.isEmpty():
        return links
    hosts = large.join(visits, "root").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("v") - 1)))
    guests = others.join(visits, "root").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("v")).cast("int"))
    guests = guests.withColumnRenamed("slot", "own").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).where("slot <> own")
    met = F.xxhash64("root", "slot", "chunk").alias("unit")
    both = hosts.select(met, "rid", "blob", F.lit(False).alias("guest"), "known").unionByName(guests.select(met, "rid", "blob", F.lit(True).alias("guest"), "known"))
    return links.unionByName(_units(both, width, percent, True))


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, rk, rid, n; rid null for an empty set), and each distinct set: rid, root of its component, the least id of its
    rows, and its first row (by id, then key)."""
    spark = docs.sparkSession
    width = shards(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    asked = read.select("rk", "text").mapInArrow(lean(lambda b: _ask(b, size, width, width)), "shard int, blob binary")
    answers = asked.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(lean(_answer), "block int, blob binary")
    null = lambda t: F.lit(None).cast(t)
    both = answers.select("block", "blob", null("long").alias("rk"), null(kind).alias("doc_id"), null("string").alias("text"))
    both = both.unionByName(read.select(F.pmod("rk", F.lit(width)).cast("int").alias("block"), null("binary").alias("blob"), "rk", "doc_id", "text"))
    dealt = both.repartition(width, "block").sortWithinPartitions("block", F.col("blob").isNull())

    schema = f"kind int, doc_id {kind}, rk long, rid long, n long, blob binary"
    path = f"{checkpoint_dir(spark)}/arcspan-{uuid.uuid4().hex}"
    dealt.mapInArrow(lean(lambda b: _order(b, size, percent, width)), schema).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    rows, routes, sets = (stored.where(F.col("kind") == k) for k in (DOCS, ROUTES, SETS))

    met = routes.select(F.col("n").cast("int").alias("shard"), "blob").repartition(width, "shard").sortWithinPartitions("shard")
    met = met.mapInArrow(lean(lambda b: _links(x for _, x in by_shard(b, _meet))), "a long, b long")
    found = components(_linked(sets, components(met), width, percent)).withColumnRenamed("node", "rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rk")).alias("first")
    least = rows.where("rid is not null").groupBy("rid").agg(F.min("doc_id").alias("least"), first, F.count("*").alias("copies")).join(found, "rid", "left")
    return rows.select("doc_id", "rk", "rid", "n"), cut(least.select("rid", F.coalesce("root", "rid").alias("root"), "least", "first", "copies"))


def _named(many: DataFrame, few: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``many`` left joined with ``few``, which has a row for each key. ``counts`` (key, copies) tells how many rows of ``many`` have it.

    Keys with over 1 / :data:`KEYS` of all rows are dealt to several tasks; there are fewer than :data:`KEYS`, which bounds the table
    of them that is broadcast.
    """
    most = max(100, (counts.agg(F.sum("copies")).first()[0] or 0) // KEYS)
    hot = cut(counts.where(F.col("copies") > most).select(key, F.ceil(F.col("copies") / most).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = many.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts).cast("int")).drop("salts")
    spread = few.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(spread, [key, "salt"], "left").drop("salt")


#: Keys that may be dealt to several tasks.
KEYS = 10_000


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, rk (xxhash64 of id and text), n_shingles, component_id."""
    rows, sets = _grouped(docs, size, percent)
    groups = cut(sets.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("copies")))
    named = _named(sets.select("rid", "root"), groups.select("root", "component_id"), "root", groups.select("root", "copies")).select("rid", "component_id")
    out = _named(rows.withColumnRenamed("n", "n_shingles"), named, "rid", sets.select("rid", "copies"))
    return out.select("doc_id", "rk", "n_shingles", F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents less all but one row of each component: one with its least id, of those the one with the least key.

    Rows without words stay, once for each id and text. All columns are as they are.
    """
    rows, sets = _grouped(docs, size, percent)
    alone = rows.where("rid is null").select("rk")
    one = sets.groupBy("root").agg(F.min("first").alias("first")).select("first.rk")
    (key,) = spare(docs, "row_key")
    keep = alone.unionByName(one).distinct().withColumnRenamed("rk", key)
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(keep, key, "left_semi").dropDuplicates([key]).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("rk")
