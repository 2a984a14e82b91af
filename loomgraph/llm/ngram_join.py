"""N-gram Jaccard join: which documents are linked, and the components of the links.

Documents are sets of hashed word shingles; two link when their Jaccard similarity reaches num / den. The join is
exact:

1. Documents with equal sets are one node.
2. Candidates. All shingles are brought into one order, roughly from rare to common. Linked sets must share
   ceil(num / den * |A|) shingles, so they share one of the first |A| - ceil(num / den * |A|) + 1 shingles of either
   (its prefix), whatever the order is: nodes with a shingle of their prefixes in common and sizes that allow a link (of
   one size class or two neighbouring ones) stand in one block. The order decides only how large blocks are. It comes
   from counts of all documents' shingles in ``BUCKETS`` buckets: a passage that many documents share stands last and
   stays out of prefixes. Blocks whose node of most blocks is the same are then taken as one.
3. Count vectors. Shingles are hashed into groups whose counts are a point. The sum of the smaller coordinates of two
   points bounds the overlap of the sets from above. In a block the points of ``DIMENSIONS`` groups are packed into an
   R-tree; a tree node's upper corner bounds the overlap with all points below it. Nodes for which this leaves a partner
   are bounded once more by the same points at 65,536 groups, which hardly overestimates.
4. A block gives out a spanning forest of the pairs that the bounds leave, at most one pair fewer than it has nodes,
   and these pairs are verified on the shingle sets. Where a pair of a forest turns out not to link, its block
   is gone through once more without that short cut: all its pairs between different components are verified.

Blocks of over ``CHUNK`` nodes or ``ELEMENTS`` shingles are cut into pieces, every two of which meet in a task of their
own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.runtime import discard, materialize, prepare, valid

DIMENSIONS = 64
#: Buckets in which shingles are counted for their order, and the rows in which a task hands its counts on.
BUCKETS, SLICES, SHIFT = 1 << 22, 1024, np.uint64(42)
#: Nodes of a block, and shingles of its nodes, that meet in one piece.
CHUNK, ELEMENTS = 2048, 4_000_000
LEAF = 16
#: Bits of the filter that tells which documents are worth shingling once more: 8 MB on every worker.
FILTER = 1 << 26
CACHED_WORDS = 60_000
#: Fixed odd multipliers of the 64-bit hash finaliser.
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _salt(n: int, factor: np.uint64) -> np.uint64:
    """n times an odd factor, modulo 2^64."""
    return np.uint64(n * int(factor) % (1 << 64))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _Words:
    return _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; of all its words if they are fewer. Words
    are what ASCII white space separates, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = _mix(acc + h[k : k + n])
    return np.unique(acc)


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of the whole set."""
    total = _mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(_mix(total + _salt(len(shingles), M1)).view(np.int64)[0])


def prefix_length(size: int, num: int, den: int) -> int:
    """How many of a set's first shingles hold one in common with every set that it links with."""
    return size - -(-num * size // den) + 1


def size_classes(num: int, den: int, largest: int = 1 << 40) -> np.ndarray:
    """The least size of each class. Sets that link are in one class or in two neighbouring ones."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
    return np.array(low)


def count_vector(pieces: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of ``DIMENSIONS`` groups, from their 16-bit groups."""
    return np.bincount(pieces >> 10, minlength=DIMENSIONS).astype(np.int32)


def sketch(shingles: np.ndarray) -> bytes:
    """The sorted 16-bit groups of all shingles, repeats included: a count vector of 65,536 groups, laid out sparsely."""
    return np.sort((shingles >> np.uint64(40)).astype("<u2")).tobytes()


def numbered(pieces: np.ndarray) -> np.ndarray:
    """Sorted 16-bit groups, each with its number among equals above it: the k-th shingle of a group matches the k-th."""
    new = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1]))
    at = np.arange(len(pieces)) - np.repeat(new, np.diff(np.append(new, len(pieces))))
    return pieces.astype(np.int32) | (at.astype(np.int32) << 16)


class CountTree:
    """An R-tree packed over count vectors; nodes keep their upper corner and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        half = points[:, : points.shape[1] // 2].sum(axis=1)
        self.order = np.lexsort((half, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        upper, least = self.points, self.sizes
        while len(upper) > LEAF:
            at = np.arange(0, len(upper), LEAF)
            upper, least = np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at)
            self.levels.append((upper, least))

    def may_link(self, point: np.ndarray, size: np.ndarray, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
        overlap = np.minimum(point, upper).sum(axis=-1)
        return (self.den + self.num) * overlap >= self.num * (size + least)

    def query(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) places of all pairs that the bound leaves."""
        found = []
        for start in range(0, len(points), 64):
            some, size = points[start : start + 64], sizes[start : start + 64]
            depth = len(self.levels)
            n_top = len(self.levels[-1][0]) if depth else len(self.points)
            q, at = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(n_top), indexing="ij"))
            for level in range(depth - 1, -2, -1):
                upper, least = self.levels[level] if level >= 0 else (self.points, self.sizes)
                keep = np.concatenate([self.may_link(some[q[a : a + 20_000]], size[q[a : a + 20_000]], upper[at[a : a + 20_000]], least[at[a : a + 20_000]]) for a in range(0, len(q), 20_000)] or [np.zeros(0, bool)])
                q, at = q[keep], at[keep]
                if level >= 0:
                    below = len(self.levels[level - 1][0]) if level else len(self.points)
                    at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                    q = np.repeat(q, LEAF)[at < below]
                    at = at[at < below]
            found.append((q + start, self.order[at]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, int),) * 2


def _distinct_sets(batch: pa.RecordBatch, width: int, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(key, set) of the rows with an id and words whose set the task has not seen; it only saves work."""
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        s = shingle_set(text, width)
        key = set_key(s)
        if doc is None or not len(s) or key in seen:
            continue
        if len(seen) >= 200_000:
            seen.clear()
        seen.add(key)
        yield key, s


def _features(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc, n, key, class) of every row, and from each task ``SLICES`` rows (slice, counts): its distinct sets' shingles
    by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, low, fresh, held = np.zeros(BUCKETS, np.int64), set(), size_classes(num, den), [], 0
        names = ["doc", "n", "key", "class", "slice", "counts"]
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            keys = [set_key(s) for s in sets]
            for key, s in zip(keys, sets, strict=True):
                if key not in seen and len(seen) < 200_000:
                    seen.add(key)
                    fresh.append((s >> SHIFT).astype(np.int32))
                    held += len(s)
            if held > BUCKETS // 2:
                counts += np.bincount(np.concatenate(fresh), minlength=BUCKETS)
                fresh, held = [], 0
            none, n = pa.nulls(batch.num_rows), np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys, pa.int64()), pa.array(np.searchsorted(low, n, side="right").astype(np.int32)), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if seen:
            counts += np.bincount(np.concatenate(fresh), minlength=BUCKETS) if fresh else 0
            none = pa.nulls(SLICES, pa.int64())
            packed = [zlib.compress(c.tobytes(), 1) for c in counts.astype("<u4").reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([none, none, none, none.cast(pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.mapInArrow(run, "doc bigint, n bigint, key bigint, class int, slice int, counts binary")


def _levels(counted: DataFrame) -> np.ndarray:
    """A level for every bucket, four to each doubling of its count over all tasks: ``BUCKETS`` bytes on the driver,
    whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
        levels = [np.floor(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])

    found = counted.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, levels binary").collect()
    levels = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for r in found:
        levels[r[0]] = np.frombuffer(r[1], np.uint8)
    return levels.ravel()


def _signatures(docs: DataFrame, width: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """(sig, key): the shingles of the prefix of every document's set; of equal sets within a task only the first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            keys, sigs = [], []
            for key, s in _distinct_sets(batch, width, seen):
                length = prefix_length(len(s), num, den)
                keys.append(key)
                sigs.append(s[np.argsort(order[(s >> SHIFT).astype(np.int64)], kind="stable")[:length]].view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array(keys, np.int64), [len(s) for s in sigs]))], ["sig", "key"])

    return docs.mapInArrow(run, "sig bigint, key bigint")


def _shared(signatures: DataFrame) -> DataFrame:
    """The distinct rows of ``signatures`` whose sig stands at two keys or more. The rows come sorted by sig and key;
    no more than the last row is kept in memory, however many keys a sig has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.zeros((2, 0), np.int64)  # the last row, if its sig has no other key so far
        last = None  # the last row
        for batch in batches:
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            if last is not None and len(fresh):
                fresh[0] = (rows[:, 0] != last).any()
            rows = rows[:, fresh]
            if not rows.shape[1]:
                continue
            goes_on = last is not None and not waiting.shape[1] and rows[0, 0] == last[0]
            rows = np.concatenate([waiting, rows], axis=1)
            last = rows[:, -1]
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.append(goes_on, same) | np.append(same, False)
            if goes_on:  # the sig was found at two keys before
                keep[: np.argmin(np.append(same, False)) + 1] = True
            waiting = rows[:, -1:] if not keep[-1] else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0, keep]), pa.array(rows[1, keep])], ["sig", "key"])

    return signatures.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(run, "sig bigint, key bigint")


def _bits_of(ids: DataFrame, spark: SparkSession) -> Broadcast:
    """A Bloom filter of one hash over a column of ids: at most ``FILTER`` bits, whatever their number."""
    bucket = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER))
    words = ids.select(F.floor(bucket / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bucket % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits)


#: Columns made from a set: their types, and how they are made.
MADE = {"point": ("binary", lambda s: count_vector((s >> np.uint64(40)).astype(np.uint16)).tobytes()), "sketch": ("binary", sketch), "shingles": ("array<bigint>", lambda s: s.view(np.int64))}


def _sets(docs: DataFrame, width: int, ids: DataFrame, columns: list[str]) -> DataFrame:
    """(key, n, columns of MADE) of the documents named by ``ids``, and of some more: their texts stay where they are, and a
    filter tells which are worth the work. Of equal sets within a task only the first counts."""
    shared = _bits_of(ids, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(shared.value[at // 64] >> (at % 64) & 1)
            found = list(_distinct_sets(batch.take(pa.array(wanted)), width, seen)) if len(wanted) else []
            if not found:
                continue
            arrays = [pa.array([k for k, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64())]
            arrays += [pa.array([MADE[c][1](s) for _, s in found], pa.binary() if MADE[c][0] == "binary" else pa.list_(pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", *columns])

    schema = "key bigint, n bigint, " + ", ".join(f"{c} {MADE[c][0]}" for c in columns)
    return docs.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(FILTER))).mapInArrow(run, schema)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b), a written table: the pairs of keys whose shingle sets link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = nodes.join(ends, "key", "left_semi").select("node")
    sets = materialize(_sets(docs, width, ids, ["shingles"]), "sets")
    side = lambda end: sets.select(F.col("key").alias(end), F.col("shingles").alias(f"s_{end}"))
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    exact = (den + num) * common >= num * (F.size("s_a") + F.size("s_b"))
    links = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(exact).select("a", "b").distinct(), "links")
    discard(sets)
    return links


class Block:
    """The nodes of one piece of a block, in which pairs are looked for between its two sides."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, sketches: list[bytes], component: np.ndarray, num: int, den: int):
        self.keys, self.sizes, self.num, self.den = keys, sizes, num, den
        self.component = np.unique(component, return_inverse=True)[1]
        self.pieces = [np.frombuffer(s, "<u2") for s in sketches]
        self.points = np.stack([count_vector(p) for p in self.pieces])
        self.codes: dict[int, np.ndarray] = {}

    def code(self, k: int) -> np.ndarray:
        if k not in self.codes:
            self.codes[k] = numbered(self.pieces[k])
        return self.codes[k]

    def linked_by_pieces(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` the bound of 65,536 groups leaves as partners of ``one``."""
        mine = self.code(one)
        table = np.zeros(int(mine.max()) + 1, bool)
        table[mine] = True
        found = np.zeros(len(others), bool)
        for start in range(0, len(others), 256):
            at = others[start : start + 256]
            some = [self.code(int(k)) for k in at]
            flat = np.concatenate(some)
            hit = table[np.minimum(flat, len(table) - 1)] & (flat < len(table))
            overlap = np.add.reduceat(hit, np.append(0, np.cumsum([len(s) for s in some[:-1]], dtype=np.int64)), dtype=np.int64)
            found[start : start + 256] = (self.den + self.num) * overlap >= self.num * (self.sizes[one] + self.sizes[at])
        return found

    def pairs(self, low: np.ndarray, high: np.ndarray, forest: bool) -> list[tuple[int, int]]:
        """Pairs (one of ``low``, one of ``high``) of different components that both bounds leave. In a forest, what is
        found counts as linked at once, so no two ways lead from node to node."""
        tree, component, found = CountTree(self.points[high], self.sizes[high], self.num, self.den), self.component, []
        same_side = len(low) == len(high) and (low == high).all()
        start, step = 0, 1
        while start < len(low):
            batch = low[start : start + step]
            start, step = start + step, min(2 * step, 64)
            for c in np.unique(component[batch]):
                asked = batch[component[batch] == c]
                rest = np.flatnonzero(component[high] != c)
                if not len(rest):
                    continue
                if len(high) <= LEAF or 4 * len(rest) < len(high):
                    q, p = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), rest, indexing="ij"))
                    keep = tree.may_link(self.points[asked[q]], self.sizes[asked[q]], self.points[high[p]], self.sizes[high[p]])
                    q, p = q[keep], p[keep]
                else:
                    q, p = tree.query(self.points[asked], self.sizes[asked])
                order = np.argsort(q, kind="stable")
                q, p = q[order], p[order]
                for k in np.unique(q):
                    one = asked[k]
                    others = high[p[np.searchsorted(q, k) : np.searchsorted(q, k, side="right")]]
                    others = others[component[others] != component[one]]
                    if same_side and not forest:
                        others = others[others > one]
                    for other in others[self.linked_by_pieces(one, others)] if len(others) else ():
                        if component[other] != component[one]:
                            found.append((one, other))
                            if forest:
                                component[component == component[other]] = component[one]
        return found


def near_nodes(points: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which nodes have a partner on the other side (``low`` and ``high``, or one and the same) that the R-tree's bound
    leaves. A node found as a partner needs no query of its own."""
    near = np.zeros(len(sizes), bool)
    same_side = len(low) == len(high) and (low == high).all()
    for asked, there in ((low, high),) if same_side else ((low, high), (high, low)):
        tree, start, step = CountTree(points[there], sizes[there], num, den), 0, 1
        while start < len(asked):
            batch = asked[start : start + step]
            start, step = start + step, min(2 * step, 64)
            batch = batch[~near[batch]]
            if len(batch):
                q, p = tree.query(points[batch], sizes[batch])
                other = batch[q] != there[p]
                near[batch[q[other]]] = near[there[p[other]]] = True
    return near


def _by_piece(blocks: DataFrame, columns: list[str], finish, names: list[str]) -> DataFrame:
    """(names ..., all bigint): what ``finish`` gives of every piece of every block: it gets the block's number, the places of
    the nodes on its low and on its high side, their keys, and the columns, and returns rows. ``blocks``: sig, m (nodes in the
    block), total (their shingles), key and the columns; blocks of many nodes or shingles are cut into pieces."""
    pieces = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("total") / ELEMENTS)).cast("int")
    own = F.pmod(F.xxhash64("key"), pieces).cast("int")
    rows = blocks.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key", *columns)

    def whole(parts: list[pa.RecordBatch]) -> list[tuple[int, ...]]:
        table = pa.Table.from_batches(parts)
        own, keys = table.column(3).to_numpy(), table.column(4).to_numpy()
        sig, low, high = (table.column(k)[0].as_py() for k in range(3))
        at_low, at_high = np.flatnonzero(own == low), np.flatnonzero(own == high)
        if not len(at_low) or not len(at_high) or len(keys) < 2:
            return []
        # the same keys come first in every block of a cluster, so its blocks agree on pairs
        at_low = at_low[np.argsort(keys[at_low])]
        return finish(sig, at_low, at_low if low == high else at_high, keys, *[table.column(5 + k) for k in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        now = None

        def emit(found: list[tuple[int, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [()] * len(names))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, found = [batch.column(k).to_numpy() for k in range(3)], []
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                this = tuple(int(k[a]) for k in key)
                if parts and this != now:
                    found += whole(parts)
                    parts = []
                now = this
                parts.append(batch.slice(a, b - a))
            yield emit(found)
        if parts:
            yield emit(whole(parts))

    keys = ["sig", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _near(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, key): the nodes of each block for which the R-tree leaves a partner in it; at most one row for each of them and
    piece. ``blocks`` have n and point."""
    def finish(sig, low, high, keys, n, point):
        points = np.frombuffer(b"".join(point.to_pylist()), np.int32).reshape(-1, DIMENSIONS)
        return [(sig, int(k)) for k in keys[near_nodes(points, n.to_numpy(), low, high, num, den)]]

    return _by_piece(blocks, ["n", "point"], finish, ["sig", "key"])


def _block_pairs(blocks: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b, sig): pairs of keys of one block, but of different components, that the bounds leave; see ``Block.pairs``.
    ``blocks`` have component, n and sketch."""
    def finish(sig, low, high, keys, component, n, sketch):
        found = Block(keys, n.to_numpy(), sketch.to_pylist(), component.to_numpy(), num, den).pairs(low, high, forest)
        return [(int(min(keys[i], keys[j])), int(max(keys[i], keys[j])), sig) for i, j in found]

    return _by_piece(blocks, ["component", "n", "sketch"], finish, ["a", "b", "sig"])


def _sized(bundle: DataFrame) -> DataFrame:
    """(sig, key, m, total) from (sig, key, n)."""
    return bundle.select("sig", "key").join(bundle.groupBy("sig").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1"), "sig")


def link_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    n_shingles: size of the row's set of ``width``-word shingles; 0 for a null text or one without words, which
    links with nothing. component_id: the smallest id reachable by links, the row's own included. Ids are integers;
    rows that share an id are one vertex, with the links of all their texts (a row without words keeps its own id).
    A row with a null id links with nothing and has a null component. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), valid(text_col).alias("text"))
    counted = materialize(_features(rows, width, num, den), "features")
    features = counted.where("slice IS NULL").select("doc", "n", "key")
    named = counted.where("n > 0 AND doc IS NOT NULL")
    nodes = materialize(named.groupBy("key").agg(F.min("doc").alias("node"), F.min("n").alias("n"), F.min("class").alias("class")), "nodes")

    shared = materialize(_shared(_signatures(rows, width, num, den, _levels(counted))), "shared")
    # a node stands in the blocks of its own size class and, as a guest, in those of the next one
    own = F.explode(F.array(F.lit(0), F.lit(1))).alias("guest")
    dealt = shared.join(nodes.select("key", "n", "class"), "key").select("sig", "key", "n", "class", own).select(F.xxhash64("sig", F.col("class") + F.col("guest")).alias("sig"), "key", "n", "guest")
    block = dealt.groupBy("sig").agg(F.count("*").alias("m"), F.sum("guest").alias("guests")).where("m > 1 AND guests < m").select("sig")
    stands = materialize(dealt.join(block, "sig").select("sig", "key", "n"), "blocks")
    discard(shared)
    # blocks are bundled by their node that stands in most blocks: a sketch goes to a bundle once
    weight = stands.groupBy("key").agg(F.count("*").alias("weight"))
    owner = stands.join(weight, "key").groupBy("sig").agg(F.max_by("key", F.struct("weight", "key")).alias("owner"))
    bundle = materialize(stands.join(owner, "sig").groupBy(F.col("owner").alias("sig"), "key").agg(F.min("n").alias("n")), "bundles")
    discard(stands)

    active = nodes.join(bundle.select("key").distinct(), "key", "left_semi").select("node")
    sketches = materialize(_sets(rows, width, active, ["point", "sketch"]), "sketches")
    # points are small: they tell which nodes of a bundle are worth a sketch
    near = materialize(_near(_sized(bundle).join(sketches.select("key", "n", "point"), "key"), num, den).distinct(), "near")
    kept = bundle.join(near, ["sig", "key"], "left_semi")
    placed = _sized(kept).join(sketches.select("key", "n", "sketch"), "key")
    tried = materialize(_block_pairs(placed.withColumn("component", F.col("key")), num, den, forest=True), "pairs")
    links = _verified(tried.select("a", "b").distinct(), rows, nodes, width, num, den)
    failed = tried.join(links, ["a", "b"], "left_anti").select("sig").distinct()
    if not failed.isEmpty():
        known = materialize(connected_components(links, "a", "b"), "components")
        again = placed.join(failed, "sig", "left_semi").join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        rest = materialize(_block_pairs(again, num, den, forest=False).select("a", "b").distinct().join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_verified(rest, rows, nodes, width, num, den))
        discard(known, rest)
    of = nodes.select("key", "node")
    links = links.join(of.toDF("a", "node_a"), "a").join(of.toDF("b", "node_b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    # an id with several texts is one vertex
    member = named.select("doc", "key").join(nodes, "key").select("doc", "node").distinct()
    twice = member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc", "a")
    same_id = member.join(twice, "doc").where("a < node").select("a", F.col("node").alias("b"))
    component = materialize(connected_components(links.unionByName(same_id), "a", "b"), "components")
    discard(bundle, near, sketches, tried)

    of_key = nodes.join(component, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    joined = features.withColumn("_key", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("key"))).join(of_key.withColumnRenamed("key", "_key"), "_key", "left")
    return joined.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one_of_each(docs: DataFrame, linked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, by ``linked`` (see ``link_documents``); rows with a
    null id stay. Of rows that share an id and a component all stay."""
    dropped = linked.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti")
