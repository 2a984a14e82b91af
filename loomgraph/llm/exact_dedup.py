"""Exact dedup by owners in Patricia tries.

Rows are keyed by the length and the SHA-256 of their text. Every task first puts whole texts into a compressed radix
trie of its own, whose terminal nodes hold the owner (the largest identifier) and how many rows were met, so a group of
copies leaves a task as one row, however many rows it has. If a trie holds more than ``HELD_BYTES``, whole subtrees, the
heaviest first, are handed to the shuffle and forgotten. The partitions of length and digest then insert what the tasks
found, in key order, into tries of their own: a subtree under one length and digest is complete once the order moves
past it, so it is handed out and forgotten, and memory holds one such subtree.

Owners of groups go back to their rows by a join on (length, digest). Its hot side has a few dozen bytes a row and
is split by Spark's handling of skewed joins; a single row needs no owner but itself and takes no part in the shuffle of owners.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import materialize, prepare

#: Bytes of edge labels, with an allowance for each node, that one task's trie holds before subtrees are handed on.
HELD_BYTES = 48 << 20
NODE_BYTES = 400
#: Repeated rows that one row of the result stands for before it is laid out.
ROWS_A_PART = 1 << 16


class Node:
    """An edge label, the nodes below by their first byte, and at the end of a key [largest id, its rows, all rows]."""

    __slots__ = ("label", "below", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.below, self.owner = label, {}, owner


class PatriciaTrie:
    """A compressed radix trie over keys of which none is a prefix of another."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, ident: int | None, top: int, rows: int) -> None:
        """Add ``rows`` rows with ``key``, of which ``top`` have the largest identifier, ``ident`` (null is the smallest)."""
        node, at = self.root, 0
        while True:
            child = node.below.get(key[at])
            if child is None:
                leaf = Node(key[at:], [ident, top, rows])
                node.below[key[at]] = leaf
                self.held += len(leaf.label) + NODE_BYTES
                return
            label = child.label
            if key.startswith(label, at):
                at += len(label)
                if at == len(key):
                    self._meet(child.owner, ident, top, rows)
                    return
                node = child
                continue
            n = self._shared(label, key, at)
            fork = Node(label[:n])
            node.below[key[at]] = fork
            child.label = label[n:]
            fork.below[child.label[0]] = child
            self.held += NODE_BYTES
            node, at = fork, at + n

    @staticmethod
    def _meet(owner: list, ident: int | None, top: int, rows: int) -> None:
        if owner[0] == ident:
            owner[1] += top
        elif ident is not None and (owner[0] is None or ident > owner[0]):
            owner[0], owner[1] = ident, top
        owner[2] += rows

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        """How many bytes ``label`` and ``key`` from ``at`` share, by halving: they are known to differ."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if label[low:mid] == key[at + low : at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.owner is not None:
                yield prefix, node.owner
            stack += [(child, prefix) for child in node.below.values()]

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """All keys with their owners; the trie is empty afterwards."""
        root, self.root, self.held = self.root, Node(b""), 0
        yield from self._walk(root, b"")

    def spill(self, down_to: int) -> Iterator[tuple[bytes, list]]:
        """Give out and forget whole subtrees under the first fork, the heaviest first, until ``down_to`` is held."""
        node, prefix = self.root, b""
        while len(node.below) == 1 and node.owner is None:
            (only,) = node.below.values()
            if not only.below:
                break
            node, prefix = only, prefix + only.label
        weights = sorted(((self._weight(child), first) for first, child in node.below.items()), reverse=True)
        for weight, first in weights:
            if self.held <= down_to:
                break
            yield from self._walk(node.below.pop(first), prefix)
            self.held -= weight
        if node is not self.root and not node.below:
            self.root, self.held = Node(b""), 0

    @staticmethod
    def _weight(node: Node) -> int:
        weight, stack = 0, [node]
        while stack:
            node = stack.pop()
            weight += len(node.label) + NODE_BYTES
            stack += node.below.values()
        return weight


def _parts(key: bytes) -> tuple[int, bytes, bytes]:
    """Length, digest and text of a key."""
    return int.from_bytes(key[:8], "big"), key[8:40], key[40:]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, the first of whose values is the length of a text, as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[0] + 100
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def owners_of(keyed: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(n_bytes, digest, keep_id, top_rows, group_size) of every text that more than one row of
    ``keyed`` (id, n_bytes, digest, body) holds. Two texts of one length and digest raise an error."""
    prepare(keyed.sparkSession)
    fields = [pa.field("n_bytes", pa.int64()), pa.field("digest", pa.binary()), pa.field("body", pa.binary()), pa.field("id", pa.int64()), pa.field("top", pa.int64()), pa.field("group_rows", pa.int64())]
    met, owned = pa.schema(fields), pa.schema([*fields[:2], *fields[3:]])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            for ident, n, digest, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(n.to_bytes(8, "big") + digest + body, ident, 1, 1)
            if trie.held > held_bytes:
                yield from _batches(((*_parts(key), *owner) for key, owner in trie.spill(held_bytes // 2)), met)
        yield from _batches(((*_parts(key), *owner) for key, owner in trie.drain()), met)

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, current = PatriciaTrie(), None
        for batch in batches:
            for n, digest, body, ident, top, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, digest) != current:
                    yield from alone(trie)
                    current = (n, digest)
                trie.insert(n.to_bytes(8, "big") + digest + body, ident, top, rows)
        yield from alone(trie)

    def alone(trie: PatriciaTrie) -> Iterator[tuple]:
        found = list(trie.drain())
        if len(found) > 1:
            raise ValueError("two texts share their length and SHA-256")
        return ((*_parts(key)[:2], *owner) for key, owner in found if owner[2] > 1)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(complete(batches), owned)

    texts = keyed.select("id", "n_bytes", "digest", "body").mapInArrow(first, "n_bytes long, digest binary, body binary, id long, top long, group_rows long")
    parted = texts.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    return parted.mapInArrow(second, "n_bytes long, digest binary, keep_id long, top_rows long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``, dropped ones too.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest id stays;
    a null id is smaller than any other. Of rows repeated with that id one stays. Ids are integers. Other columns are
    not read, so their names cannot clash. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("body"))
    owners = materialize(owners_of(keyed, held_bytes), "owners")
    found = keyed.select("id", "n_bytes", "digest").join(owners, ["n_bytes", "digest"], "left")
    found = found.select("id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce("top_rows", F.lit(1)).alias("top_rows"))
    # rows that repeat the owner's id are alike in all columns: they are counted, and laid out again with one of them kept
    found = materialize(found.withColumn("owner", F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("repeats", F.col("owner") & (F.col("top_rows") > 1)), "owned")
    plain = found.where("not repeats").select("id", "digest", "keep_id", "group_size", F.col("owner").alias("kept"))
    alike = found.where("repeats").groupBy("id", "digest", "keep_id", "group_size").agg(F.count("*").alias("n"))
    parts = alike.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {ROWS_A_PART})"))).repartition("digest", "part")
    laid = parts.withColumn("k", F.explode(F.expr(f"sequence(part * {ROWS_A_PART}, least(n, (part + 1) * {ROWS_A_PART}) - 1)")))
    out = plain.unionByName(laid.select("id", "digest", "keep_id", "group_size", (F.col("k") == 0).alias("kept")))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
