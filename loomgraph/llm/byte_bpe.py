"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation: every code point gets a class from a table; with one look at its neighbours the class
becomes a symbol of a small automaton. Each symbol is a function from states to states, and composing
functions is associative, so a batch of texts is cut into equal blocks, the blocks are composed side by side,
a scan over the blocks gives each one's entry state, and a second sweep marks where tokens start. Text
boundaries are symbols that forget the state, so one scan serves all texts of a batch. The slices between
starts feed pair merging with a cache.

The automaton is that of the pattern published with the rank files: contractions, then an optional space with
letters, digits or other signs, then white space whose last space joins what follows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.runtime import prepare, valid

#: The code points that Unicode calls White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, DIGIT, OTHER, SPACE = range(4)
#: Symbols: letter, digit, other sign, apostrophe before one or two contraction letters, white space inside a
#: run or at the text's end, the last white space before a sign if it is a space, and if it is not.
L, N, O, A1, A2, W, SP, WS = range(8)
#: States: nothing yet, in letters, digits, other signs, after a joining space, in white space, after a lone
#: white space, one or two contraction letters to come, after a contraction.
NONE, IN_L, IN_N, IN_O, JOIN, IN_W, LONE, NEED1, NEED2, DONE = range(10)
STATES, SYMBOLS = 10, 8
BLOCK = 256

CACHED_PIECES = 150_000
LONGEST_CACHED = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by symbol and state; symbols from SYMBOLS on are first in their text."""
    to, start = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.ones((2 * SYMBOLS, STATES), bool)
    for symbol, state in ((L, IN_L), (N, IN_N), (O, IN_O), (A1, NEED1), (A2, NEED2), (W, IN_W), (SP, JOIN), (WS, LONE)):
        to[symbol] = to[symbol + SYMBOLS] = state
    for symbol, before, after in ((L, IN_L, IN_L), (L, JOIN, IN_L), (L, NEED1, DONE), (L, NEED2, NEED1), (N, IN_N, IN_N), (N, JOIN, IN_N), (O, IN_O, IN_O), (O, JOIN, IN_O), (A1, IN_O, IN_O), (A1, JOIN, IN_O), (A2, IN_O, IN_O), (A2, JOIN, IN_O), (W, IN_W, IN_W)):
        to[symbol, before], start[symbol, before] = after, False
    return to, start


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = DIGIT
    table[WHITE_SPACE] = SPACE
    return table


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token. points: those of all texts, one after the other; ends: where each text ends."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    last, first = np.zeros(n + 2, bool), np.zeros(n, bool)
    bounds = np.unique(ends[ends > 0])
    last[bounds - 1] = True
    first[0] = True
    first[bounds[bounds < n]] = True
    last = last[:n]
    space = kind == SPACE
    symbol = np.array([L, N, O, W], np.uint8)[kind]
    before_sign = space & ~last & ~np.append(space[1:], True)
    symbol[before_sign] = np.where(points[before_sign] == 0x20, SP, WS)
    quote = np.flatnonzero((points == 0x27) & ~last)
    if len(quote):
        one = points[quote + 1]
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = A1
        two = quote[~last[quote + 1]]
        pair = points[two + 1].astype(np.uint64) << 32 | points[np.minimum(two + 2, n - 1)]
        symbol[two[np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))]] = A2
    symbol[first] += SYMBOLS

    to, start = _automaton()
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, W + SYMBOLS, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat, flat_start, width = to.ravel(), start.ravel(), np.int32(STATES)
    f = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in columns:  # compose each block's functions, all blocks side by side
        f = flat[(column.astype(np.int32) * width)[:, None] + f]
    state = np.zeros(blocks, np.uint8)
    for b in range(1, blocks):  # scan over the blocks
        state[b] = f[b - 1, state[b - 1]]
    starts = np.empty((BLOCK, blocks), bool)
    for k, column in enumerate(columns):
        at = column.astype(np.int32) * width + state
        starts[k] = flat_start[at]
        state = flat[at]
    return np.ascontiguousarray(starts.T).ravel()[:n]


class Ranks(dict):
    """Ids of a pre-token by cached pair merging; the dict holds what was merged before."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = {i: piece for piece, i in self.ranks.items()}

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self.merge(piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 400:
            return self.merge_long(piece)
        none = len(ranks) + 1_000_000
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return tuple([ranks[p] for p in parts])

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and links: n log n for a piece of n bytes."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != merged:
                continue
            parts[i], parts[j] = merged, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return tuple([ranks[p] for p in parts if p is not None])


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def encode_texts(texts: list[str | None], ranks: Ranks) -> list[list[int]]:
    """Ids of each text."""
    data = [(t or "").encode() for t in texts]
    joined = b"".join(data)
    raw = np.frombuffer(joined, np.uint8)
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # where code points start
    ends = np.cumsum([len(d) for d in data])
    points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
    starts = at[token_starts(points, np.searchsorted(at, ends))]
    cuts = [0, *np.searchsorted(starts, ends).tolist()]
    edges = [*starts.tolist(), len(joined)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        pieces = [joined[x:y] for x, y in zip(edges[a:b], edges[a + 1 : b + 1], strict=True)]
        out.append(list(chain.from_iterable(map(ranks.__getitem__, pieces))))
    return out


def decode_ids(ids: list[list[int] | None], ranks: Ranks) -> list[bytes]:
    """The bytes of each list of ids; an unknown id fails."""
    return [b"".join(map(ranks.pieces.__getitem__, x or ())) for x in ids]


class Pieces:
    """All pieces of a vocabulary, one after the other, for decoding by offsets."""

    def __init__(self, ranks: Ranks):
        most = max(ranks.pieces) + 1
        found = [ranks.pieces.get(i, b"") for i in range(most)]
        self.size = np.array(list(map(len, found)), np.int32)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.bytes = np.frombuffer(b"".join(found), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the bytes that all of them stand for."""
        size = self.size[ids]
        return np.cumsum(size, dtype=np.int32) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Each token's bytes, laid at its offset."""
        size = self.size[ids]
        at = np.repeat(self.start[ids] - offsets, size) + np.arange(size.sum(dtype=np.int64))
        return self.bytes[at].tobytes()


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    return Pieces(ranks_of(path))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep_offsets: bool = True, decode: bool = False) -> DataFrame:
    """(id, ids array<int>[, offsets array<int>][, bytes]) for every row; offsets are where each token starts in the
    text's UTF-8 bytes (of U+FFFD where they are not UTF-8), bytes what the ids decode to. A null or empty text has no ids. Strings that look like special tokens are ordinary
    text. Repeated rows stay repeated; other columns are not read."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pieces = ranks_of(ranks_path), pieces_of(ranks_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                ids = [np.array(x, np.int32) for x in encode_texts(batch.column(1).to_pylist(), ranks)]
                offsets = [pieces.offsets(x) for x in ids]
                columns, names = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"]
                if keep_offsets:
                    columns.append(pa.array(offsets, pa.list_(pa.int32())))
                    names.append("offsets")
                if decode:
                    columns.append(pa.array(map(pieces.decode, ids, offsets), pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if keep_offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType())))
    if decode:
        fields.append(T.StructField("bytes", T.BinaryType()))
    return docs.select(id_col, valid(text_col)).mapInArrow(run, T.StructType(fields))


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, bytes): the bytes that the ids stand for; null ids count as none, an unknown id fails. With stored
    ``offsets`` use ``decode_range``, which gives any stretch of a text's bytes without decoding what stands before."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(ranks_path)
        for batch in batches:
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decode_ids(ids.to_pylist(), ranks), pa.binary())], [id_col, ids_col, "bytes"])

    schema = T.StructType([encoded.schema[id_col], encoded.schema[ids_col], T.StructField("bytes", T.BinaryType())])
    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def decode_range(encoded: DataFrame, ranks_path: str, start: int, end: int, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes): bytes ``start`` to ``end`` (exclusive) of each text, from those tokens alone whose offsets lie there.
    ``encoded`` has ids and offsets; null ids count as none, and what lies beyond a text is empty."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(ranks_path)
        for batch in batches:
            found = []
            for ids, offsets in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, offsets = np.array(ids or (), np.int32), np.array(offsets or (), np.int32)
                a = max(int(np.searchsorted(offsets, start, side="right")) - 1, 0)
                b = int(np.searchsorted(offsets, end))
                part = ids[a:b]
                first = int(offsets[a]) if len(part) else 0
                found.append(pieces.decode(part, offsets[a:b] - first)[start - first : max(end - first, 0)] if len(part) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, "ids", "offsets").mapInArrow(run, T.StructType([encoded.schema[id_col], T.StructField("bytes", T.BinaryType())]))
