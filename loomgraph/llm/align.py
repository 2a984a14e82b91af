"""Alignment of the tokens of two tokenizers over the same bytes.

Tokens of both are byte intervals that tile a text. B's intervals are a static index: sorted starts and ends. Each A token
bisects them for the B tokens that it overlaps. A gap between two A tokens that no B token spans, so that the lists on
both sides share none, ends a group; a group holds the tokens between two such gaps.

Neither tokenizer joins what stands before a space that follows a sign to what comes after it (``Tokenizers`` makes sure of it), so
texts are cut there into chunks, chunks repeat, and each distinct one is encoded and aligned once while a task remembers it.

One pass over the texts writes each document's numbers and its distinct id pairs; the rest are joins and sums over that
table. How many documents hold a pair linked is a count over it. Every pair then meets its count again: the pairs with
at least a ``FREQUENT``-th of all (pair, document) rows, which are no more than ``FREQUENT`` by that very definition, are
broadcast; the others, none of which has many rows, meet their counts in a shuffled join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import materialize, prepare

#: Pairs whose counts are broadcast: those with one row in so many of all (pair, document) rows.
FREQUENT = 1 << 20
#: Distinct chunks that a task remembers; beyond it the memory starts anew (results do not change).
REMEMBERED = 250_000
#: A group with more links than this is laid out by distinct ids.
WIDE = 4096
#: Cuts only before a space that follows a sign: white space that starts otherwise stays with what stands before it.
CHUNKS = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S++)*+(?:[^\S ]\s*+\Z)?|\s++")
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers over chunks, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(a_path) as f:
            model = json.load(f)
        letters = byte_alphabet()
        special = {t["content"] for t in model["added_tokens"]}
        vocabulary = {k: i for k, i in model["model"]["vocab"].items() if k not in special}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merged != sorted(merged) or model["normalizer"] or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("A's ids are not in the order of its merges, or it changes texts first")
        pieces = {i: bytes(map(letters.__getitem__, k)) for k, i in vocabulary.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={p: i for i, p in pieces.items()}, special_tokens={})
        self.a_ids = max(pieces) + 1
        self.a_size = np.array([len(pieces.get(i, b"")) for i in range(self.a_ids)], np.int64)

        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_ids = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.b_ids)]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("a piece of B continues past a word start; chunks can't be encoded apart")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.lone = self.b.encode("a ")[len(self.b.encode("a")) :]

    def encode_a(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each chunk). Chunks that end in white space must not meet the next one's space."""
        out, held = [], []
        for chunk in chunks:
            held.append(chunk)
            if chunk[-1].isspace():
                out += self.a.encode_ordinary("".join(held))
                held = []
        out += self.a.encode_ordinary("".join(held))
        ids = np.array(out, np.int64)
        ends = np.searchsorted(np.cumsum(self.a_size[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; the library puts the first space before a text itself, unless the text is empty."""
        return [ids if len(c) > 1 else self.lone for c, ids in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True)]


@lru_cache(maxsize=2)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every A token the stretch [low, high) of B tokens that it overlaps, by bisection of B's starts and ends."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    return np.searchsorted(b_end, a_end - a_size, side="right"), np.searchsorted(b_end - b_size, a_end, side="left")


def group_ends(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A tokens and how many B tokens stand before the end of each group."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.append(high[:-1] <= low[1:], True)
    return np.flatnonzero(last) + 1, high[last]


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            more = np.zeros(max(2 * len(self.data), self.n + len(values)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the stretches that start at ``start`` and have ``size`` places."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Chunks:
    """Distinct chunks with their tokens' numbers, groups and linked id pairs (code: A id times B's vocabulary plus B id)."""

    def __init__(self, tokenizers: Tokenizers, keep_groups: bool = False):
        self.tokenizers, self.keep_groups = tokenizers, keep_groups
        self.pairs_of_vocabulary = tokenizers.a_ids * tokenizers.b_ids
        # tokens as they stand in the listing: within a group, at the end of its A tokens, at its end
        self.a_text, self.a_last = (np.array([f"{i}{sign}" for i in range(tokenizers.a_ids)], object) for sign in ",|")
        self.b_text, self.b_last = (np.array([f"{i}{sign}" for i in range(tokenizers.b_ids)], object) for sign in ",;")
        self.start_anew()

    def start_anew(self) -> None:
        self.number: dict[str, int] = {}
        self.listing: list[str] = []
        self.groups: list[list[dict]] = []
        #: n_a, n_b, n_groups, n_links (-1 for chunks whose bytes differ)
        self.numbers = [Grown(np.int64) for _ in range(4)]
        self.first, self.size = Grown(np.int64), Grown(np.int64)  # where the chunk's pairs stand
        self.code, self.times = Grown(np.int64), Grown(np.int64)

    def numbers_of(self, chunks: list[str]) -> np.ndarray:
        """The number of every chunk; new ones are encoded and aligned together."""
        if len(self.number) > REMEMBERED:
            self.start_anew()
        new = list(set(chunks).difference(self.number))
        if new:
            self.align(new)
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def align(self, chunks: list[str]) -> None:
        tok = self.tokenizers
        data = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        a, a_n = tok.encode_a(chunks, sizes)
        b_lists = tok.encode_b(chunks)
        good = np.ones(len(chunks), bool)
        if b"".join(map(tok.b_bytes.__getitem__, chain.from_iterable(b_lists))) != b"".join(data):
            good = np.array([b"".join(map(tok.b_bytes.__getitem__, ids)) == d for ids, d in zip(b_lists, data, strict=True)])
            a, a_n = a[np.repeat(good, a_n)], a_n * good
            b_lists = [ids if ok else [] for ids, ok in zip(b_lists, good.tolist(), strict=True)]
        b_n = np.fromiter(map(len, b_lists), np.int64, len(b_lists))
        b = np.fromiter(chain.from_iterable(b_lists), np.int64, int(b_n.sum()))
        a_end, b_end = group_ends(*overlaps(tok.a_size[a], tok.b_size[b]))
        a_in, b_in = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        chunk = np.searchsorted(np.cumsum(a_n), a_end)  # chunks end where groups end
        links = a_in * b_in

        wide = links > WIDE
        few = np.where(wide, 0, links)
        group = np.repeat(np.arange(len(links)), few)
        place = np.arange(len(group)) - np.repeat(np.cumsum(few) - few, few)
        codes = [a[(a_end - a_in)[group] + place // b_in[group]] * tok.b_ids + b[(b_end - b_in)[group] + place % b_in[group]]]
        owners, times = [chunk[group]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            (x, x_n), (y, y_n) = (np.unique(ids[e - n : e], return_counts=True) for ids, e, n in ((a, int(a_end[g]), int(a_in[g])), (b, int(b_end[g]), int(b_in[g]))))
            codes.append((x[:, None] * tok.b_ids + y).ravel())
            times.append((x_n[:, None] * y_n).ravel())
            owners.append(np.full(len(codes[-1]), chunk[g]))
        key = np.concatenate(owners) * self.pairs_of_vocabulary + np.concatenate(codes)
        key, n = sums_by_key(key, np.concatenate(times))
        owner, code = np.divmod(key, self.pairs_of_vocabulary)
        found = [a_n, b_n, np.bincount(chunk, minlength=len(chunks)), np.where(good, sums_at(chunk, links, len(chunks)), -1)]
        size = np.bincount(owner, minlength=len(chunks))
        self.first.extend(self.code.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.code.extend(code)
        self.times.extend(n)
        for column, values in zip(self.numbers, found, strict=True):
            column.extend(values)
        self.write_down(chunks, a, b, a_end, b_end, chunk)

    def write_down(self, chunks: list[str], a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, chunk: np.ndarray) -> None:
        """Number the chunks, and list their groups as text (and as they are)."""
        a_in, b_in = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        a_part, b_part = self.a_text[a], self.b_text[b]
        a_part[a_end - 1], b_part[b_end - 1] = self.a_last[a[a_end - 1]], self.b_last[b[b_end - 1]]
        before = np.cumsum(a_in + b_in) - a_in - b_in  # of both, the A tokens of a group first
        listed = np.empty(len(a) + len(b), object)
        listed[spans(before, a_in)], listed[spans(before + a_in, b_in)] = a_part, b_part
        parts, n = listed.tolist(), sums_at(chunk, a_in + b_in, len(chunks))
        cuts = [0, *np.cumsum(n).tolist()]
        self.number.update(zip(chunks, range(len(self.listing), len(self.listing) + len(chunks)), strict=True))
        self.listing += ["".join(parts[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        if self.keep_groups:
            kept: list[list[dict]] = [[] for _ in chunks]
            for c, x, i, y, j in zip(chunk.tolist(), a_end.tolist(), a_in.tolist(), b_end.tolist(), b_in.tolist(), strict=True):
                kept[c].append({"a": a[x - i : x].tolist(), "b": b[y - j : y].tolist()})
            self.groups += kept

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk numbers of all texts, text of each, which texts have tokens). What is not UTF-8 has none."""
        cut: list[list[str]] = []
        for raw in texts:
            try:
                cut.append(CHUNKS.findall(" " + raw.decode()) if raw else [])
            except UnicodeDecodeError:
                cut.append([])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        number = self.numbers_of(list(chain.from_iterable(cut)))
        text = np.repeat(np.arange(len(cut)), n)
        bad = np.zeros(len(cut), bool)
        bad[text[self.numbers[3].data[number] < 0]] = True
        keep = ~bad[text]
        return number[keep], text[keep], (n > 0) & ~bad

    def pairs(self, number: np.ndarray, text: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, times) of the pairs of chunks that texts hold so many ``times``, each pair once a text."""
        size = self.size.data[number]
        at = spans(self.first.data[number], size)
        key, n = sums_by_key(np.repeat(text, size) * self.pairs_of_vocabulary + self.code.data[at], np.repeat(times, size) * self.times.data[at])
        return *np.divmod(key, self.pairs_of_vocabulary), n

    def distinct(self, number: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, text, times) of the distinct chunks of each text."""
        most = self.size.n + 1
        key, n = sums_by_key(text * most + number, np.ones(len(number), np.int64))
        text, number = np.divmod(key, most)
        return number, text, n


def sums_by_key(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(key):
        return key.astype(np.int64), value.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(value[order], first)


def sums_at(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers at places 0 to n - 1."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, value)
    return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, pairs, times, groups_sha256[, groups]) for every row of ``docs``: the distinct
    linked id pairs (A id times B's vocabulary plus B id) in order, and how many links have each. ``row`` is unique
    once the table is written."""
    prepare(docs.sparkSession)
    listed = [("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("groups_sha256", pa.string())]
    listed += [("groups", pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))][:keep_groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(tokenizers_of(a_path, b_path), keep_groups)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            number, text, full = chunks.texts(batch.column(1).to_pylist())
            cuts = np.searchsorted(text, np.arange(n + 1))
            found = []
            for column in chunks.numbers:
                running = np.append(0, np.cumsum(column.data[number]))
                found.append(running[cuts[1:]] - running[cuts[:-1]])
            listing, order, edges = chunks.listing, number.tolist(), cuts.tolist()
            digests = [hashlib.sha256("".join([listing[i] for i in order[a:b]])[:-1].encode()).hexdigest() if ok else "" for a, b, ok in zip(edges, edges[1:], full.tolist(), strict=False)]
            some, code, times = chunks.pairs(*chunks.distinct(number, text))
            at = pa.array(np.searchsorted(some, np.arange(n + 1)).astype(np.int32))
            out = [pa.array(np.arange(row, row + n)), batch.column(0), *map(pa.array, found), *(pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (code, times)), pa.array(digests, pa.string())]
            if keep_groups:
                out.append(pa.array([list(chain.from_iterable(chunks.groups[i] for i in order[a:b])) for a, b in zip(edges, edges[1:], strict=False)], listed[-1][1]))
            row += n
            yield pa.RecordBatch.from_arrays(out, ["row", id_col, *NUMBERS, *(name for name, _ in listed)])

    fields = T.StructType([T.StructField("row", T.LongType(), False), T.StructField(id_col, docs.schema[id_col].dataType)])
    for name in NUMBERS:
        fields = fields.add(name, T.LongType())
    for name, _ in listed:
        fields = fields.add(name, T._parse_datatype_string({"groups_sha256": "string", "groups": "array<struct<a: array<int>, b: array<int>>>"}.get(name, "array<bigint>")))
    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, fields)


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """(pair, a_id, b_id, n, best): in how many rows of ``aligned`` an A and a B token with these ids share a group, and
    whether no other pair with that A id stands in more."""
    pairs = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    pairs = materialize(pairs.withColumn("a_id", F.expr(f"pair div {b_ids}").cast("int")), "paircounts")
    most = pairs.groupBy("a_id").agg(F.max("n").alias("most"))  # an A id has at most b_ids pairs
    return pairs.join(most, "a_id").select("pair", "a_id", (F.col("pair") % b_ids).cast("int").alias("b_id"), "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, share: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of every row with links: how many have an id pair that is the best of its A id, and
    the sum of the counts of all their pairs."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= -(-total // share)  # so at most ``share`` pairs
    held = counts.select("pair", "n", "best")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    frequent = F.broadcast(held.where(often))
    one = links.join(frequent, "pair").groupBy("row").agg(*sums)
    other = links.join(frequent.select("pair"), "pair", "left_anti").join(held.where(~often), "pair").groupBy("row").agg(*sums)
    return one.unionByName(other).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, share: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for every row of ``docs``; with
    ``keep_groups`` also the groups themselves, each the A ids and the B ids that it holds.

    A reads a space and the text, B the text, which puts the space there itself. ``n_links`` counts pairs of an A and a B token of one
    group, ``n_best`` those whose id pair stands in as many documents as any of that A id, ``count_sum`` sums these
    documents over the links. Null and empty texts, those that are not UTF-8 and those whose tokens do not give back
    their bytes have no tokens: zeros, an empty digest, no groups. Each row is a document of its own, repeated rows
    and null ids too. Other columns are not read, so their names cannot clash.
    """
    aligned = materialize(aligned_texts(docs, a_path, b_path, id_col, text_col, keep_groups), "aligned")
    counts = materialize(pair_counts(aligned, tokenizers_of(a_path, b_path).b_ids), "counts")
    out = aligned.join(score_links(aligned, counts, share), "row", "left")
    return out.select(id_col, *NUMBERS, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256", *["groups"][:keep_groups])
