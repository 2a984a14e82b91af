"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes deep with the counts of the byte that follows.
The code length of a byte is read from the longest context that the tree holds; where the byte was not seen
there, an escape is paid (method C: of n + d chances, d distinct followers go to the escape) and the next shorter
context is asked, down to the uniform code. The statistics are frozen after training, so the cost of a byte
depends on the ``ORDER`` bytes before it alone, and a whole text is scored by table look-ups: costs of the
contexts of order 0 to 2 are dense tables or pages of rows, those of order 3 a hash table.

Training counts are taken on Spark from a bounded sample (``docs_per_language``); the tables are bounded with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import prepare, valid

ORDER = 3
UNDETERMINED = "und"
#: Default of the sample: so many whole documents of each language.
#: Parts of a language that are ranked side by side for the sample.
SAMPLE_PARTS = 64
DOCS_PER_LANGUAGE = 250
#: Texts are counted and scored in pieces of so many bytes, each with the context before it.
PIECE = 1 << 16
#: Hash slots that are tried for a context of order 3.
PROBES = 24


def _grams(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, the (k + 1)-byte strings packed into integers, counts) for each order k and piece of the text."""
    for a in range(0, len(text), PIECE):
        for k in range(ORDER + 1):
            raw = np.frombuffer(text[max(0, a - k) : a + PIECE], np.uint8).astype(np.uint32)
            packed = raw[: len(raw) - k]
            for i in range(1, k + 1):
                packed = packed << 8 | raw[i : len(raw) - k + i]
            if len(packed):
                yield k, *np.unique(packed, return_counts=True)


def training_counts(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, k, gram, n): counts of byte strings, gathered by partial sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, gram, n in _grams((text or "").encode()):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    rows = labelled.select(lang_col, text_col).mapInArrow(run, "lang string, k int, gram bigint, n bigint")
    return rows.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


class Rows:
    """Row numbers of 3-byte strings, -1 for others: a page of 256 numbers for each prefix of two bytes that occurs."""

    def __init__(self, strings: np.ndarray):
        prefixes = np.unique(strings >> np.uint32(8))
        self.page = np.zeros(65536, np.uint32)  # page 0 is empty
        self.page[prefixes] = np.arange(1, len(prefixes) + 1, dtype=np.uint32)
        self.rows = np.full((len(prefixes) + 1) * 256, -1, np.int32)
        self.rows[self._place(strings)] = np.arange(len(strings), dtype=np.int32)

    def _place(self, strings: np.ndarray) -> np.ndarray:
        return self.page[strings >> np.uint32(8)] << np.uint32(8) | strings & np.uint32(0xFF)

    def __getitem__(self, strings: np.ndarray) -> np.ndarray:
        return self.rows[self._place(strings)]


@dataclass
class PpmTables:
    """Code lengths in bits of every language, side by side in the last axis."""

    languages: list[str]
    cost0: np.ndarray  # [256, L]
    cost1: np.ndarray  # [65536, L]: order 1 or below
    escape2: np.ndarray  # [65536, L]
    row2: Rows  # row of cost2
    cost2: np.ndarray  # [rows, L]
    escape3: np.ndarray  # [rows of 3-byte contexts, L]
    context3: Rows  # row of escape3
    key3: np.ndarray  # hash table of 4-byte strings
    slot3: np.ndarray  # row of cost3
    cost3: np.ndarray

    def costs(self, raw: np.ndarray) -> np.ndarray:
        """[n, L]: bits of each byte, each by the longest context within the text."""
        n = len(raw)
        out = np.empty((n, len(self.languages)), np.float32)
        b = raw.astype(np.uint32)
        out[:1] = self.cost0[b[:1]]
        out[1:2] = self.cost1[(b[:1] << 8 | b[1:2])] if n > 1 else 0
        if n > 2:
            two = b[:-2] << 8 | b[1:-1]
            at = self.row2[two << 8 | b[2:]]
            out[2:] = self.cost2[at]
            lost = np.flatnonzero(at < 0)
            out[2 + lost] = self.escape2[two[lost]] + self.cost1[b[1 + lost] << 8 | b[2 + lost]]
        if n > 3:
            three = b[:-3] << 16 | b[1:-2] << 8 | b[2:-1]
            context = self.context3[three]
            known = np.flatnonzero(context >= 0)
            key = three[known] << 8 | b[3 + known]
            row = self.look_up(key)
            out[3 + known] = np.where((row >= 0)[:, None], self.cost3[row], out[3 + known] + self.escape3[context[known]])
        return out

    def look_up(self, key: np.ndarray) -> np.ndarray:
        size = np.uint32(len(self.key3) - 1)
        at = (key * np.uint32(2654435761)) >> np.uint32(7) & size
        row = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for _ in range(PROBES):
            slot = self.slot3[at]
            hit = (self.key3[at] == key[left]) & (slot >= 0)
            row[left[hit]] = slot[hit]
            go = ~hit & (slot >= 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + np.uint32(1)) & size
        return row


def build_tables(languages: list[str], lang: np.ndarray, k: np.ndarray, gram: np.ndarray, n: np.ndarray) -> PpmTables:
    """The tables from counts (one entry for each language, order and byte string; lang: index into languages)."""
    L = len(languages)
    gram = gram.astype(np.uint32)

    def dense(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings of the order, their counts [rows, L], and the contexts' sums and distinct followers."""
        of = k == order
        strings, at = np.unique(gram[of], return_inverse=True)
        counts = np.zeros((len(strings), L), np.float32)
        counts[at, lang[of]] = n[of]
        contexts, context_at = np.unique(strings >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), L), np.float32), np.zeros((len(contexts), L), np.float32)
        np.add.at(total, context_at, counts)
        np.add.at(kinds, context_at, (counts > 0).astype(np.float32))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0).astype(np.float32)
            seen = np.log2((total + kinds)[context_at]) - np.log2(counts)
        return strings, np.where(counts > 0, seen, np.inf).astype(np.float32), contexts, escape

    strings, seen, _, escape = dense(0)
    cost0 = np.tile(escape[0] + 8.0 if len(escape) else np.float32(8), (256, 1)).astype(np.float32)
    cost0[strings] = np.where(np.isfinite(seen), seen, escape[0] + 8.0)

    strings, seen, contexts, escape = dense(1)
    escape1 = np.zeros((256, L), np.float32)
    escape1[contexts] = escape
    cost1 = (escape1[:, None, :] + cost0[None, :, :]).reshape(65536, L)
    cost1[strings] = np.where(np.isfinite(seen), seen, cost1[strings])

    strings, seen, contexts, escape = dense(2)
    escape2 = np.zeros((65536, L), np.float32)
    escape2[contexts] = escape
    cost2 = np.where(np.isfinite(seen), seen, escape2[strings >> np.uint32(8)] + cost1[strings & np.uint32(0xFFFF)])
    row2 = Rows(strings)

    strings3, seen, contexts3, escape3 = dense(3)
    tail = strings3 & np.uint32(0xFFFFFF)
    at = row2[tail]
    below = np.where((at >= 0)[:, None], cost2[at], escape2[tail >> np.uint32(8)] + cost1[tail & np.uint32(0xFFFF)])
    cost3 = np.where(np.isfinite(seen), seen, escape3[np.searchsorted(contexts3, strings3 >> np.uint32(8))] + below)
    size = 1 << max(12, int(np.ceil(np.log2(4 * len(strings3) + 1))))
    while True:
        key3, slot3 = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        left = np.arange(len(strings3), dtype=np.int32)
        at = ((strings3 * np.uint32(2654435761)) >> np.uint32(7) & np.uint32(size - 1)).astype(np.int64)
        for _ in range(PROBES):
            free = slot3[at] < 0
            slot3[at[free]] = left[free]  # of several, the last stays
            placed = slot3[at] == left
            key3[at[placed]] = strings3[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & (size - 1)
        if not len(left):
            break
        size *= 2
    return PpmTables(languages, cost0, cost1, escape2, row2, cost2.astype(np.float32), escape3, Rows(contexts3), key3, slot3, cost3.astype(np.float32))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> PpmTables | None:
    """Frozen statistics from a bounded sample of the labelled rows: of each language the ``docs_per_language``
    rows whose id has the smallest hash, with their whole texts (equal rows count once). Rows without a label or text are left out; without
    any row there are no tables (None).

    What comes to the driver are the counts of distinct byte strings of at most 4 bytes in that sample."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(lang_col).alias("_lang"), valid(text_col).alias("_text"))
    # hashes alone are ranked, first in parts of a language, then in what the parts leave; then the texts are fetched
    picked = rows.select("_h", "_id", "_th", "_lang").withColumn("_part", F.pmod("_th", F.lit(SAMPLE_PARTS)))
    for keys in (["_lang", "_part"], ["_lang"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("_h", "_id", "_th"))
        picked = picked.withColumn("_rank", rank).where(F.col("_rank") <= docs_per_language)
    picked = picked.select(F.col("_h").alias("_h2"), F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), F.col("_lang").alias("_lang2")).distinct()
    same = [F.col(c).eqNullSafe(F.col(c + "2")) for c in ("_h", "_id", "_th", "_lang")]
    # docs_per_language rows a language, each of some 40 bytes: far less than the tables that are made of them
    sample = rows.join(F.broadcast(picked), same, "left_semi").dropDuplicates(["_h", "_id", "_th", "_lang"])
    counts = training_counts(sample, "_lang", "_text").toArrow()
    if not counts.num_rows:
        return None
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names))
    index = {name: i for i, name in enumerate(languages)}
    lang = np.array([index[x] for x in names], np.int64)
    return build_tables(languages, lang, *(counts.column(c).to_numpy() for c in ("k", "gram", "n")))


def score_texts(texts: list[str | None], tables: PpmTables) -> list[tuple[str, float, float]]:
    """(language, score, bits per byte) of each text; see ``identify``."""
    out = []
    for text in texts:
        if text is None or not any(map(str.isalpha, text)):
            out.append((UNDETERMINED, 0.0, 0.0))
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        bits = np.zeros(len(tables.languages))
        for a in range(0, len(raw), PIECE):
            before = min(a, ORDER)
            bits += tables.costs(raw[a - before : a + PIECE])[before:].sum(axis=0, dtype=np.float64)
        best = int(bits.argmin())
        rest = np.exp2(-np.minimum(bits - bits[best], 1000)).sum()
        out.append((tables.languages[best], float(1 / rest), float(bits[best] / len(raw))))
    return out


def identify(docs: DataFrame, tables: PpmTables | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, [keep ...,] lang_pred, score, bits_per_byte) for every row, from the whole text alone.

    lang_pred: the language whose code for the text is shortest (the first by name among equals), or "und"
    for a null text or one without a letter; then score and bits are 0. score: the share of that language when
    each one weighs 2^-bits. Without tables every row is "und". Repeated rows stay repeated. Bytes that are not UTF-8
    count, and are kept, as U+FFFD.
    """
    prepare(docs.sparkSession)
    keep = list(keep or ())
    columns = [id_col, *[c for c in keep if c not in (id_col,)]]
    result = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    schema = T.StructType([*[docs.schema[c] for c in columns], *result])
    if tables is None:
        return docs.select(*columns, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value
        for batch in batches:
            found = score_texts(batch.column(width).to_pylist(), ready)
            lang, score, bits = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], schema.names)

    readable = [valid(c).alias(c) if isinstance(docs.schema[c].dataType, T.StringType) else c for c in columns]
    return docs.select(*readable, valid(text_col).alias("_scored_text")).mapInArrow(run, schema)
