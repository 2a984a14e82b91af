"""Periodic runs of words, found by a suffix automaton.

The automaton over a text's words has one state for each set of equal substrings' end positions. Going from the longest
states to the shortest, the ordered end positions of a state's children in the suffix-link tree are merged, the smaller set
into the larger. Two positions that become neighbours at a distance no greater than the state's length are the ends of a
square: the word sequence of that distance stands twice, side by side. The state where the last word of a run's end and
that one period before it first meet is as long as the run less one period, so the seeds of one period and start extend
to the whole run by taking the farthest end.

A run has at least six words and four periods, so each five words in a row within it stand at least twice in it. Stretches
in which every five words in a row repeat are cut out first, again and again until nothing changes, and only they get an
automaton; the rest of a text cannot hold a run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import prepare

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A run has at least this many words, and this many periods; each GRAM words in a row of it then stand in it twice.
LEAST_WORDS, LEAST_PERIODS, GRAM = 6, 4, 5


def repeating_stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) of which every ``GRAM`` words in a row stand at least twice within the stretch."""
    open_, done = [(0, len(words))], []
    while open_:
        start, end = open_.pop()
        n = end - start - GRAM + 1
        if end - start < LEAST_WORDS:
            continue
        grams = words[start : start + n].copy()
        for k in range(1, GRAM):
            grams *= np.int64(6364136223846793005)
            grams += words[start + k : start + k + n]
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(n + 2, bool)
        twice[order[1:][same] + 1] = True
        twice[order[:-1][same] + 1] = True
        edges = np.flatnonzero(twice[1:] != twice[:-1])
        if len(edges) == 2 and edges[0] == 0 and edges[1] == n:
            done.append((start, end))
        else:
            open_ += [(start + a, start + b + GRAM - 1) for a, b in edges.reshape(-1, 2).tolist()]
    return sorted(done)


class EndPositions:
    """An ordered set of positions in blocks, so that adding one costs the root of their number at most."""

    __slots__ = ("blocks", "firsts", "size")
    MOST = 512

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def neighbours(self, position: int) -> tuple[int | None, int | None]:
        """The nearest positions before and after one that is not there."""
        at = max(bisect_left(self.firsts, position) - 1, 0)
        block = self.blocks[at]
        i = bisect_left(block, position)
        after = block[i] if i < len(block) else self.firsts[at + 1] if at + 1 < len(self.firsts) else None
        return block[i - 1] if i else None, after

    def add(self, position: int) -> None:
        at = max(bisect_left(self.firsts, position) - 1, 0)
        block = self.blocks[at]
        insort(block, position)
        self.firsts[at] = block[0]
        self.size += 1
        if len(block) > self.MOST:
            half = block[self.MOST // 2 :]
            del block[self.MOST // 2 :]
            self.blocks.insert(at + 1, half)
            self.firsts.insert(at + 1, half[0])

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, end position or -1 for copied states) of every state; state 0 is the root."""
    width = max(words, default=0) + 1
    length, link, end, step = [0], [-1], [-1], {}
    outgoing: list[list[int]] = [[]]
    last = 0
    for at, word in enumerate(words):
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        outgoing.append([])
        p = last
        while p >= 0 and p * width + word not in step:
            step[p * width + word] = state
            outgoing[p].append(word)
            p = link[p]
        if p >= 0:
            q = step[p * width + word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                outgoing.append(outgoing[q][:])
                for w in outgoing[q]:
                    step[copy * width + w] = step[q * width + w]
                while p >= 0 and step.get(p * width + word) == q:
                    step[p * width + word] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return length, link, end


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """The farthest end (exclusive) of what repeats with (period, start), from the seeds of an automaton over ``words``."""
    length, link, end = suffix_automaton(words)
    held: list[EndPositions | None] = [EndPositions(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        # all states below this one in the link tree are longer, so its positions are complete; give them to its parent
        own, parent = held[state], link[state]
        held[state] = None
        if parent <= 0:
            continue
        larger = held[parent]
        if larger is None:
            held[parent] = own
            continue
        if own.size > larger.size:
            own, larger = larger, own
        most = length[parent]
        for position in own:  # neighbours in the other set only: pairs within one set met in a longer state
            before, after = larger.neighbours(position)
            for a, b in ((before, position), (position, after)):
                if a is not None and b is not None and b - a <= most:
                    key = (b - a, a + 1 - most)
                    if found.get(key, 0) <= b:
                        found[key] = b + 1
        for position in own:
            larger.add(position)
        held[parent] = larger
    return found


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. What repeats with a multiple of a smaller period, within
    the run of that period, is no run of its own."""
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (period, start), stop in sorted(squares(words).items()):
        if stop - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            known = by_start.setdefault(start, [])
            if not any(period % q == 0 and stop <= e for q, e in known):
                known.append((period, stop))
    return sorted((start, stop - start, period) for start, known in by_start.items() for period, stop in known)


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period."""
    found = []
    if len(words) < LEAST_WORDS:
        return found
    for start, end in repeating_stretches(np.fromiter(map(hash, words), np.int64, len(words))):
        number: dict[bytes, int] = {}
        found += [(start + s, n, q) for s, n, q in runs_of([number.setdefault(w, len(number)) for w in words[start:end]])]
    return found


def repeated_words(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words stand in a run after its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:n]) > 0


def plant_repeats(words: list[bytes], ident: int | None) -> list[bytes]:
    """The words of a document with the contract's repetition: one in ten, by the checksum of its id, goes on with some of its words over
    and over from some word on. A null id has none."""
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, keep: bool = False) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]) for
    every row of ``docs``; with ``keep`` also the runs (start, length, period) themselves and the text without the words that a
    run repeats.

    Words are what no space, tab, line break, form feed or vertical tab parts. A run is a stretch of words with smallest
    period q, at least six words and four periods long, that cannot grow either way. The longest run (ties: smallest start,
    then period) gives the four numbers; without a run they are null. A null or empty text has no words; bytes that
    are not UTF-8 are words like any other. Repeated rows stay repeated; other columns are not read. ``planted`` puts the repetitions of
    ``plant_repeats`` into the words first.
    """
    prepare(docs.sparkSession)
    fields = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for field in T._parse_datatype_string(SCHEMA + (", runs array<struct<start: long, length: long, period: long>>, collapsed binary" if keep else "")):
        fields = fields.add(field)

    def one(ident, text: bytes | None) -> list:
        words = WORD.findall(text or b"")
        if planted:
            words = plant_repeats(words, ident)
        runs = find_runs(words)
        listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        gone = repeated_words(runs, len(words)) if runs else ()
        collapsed = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if runs else words)
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        exponent = 1000 * longest[1] // longest[2] if runs else None
        out = [len(words), len(runs), *longest, exponent, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
        return out + ([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed] if keep else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 6 + [pa.string()] * 2
                if keep:
                    types += [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], fields.names)

    return docs.select(id_col, F.col(text_col).cast("binary").alias(text_col)).mapInArrow(run, fields)
