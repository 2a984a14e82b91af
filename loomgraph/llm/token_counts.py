"""Token counts by prefix dynamic programming over a sentencepiece BPE vocabulary.

For every prefix of a text the table holds the exact number of tokens the library would give for that
prefix, so "how many tokens has the first n characters" and "the longest prefix within a budget" are
look-ups, not re-encodings.

The recurrence: among the vocabulary pieces that end at position i there is exactly one that can be the last
token of the encoding of the prefix of length i, namely the piece t whose pairing with the last token of the
prefix i - len(t) survives merging unchanged. So count[i] = count[i - len(t)] + 1. No piece of the vocabulary
continues past a word start, so the recurrence restarts at each word, and words repeat: their prefix steps
are cached.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import materialize, prepare, valid

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LONGEST_CACHED = 64
#: Distinct words whose steps one worker keeps; beyond it the cache starts anew (results do not change).
CACHED_WORDS = 1_000_000
NEVER = float("-inf")


class Memo(dict):
    """A dict that fills its gaps by ``make`` and starts anew once it holds ``most`` entries."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= LONGEST_CACHED:
            self[key] = value
        return value


class PrefixCounter:
    """Steps (count at prefix i minus count at prefix i - 1) for words of one vocabulary."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        by_end: dict[str, list[int]] = {}
        for piece in self.score:
            if len(piece) > 2:
                by_end.setdefault(piece[-3:], []).append(len(piece))
        self.by_end = {e: tuple(sorted(set(n))) for e, n in by_end.items()}
        #: lengths of the pieces that can end a text whose last characters, three at most, are these
        self.ends = Memo(self.end_lengths, CACHED_WORDS)
        #: for every piece: which last tokens before it hold (None: it is the first)
        self.after: dict[str, dict[str | None, bool]] = {p: {} for p in self.score}
        self.by_word = Memo(self.word_steps, CACHED_WORDS)
        self.history = Memo(self.merges, CACHED_WORDS)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece continues past a word start; words can't be counted apart")

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """Merging by the best score, leftmost first among equals: (score, first part, last part) after every merge."""
        parts, score, found = list(text), self.score, []
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                return found
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found.append((best, parts[0], parts[-1]))

    def pair_holds(self, left: str, right: str) -> bool:
        """Whether two tokens side by side stay as they are: their own merges take turns by score (the left one first
        among equals), and the parts that touch must never be the best to merge."""
        score, own_left, own_right = self.score, self.history[left], self.history[right]
        i, j, a, b = 0, 0, left[-1], right[0]
        while True:
            s_left = own_left[i][0] if i < len(own_left) else NEVER
            s_right = own_right[j][0] if j < len(own_right) else NEVER
            across = score.get(a + b, NEVER)
            if across > s_left and across >= s_right and across > NEVER:
                return False
            if s_left == s_right == NEVER:
                return True
            if s_left >= s_right:
                a, i = own_left[i][2], i + 1
            else:
                b, j = own_right[j][1], j + 1

    def is_token(self, piece: str) -> bool:
        found = self.history[piece]
        return len(piece) == 1 or bool(found) and found[-1][1] == piece

    def end_lengths(self, end: str) -> tuple[int, ...]:
        short = tuple(n for n in (1, 2) if n <= len(end) and end[-n:] in self.score)
        return short + (self.by_end.get(end, ()) if len(end) == 3 else ())

    def word_steps(self, word: str) -> bytes:
        """Steps of a word's prefixes, two bytes each."""
        after, ends = self.after, self.ends
        count, last = [0], [None]
        for i in range(1, len(word) + 1):
            for n in ends[word[i - 3 : i] if i > 3 else word[:i]]:
                known = after.get(t := word[i - n : i]) if n <= i else None
                if known is not None:
                    p = last[i - n]
                    ok = known.get(p)
                    if ok is None:
                        ok = known[p] = self.is_token(t) and (p is None or self.pair_holds(p, t))
                    if ok:
                        count.append(count[i - n] + 1)
                        last.append(t)
                        break
            else:  # byte fallback: nothing merges across it
                count.append(count[-1] + len(word[i - 1].encode()))
                last.append(None)
        return array("h", map(sub, count[1:], count)).tobytes()

    def text_steps(self, text: str) -> np.ndarray:
        """One step for each character of the text; their running sum is the count at every prefix. The word
        start that the library puts before a text is part of the first step."""
        if not text:
            return np.zeros(0, np.int16)
        all_steps = np.frombuffer(b"".join(map(self.by_word.__getitem__, WORDS.findall(SPACE + text.replace(" ", SPACE)))), np.int16)
        first = all_steps[1:].copy()
        first[0] += all_steps[0]
        return first


@lru_cache(maxsize=4)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def token_prefix_steps(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = True, budgets: dict[str, int] | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens[, steps][, a column for each of ``budgets``]) for every row of ``docs``.

    ``steps`` is array<short>: its running sum at i is the exact token count of the first i characters (see
    ``tokens_at`` and ``chars_within``). ``budgets`` names long columns: how many characters the longest prefix of at
    most so many tokens has. A null text counts as empty: 0 bytes, 0 tokens, no steps, 0 characters; bytes that are not
    UTF-8 count as U+FFFD. Repeated
    rows stay repeated; other columns are not read.
    """
    prepare(docs.sparkSession)
    budgets = budgets or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = counter(model_path)
        for batch in batches:
            n_bytes, n_tokens, all_steps, within = [], [], [], {name: [] for name in budgets}
            for text in batch.column(1).to_pylist():
                steps = prefix.text_steps(text or "")
                counts = steps.cumsum(dtype=np.int64)
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                for name, budget in budgets.items():
                    # the count may sink from prefix to prefix, so the last one within the budget is looked for
                    within[name].append(len(counts) if not len(counts) or n_tokens[-1] <= budget else len(counts) - int((counts[::-1] <= budget).argmax()) if counts.min() <= budget else 0)
                if keep_steps:
                    all_steps.append(steps)
            out = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            out += [pa.array(all_steps, pa.list_(pa.int16()))][:keep_steps] + [pa.array(x, pa.int64()) for x in within.values()]
            yield pa.RecordBatch.from_arrays(out, fields.names)

    fields = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    if keep_steps:
        fields = fields.add("steps", T.ArrayType(T.ShortType()))
    for name in budgets:
        fields = fields.add(name, T.LongType())
    return docs.select(id_col, valid(text_col)).mapInArrow(run, fields)


def tokens_at(steps: Column, n_chars: Column | int) -> Column:
    """Exact token count of the first ``n_chars`` characters, from the stored steps."""
    n = n_chars if isinstance(n_chars, Column) else F.lit(n_chars)
    return F.aggregate(F.slice(steps, 1, F.least(n, F.size(steps))), F.lit(0).cast("long"), lambda a, x: a + x)


def chars_within(steps: Column, budget: int) -> Column:
    """Length of the longest prefix whose token count is at most ``budget``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        n, i = a["n"] + x, a["i"] + 1
        return F.struct(n.alias("n"), i.alias("i"), F.when(n <= budget, i).otherwise(a["best"]).alias("best"))

    return F.aggregate(steps, zero, step, lambda a: a["best"])


def stored_steps(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (id, n_bytes, n_tokens, steps, chars_within_limit) of all rows: any later question about a
    prefix or a budget reads it (``tokens_at``, ``chars_within``) and encodes nothing."""
    return materialize(token_prefix_steps(docs, model_path, id_col, text_col, budgets={"chars_within_limit": limit}), "steps")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, chars_within_limit) of every whole text, all from its counts at every prefix:
    the last one, and the longest prefix that keeps to the limit. The steps of all prefixes are written beside them
    (``stored_steps``), and the columns read from there."""
    counts = stored_steps(docs, model_path, limit, id_col, text_col)
    return counts.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within_limit")
