"""Chunks that keep together what belongs together: entities, related mentions, and sentences on one subject.

Sentences, places of mentions and distances are columns; only arrays of places go to Python, where one pass packs sentences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.mentions import all_spans, match_spans

#: White space after the end of a sentence.
GAP = r"(?<=[.!?])\s+"


def _borders_kept(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, within: int) -> np.ndarray:
    """Which gaps [starts, ends) lie inside a span [first, last), or between two spans less than ``within`` apart."""
    first, last = np.sort(first), np.sort(last)
    begun, over = np.searchsorted(first, ends, "left"), np.searchsorted(last, starts, "right")
    kept = begun > over
    if within and len(first):
        far = np.int64(1) << 60
        before = np.where(over > 0, last[np.maximum(over - 1, 0)], -far)
        after_at = np.searchsorted(first, ends, "left")
        after = np.where(after_at < len(first), first[np.minimum(after_at, len(first) - 1)], far)
        kept |= after - before < within
    return kept


def _pack(starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, forced: np.ndarray, length: int, size: int) -> list[dict]:
    """Chunks of a text: cut at each forced gap, and at the last gap that is not kept before ``size`` is passed."""
    out, begin, cut = [], 0, None  # cut: the last gap of the open chunk at which it may end
    for k in range(len(starts) + 1):
        end = length if k == len(starts) else starts[k]
        if cut is not None and end - begin > size:
            out.append({"start": int(begin), "end": int(starts[cut])})
            begin, cut = ends[cut], None
        if k == len(starts):
            out.append({"start": int(begin), "end": int(length)})
        elif forced[k]:
            out.append({"start": int(begin), "end": int(starts[k])})
            begin, cut = ends[k], None
        elif not kept[k]:
            cut = k
    return out


def _far_ones(far: np.ndarray, gaps: int, percentile: float) -> np.ndarray:
    """Which distances reach the percentile of all of them and are not 0; without distances none."""
    if not len(far):
        return np.zeros(gaps, dtype=bool)
    limit = np.sort(far)[max(int(np.ceil(percentile * len(far) - 1e-9)) - 1, 0)]
    return (far >= limit) & (far > 0)


def _packer(size: int, within: int, percentile: float):
    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def packed(starts: pd.Series, ends: pd.Series, first: pd.Series, last: pd.Series, far: pd.Series, length: pd.Series) -> pd.Series:
        def one(s, e, a, b, f, n):
            s, e, a, b = (np.asarray(x, dtype=np.int64) for x in (s, e, a, b))
            return _pack(s, e, _borders_kept(s, e, a, b, within), _far_ones(np.asarray(f, dtype=float), len(s), percentile), n, size) if n else []

        return pd.Series([one(*row) for row in zip(starts, ends, first, last, far, length, strict=True)], dtype=object)

    # called non-deterministic so that Spark infers no filter from its explosion, which would pack every text twice
    return packed.asNondeterministic()


#: Types of the arrays that a way of chunking does without.
NO_SPANS, NO_DISTANCES = "array<struct<start:bigint,end:bigint>>", "array<double>"


def _chunks(df: DataFrame, keys: list[str], text: str, spans: Column, size: int, within: int = 0, far: Column | None = None, percentile: float = 1.0) -> DataFrame:
    """``spans`` is an expression over ``df``, ``far`` over its texts' sets of words (_sets)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keys, body.alias("_text"), match_spans(body, GAP).alias("_all"), spans.alias("_spans"))
    # white space after the last sentence is no gap and belongs to no chunk
    rows = rows.withColumn("_gaps", F.when(F.col("_text").rlike(GAP + r"\z"), F.slice("_all", F.lit(1), F.size("_all") - 1)).otherwise(F.col("_all")))
    length = F.length(F.regexp_replace("_text", GAP + r"\z", "")).cast("long")
    places = [F.col(f"{c}.{f}") for c in ("_gaps", "_spans") for f in ("start", "end")]
    if far is None:
        far = F.array().cast(NO_DISTANCES)
    else:
        rows = rows.withColumn("_sets", _word_sets(F.col("_text")))
    rows = rows.withColumn("_cuts", _packer(size, within, percentile)(*places, far, length))
    rows = rows.select(*keys, "_text", "_spans", F.posexplode("_cuts").alias("chunk", "_c"))
    held = F.size(F.filter("_spans", lambda s: (s["start"] >= F.col("_c.start")) & (s["start"] < F.col("_c.end"))))
    return rows.select(*keys, "chunk", F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), F.col("_text").substr(F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start")).alias("chunk_text"), held.alias("held"))


def chunk_by_entities(df: DataFrame, keys: list[str], text: str, size: int = 1000, patterns: dict[str, str] | None = None) -> DataFrame:
    """(keys, chunk, start, end, chunk_text, held): sentences put together up to ``size`` characters, never cut inside a
    mention of ``patterns`` (MENTIONS by default); held counts the mentions that start in the chunk. A chunk is longer
    than ``size`` where a sentence is, or where mentions leave no place to cut. Places are in code points, end exclusive; the white space between
    chunks is in none. Null and empty texts have no chunks, repeated rows each their own; other columns are not read."""
    return _chunks(df, keys, text, all_spans(F.col(text), patterns), size)


def chunk_by_relations(df: DataFrame, keys: list[str], text: str, size: int = 1000, within: int = 100, patterns: dict[str, str] | None = None) -> DataFrame:
    """The same, never cut between two mentions that ``co_occurrences`` relates: less than ``within`` characters apart."""
    return _chunks(df, keys, text, all_spans(F.col(text), patterns), size, within)


def _word_sets(text: Column) -> Column:
    """The distinct words of each sentence, in lower case."""
    sentences = F.split(text, GAP)
    return F.transform(sentences, lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def chunk_by_meaning(df: DataFrame, keys: list[str], text: str, size: int = 1000, percentile: float = 0.9) -> DataFrame:
    """(keys, chunk, start, end, chunk_text, held): sentences put together up to ``size`` characters, and cut wherever two
    neighbours are at least as far from each other as the ``percentile`` of all neighbours of that text, and not alike.

    The distance is 1 - cosine of the sentences' vectors with a 1 for each word, exact and without a model; one without
    words is 1 away from all. The percentile is the value at place ceil(percentile x n) of the n distances in order.
    held is 0. Other cases as in ``chunk_by_entities``."""
    def apart(a: Column, b: Column) -> Column:
        norm = F.sqrt(F.size(a).cast("double") * F.size(b))
        return F.when(norm == 0, 1.0).otherwise(F.round(1 - F.size(F.array_intersect(a, b)) / norm, 9))  # equal ones compare as equal

    sets, many = F.col("_sets"), F.size("_gaps")
    far = F.zip_with(F.slice(sets, F.lit(1), many), F.slice(sets, F.lit(2), many), apart)
    return _chunks(df, keys, text, F.array().cast(NO_SPANS), size, far=far, percentile=percentile)
