"""Alignment of labels: a cosine join of TF-IDF vectors over character n-grams, and suggestions that blend it with label
similarity.

The join is exact. Grams have one order, from rare to common; a label's prefix holds its grams as long as what is left of
its unit vector, from that gram on, still has length ``least`` or more. The first gram that two labels share stands in both
prefixes if their cosine reaches ``least``, since beyond it nothing is shared before it and the rest is too short. So
prefixes meet, and only labels that meet are measured. A gram of many prefixes is cut into blocks that meet one another.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import materialize, prepare

#: Lengths of grams within a word and the space on either side of it; weights of label and cosine.
GRAMS = (2, 3, 4)
LABEL_WEIGHT, COSINE_WEIGHT = 0.4, 0.6
#: Prefixes of one gram that one task compares with as many others.
BLOCK = 2000


def plain_label(c: Column) -> Column:
    """Small letters, with underscores, hyphens and runs of white space as one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-\s]+", " "))


def char_grams(label: Column) -> Column:
    """array<string>: the grams of each word with a space on either side, as often as they stand there."""
    of_word = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.filter(F.split(label, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, lambda w: F.concat(*[of_word(w, n) for n in GRAMS])))


def label_vectors(labels: DataFrame) -> DataFrame:
    """(label, gram, df, weight): unit TF-IDF vectors of the distinct ``label``s (plain ones); weight is the count of a gram
    times ln((1 + labels) / (1 + labels with the gram)) + 1, over the vector's length. Labels without a gram have no rows."""
    labels = labels.select("label").where("label IS NOT NULL AND label <> ''").distinct()
    counts = materialize(labels.select("label", F.explode(char_grams(F.col("label"))).alias("gram")).groupBy("label", "gram").agg(F.count("*").alias("tf")), "grams")
    n = counts.select("label").distinct().count()
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    raw = counts.join(df, "gram").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("label")))
    return raw.select("label", "gram", "df", (F.col("w") / length).alias("weight"))


def _prefixes(vectors: DataFrame, least: float) -> DataFrame:
    left = F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("label").orderBy("df", "gram").rowsBetween(W.currentRow, W.unboundedFollowing))
    return vectors.withColumn("_left", left).where(F.col("_left") >= least * least - 1e-9).select("label", "gram")


def cosine_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine): the labels of ``left`` and ``right`` (vectors of one ``label_vectors``) whose cosine is ``least`` (over 0)
    or more; none is lost, equal labels meet too."""
    one, other = materialize(_prefixes(left, least), "prefixes"), materialize(_prefixes(right, least), "prefixes")
    sizes = one.groupBy("gram").agg(F.count("*").alias("m")).join(other.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    blocks = sizes.select("gram", F.ceil(F.col("m") / BLOCK).cast("int").alias("_m"), F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"))
    # a gram's block of one side meets every block of the other side, each pair of blocks under a key of its own
    at = lambda own: F.pmod(F.xxhash64("label"), F.col(own)).cast("int")
    spread = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    a = one.join(blocks, "gram").select("gram", F.col("label").alias("a"), at("_m").alias("i"), spread("_n").alias("j"))
    b = other.join(blocks, "gram").select("gram", F.col("label").alias("b"), at("_n").alias("j"), spread("_m").alias("i"))
    met = materialize(a.join(b, ["gram", "i", "j"]).select("a", "b").distinct(), "met")
    x = left.select(F.col("label").alias("a"), "gram", F.col("weight").alias("_x"))
    y = right.select(F.col("label").alias("b"), "gram", F.col("weight").alias("_y"))
    dots = met.join(x, "a").join(y, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))
    return dots.where(F.col("cosine") >= least - 1e-9)


def similar_labels(left: DataFrame, right: DataFrame, label_col: str = "label", least: float = 0.5) -> DataFrame:
    """(a, b, cosine) of the distinct plain labels of two tables, weighted over the labels of both."""
    a, b = (df.select(plain_label(F.col(label_col)).alias("label")).distinct() for df in (left, right))
    vectors = materialize(label_vectors(a.unionByName(b)), "vectors")
    return cosine_join(vectors.join(a, "label", "left_semi"), vectors.join(b, "label", "left_semi"), least)


def _matching(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def suggest_alignments(left: DataFrame, right: DataFrame, id_col: str = "id", label_col: str = "label", threshold: float = 0.65) -> DataFrame:
    """(source, target, label_score, cosine, score): the ids of ``left`` and ``right`` whose labels score ``threshold`` or more:
    0.4 times the label similarity (the larger of matching characters and shared words, to 4 digits) plus 0.6 times the
    TF-IDF cosine, to 4 digits.

    The label part is 0.4 at most, so only labels with a cosine of (threshold - 0.4) / 0.6 are measured; the threshold must be
    over 0.4. Rows that share a label are scored once; null and empty labels are aligned with nothing; repeated rows repeat."""
    if not LABEL_WEIGHT < threshold <= 1:
        raise ValueError("the threshold must lie above the weight of the label part")
    prepare(left.sparkSession)
    least = (threshold - LABEL_WEIGHT - 5e-5) / COSINE_WEIGHT
    pairs = similar_labels(left, right, label_col, max(least, 1e-3))
    matching = F.pandas_udf(_matching, T.DoubleType())
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = F.size(F.array_intersect(words("a"), words("b"))) / F.size(F.array_union(words("a"), words("b")))
    scored = pairs.withColumn("label_score", F.round(F.greatest(matching("a", "b"), shared), 4))
    scored = scored.withColumn("score", F.round(LABEL_WEIGHT * F.col("label_score") + COSINE_WEIGHT * F.col("cosine"), 4)).where(F.col("score") >= threshold)
    named = lambda df, end, name: df.select(plain_label(F.col(label_col)).alias(end), F.col(id_col).alias(name))
    found = scored.join(named(left, "a", "source"), "a").join(named(right, "b", "target"), "b")
    return found.select("source", "target", "label_score", F.round("cosine", 6).alias("cosine"), "score")
