"""Mentions with offsets, pairs of mentions near each other, and what pronouns refer to.

Spark's regular expressions give matches without their places. A text split at the same pattern gives what stands between the
matches, so running sums over the lengths of both give every start and end, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Edges of a word: no letter, digit or underscore beyond.
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Labels of mentions, in the order that settles ties, with their patterns and confidence. Repeated groups are
#: possessive (++), as Java's matcher takes stack for every round of one that may give back, and long lists of names are many
#: rounds. An organisation is therefore a chain of capitalised words first, of which TRIMMED keeps what ends in a suffix.
SUFFIXES = "Inc|Corp|LLC|Ltd|Company"
MENTIONS = {
    "ORG": rf"{LEFT}[A-Z][a-zA-Z]++{RIGHT}(?:\s++[A-Z][a-zA-Z]++{RIGHT})++\.?",
    "PERSON": rf"{LEFT}[A-Z][a-z]++{RIGHT}(?:\s++(?!{SUFFIXES})[A-Z][a-z]++{RIGHT})++",
    "GPE": rf"{LEFT}[A-Z][a-z]+\s*(?:City|State|Country|Nation){RIGHT}",
    "DATE": rf"{LEFT}(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{4}}){RIGHT}",
}
TRIMMED = {"ORG": rf"(?s)^.*\s(?:{SUFFIXES})(?:\.|{RIGHT})"}
CONFIDENCE = 0.7
#: Pronouns with the labels that they can stand for.
PERSON, THING, GROUP = ("PERSON",), ("ORG", "GPE", "DATE"), ("ORG", "GPE", "PERSON")
PRONOUNS = {"he": PERSON, "him": PERSON, "his": PERSON, "she": PERSON, "her": PERSON, "it": THING, "its": THING, "they": GROUP, "them": GROUP, "their": GROUP}
PRONOUN = rf"(?i){LEFT}(?:{'|'.join(PRONOUNS)}){RIGHT}"
#: Elements of an array that are summed up by one growing array; longer ones are cut into blocks of so many.
BLOCK = 512


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(values: Column, start: Column) -> Column:
    """Running sums of a short array, from ``start`` on, each with its own element in it."""
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    step = lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["sums"], a["at"] + v).alias("sums"))
    return F.aggregate(values, zero, step, lambda a: a["sums"])


def running_sums(values: Column) -> Column:
    """array<long>: the running sums of an array of whole numbers. Blocks keep the arrays that grow short."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, v: a + v)

    def joined(blocks: Column) -> Column:
        ends = _sums(F.transform(blocks, total), F.lit(0))
        return F.flatten(_once(ends, lambda e: F.transform(blocks, lambda block, k: _sums(block, F.when(k == 0, 0).otherwise(F.get(e, k - 1))))))

    return _once(_once(values, cut), joined)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, mention>> of the matches of a pattern, left to right; none for a null text."""
    text = F.coalesce(text, F.lit(""))
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    widths = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda gap, match: F.coalesce(gap, F.lit(0)).cast("long") + F.coalesce(match, F.lit(0)))
    spans = _once(running_sums(widths), lambda ends: _once(found, lambda f: F.transform(f, lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("end"), m.alias("mention")))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,mention:string>>"))


def all_spans(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """array<struct<label, start, end, mention>> of the matches of all patterns (MENTIONS), label by label."""
    def labelled(label: str, pattern: str) -> Column:
        spans = match_spans(text, pattern)
        if label in TRIMMED:
            cut = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.regexp_extract(s["mention"], TRIMMED[label], 0).alias("mention")))
            spans = F.transform(F.filter(cut, lambda s: s["mention"] != ""), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["mention"])).alias("end"), s["mention"].alias("mention")))
        return F.transform(spans, lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["mention"].alias("mention")))

    return F.concat(*[labelled(label, pattern) for label, pattern in (patterns or MENTIONS).items()])


def find_mentions(df: DataFrame, keys: list[str], text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(keys, label, start, end, mention, confidence): one row for each match of each pattern, in code points, end
    exclusive. Matches of one label do not overlap, those of two may. Null and empty texts have none; repeated rows repeat
    theirs; columns other than ``keys`` and ``text`` are not read."""
    rows = df.select(*keys, F.explode(all_spans(F.col(text), patterns)).alias("_m"))
    return rows.select(*keys, "_m.label", "_m.start", "_m.end", "_m.mention", F.lit(CONFIDENCE).alias("confidence"))


def co_occurrences(mentions: DataFrame, keys: list[str], within: int = 100) -> DataFrame:
    """(keys, subject, subject_start, object, object_start, distance, predicate, confidence): pairs of mentions of one
    text, the earlier one (by start, end, label) first, if its end and the other's start lie less than ``within`` characters apart.

    A band join: ends and starts meet in bins of ``within`` characters, each end also in the bins beside its own, so a text
    with many mentions meets itself only where they are near. Null keys meet nothing. Rows that repeat count each."""
    order = lambda side: F.struct(F.col(f"{side}.start"), F.col(f"{side}.end"), F.col(f"{side}.label"), F.col(f"{side}.mention"), F.col(f"{side}._n"))
    # repeated rows are told apart by a number of their own
    numbered = mentions.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "start", "end", "label", "mention").orderBy(F.lit(0))))
    bin_of = lambda c: F.floor(F.col(c) / within)
    first = numbered.withColumn("_bin", F.explode(F.array(*[bin_of("end") + k for k in (-1, 0, 1)]))).alias("a")
    second = numbered.withColumn("_bin", bin_of("start")).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_bin")]
    distance = F.abs(F.col("a.end") - F.col("b.start"))
    # mentions are many times the texts that their size is guessed from: no side is broadcast
    pairs = first.join(second.hint("merge"), [*same, order("a") < order("b"), distance < within])
    return pairs.select(*[F.col(f"a.{k}") for k in keys], F.col("a.mention").alias("subject"), F.col("a.start").alias("subject_start"), F.col("b.mention").alias("object"), F.col("b.start").alias("object_start"), distance.alias("distance"), F.lit("related_to").alias("predicate"), F.lit(0.6).alias("confidence"))


def resolve_pronouns(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, start, end, pronoun, antecedent, antecedent_label, antecedent_start): every pronoun with the mention it stands for.

    That is the one that ends last before the pronoun starts, of those with a label that the pronoun can stand for, else of all
    labels; of two that end together the label that comes first in MENTIONS. A pronoun before all mentions has none (null).
    ``keys`` name a text: rows that share them are read as one, so they must be unique. One ordered pass over a text's
    mentions serves all its pronouns."""
    rank = F.array_position(F.array(*map(F.lit, MENTIONS)), F.col("label"))
    both = find_mentions(df, keys, text, {**MENTIONS, "PRONOUN": PRONOUN})
    spoken = F.col("label") == "PRONOUN"
    # a mention counts from where it ends, a pronoun from where it starts; at one place the pronoun comes first
    both = both.withColumn("_at", F.when(spoken, F.col("start")).otherwise(F.col("end"))).withColumn("_rank", F.when(spoken, -100).otherwise(-rank))
    before = W.partitionBy(*keys).orderBy("_at", (~spoken).cast("int"), "_rank", "start").rowsBetween(W.unboundedPreceding, -1)
    known = F.struct("mention", "label", "start")
    latest = lambda labels: F.last(F.when(F.col("label").isin(*labels), known), ignorenulls=True).over(before)
    kinds = {labels: f"_{k}" for k, labels in enumerate((PERSON, THING, GROUP, tuple(MENTIONS)))}
    seen = both.withColumns({name: latest(labels) for labels, name in kinds.items()}).where(spoken)
    word, fit = F.lower("mention"), F.lit(None)
    for labels in (PERSON, THING, GROUP):
        fit = F.when(word.isin(*[p for p, can in PRONOUNS.items() if can == labels]), F.col(kinds[labels])).otherwise(fit)
    found = seen.withColumn("_found", F.coalesce(fit, F.col(kinds[tuple(MENTIONS)])))
    return found.select(*keys, "start", "end", F.col("mention").alias("pronoun"), F.col("_found.mention").alias("antecedent"), F.col("_found.label").alias("antecedent_label"), F.col("_found.start").alias("antecedent_start"))


def coreference_chains(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, entity, label, mentions, pronouns, first_start): what one text says of one thing: its mentions (alike but for
    case) and the pronouns that stand for them. Things mentioned once, without a pronoun, are chains of one. Null keys are
    a key like any other, and repeated rows as in ``resolve_pronouns``."""
    named = find_mentions(df, keys, text).select(*keys, F.lower("mention").alias("entity"), "label", F.lit(1).alias("m"), F.lit(0).alias("p"), "start")
    spoken = resolve_pronouns(df, keys, text).where("antecedent IS NOT NULL")
    spoken = spoken.select(*keys, F.lower("antecedent").alias("entity"), F.col("antecedent_label").alias("label"), F.lit(0).alias("m"), F.lit(1).alias("p"), F.lit(None).cast("long").alias("start"))
    return named.unionByName(spoken).groupBy(*keys, "entity", "label").agg(F.sum("m").alias("mentions"), F.sum("p").alias("pronouns"), F.min("start").alias("first_start"))
