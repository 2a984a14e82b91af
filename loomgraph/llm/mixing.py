"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is shuffled by a digest; a document's virtual finish time is the running total of its source's
words divided by the source's target, and up to ``epochs`` passes over a source follow each other. The mix is
the global order by finish time, cut where the total budget is reached.

A source may hold any share of the rows, so running totals are taken in two steps: sums of (source, digest
prefix) buckets, a running total over those sums, then a running total inside each bucket. The global cut is found
in the same way: sums by slices of the finish time, then by slices of the slice that holds the cut, and only
the rows of that last slice are put in order. What comes to the driver is three such cut positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096
#: Digits of the digest that name a bucket: 16^3 buckets for each source.
BUCKET_DIGITS = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Size and shuffle order of every document. _skey sorts by code point with the null source last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(
        F.col(id_col).alias("_id"),
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), source_col)).alias("_skey"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text))).alias("_h"),
        F.md5(text).alias("_th"),
        *[F.struct(*keep).alias("_keep")][: bool(keep)],
    )
    return row.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(_skey, source_size, target) from (_skey, source_size), one row a source.

    The i-th source weighs ``weights[i mod n]``. All sizes are shared out by weight; a target stops at ``epochs``
    times its source's size and the excess is shared by weight among the others. With the sources in order of
    limit over weight, the share of a unit of weight is the largest of (total - limits before) over (weight from
    here on)."""
    size = F.col("source_size")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(W.orderBy("_skey")) - 1, F.lit(len(weights))))
    t = sizes.withColumn("_w", weight).withColumn("_cap", epochs * size)
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_skey")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum(size).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    t = t.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return t.select("_skey", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def _with_cumulative(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    inside = W.partitionBy("_skey", "_b").orderBy("_h", "_id", "_th").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(offsets, ["_skey", "_b"]).withColumn("_cum", F.sum("_size").over(inside) + F.col("_before"))


def _finish(epoch: Column | int) -> Column:
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.when(F.col("target") > 0, (F.col("_cum") + e * F.col("source_size")) / F.col("target")).otherwise(0.0)


def _slice(finish: Column) -> Column:
    return F.least(F.floor(finish * SLICES), F.lit(2 * SLICES)).cast("long")


def _inner(finish: Column) -> Column:
    return F.least(F.floor((finish * SLICES - _slice(finish)) * SLICES), F.lit(SLICES)).cast("long")


def _cut(sums: DataFrame, key: str, budget: int, before: int) -> tuple[int, int] | None:
    """The first key at which the running total passes the budget, and the total before it."""
    run = W.orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    over = sums.withColumn("_run", F.sum("_n").over(run) + before).where(F.col("_run") > budget)
    row = over.orderBy(key).select(key, (F.col("_run") - F.col("_n")).alias("_pre")).first()
    return (row[0], row[1]) if row else None


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, finish) for every row of ``docs``, in the order of finish times; with ``keep``
    (its columns, copies, finish) instead, see ``mix_order``.

    size: words of the whole text (null: 0); taken: words of it that the mix takes, ``copies`` times size with
    copies from 0 to ``epochs``; finish: the virtual finish time of its first copy, the source's words up to it over the
    source's target (0 without a target). Rows without words take 0. The order is that of the digests of id and text (then
    id, then the text's digest), so reruns agree, and rows that are alike in all of these differ in nothing but their
    place. An empty table gives no rows; other columns are not read.
    """
    keep = list(keep or ())
    rows = materialize(_keyed(docs, id_col, text_col, source_col, []), "sized")
    buckets = rows.groupBy("_skey", "_b").agg(F.sum("_size").alias("_n"))
    sources = materialize(source_targets(buckets.groupBy("_skey").agg(F.sum("_n").alias("source_size")), weights, epochs), "targets")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_skey").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(buckets.withColumn("_before", before).drop("_n").join(sources, "_skey"), "offsets")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0

    placed = materialize(_with_cumulative(rows, offsets), "placed")
    copies = placed.where("_size > 0").withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_f", _finish(F.col("_e")))
    order = ["_f", "_skey", "_h", "_id", "_th", "_e"]
    cut = _cut(copies.groupBy(_slice(F.col("_f")).alias("_s")).agg(F.sum("_size").alias("_n")), "_s", budget, 0)
    inner = last = None
    if cut:
        there = copies.where(_slice(F.col("_f")) == cut[0])
        inner = _cut(there.groupBy(_inner(F.col("_f")).alias("_s")).agg(F.sum("_size").alias("_n")), "_s", budget, cut[1])
        run = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        within = there.where(_inner(F.col("_f")) == inner[0]).withColumn("_run", F.sum("_size").over(run) + inner[1])
        last = within.where(F.col("_run") <= budget).orderBy(*[F.desc(c) for c in order]).select(*order).first()

    def taken(epoch: int) -> Column:
        f = _finish(epoch)
        if not cut:
            return F.lit(True)
        at_cut = F.lit(False)
        if last:  # the copy's place in the order is not after that of the last one taken
            here = dict(zip(order, (f, F.col("_skey"), F.col("_h"), F.col("_id"), F.col("_th"), F.lit(epoch)), strict=True))
            at_cut = F.lit(True)
            for c in reversed(order):
                value = F.lit(last[c])
                equal = here[c].isNull() if last[c] is None else here[c].eqNullSafe(value)
                less = F.lit(False) if last[c] is None else here[c].isNull() | (here[c] < value)
                at_cut = less | (equal & at_cut)
        s, i = _slice(f), _inner(f)
        return (s < cut[0]) | ((s == cut[0]) & ((i < inner[0]) | ((i == inner[0]) & at_cut)))

    if keep:
        placed = _with_cumulative(_keyed(docs, id_col, text_col, source_col, keep), offsets)
    n = sum((taken(e).cast("long") for e in range(1, epochs)), taken(0).cast("long"))
    out = placed.withColumn("_copies", F.when(F.col("_size") > 0, n).otherwise(0).cast("long"))
    if keep:
        return out.select("_keep.*", F.col("_copies").alias("copies"), _finish(0).alias("finish"), F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(0.0).alias("round"))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"), _finish(0).alias("finish")).orderBy("finish", id_col)


def mix_order(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """The mix itself: the columns of ``keep`` of every copy that it takes, range-sorted by finish time over all sources
    and cut at the budget. ``options`` are those of ``mix_sources``; rows without words are in no mix."""
    mixed = mix_sources(docs, keep=keep, **options).where("copies > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copies.withColumn("_at", F.col("finish") + F.col("_copy") * F.col("round")).orderBy("_at", *[c for c in keep if c == options.get("id_col", "doc_id")]).select(keep)
