"""Exact vector search with filters, rank fusion, and policies over decisions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.functions import similarity as S
from loomgraph.runtime import materialize, prepare

METRICS = {"cosine": S.cosine, "inner_product": S.dot, "l2": lambda x, y: 1 / (1 + S.euclidean(x, y)), "l1": lambda x, y: 1 / (1 + S.manhattan(x, y))}


def metadata_filter(conditions: list[tuple[str, str, object]]) -> Column:
    """All of (field, operator, value); a missing field satisfies none, "ne" included."""
    made = {
        "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
        "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v), "contains": lambda c, v: c.contains(v),
    }
    keep = F.lit(True)
    for field, operator, value in conditions:
        keep &= F.coalesce(made[operator](F.col(field), value), F.lit(False))
    return keep


#: Rows and queries that meet in one group of a search, at most, and the rows that are compared with one query at a time.
ROW_BLOCK, QUERY_BLOCK, STRIP = 16_384, 4_096, 1_024
#: Components whose squares neither overflow nor vanish; vectors with others are compared by ``METRICS`` one by one.
TINY, HUGE = 1e-90, 1e90


def _plain_knn(rows: DataFrame, asked: DataFrame, metric: str) -> DataFrame:
    """(query_id, _n, _x, score) of all pairs, by the columns of ``METRICS``: for the few vectors that are not plain."""
    pairs = rows.crossJoin(F.broadcast(asked))
    return pairs.select("query_id", "_n", "_x", METRICS[metric](F.col("_v"), F.col("_q")).alias("score"))


def _exact(metric: str, some: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of a few vectors, with sums from left to right as in ``METRICS``: equal vectors get equal scores."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    if metric == "l2":
        return 1 / (1 + np.sqrt(total((some - q) * (some - q))))
    if metric == "l1":
        return 1 / (1 + total(np.abs(some - q)))
    dots = total(some * q)
    if metric == "inner_product":
        return dots
    length = np.sqrt(total(some * some)) * np.sqrt(total((q * q)[None, :]))
    return np.divide(dots, length, out=np.zeros(len(some)), where=length > 0)


def _rough(metric: str, v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(losses of each query with each row, how far off they may be): a smaller loss is a better score."""
    if metric == "l1":
        loss, ones = np.empty((len(q), len(v))), np.ones(v.shape[1])
        for at in range(0, len(v), STRIP):
            strip = v[at : at + STRIP]
            buffer = np.empty_like(strip)
            for i in range(len(q)):
                np.subtract(strip, q[i], out=buffer)
                np.abs(buffer, out=buffer)
                loss[i, at : at + STRIP] = buffer @ ones
        return loss, 1e-12 * (np.abs(v).sum(axis=1).max() + np.abs(q).sum(axis=1))
    squares, mine = (v * v).sum(axis=1), (q * q).sum(axis=1)
    if metric == "l2":
        loss = np.sqrt(np.maximum(squares[None, :] + mine[:, None] - 2 * (q @ v.T), 0))
        # an error of e in a square is one of at most sqrt(e) in its root
        return loss, 1e-6 * np.sqrt(squares.max() + mine)
    if metric == "inner_product":
        return -(q @ v.T), 1e-12 * np.sqrt(squares.max()) * np.sqrt(mine)
    one = lambda x, n: x / np.where(n > 0, np.sqrt(n), 1.0)[:, None]
    return -(one(q, mine) @ one(v, squares).T), np.full(len(q), 1e-12)


def _best_of_block(metric: str, k: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The k best rows of a block for each of its queries: products of matrices leave a few candidates, which are scored
    exactly."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_x", "ascending")], null_placement="at_start"))
    matrix = lambda c: np.asarray(c.combine_chunks().flatten(), dtype=np.float64).reshape(len(c), -1)
    out_q, out_x, out_s = [], [], []
    if len(rows) and len(asked):
        v, q = matrix(rows["_v"]), matrix(asked["_q"])
        step = max(1, (1 << 20) // len(rows))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            loss, off = _rough(metric, v, some)
            last = min(k, len(v)) - 1
            bound = np.partition(loss, last, axis=1)[:, last]
            bound = bound + 2 * off + 1e-14 * (1 + np.abs(bound))
            for i in range(len(some)):
                near = np.flatnonzero(loss[i] <= bound[i])
                score = _exact(metric, v[near], some[i])
                order = np.argsort(-score, kind="stable")[:k]
                out_q.append(np.full(len(order), at + i)), out_x.append(near[order]), out_s.append(score[order])
    pick = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    x, q = rows["_x"].take(pa.array(pick(out_x))), asked.take(pa.array(pick(out_q)))
    return pa.table({"query_id": q["query_id"], "_n": q["_n"], "_x": x, "score": pa.array(pick(out_s), pa.float64())})


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for every row of ``queries`` the k best rows of those that pass ``where``, ties to the
    smaller id; null vectors take no part, and a query may find itself. Exact: rows are dealt into blocks, every query
    goes to each of them, and a block gives the k best it has for each query. A block's candidates come from products of
    matrices with a margin for their error; their scores are those of ``METRICS``. Work is rows x queries."""
    spark = prepare(vectors.sparkSession)
    numbers = lambda c: F.col(c).cast("array<double>")
    rows = (vectors if where is None else vectors.where(where)).where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("_x"), numbers(vector_col).alias("_v"))
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), numbers(vector_col).alias("_q")).withColumn("_n", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")
    dim = asked.groupBy(F.size("_q").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).agg(F.max("dim")).first()[0] or 0
    fits = lambda e: e.isNotNull() & ((e == 0) | ((F.abs(e) > TINY) & (F.abs(e) < HUGE)))
    plain = lambda c: (F.size(c) == dim) & F.forall(c, fits)
    n, odd = rows.agg(F.count("*"), F.count(F.when(~plain("_v"), 1))).first()
    m, odd_asked = asked.agg(F.count("*"), F.count(F.when(~plain("_q"), 1))).first()
    row_blocks = max(1, -(-n // ROW_BLOCK), min(-(-n // STRIP), 2 * spark.sparkContext.defaultParallelism))
    query_blocks = max(1, -(-m // QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.where(plain("_v")).select("_x", "_v", F.pmod(F.xxhash64("_x"), F.lit(row_blocks)).cast("int").alias("_r"), every(query_blocks).alias("_b"))
    right = asked.where(plain("_q")).select("query_id", "_n", "_q", every(row_blocks).alias("_r"), F.pmod(F.xxhash64("_n"), F.lit(query_blocks)).cast("int").alias("_b"))
    left, right = (df.repartition(row_blocks * query_blocks, "_r", "_b").groupBy("_r", "_b") for df in (left, right))
    schema = StructType([StructField(c, df.schema[c].dataType) for c, df in (("query_id", asked), ("_n", asked), ("_x", rows))] + [StructField("score", DoubleType())])

    def block(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return _best_of_block(metric, k, rows, asked)

    best = left.cogroup(right).applyInArrow(block, schema)
    if odd:
        best = best.unionByName(_plain_knn(rows.where(~plain("_v")), asked, metric))
    if odd_asked:
        best = best.unionByName(_plain_knn(rows.where(plain("_v")), asked.where(~plain("_q")), metric))
    rank = F.row_number().over(W.partitionBy("_n").orderBy(F.desc("score"), "_x"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("_x").alias(id_col), "score", "rank")


def reciprocal_rank_fusion(rankings: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """(keys, fused): the sum of 1 / (k + rank) over all rankings; keys are the row's id, or the query's and the row's."""
    every = rankings[0].select(*keys, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(*keys, "rank"))
    return every.groupBy(*keys).agg(F.sum(1 / (k + F.col("rank"))).alias("fused"))


def weighted_fusion(rankings: list[tuple[float, DataFrame]], keys: list[str]) -> DataFrame:
    """(keys, fused): the sum of weight times score over all rankings."""
    every = None
    for weight, r in rankings:
        one = r.select(*keys, (F.col("score") * weight).alias("_s"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*keys).agg(F.sum("_s").alias("fused"))


#: Fixed values of ``rank_and_merge``: the weight of what memory finds, what each related item of a graph node adds and the most
#: they add together, the factor for each time a node is found again, the characters that tell contents apart, and the
#: share of the similarity in the new order.
MEMORY_WEIGHT, RELATED_STEP, RELATED_MOST, AGAIN, CONTENT_KEY, SIMILARITY_SHARE = 0.3, 0.01, 0.2, 1.2, 100, 0.3


def rank_and_merge(results: DataFrame, k: int, alpha: float = 0.5, least: float = 0.0) -> DataFrame:
    """(query, origin, id, content, score, rank): the ``k`` best of what vectors, a graph and memory found for each query.

    ``results`` holds (query, origin, id, content, score, related, similarity), origin one of vector, graph and memory. Scores
    of one query and origin are brought to 0 to 1 (left as they are if all are equal), then weighted: vectors by 1 - alpha,
    memory by MEMORY_WEIGHT, a graph by alpha, and RELATED_STEP more for each related item, up to RELATED_MOST. Graph
    rows with one id are one result: the best score, times AGAIN for each further one. All others with the same first
    CONTENT_KEY characters are one: the best. Where ``similarity`` (of the query and the content) is not null it makes up
    SIMILARITY_SHARE of the final score. Results below ``least`` go; ties go to the smaller origin, id, content.

    A null query is one of its own; a null score counts as 0, null content as empty, null related as none; other origins are left out.
    Only what one query found meets in a task, so give each origin's best few of a query, as ``knn`` does."""
    mine = W.partitionBy("query", "origin")
    rows = results.where(F.col("origin").isin("vector", "graph", "memory")).select("query", "origin", "id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("_s"), F.coalesce("related", F.lit(0)).alias("_r"), "similarity")
    low, high = F.min("_s").over(mine), F.max("_s").over(mine)
    rows = rows.withColumn("_s", F.when(high > low, (F.col("_s") - low) / (high - low)).otherwise(F.col("_s")))
    graph = F.col("_s") * alpha + F.least(F.lit(RELATED_MOST), F.col("_r") * RELATED_STEP)
    rows = rows.withColumn("_s", F.when(F.col("origin") == "vector", F.col("_s") * (1 - alpha)).when(F.col("origin") == "memory", F.col("_s") * MEMORY_WEIGHT).otherwise(graph))
    node = (F.col("origin") == "graph") & F.col("id").isNotNull()
    rows = rows.withColumn("_node", F.when(node, F.col("id"))).withColumn("_key", F.when(~node, F.left("content", F.lit(CONTENT_KEY))))
    best = F.min(F.struct(-F.col("_s"), "origin", "id", "content", "similarity"))
    one = rows.groupBy("query", "_node", "_key").agg(best.alias("_b"), F.max("_s").alias("_s"), F.count("*").alias("_n")).select("query", "_b.*", (F.col("_s") * F.when(F.col("_node").isNull(), 1.0).otherwise(F.pow(F.lit(AGAIN), F.col("_n") - 1))).alias("score"))
    score = F.coalesce(F.col("score") * (1 - SIMILARITY_SHARE) + F.col("similarity") * SIMILARITY_SHARE, F.col("score"))
    kept = one.select("query", "origin", "id", "content", score.alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "origin", "id", "content"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_pool(df: DataFrame, keys: list[str], vector_col: str = "embedding", how: str = "mean") -> DataFrame:
    """(keys, pos, value): the mean or maximum of the vectors of a key by component."""
    parts = df.select(*keys, F.posexplode(vector_col).alias("pos", "_x"))
    return parts.groupBy(*keys, "pos").agg((F.avg("_x") if how == "mean" else F.max("_x").cast("double")).alias("value"))


def attention_pool(df: DataFrame, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """(keys, pos, value): the mean of the vectors of a key, each weighted by the softmax of its inner product with their
    plain mean."""
    rows = df.where(F.col(vector_col).isNotNull()).select(*keys, F.col(vector_col).cast("array<double>").alias("_v")).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    parts = rows.select(*keys, "_row", F.posexplode("_v").alias("pos", "_x"))
    mean = parts.groupBy(*keys, "pos").agg(F.avg("_x").alias("_mean"))
    scores = parts.join(mean, [*keys, "pos"]).groupBy(*keys, "_row").agg(F.sum(F.col("_x") * F.col("_mean")).alias("_s"))
    top = scores.groupBy(*keys).agg(F.max("_s").alias("_top"))
    weight = scores.join(top, keys).select("_row", F.exp(F.col("_s") - F.col("_top")).alias("_w"))
    return parts.join(weight, "_row").groupBy(*keys, "pos").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("value"))


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the largest version of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))).where("_k = 1").drop("_k")


def policy_violations(decisions: DataFrame, rules: dict[str, object]) -> DataFrame:
    """``decisions`` with ``violations``: the rules (min_x, max_x, required_x, allowed_x) that they break; a missing
    value breaks every rule but max_."""
    found = []
    for name, value in rules.items():
        kind, field = name.split("_", 1)
        c = F.col(field)
        broken = {"min": lambda c, v: c.isNull() | (c < v), "max": lambda c, v: c > v, "required": lambda c, v: c.isNull(), "allowed": lambda c, v: c.isNull() | ~c.isin(*v)}[kind](c, value)
        found.append(F.when(broken, F.lit(name)))
    return decisions.withColumn("violations", F.array_compact(F.array(*found)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, fields): added, removed and modified rows with the fields that differ, null-safe."""
    values = [c for c in before.columns if c != key]
    old = before.select(F.col(key), F.struct(*values).alias("_old"))
    new = after.select(F.col(key), F.struct(*values).alias("_new"))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in values]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("modified")
    out = old.join(new, key, "full_outer").select(key, change.alias("change"), F.when(change == "modified", differing).otherwise(F.array().cast("array<string>")).alias("fields"))
    return out.where((F.col("change") != "modified") | (F.size("fields") > 0))
