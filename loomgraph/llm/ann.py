"""Approximate nearest neighbours by cosine with an adaptive dimension scan.

Vectors are scaled to length one, rotated by a random orthogonal matrix and put into lists around centroids. A
query probes its nearest lists; how many, the fitted sample tells: so many that they hold the wanted share of the
neighbours within the sample. The nearest of them are searched first, and the distance of the k-th neighbour found
there is the query's threshold for the others. Inside lists the dimensions are read in blocks of columns: after k of D
of them the partial squared distance, times D / k, estimates the whole one, and a candidate is abandoned when
the estimate exceeds the threshold by more than the error that the rotation makes plausible
(1 + epsilon / sqrt(k), squared). Survivors are measured on the original vectors in double precision.

Small lists share a group and crowded ones, such as thousands of copies of one vector, are cut into several: a task
holds about ``GROUP_ROWS`` vectors and ``QUERY_ROWS`` queries. A query's vector goes to a group once, with the numbers of
the lists that it probes there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import materialize, prepare

COLUMN_BLOCK = 16
EPSILON = 2.1
#: Vectors, and queries, that one group holds about, and the queries that are compared at a time.
GROUP_ROWS, QUERY_ROWS, TILE = 16_384, 16_384, 64
#: A query first probes lists of so many vectors, and at least so many in all.
FIRST_PROBED, LEAST_PROBED = 256, 1024
#: Queries of the sample by which the number of probes is chosen.
TRIALS = 256


@dataclass
class Index:
    rotation: np.ndarray  # [D, D]
    centroids: np.ndarray  # [lists, D], rotated, of length one
    probes: int  # lists that a query probes


@dataclass
class Deal:
    """How lists are dealt out to groups, by list: rows in it, its (first) group, its groups, parts of their queries."""

    counts: np.ndarray
    base: np.ndarray
    chunks: np.ndarray
    parts: np.ndarray


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None) -> DataFrame:
    """(_id, _v array<double>) of the rows that take part: no null, no non-finite component, not zero, of the
    dimension given."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    if dim is not None:
        kept = kept.where(F.size(v) == dim)
    return kept.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one dimension, without nulls, as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def fit_index(rows: DataFrame, n_rows: int, max_sample: int = 20_000, max_lists: int = 4096, rounds: int = 8, seed: int = 7, k: int = 5, recall: float = 0.95) -> Index | None:
    """Rotation and centroids (spherical k-means) from the ``max_sample`` rows whose id has the smallest hash. The
    number of lists is the square root of the number of rows, at most ``max_lists`` and a tenth of the sample. The number
    of probes is that which finds ``recall`` of the ``k`` nearest in the sample of its first rows."""
    found = rows.orderBy(F.xxhash64("_id"), "_id").select("_v").limit(max_sample).toArrow()
    if not found.num_rows:
        return None
    sample = _unit(_matrix(found.column("_v").combine_chunks()))
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((sample.shape[1], sample.shape[1])))[0]
    sample = sample @ rotation
    n_lists = max(1, min(round(n_rows**0.5), max_lists, len(sample) // 10))
    centroids = sample[random.choice(len(sample), n_lists, replace=False)]
    for _ in range(rounds):
        at = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centroids)
    asked = sample[:TRIALS]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    wanted = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, (sample @ centroids.T).argmax(axis=1)[wanted], axis=1).ravel())
    probes = 1 + int(needed[min(int(recall * len(needed)), len(needed) - 1)]) if len(needed) else 1
    return Index(rotation, centroids, probes)


def deal_lists(counts: np.ndarray, probes: int, n_queries: int) -> Deal:
    """Lists, in the order of their numbers, fill groups of about GROUP_ROWS; a list that alone has more gets groups of
    its own. A list is probed by its share of all probes, by size, and the queries of a group are cut into parts."""
    chunks = np.maximum(1, -(-counts // GROUP_ROWS))
    base, share = np.zeros(len(counts), np.int64), np.minimum(1.0, probes * counts / max(1, counts.sum()))
    parts, group, held, members = np.ones(len(counts), np.int64), 0, 0, []

    def close() -> None:
        parts[members] = max(1, -(-int(n_queries * min(1.0, share[members].sum())) // QUERY_ROWS))

    for i, (n, cut) in enumerate(zip(counts, chunks, strict=True)):
        if members and (cut > 1 or held + n > GROUP_ROWS):
            close()
            group, held, members = group + int(chunks[members[0]]), 0, []
        base[i], held = group, held + n
        members.append(i)
    close()
    return Deal(counts, base, chunks, parts)


def scan(queries: np.ndarray, rows: np.ndarray, probed: np.ndarray, limit: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of the rows that may be among its k nearest (ties with the k-th included): of the rows
    that it has ``probed`` (queries x rows) those within ``limit``, its squared distance; all are rotated and of length
    one."""
    dim, alive, partial, read = rows.shape[1], probed.copy(), np.zeros(probed.shape), 0
    columns = np.flatnonzero(alive.any(axis=0))
    alive, partial = alive[:, columns], partial[:, columns]
    for a in range(0, dim, COLUMN_BLOCK):
        x, q = rows[columns, a : a + COLUMN_BLOCK], queries[:, a : a + COLUMN_BLOCK]
        partial += (x * x).sum(axis=1) + (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T)
        read += x.shape[1]
        margin = (1 + EPSILON / read**0.5) ** 2 if read < dim else 1.0
        alive &= partial * (dim / read) <= (limit * margin + 1e-9)[:, None]
        if read < dim:
            some = alive.any(axis=0)
            if some.mean() < 0.8:  # columns that no query wants any more are left behind
                columns, alive, partial = columns[some], alive[:, some], partial[:, some]
    out = []
    for mine, far in zip(alive, partial, strict=True):
        at = np.flatnonzero(mine)
        if len(at) > k:
            at = at[far[at] <= np.partition(far[at], k - 1)[k - 1] + 1e-9]
        out.append(columns[at])
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", max_sample: int = 20_000) -> DataFrame:
    """(query_id, rank, id, score): of each query the k nearest rows found, by cosine in double precision on the
    original vectors, nearest first, ties to the smaller id; rows with the query's own id are no candidates.

    Vectors that are null, zero, hold a null or non-finite component, or have another dimension than the row of
    the smallest id take no part, on either side. Rows that share an id are separate candidates, and queries that share
    one are each answered. Rows with the query's own id do not count towards the rows that it has to probe, so a query
    gets fewer than k rows only if there are fewer candidates in all.

    ``recall``: the share of neighbours that the probed lists are to hold, by the sample of at most ``max_sample`` rows.
    Vectors without any clusters need most of the lists for 0.95; clustered ones a few.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col, None)
    first = rows.orderBy("_id").select(F.size("_v")).first()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    if first is None:
        return spark.createDataFrame([], schema)
    dim = first[0]
    rows = rows.where(F.size("_v") == dim)
    index = fit_index(rows, rows.count(), max_sample, k=k, recall=recall)
    shared = spark.sparkContext.broadcast(index)
    near = lambda v: (_unit(v) @ shared.value.rotation) @ shared.value.centroids.T
    packed = lambda v: pa.array([x.tobytes() for x in v], pa.binary())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(near(v).argmax(axis=1).astype(np.int32)), batch.column(0), packed(v)], ["_list", "_id", "_v"])

    listed = materialize(rows.mapInArrow(assign, "_list int, _id bigint, _v binary").withColumn("_n", F.monotonically_increasing_id()), "lists")
    asked = materialize(usable(queries, id_col, vector_col, dim).withColumn("_q", F.monotonically_increasing_id()), "queries")
    counts = np.zeros(len(index.centroids), np.int64)  # one number for each list, at most max_lists
    for r in listed.groupBy("_list").count().collect():
        counts[r[0]] = r[1]
    # where rows with a query's own id stand: they are no candidates. At most one entry for each list
    own = listed.groupBy("_id", "_list").count().groupBy("_id").agg(F.collect_list(F.struct("_list", F.col("count").alias("n"))).alias("_own"))
    own = own.join(asked.select("_id").distinct(), "_id", "left_semi")
    asked = materialize(asked.join(own, "_id", "left"), "queries")
    dealt = deal_lists(counts, index.probes, asked.count())

    def probe(first_lists: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["_group", "_part", "_q", "_id", "_v", "_limit", "_lists"]
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, v, own = batch.column(0).to_numpy(), _matrix(batch.column(2)), batch.column(4).to_pylist()
                raw, rows = packed(v), []
                for i, order in enumerate(np.argsort(-near(v), axis=1, kind="stable")):
                    candidates = dealt.counts.copy()
                    for x in own[i] or ():
                        candidates[x["_list"]] -= x["n"]
                    held = np.cumsum(candidates[order])
                    at_first = min(int(np.searchsorted(held, FIRST_PROBED)) + 1, len(order))
                    at_most = max(at_first, min(int(np.searchsorted(held, LEAST_PROBED)) + 1, len(order)), shared.value.probes)
                    lists = order[:at_first] if first_lists else order[at_first:at_most]
                    for group in np.unique(dealt.base[lists]):
                        here = lists[dealt.base[lists] == group]
                        part = int(q[i]) * 2654435761 % int(dealt.parts[here[0]])
                        rows += [(int(group) + chunk, part, i, here) for chunk in range(int(dealt.chunks[here[0]]))]
                group, part, at, lists = zip(*rows, strict=True) if rows else ((),) * 4
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(part, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), raw.take(take), batch.column(3).take(take), pa.array(lists, pa.list_(pa.int32()))], names)

        return run

    base, chunks, parts = (F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast("array<bigint>") for x in (dealt.base, dealt.chunks, dealt.parts))
    of = lambda x: F.get(x, F.col("_list"))
    data = listed.select((of(base) + F.pmod("_n", of(chunks))).cast("long").alias("_group"), F.explode(F.sequence(F.lit(0), (of(parts) - 1).cast("int"))).alias("_part"), "_list", F.col("_id").alias("_x"), "_v")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_q": np.zeros(0, "int64"), "query_id": np.zeros(0, "int64"), "_x": np.zeros(0, "int64"), "score": np.zeros(0)})
        if not len(q) or not len(x):
            return none
        matrix = lambda v: np.frombuffer(b"".join(v), np.float64).reshape(len(v), dim)
        qv, xv, x_ids, x_list = matrix(q["_v"]), matrix(x["_v"]), x["_x"].to_numpy(), x["_list"].to_numpy()
        q_ids, q_no, limits = q["_id"].to_numpy(), q["_q"].to_numpy(), q["_limit"].to_numpy()
        x_norm, x_turned, found = np.sqrt((xv * xv).sum(axis=1)), _unit(xv) @ shared.value.rotation, [none]
        for start in range(0, len(q), TILE):
            some = slice(start, start + TILE)
            of_query = q["_lists"].iloc[some]
            wants = np.zeros((len(of_query), len(counts)), bool)
            for i, lists in enumerate(of_query):
                wants[i, lists] = True
            probed = wants[:, x_list] & (x_ids != q_ids[some][:, None])
            for i, at in enumerate(scan(_unit(qv[some]) @ shared.value.rotation, x_turned, probed, limits[some], k), start):
                score = (xv[at] * qv[i]).sum(axis=1) / (x_norm[at] * np.sqrt((qv[i] * qv[i]).sum()))
                best = np.lexsort((x_ids[at], -score))[:k]
                found.append(pd.DataFrame({"_q": q_no[i], "query_id": q_ids[i], "_x": x_ids[at][best], "score": score[best]}))
        return pd.concat(found)

    keys = ["_group", "_part"]
    fields = "_group bigint, _part int, _q bigint, _id bigint, _v binary, _limit double, _lists array<int>"

    def searched(given: DataFrame, first_lists: bool) -> DataFrame:
        sent = given.select("_q", "_id", "_v", "_limit", "_own").mapInArrow(probe(first_lists), fields)
        return sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "_q bigint, query_id bigint, _x bigint, score double")

    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "_x"))
    start = searched(asked.withColumn("_limit", F.lit(float("inf"))), True).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    start = materialize(start, "neighbours")
    # cosines c of k neighbours bound the squared distance of the k-th: 2 - 2c
    limit = start.groupBy("_q").agg(F.when(F.count("*") == k, 2 - 2 * F.min("score") + 1e-9).alias("_limit"))
    rest = searched(asked.join(limit, "_q", "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf")))), False)
    return start.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_x").alias(id_col), "score")
