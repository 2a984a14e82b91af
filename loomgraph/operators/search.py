"""Search by words over graphs, and conversations as memory: keyword scores, an index of names, retention and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores of the tiers in which a query word finds a name.
TIERS = {"exact": 1.0, "token": 0.8, "prefix": 0.5}


def words(c: Column) -> Column:
    """Distinct words of a text in lower case; none of a null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def keyword_score(query: Column, text: Column) -> Column:
    """The share of the query's words that stand somewhere in the text, parts of words included; 0 without a word."""
    asked = words(query)
    hit = F.filter(asked, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))
    return F.when(F.size(asked) > 0, F.size(hit) / F.size(asked)).otherwise(0.0)


def entity_match_score(query: Column, text: Column) -> Column:
    """Shared words, and one more if a word of the query stands in the text as a part, over the query's words."""
    asked = words(query)
    shared = F.size(F.array_intersect(asked, words(text)))
    part = F.exists(asked, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w)).cast("int")
    return F.when(F.size(asked) > 0, (shared + part) / F.size(asked)).otherwise(0.0)


def name_index(entities: DataFrame, prefix: int = 3) -> DataFrame:
    """(key, kind, id, name): the keys under which a name is found: the name itself, its words, and their first
    ``prefix`` characters. Null names have none."""
    e = entities.where("name IS NOT NULL").select("id", "name")
    keys = F.concat(
        F.array(F.struct(F.lower(F.trim("name")).alias("key"), F.lit("exact").alias("kind"))),
        F.transform(words(F.col("name")), lambda w: F.struct(w.alias("key"), F.lit("token").alias("kind"))),
        F.transform(F.array_distinct(F.transform(words(F.col("name")), lambda w: F.left(w, F.lit(prefix)))), lambda w: F.struct(w.alias("key"), F.lit("prefix").alias("kind"))),
    )
    return e.select(F.explode(keys).alias("_k"), "id", "name").select("_k.key", "_k.kind", "id", "name")


def search_names(index: DataFrame, queries: DataFrame, k: int = 10, prefix: int = 3) -> DataFrame:
    """(query, id, score, rank): for each row of ``queries`` (query) the ``k`` best names: 1 for the whole name, else the
    mean over the query's words of the best tier in which each finds the name. Looked up by equal keys alone."""
    q = queries.where("query IS NOT NULL").select("query").distinct().withColumn("_words", words(F.col("query")))
    asked = q.select("query", F.size("_words").alias("_n"), F.explode("_words").alias("_w"))
    tokens = asked.join(index.where("kind = 'token'"), F.col("_w") == F.col("key")).select("query", "_n", "_w", "id", F.lit(TIERS["token"]).alias("_s"))
    heads = asked.where(F.length("_w") >= prefix).join(index.where("kind = 'prefix'"), F.left("_w", F.lit(prefix)) == F.col("key"))
    heads = heads.where(F.exists(words(F.col("name")), lambda w: w.startswith(F.col("_w")))).select("query", "_n", "_w", "id", F.lit(TIERS["prefix"]).alias("_s"))
    by_word = tokens.unionByName(heads).groupBy("query", "_n", "id", "_w").agg(F.max("_s").alias("_s"))
    scored = by_word.groupBy("query", "id", "_n").agg(F.sum("_s").alias("_s")).select("query", "id", (F.col("_s") / F.col("_n")).alias("score"))
    exact = q.join(index.where("kind = 'exact'"), F.lower(F.trim("query")) == F.col("key")).select("query", "id", F.lit(TIERS["exact"]).alias("score"))
    best = scored.unionByName(exact).groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def token_estimate(c: Column) -> Column:
    """A rough token count: words of a text, split at white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def short_term(turns: DataFrame, key: str, order: str, text: str, most: int, budget: int) -> DataFrame:
    """The latest turns of each conversation: at most ``most``, and as many as a budget of tokens holds, counted back from
    the last. A turn that alone is over the budget leaves none."""
    back = W.partitionBy(key).orderBy(F.desc(order))
    place = F.row_number().over(back)
    total = F.sum(token_estimate(F.col(text))).over(back.rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumns({"_place": place, "_total": total}).where((F.col("_place") <= most) & (F.col("_total") <= budget)).drop("_place", "_total")


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; a null time is kept."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= now - F.make_interval(days=F.lit(days))))


def page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the row whose ordering values are ``after`` (the first rows if None), in order: a
    cursor, so later pages cost no more than the first. The order's columns hold no nulls and are unique together."""
    if after is not None:
        later = F.lit(False)
        for c, v in reversed(list(zip(order, after, strict=True))):
            later = (F.col(c) > v) | ((F.col(c) == v) & later)
        rows = rows.where(later)
    return rows.orderBy(*order).limit(size)


def triple_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, subject, predicate, object): triples that stand in one graph only, each once; nulls are equal."""
    columns = ["subject", "predicate", "object"]
    side = lambda df, n: df.select(*columns).distinct().withColumn("_side", F.lit(n))
    both = side(before, 1).unionByName(side(after, 2)).groupBy(*columns).agg(F.sum("_side").alias("_sides"))
    return both.where("_sides < 3").select(F.when(F.col("_sides") == 1, "removed").otherwise("added").alias("change"), *columns)


def pairwise_distances(vectors: DataFrame, ids: DataFrame, metric, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 500) -> DataFrame:
    """(a, b, distance): the distances among the rows named by ``ids``, a stated set that is compared with itself, a < b.

    The set is dealt into blocks of about ``block`` rows, and each pair of blocks meets under a key of its own."""
    some = vectors.join(ids.select(id_col).distinct(), id_col, "left_semi").select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    blocks = max(1, -(-some.count() // block))
    some = some.withColumn("_k", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    x, y = (some.select(F.col("_id").alias(c), F.col("_v").alias(f"_{c}"), F.col("_k").alias(own), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(other)) for c, own, other in (("a", "_i", "_j"), ("b", "_j", "_i")))
    return x.join(y, ["_i", "_j"]).where("a < b").select("a", "b", metric(F.col("_a"), F.col("_b")).alias("distance"))
