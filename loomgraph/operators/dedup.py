"""Entity resolution: blocking, pair scores, candidates, groups and merging of (id, type, name[, properties])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators.components import connected_components
from loomgraph.runtime import materialize

#: Weights of the parts of a score.
WEIGHTS = {"string": 0.6, "property": 0.2, "relationship": 0.2}


def blocking_keys(method: str = "tokens") -> Column:
    """Keys of a row: "first" its first character; "tokens" the first four letters of each word of over two letters
    with the type; "hybrid" these and the sound of the name; "complete" the whole name and every pair of neighbouring
    characters, with the type, in any script: names whose edit distance is at most 0.3 of the longer one share one of these,
    as a longer name of n characters has n - 1 pairs, of which each edit takes two at most."""
    name = F.lower(F.trim("name"))
    if method == "complete":
        return F.array_distinct(F.transform(F.array_append(S.bigrams(name), name), lambda w: F.concat_ws(":", F.coalesce("type", F.lit("")), w)))
    if method == "first":
        return F.array(F.concat(F.lit("chr:"), name.substr(1, 1)))
    tokens = F.transform(F.filter(F.split(name, "[^a-z0-9]+"), lambda w: F.length(w) > 2), lambda w: F.concat_ws(":", F.lit("tok"), F.coalesce("type", F.lit("")), w.substr(1, 4)))
    if method == "tokens":
        return F.array_distinct(tokens)
    return F.array_distinct(F.concat(tokens, F.array(F.concat(F.lit("pho:"), F.soundex(name)))))


def distinct_names(df: DataFrame) -> DataFrame:
    """(name_id, type, name): one row for each type and name without outer space and case, the smallest id of its rows; a
    null name has none."""
    key = [F.col("type"), F.lower(F.trim("name")).alias("name")]
    return df.where("name IS NOT NULL").groupBy(*key).agg(F.min("id").alias("name_id")).select("name_id", "type", "name")


def block_pairs(df: DataFrame, method: str = "tokens", largest_block: int | None = None) -> DataFrame:
    """(l_id, r_id): pairs l_id < r_id that share a key, once. Blocks hold distinct (type, name); of names that are equal
    the smallest id stands for all: it meets each of its copies and the names of other blocks, so copies do not
    multiply and the pairs connect what all pairs would. ``largest_block`` raises on a block that holds more names, instead
    of dropping it."""
    names = materialize(distinct_names(df), "names")
    keyed = names.select(F.col("name_id").alias("id"), F.explode(blocking_keys(method)).alias("key"))
    if largest_block:
        worst = keyed.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if worst > largest_block:
            raise ValueError(f"a block holds {worst} names; choose finer keys")
    r = keyed.select(F.col("id").alias("r_id"), "key")
    pairs = keyed.withColumnRenamed("id", "l_id").join(r, "key").where("l_id < r_id").select("l_id", "r_id").distinct()
    same = [F.lower(F.trim("name")).alias("name"), F.col("type").alias("_type"), F.col("id").alias("r_id")]
    copies = df.where("name IS NOT NULL").select(*same).join(names, "name").where(F.col("_type").eqNullSafe(F.col("type"))).select(F.col("name_id").alias("l_id"), "r_id").where("l_id < r_id")
    return pairs.unionByName(copies)


def with_sides(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """The pairs with the columns of both rows, prefixed l_ and r_."""
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return pairs.join(side("l"), "l_id").join(side("r"), "r_id")


def prefilter(pairs: DataFrame, least_ratio: float = 0.3, shared_word: bool = False) -> DataFrame:
    """Pairs of one type whose names' lengths do not differ too much (and which share a word)."""
    longer, shorter = F.greatest(F.length("l_name"), F.length("r_name")), F.least(F.length("l_name"), F.length("r_name"))
    keep = F.col("l_type").eqNullSafe(F.col("r_type")) & (shorter >= least_ratio * longer)
    if shared_word:
        keep &= F.arrays_overlap(S.word_set(F.col("l_name"), 3), S.word_set(F.col("r_name"), 3))
    return pairs.where(keep)


METHODS = {"levenshtein": S.levenshtein_similarity, "bigram": S.bigram_jaccard, "jaro_winkler": S.jaro_winkler, "exact": lambda a, b: (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")}


def score(pairs: DataFrame, method: str = "levenshtein", properties: str | None = None, relations: str | None = None) -> DataFrame:
    """The pairs with ``similarity``: the string similarity of the names, with that of the property maps and relation
    sets where they are named, by weight over what is there."""
    parts = [("string", METHODS[method](F.col("l_name"), F.col("r_name")))]
    if properties:
        parts.append(("property", S.property_similarity(F.col(f"l_{properties}"), F.col(f"r_{properties}"))))
    if relations:
        parts.append(("relationship", S.jaccard(F.col(f"l_{relations}"), F.col(f"r_{relations}"), 0.5)))
    total = sum(WEIGHTS[k] for k, _ in parts)
    weighted = parts[0][1] * WEIGHTS[parts[0][0]]
    for k, s in parts[1:]:
        weighted = weighted + s * WEIGHTS[k]
    return pairs.withColumn("similarity", weighted / total)


def candidates(scored: DataFrame, threshold: float = 0.7, least_confidence: float = 0.6) -> DataFrame:
    """Pairs at or over the threshold with a confidence: the similarity, a tenth more for equal names, a twentieth for
    one type, at most 1."""
    bonus = F.when(F.lower(F.trim("l_name")) == F.lower(F.trim("r_name")), 0.1).otherwise(0.0) + F.when(F.col("l_type") == F.col("r_type"), 0.05).otherwise(0.0)
    out = scored.where(F.col("similarity") >= threshold).withColumn("confidence", F.least(F.lit(1.0), F.col("similarity") + bonus))
    return out.where(F.col("confidence") >= least_confidence)


def detect_duplicates(df: DataFrame, threshold: float = 0.7, method: str = "levenshtein", blocking: str = "tokens") -> DataFrame:
    """Blocking, prefilter, score and candidates in one."""
    return candidates(score(prefilter(with_sides(block_pairs(df, blocking), df)), method), threshold)


def detect_incremental(new: DataFrame, existing: DataFrame, threshold: float = 0.7, method: str = "levenshtein", blocking: str = "complete") -> DataFrame:
    """Candidates between new rows (l_) and existing ones (r_) of one type. The default blocking misses none at a Levenshtein
    threshold of 0.7 or more; others are faster, and miss names that share no key. Distinct names are compared, then every
    row with each of them that its name matches."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    names = [materialize(distinct_names(df).withColumnRenamed("name_id", "id"), "names") for df in (new, existing)]
    key = lambda df, c: df.select(F.col("id").alias(c), F.explode(blocking_keys(blocking)).alias("key"))
    pairs = key(names[0], "l_id").join(key(names[1], "r_id"), "key").select("l_id", "r_id").distinct()
    near = candidates(score(prefilter(pairs.join(side(names[0], "l"), "l_id").join(side(names[1], "r"), "r_id")), method), threshold)
    found = near.select("l_type", F.col("l_name").alias("_l"), F.col("r_name").alias("_r"), "similarity", "confidence")
    rows = lambda df, p: side(df, p).withColumn(f"_{p}", F.lower(F.trim(f"{p}_name")))
    left = rows(new, "l").join(found.withColumnRenamed("l_type", "_type"), "_l").where(F.col("l_type").eqNullSafe(F.col("_type")))
    return left.join(rows(existing, "r"), "_r").where(F.col("r_type").eqNullSafe(F.col("_type"))).drop("_l", "_r", "_type")


def top_k_per_entity(cands: DataFrame, k: int) -> DataFrame:
    """Pairs among the k best of either side."""
    both = cands.select("l_id", "r_id", "similarity", F.col("l_id").alias("_e")).unionByName(cands.select("l_id", "r_id", "similarity", F.col("r_id").alias("_e")))
    rank = F.row_number().over(W.partitionBy("_e").orderBy(F.desc("similarity"), "l_id", "r_id"))
    return both.withColumn("_rank", rank).where(F.col("_rank") <= k).select("l_id", "r_id", "similarity").distinct()


def groups(cands: DataFrame) -> DataFrame:
    """(id, group): connected candidates; the group is its smallest id."""
    return connected_components(cands, "l_id", "r_id").select(F.col("node").alias("id"), F.col("component").alias("group"))


def group_summary(cands: DataFrame, members: DataFrame, smallest: int = 2) -> DataFrame:
    """(group, size, mean_similarity, confidence, quality): confidence is the mean, weighted by size up to five."""
    pairs = cands.join(members.withColumnRenamed("id", "l_id"), "l_id").groupBy("group").agg(F.avg("similarity").alias("mean_similarity"))
    out = members.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") >= smallest).join(pairs, "group")
    conf = F.col("mean_similarity") * (0.8 + 0.2 * F.least(F.lit(1.0), F.col("size") / 5))
    return out.withColumn("confidence", conf).withColumn("quality", F.when(F.col("mean_similarity") >= 0.7, "high").otherwise("low"))


def update_groups(members: DataFrame, cands: DataFrame) -> DataFrame:
    """(id, group): known groups with new candidates: each links what it names, and groups that it links become one."""
    edges = members.where("id <> group").select(F.col("id").alias("l_id"), F.col("group").alias("r_id")).unionByName(cands.select("l_id", "r_id"))
    alone = members.where("id = group").select("id", "group")
    found = groups(edges)
    return found.unionByName(alone.join(found, "id", "left_anti"))


def merge_groups(df: DataFrame, members: DataFrame, strategy: str = "keep_most_complete", order_by: str = "id") -> DataFrame:
    """One row for each group, and the ungrouped rows as they are: the chosen row's values, nulls filled from the
    group. Strategies: keep_first, keep_last (by ``order_by``), keep_most_complete, keep_highest_confidence."""
    values = [c for c in df.columns if c != "id"]
    complete = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0))
    order = {
        "keep_first": [F.asc(order_by)],
        "keep_last": [F.desc(order_by)],
        "keep_most_complete": [complete.desc(), F.asc(order_by)],
        "keep_highest_confidence": [F.desc("confidence") if "confidence" in df.columns else F.asc(order_by), F.asc(order_by)],
    }[strategy]
    joined = df.join(members, "id", "left").withColumn("group", F.coalesce("group", F.col("id")))
    w = W.partitionBy("group").orderBy(*order)
    filled = joined.withColumns({c: F.first(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c in values})
    filled = filled.withColumns({"_rank": F.row_number().over(w), "merged": F.count("*").over(W.partitionBy("group"))})
    return filled.where("_rank = 1").select("id", *values, "merged")


def merge_all(df: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each group with all distinct values of every column as sorted arrays."""
    values = [c for c in df.columns if c != "id"]
    joined = df.join(members, "id", "left").withColumn("group", F.coalesce("group", F.col("id")))
    return joined.groupBy(F.col("group").alias("id")).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in values], F.count("*").alias("merged"))


def normalized_triples(triples: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """(subject, predicate, object) with predicates by synonym and literals in lower case without outer or doubled space."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    predicate = clean("predicate")
    for word, known in sorted(synonyms.items()):
        predicate = F.when(clean("predicate") == word, known).otherwise(predicate)
    return triples.withColumns({"predicate": predicate, "object": clean("object")})


def duplicate_relationships(triples: DataFrame, synonyms: dict[str, str], threshold: float = 0.8) -> DataFrame:
    """(l_id, r_id, similarity): relationships of one subject that say the same: 0.6 for the predicate, 0.4 for the
    object. Blocks are (subject, predicate, character) over distinct objects, from 0.7 of the object on (subject,
    predicate, pair of characters): below 0.6 the predicates must agree for a pair to reach the threshold, and objects that
    are alike at all share a character. Equal triples meet their smallest id only."""
    t = normalized_triples(triples, synonyms)
    one = materialize(t.groupBy("subject", "predicate", "object").agg(F.min("id").alias("id")), "triples")
    same = t.withColumnRenamed("id", "r_id").join(one.withColumnRenamed("id", "l_id"), ["subject", "predicate", "object"]).where("l_id < r_id").select("l_id", "r_id", F.lit(1.0).alias("similarity"))
    least = (threshold - 0.6) / 0.4
    key = F.array_append(S.bigrams(F.col("object")), F.col("object")) if least >= 0.7 else F.split("object", "")
    key = F.array_distinct(key)
    side = lambda p: one.select(F.col("id").alias(f"{p}_id"), "subject", "predicate", F.col("object").alias(f"{p}_object"), F.explode(key).alias("_key"))
    s = 0.6 + 0.4 * S.levenshtein_similarity(F.col("l_object"), F.col("r_object"))
    near = side("l").join(side("r"), ["subject", "predicate", "_key"]).where("l_id < r_id").select("l_id", "r_id", "l_object", "r_object").distinct()
    return same.unionByName(near.select("l_id", "r_id", s.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12))


def merge_relationships(triples: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """One relationship for each normalised (subject, predicate, object), of the smallest id, with the number merged."""
    return normalized_triples(triples, synonyms).groupBy("subject", "predicate", "object").agg(F.min("id").alias("id"), F.count("*").alias("merged"))


def merge_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, and the share of filled values in each."""
    def filled(df: DataFrame, name: str) -> DataFrame:
        values = [c for c in df.columns if c not in ("id", "merged")]
        share = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0)) / max(len(values), 1)
        return df.agg(F.count("*").alias(f"rows_{name}"), F.avg(share).alias(f"filled_{name}"))

    return filled(before, "before").join(F.broadcast(filled(after, "after")), F.lit(True))
