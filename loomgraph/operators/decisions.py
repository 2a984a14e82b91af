"""Decisions: causes and effects, precedents, influence, insights, and versioned policies.

A decision is a row (id, category, outcome, confidence, ts, entities array, scenario); causal edges are rows (source,
target, type, weight). Everything is asked for a table of decisions at once, not for one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.runtime import materialize

#: Types of edges that carry causes, those of them that carry effects, and the days of influence.
CAUSAL = ("CAUSED", "INFLUENCED", "PRECEDENT_FOR")
EFFECTIVE = ("CAUSED", "INFLUENCED")
WINDOW_DAYS = 30
#: Jaccard similarities at which precedents are asked for, one after the other, before the threshold.
STEPS = (1, 0.8, 0.6)
#: The most frequent words, which are bits of one number, scenarios of a word that meet a query in one piece, and rows for a task.
BITS, PIECE, ROWS = 63, 2_000, 500_000


def causal_chain(edges: DataFrame, seeds: DataFrame, direction: str = "upstream", max_depth: int = 10, types: tuple[str, ...] = CAUSAL) -> DataFrame:
    """(origin, id, distance): decisions that lead to each seed (column id) or follow from it, by the fewest edges, up to
    ``max_depth`` of them. A seed is not in its own chain; null ends and weights add nothing. Each round joins only the
    pairs that the round before found."""
    if direction not in ("upstream", "downstream"):
        raise ValueError("direction is upstream or downstream")
    ends = ("target", "source") if direction == "upstream" else ("source", "target")
    e = edges.where(F.col("type").isin(*types)).select(F.col(ends[0]).alias("_at"), F.col(ends[1]).alias("_next")).where("_at <> _next").distinct()
    e = materialize(e, "edges")  # every round reads them
    known = fresh = materialize(seeds.where("id IS NOT NULL").select(F.col("id").alias("origin"), "id", F.lit(0).alias("distance")).distinct(), "chain")
    for depth in range(1, max_depth + 1):
        step = fresh.join(e, fresh["id"] == e["_at"]).select("origin", F.col("_next").alias("id")).distinct()
        fresh = materialize(step.join(known, ["origin", "id"], "left_anti").withColumn("distance", F.lit(depth)), "chain")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known.where("distance > 0")


def root_causes(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(origin, id, distance): upstream decisions that nothing caused or influenced.

    Pairs are made from the side with fewer ends: up from the seeds, or down from the roots, which then makes no pair of
    a seed with what lies between."""
    e = materialize(edges.where(F.col("type").isin(*EFFECTIVE)).select("source", "target", "type").distinct(), "edges")
    caused = e.select(F.col("target").alias("id")).distinct()
    asked = materialize(seeds.where("id IS NOT NULL").select("id").distinct(), "seeds")
    # an edge onto itself makes its decision caused, as any other
    roots = materialize(e.where("source IS NOT NULL").select(F.col("source").alias("id")).distinct().join(caused, "id", "left_anti"), "roots")
    if roots.count() < asked.count():
        down = causal_chain(e, roots, "downstream", max_depth, EFFECTIVE).select(F.col("id").alias("origin"), F.col("origin").alias("id"), "distance")
        return down.join(asked.withColumnRenamed("id", "origin"), "origin", "left_semi").select("origin", "id", "distance")
    return causal_chain(e, asked, "upstream", max_depth, EFFECTIVE).join(caused, "id", "left_anti").select("origin", "id", "distance")


def causal_loops(edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(path, length): cycles of 2 to ``max_depth`` causing or influencing edges without a repeated decision, each once,
    from its smallest decision. Paths only grow through larger decisions than their first."""
    e = edges.where(F.col("type").isin(*EFFECTIVE) & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    paths, found = e.where("source < target").select(F.array("source", "target").alias("path")), None
    for _ in range(max_depth - 1):
        paths = materialize(paths, "loops")
        if paths.isEmpty():
            break
        step = paths.join(e, F.element_at("path", -1) == F.col("source"))
        closed = step.where(F.col("target") == F.col("path")[0]).select("path", F.size("path").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = step.where((F.col("target") > F.col("path")[0]) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
    return found if found is not None else paths.withColumn("length", F.size("path")).where("false")


def impact_scores(edges: DataFrame, decisions: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id, influenced, precedents, score) of every decision: the mean confidence of all that follow from it, and at half
    weight that of the precedents it rests on, at most 1; 0 without either."""
    conf = decisions.select("id", "confidence")

    def strength(chain: DataFrame, name: str) -> DataFrame:
        return chain.join(conf, "id").groupBy(F.col("origin").alias("id")).agg(F.count("*").alias(name), F.sum("confidence").alias(f"{name}_sum"))

    down = strength(causal_chain(edges, decisions, "downstream", max_depth, EFFECTIVE), "influenced")
    up = strength(causal_chain(edges, decisions, "upstream", max_depth, ("PRECEDENT_FOR",)), "precedents")
    out = decisions.select("id").join(down, "id", "left").join(up, "id", "left").na.fill(0)
    total = F.col("influenced_sum") + 0.5 * F.col("precedents_sum")
    weight = F.greatest("influenced", F.lit(1)) + 0.5 * F.greatest("precedents", F.lit(1))
    return out.select("id", "influenced", "precedents", F.least(F.lit(1.0), total / weight).alias("score"))


def influence_score(a: str, b: str) -> Column:
    """How much decision struct ``a`` influences ``b``: half by the share of a's entities that b has, 0.3 for one category,
    0.2 for nearness within ``WINDOW_DAYS`` days. Null entities count as none."""
    get = lambda p, c: F.col(f"{p}.{c}")
    mine, other = (F.coalesce(get(p, "entities"), F.array().cast("array<string>")) for p in (a, b))
    shared = F.size(F.array_intersect(mine, other)) / F.greatest(F.size(F.array_distinct(mine)), F.lit(1))
    same = F.when(get(a, "category") == get(b, "category"), 1.0).otherwise(0.0)
    days = F.abs(F.unix_micros(get(a, "ts").cast("timestamp")) - F.unix_micros(get(b, "ts").cast("timestamp"))) / (86_400_000_000 * WINDOW_DAYS)
    return 0.5 * shared + 0.3 * same + 0.2 * F.greatest(F.lit(0.0), 1 - days)


def influences(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, score) of every causal edge whose ends are decisions."""
    side = lambda end: decisions.select(F.col("id").alias(end), F.struct("entities", "category", "ts").alias(f"_{end}"))
    e = edges.where(F.col("type").isin(*CAUSAL)).select("source", "target").distinct()
    return e.join(side("source"), "source").join(side("target"), "target").select("source", "target", influence_score("_source", "_target").alias("score"))


def words_of(text: Column) -> Column:
    """Distinct words of a text in lower case, split at white space; none of a null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def precedents(queries: DataFrame, decisions: DataFrame, threshold: float = 0.5, k: int = 10, as_of: Column | None = None) -> DataFrame:
    """(query, id, similarity, rank): for each query (id, category, scenario; ids are keys) the ``k`` decisions of its category,
    itself excepted, whose similarity reaches the threshold, ties by id. The similarity is 0.7 of the Jaccard similarity of the
    words; without a graph, structure adds nothing. ``as_of`` keeps decisions whose valid_from and valid_until hold it.

    Scenarios with the same words are compared once, and stand for their k + 1 smallest ids (a query may be one of them).
    The threshold falls in ``STEPS``: only queries that have not found more than k decisions at one are asked at the next.
    At each they are compared with the scenarios that share one of their rarest words: a Jaccard similarity of t needs one of
    any |A| - ceil(t |A|) + 1 words of A in common, and sizes that differ by no more than t. Scenarios of a frequent word
    are dealt out in pieces, and its words are compared as bits, so few words in many scenarios are no burden of one task."""
    if as_of is not None:
        decisions = decisions.where((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_until").isNull() | (as_of <= F.col("valid_until"))))
    least = threshold / 0.7
    worded = lambda df, name: df.select(F.col("id").alias(name), "category", F.array_sort(words_of(F.col("scenario"))).alias("words")).where(F.size("words") > 0)
    asked = materialize(worded(queries, "query").where("query IS NOT NULL"), "asked")
    rows = materialize(worded(decisions, "id").where("id IS NOT NULL"), "worded")
    sets = materialize(rows.groupBy("category", "words").agg(F.count("*").alias("n")).withColumn("n", F.least("n", F.lit(k + 1))), "scenarios")
    place = F.row_number().over(W.partitionBy("category", "words").orderBy("id"))
    first = materialize(rows.withColumn("_at", place).where(F.col("_at") <= k + 1).drop("_at"), "firsts")
    common = materialize(sets.select("category", F.explode("words").alias("word")).groupBy("category", "word").agg(F.count("*").alias("df")), "words")
    bits = _Bits([r["word"] for r in common.groupBy("word").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "word").limit(BITS).collect()])
    held = sets.select("category", "words", "n", F.size("words").alias("size"), bits.mask("words").alias("mask"), bits.rest("words").alias("rest"), F.explode("words").alias("word"))
    held = materialize(held.join(common, ["category", "word"]).withColumn("piece", F.pmod(F.xxhash64("words"), _pieces())).drop("df"), "postings")
    left, found = asked.select("category", F.col("words").alias("q_words")).distinct(), None
    for step in (*(s for s in STEPS if s > least), least):
        near = materialize(_near_scenarios(left, held, common, bits, step, threshold), "near")
        level = near.groupBy("category", "q_words", "similarity").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("category", "q_words").orderBy(F.desc("similarity")).rowsBetween(W.unboundedPreceding, W.currentRow))
        level = materialize(level.withColumn("above", above), "levels")
        done = level.groupBy("category", "q_words").agg(F.max("above").alias("above")).where(F.col("above") > k).select("category", "q_words") if step > least else left
        kept = near.join(level.where(F.col("above") - F.col("n") <= k).select("category", "q_words", "similarity"), ["category", "q_words", "similarity"])
        kept = kept.join(done, ["category", "q_words"], "left_semi").select("category", "q_words", "words", "similarity")
        found = kept if found is None else found.unionByName(kept)
        left = materialize(left.join(done, ["category", "q_words"], "left_anti"), "left")
        if left.isEmpty():
            break
    ids = found.join(first, ["category", "words"]).select("category", "q_words", "id", "similarity")
    # of one set of words only the k + 1 best can be among the k of a query
    order = F.row_number().over(W.partitionBy("category", "q_words").orderBy(F.desc("similarity"), "id"))
    ids = ids.withColumn("_at", order).where(F.col("_at") <= k + 1)
    pairs = asked.withColumnRenamed("words", "q_words").join(ids, ["category", "q_words"]).where("id <> query")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return pairs.select("query", "id", "similarity").withColumn("rank", rank).where(F.col("rank") <= k)


class _Bits:
    """Sets of words as a number with a bit for each of the words given, and an array of the others."""

    def __init__(self, words: list[str]) -> None:
        self.bit = F.create_map(*[F.lit(x) for i, word in enumerate(words) for x in (word, 1 << i)]) if words else F.create_map().cast("map<string,bigint>")

    def mask(self, words: str) -> Column:
        known = F.transform(words, lambda w: F.coalesce(F.try_element_at(self.bit, w).cast("bigint"), F.lit(0).cast("bigint")))
        return F.aggregate(known, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))

    def rest(self, words: str) -> Column:
        return F.filter(words, lambda w: F.try_element_at(self.bit, w).isNull())


def _shared(a: str, b: str) -> Column:
    """How many words the sets ``a`` and ``b`` (prefixes of the columns mask and rest) have in common."""
    (x, p), (y, q) = ((F.col(f"{c}mask"), F.col(f"{c}rest")) for c in (a, b))
    rest = F.when((F.size(p) > 0) & (F.size(q) > 0), F.size(F.array_intersect(p, q))).otherwise(0)
    return F.bit_count(x.bitwiseAND(y)) + rest


def _pieces() -> Column:
    return F.ceil(F.col("df") / PIECE).cast("bigint")


def _near_scenarios(asked: DataFrame, held: DataFrame, common: DataFrame, bits: _Bits, step: float, threshold: float) -> DataFrame:
    """(category, q_words, words, n, similarity) of the pairs whose Jaccard similarity reaches ``step`` and whose similarity
    the threshold; ``held`` has a row for each word of a scenario."""
    if step == 1:
        same = held.select("category", F.col("words").alias("q_words"), "n").distinct()
        return asked.join(same, ["category", "q_words"]).select("category", "q_words", F.col("q_words").alias("words"), "n", F.lit(0.7).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    size = F.size("q_words")
    order = W.partitionBy("category", "q_words").orderBy("df", "word")
    prefix = asked.withColumn("word", F.explode("q_words")).join(common, ["category", "word"])
    prefix = prefix.withColumns({"_at": F.row_number().over(order), "_before": F.collect_list("word").over(order.rowsBetween(W.unboundedPreceding, -1))})
    prefix = prefix.where(F.col("_at") <= size - F.ceil(F.lit(step) * size - 1e-9) + 1).withColumn("q_size", size)
    prefix = prefix.select("category", "word", "q_words", "q_size", *[f(c).alias(f"{p}_{name}") for p, c in (("q", "q_words"), ("b", "_before")) for name, f in (("mask", bits.mask), ("rest", bits.rest))], F.explode(F.sequence(F.lit(0).cast("bigint"), _pieces() - 1)).alias("piece"))
    # small tables make many pairs: their number of tasks does not follow their bytes
    tasks = max(4 * held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // ROWS))
    keys = ["category", "word", "piece"]
    pairs = prefix.repartition(tasks, *keys).join(held.repartition(tasks, *keys), keys).where((F.col("size") >= step * F.col("q_size") - 1e-9) & (F.col("q_size") >= step * F.col("size") - 1e-9))
    # a pair comes once, at the first of the rare words that both have
    pairs = pairs.where(_shared("b_", "") == 0)
    both = _shared("q_", "")
    jaccard = both / (F.col("q_size") + F.col("size") - both)
    near = pairs.where(jaccard >= step - 1e-9).withColumn("similarity", 0.7 * jaccard)
    return near.where(F.col("similarity") >= threshold - 1e-12).select("category", "q_words", "words", "n", "similarity")


def hybrid_similarity(semantic: Column, structural: Column, text: Column, category: Column, weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)) -> Column:
    """The weighted sum of four similarities; a null one adds nothing."""
    parts = [w * F.coalesce(s, F.lit(0.0)) for w, s in zip(weights, (semantic, structural, text, category), strict=True)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def decision_insights(decisions: DataFrame, by: list[str]) -> DataFrame:
    """(by ..., decisions, mean, least, most, median of the confidence); nulls are left out of the figures. The median is
    the upper one: the value at place n // 2, from 0."""
    return decisions.groupBy(*by).agg(
        F.count("*").alias("decisions"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"),
        (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -confidence)")).alias("median"),
    )


def connected_decisions(links: DataFrame, decisions: DataFrame, seeds: DataFrame, max_hops: int = 10) -> DataFrame:
    """(origin, id, hop): decisions within ``max_hops`` undirected (source, target) links of each seed (column id)."""
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).withColumn("type", F.lit("LINK"))
    reached = causal_chain(both, seeds, "downstream", max_hops, ("LINK",))
    return reached.join(decisions.select("id"), "id", "left_semi").select("origin", "id", F.col("distance").alias("hop"))


def causal_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(origin, id, path, hops, decay, weakest): of each decision downstream of a seed the path of the fewest edges (the
    smallest as an array among equals), the product of its weights, and its weakest edge, the first among equals, as
    struct(weight, source, target)."""
    e = edges.where(F.col("type").isin(*CAUSAL)).groupBy(F.col("source").alias("_a"), F.col("target").alias("_b")).agg(F.max("weight").alias("_w"))
    start = seeds.select(F.col("id").alias("origin"), "id", F.array("id").alias("path"), F.lit(0).alias("hops"), F.lit(1.0).alias("decay"), F.lit(None).cast("struct<weight:double,source:string,target:string>").alias("weakest"))
    known = fresh = materialize(start.distinct(), "paths")
    for _ in range(max_depth):
        edge = F.struct(F.col("_w").alias("weight"), F.col("_a").alias("source"), F.col("_b").alias("target"))
        step = fresh.join(e, fresh["id"] == e["_a"]).select(
            "origin", F.col("_b").alias("id"), F.concat("path", F.array("_b")).alias("path"), (F.col("hops") + 1).alias("hops"), (F.col("decay") * F.col("_w")).alias("decay"),
            F.when(F.col("weakest").isNull() | (F.col("_w") < F.col("weakest.weight")), edge).otherwise(F.col("weakest")).alias("weakest"),
        )
        best = step.groupBy("origin", "id").agg(F.min_by(F.struct("path", "hops", "decay", "weakest"), "path").alias("_x")).select("origin", "id", "_x.*")
        fresh = materialize(best.join(known, ["origin", "id"], "left_anti"), "paths")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known.where("hops > 0")


def add_policy(policies: DataFrame, policy_id: str, rules: dict[str, float], category: str | None) -> DataFrame:
    """``policies`` (policy_id, version, category, rules map<string,double>) with one more row: the next version of a known
    id, else version 1. Nothing is overwritten, so the history stays."""
    new = policies.sparkSession.createDataFrame([(policy_id, category, rules)], "policy_id string, category string, rules map<string,double>")
    known = policies.groupBy("policy_id").agg(F.max("version").alias("_v"))
    row = new.join(known, "policy_id", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int"))
    return policies.unionByName(row.select(policies.columns))


def latest_policies(policies: DataFrame) -> DataFrame:
    """The latest version of each policy."""
    return policies.groupBy("policy_id").agg(F.max_by(F.struct("version", "category", "rules"), "version").alias("_x")).select("policy_id", "_x.*")


def compliance(decisions: DataFrame, policies: DataFrame, facts: str = "facts") -> DataFrame:
    """(id, policy_id, version, violations, compliant): every decision against the latest version of the policies of its
    category, or of none. A rule min_x, max_x or required_x bounds fact x of the map<string,double> ``facts``; a missing
    fact breaks min_ and required_, and any other rule asks that its fact is there."""
    rules = latest_policies(policies).select("policy_id", "version", F.coalesce("category", F.lit("*")).alias("_c"), F.map_entries("rules").alias("_rules"))
    here = decisions.withColumn("_c", F.explode(F.array_compact(F.array("category", F.lit("*"))))).join(rules, "_c")
    fact = lambda name: F.try_element_at(F.col(facts), name)

    def broken(rule: Column) -> Column:
        name, bound = rule["key"], rule["value"]
        kind, field = F.split(name, "_", 2)[0], F.regexp_replace(name, "^(min|max|required)_", "")
        value = fact(field)
        return F.when(kind == "min", value.isNull() | (value < bound)).when(kind == "max", F.coalesce(value > bound, F.lit(False))).otherwise(value.isNull())

    bad = F.array_sort(F.transform(F.filter("_rules", broken), lambda r: r["key"]))
    return here.select("id", "policy_id", "version", bad.alias("violations")).withColumn("compliant", F.size("violations") == 0)


def policy_impact(decisions: DataFrame, policies: DataFrame, policy_id: str, rules: dict[str, float], facts: str = "facts") -> DataFrame:
    """(id, before, after): decisions whose compliance with a policy would change under new rules."""
    now = policies.where(F.col("policy_id") == policy_id)
    category = now.agg(F.max_by("category", "version")).first()[0]
    then = add_policy(now, policy_id, rules, category)
    old, new = (compliance(decisions, p, facts).select("id", F.col("compliant").alias(name)) for p, name in ((now, "before"), (then, "after")))
    return old.join(new, "id").where("before <> after")
