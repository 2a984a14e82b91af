"""Conflicts between sources: detection, severity, resolution and analytics over (id, property, value, source, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Properties whose conflicts are critical, and type pairs that exclude each other.
CRITICAL = ("id", "name", "type", "founded_year", "revenue")
INCOMPATIBLE = (("Person", "Organization"), ("Person", "Location"), ("Organization", "Location"), ("Event", "Person"))
#: Properties that hold times.
TEMPORAL = ("date", "created_at", "updated_at", "founded", "founded_year", "start_date", "end_date", "timestamp")


def observations(df: DataFrame, properties: list[str], id_col: str = "id", source_col: str = "source", confidence_col: str | None = None, ts_col: str | None = None) -> DataFrame:
    """(id, property, value, source, confidence, ts): one row for each value that is not null, as text."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties]))
    conf = F.col(confidence_col).cast("double") if confidence_col else F.lit(1.0)
    ts = F.col(ts_col) if ts_col else F.lit(None).cast("timestamp_ntz")
    return df.select(F.col(id_col).alias("id"), each.alias("x"), F.col(source_col).cast("string").alias("source"), conf.alias("confidence"), ts.alias("ts")).where("x.value IS NOT NULL").select("id", "x.*", "source", "confidence", "ts")


def value_conflicts(obs: DataFrame) -> DataFrame:
    """(id, property, n, values, sources, confidence, severity) of every property of an id that has several values.

    confidence: mean confidence times (1 + distinct values / observations), at most 1. severity: critical for the
    critical properties, high if all values are numbers over 1000 apart, else medium."""
    num = F.col("value").try_cast("double")
    g = obs.groupBy("id", "property").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("values"), F.array_sort(F.collect_set("source")).alias("sources"), F.avg("confidence").alias("_conf"), (F.max(num) - F.min(num)).alias("_range"), F.count(num).alias("_numbers"))
    g = g.where(F.size("values") > 1)
    severity = F.when(F.col("property").isin(*CRITICAL), "critical").when((F.col("_numbers") == F.col("n")) & (F.col("_range") > 1000), "high").otherwise("medium")
    return g.select("id", "property", "n", "values", "sources", F.least(F.lit(1.0), F.col("_conf") * (1 + F.size("values") / F.col("n"))).alias("confidence"), severity.alias("severity"))


def temporal_conflicts(obs: DataFrame) -> DataFrame:
    """Value conflicts of time properties by their year."""
    year = F.regexp_extract("value", r"(19\d\d|20\d\d)", 1)
    return value_conflicts(obs.where(F.col("property").isin(*TEMPORAL)).withColumn("value", F.when(year != "", year).otherwise(F.col("value"))))


def type_conflicts(df: DataFrame, id_col: str = "id", type_col: str = "type") -> DataFrame:
    """(id, types): ids that stand with several types."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(type_col)).alias("types")).where(F.size("types") > 1)


def logical_conflicts(df: DataFrame) -> DataFrame:
    """(id, first, second): ids that stand with two types which exclude each other."""
    matrix = df.sparkSession.createDataFrame(list(INCOMPATIBLE), "first string, second string")
    types = df.select("id", "type").distinct()
    return types.withColumnRenamed("type", "first").join(types.withColumnRenamed("type", "second"), "id").join(F.broadcast(matrix), ["first", "second"]).select("id", "first", "second")


def relationship_conflicts(edges: DataFrame, properties: list[str]) -> DataFrame:
    """(source, target, type, differing): edges that stand several times with different properties."""
    counts = [F.countDistinct(F.coalesce(F.col(p).cast("string"), F.lit("\u0000"))).alias(p) for p in properties]
    g = edges.groupBy("source", "target", "type").agg(*counts)
    differing = F.array_compact(F.array(*[F.when(F.col(p) > 1, F.lit(p)) for p in properties]))
    return g.select("source", "target", "type", differing.alias("differing")).where(F.size("differing") > 0)


def _chosen(obs: DataFrame, order: list[Column], confidence: Column | float, method: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id", "property").orderBy(*order))
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return obs.withColumn("_rank", rank).where("_rank = 1").select("id", "property", "value", conf.alias("confidence"), F.lit(method).alias("method"))


def resolve(obs: DataFrame, method: str = "voting", credibility: DataFrame | None = None) -> DataFrame:
    """(id, property, value, confidence, method), one row for each property of an id.

    voting: the most frequent value; credibility_weighted: the largest sum of confidence times the source's
    credibility (source, credibility; 0.5 unless given); most_recent, first_seen, highest_confidence: that
    observation. Ties go to the smaller value."""
    if method == "most_recent":
        return _chosen(obs, [F.desc_nulls_last("ts"), F.asc("value")], 0.8, method)
    if method == "first_seen":
        return _chosen(obs, [F.asc_nulls_last("ts"), F.asc("value")], 0.7, method)
    if method == "highest_confidence":
        return _chosen(obs, [F.desc("confidence"), F.asc("value")], F.col("confidence"), method)
    if method == "voting":
        votes = obs.withColumn("_w", F.lit(1.0))
    elif method == "credibility_weighted":
        votes = obs.withColumn("_w", F.col("confidence") * F.lit(0.5))
        if credibility is not None:
            votes = obs.join(credibility, "source", "left").withColumn("_w", F.col("confidence") * F.coalesce("credibility", F.lit(0.5)))
    else:
        raise ValueError(f"no such method: {method}")
    sums = votes.groupBy("id", "property", "value").agg(F.sum("_w").alias("_w"))
    share = F.col("_w") / F.sum("_w").over(W.partitionBy("id", "property"))
    return _chosen(sums.withColumn("_share", share), [F.desc("_w"), F.asc("value")], F.col("_share"), method)


def manual_review(conflicts: DataFrame) -> DataFrame:
    """The conflicts as work for people: question, values and sources, the severe ones first."""
    first = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    question = F.concat(F.lit("Which value of "), "property", F.lit(" holds for "), F.col("id").cast("string"), F.lit(": "), F.array_join("values", " | "), F.lit("?"))
    return conflicts.select("id", "property", question.alias("question"), "sources", first.alias("priority"))


def conflict_report(conflicts: DataFrame) -> DataFrame:
    """(property, severity, conflicts): counts by both, by each and in all (null: all)."""
    return conflicts.groupingSets([("property", "severity"), ("property",), ("severity",), ()], "property", "severity").agg(F.count("*").alias("conflicts"))


def monthly_trend(obs: DataFrame) -> DataFrame:
    """(month, n, direction): observations by month; rising or falling means over a tenth against the month before."""
    m = obs.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(W.orderBy("month"))
    return m.withColumn("direction", F.when(before.isNull(), "first").when(F.col("n") > 1.1 * before, "rising").when(F.col("n") < 0.9 * before, "falling").otherwise("stable"))


def source_disagreement(obs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source, observations, disagreements, credibility): how often a source's value is not the one chosen;
    credibility is the share that is."""
    j = obs.join(resolved.select("id", "property", F.col("value").alias("_chosen")), ["id", "property"])
    return j.groupBy("source").agg(F.count("*").alias("observations"), F.sum((F.col("value") != F.col("_chosen")).cast("long")).alias("disagreements")).withColumn("credibility", 1 - F.col("disagreements") / F.col("observations"))
