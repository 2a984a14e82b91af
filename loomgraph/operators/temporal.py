"""Valid-time and transaction-time operators. An open upper bound is a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END_OF_TIME = "9999-12-31 23:59:59.999999"
UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def end_or_open(end) -> Column:
    return F.coalesce(_c(end), F.lit(END_OF_TIME).cast("timestamp_ntz"))


def active_at(start, end, at: Column, closed: str = "left") -> Column:
    """Whether [start, end) holds ``at``; [start, end] with closed="both". A null start is open too."""
    after = _c(start).isNull() | (_c(start) <= at)
    before = _c(end).isNull() | (at < _c(end)) if closed == "left" else _c(end).isNull() | (at <= _c(end))
    return after & before


def overlaps(start, end, low: Column, high: Column, meets: bool = False) -> Column:
    """Whether [start, end) and [low, high) share time; with ``meets`` a shared end counts too."""
    s, e = _c(start), end_or_open(end)
    return (s <= high) & (low <= e) if meets else (s < high) & (low < e)


def covers(start, end, low: Column, high: Column) -> Column:
    return (_c(start) <= low) & (end_or_open(end) >= high)


def allen_relation(a_start, a_end, b_start, b_end) -> Column:
    """Which of the thirteen relations holds between intervals a and b."""
    s1, e1, s2, e2 = _c(a_start), end_or_open(a_end), _c(b_start), end_or_open(b_end)
    rules = (
        (e1 < s2, "before"), (s1 > e2, "after"), ((s1 == s2) & (e1 == e2), "equals"),
        (e1 == s2, "meets"), (s1 == e2, "met_by"),
        ((s1 == s2) & (e1 < e2), "starts"), ((s1 == s2) & (e1 > e2), "started_by"),
        ((e1 == e2) & (s1 > s2), "finishes"), ((e1 == e2) & (s1 < s2), "finished_by"),
        ((s1 > s2) & (e1 < e2), "during"), ((s1 < s2) & (e1 > e2), "contains"),
        (s1 < s2, "overlaps"),
    )
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("overlapped_by")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", tolerance_s: int = 0) -> DataFrame:
    """Maximal intervals of each key; intervals that touch, or lie at most ``tolerance_s`` apart, are joined."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end_or_open(end)).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = (reach.isNull() | (_c(start) > reach + F.expr(f"INTERVAL {int(tolerance_s)} SECOND"))).cast("int")
    island = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end_or_open(end)).alias(end), F.count("*").alias("merged")).drop("_island")


def gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Time between the merged intervals of each key."""
    merged = merge_intervals(df, keys, start, end)
    after = F.lead(start).over(W.partitionBy(*keys).orderBy(start))
    return merged.select(*keys, F.col(end).alias("gap_start"), after.alias("gap_end")).where("gap_end IS NOT NULL")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def coverage(df: DataFrame, keys: list[str], low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Share of [low, high) that the intervals of each key cover."""
    cut = df.withColumn(start, F.greatest(_c(start), low)).withColumn(end, F.least(end_or_open(end), high)).where(_c(start) < _c(end))
    length = _micros(F.col(end)) - _micros(F.col(start))
    return merge_intervals(cut, keys, start, end).groupBy(*keys).agg((F.sum(length) / (_micros(high) - _micros(low)).cast("double")).alias("coverage"))


def timeline(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, ts, event): added and removed events of every interval; ends that another start continues are "modified".
    Of intervals with one start the shorter comes first, so reruns agree."""
    order = W.partitionBy(key).orderBy(start, end)
    marked = df.withColumn("_cont", F.lead(start).over(order) == _c(end)).withColumn("_from", F.lag(end).over(order) == _c(start))
    events = F.array(F.struct(_c(start).alias("ts"), F.when(F.col("_from"), "modified").otherwise("added").alias("event")), F.struct(_c(end).alias("ts"), F.lit("removed").alias("event")))
    return marked.withColumn("_e", F.explode(events)).where(~(F.coalesce("_cont", F.lit(False)) & (F.col("_e.event") == "removed")) & F.col("_e.ts").isNotNull()).select(key, "_e.*")


def retroactive(start, end, change: Column) -> Column:
    """How a change from ``change`` on touches an interval."""
    return F.when(_c(start) >= change, "affected").when(end_or_open(end) > change, "partial").otherwise("unaffected")


def snap(start, end, unit: str) -> tuple[Column, Column]:
    """The interval widened to whole units: the end goes to the last microsecond of its unit."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    low = lambda c: F.date_trunc(unit, _c(c)).cast("timestamp_ntz")
    return low(start), low(end) + F.expr(f"INTERVAL 1 {unit}") - F.expr("INTERVAL 1 MICROSECOND")


def at_time(entities: DataFrame, edges: DataFrame, at: Column, axis: str = "valid") -> tuple[DataFrame, DataFrame]:
    """The graph as of a time: entities and edges active on the axis (valid, transaction, both), and of the edges
    those whose ends are there."""
    axes = {"valid": [("valid_from", "valid_until")], "transaction": [("recorded_at", "superseded_at")]}
    axes["both"] = axes["valid"] + axes["transaction"]

    def alive(df: DataFrame) -> DataFrame:
        for low, high in axes[axis]:
            if low in df.columns:
                df = df.where(active_at(low, high if high in df.columns else F.lit(None).cast("timestamp_ntz"), at))
        return df

    # files of ids are small beside the ids in memory: their size must not lead to a broadcast
    nodes, ids = alive(entities), alive(entities).select("id").distinct().hint("merge")
    kept = alive(edges).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, kept


def range_join(left: DataFrame, right: DataFrame, keys: list[str], unit_s: int = 86_400) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) with equal keys that share time; a null end is open, a null
    start or key meets nothing. Closed intervals are cut into bins of ``unit_s`` seconds, joined on the bin, and a pair
    counts only in the bin where it first meets; open ones meet by their keys alone, without bins."""
    def binned(df: DataFrame, p: str) -> DataFrame:
        low, high = (F.floor(_micros(F.col(f"{p}_{x}")) / (unit_s * 1_000_000)).cast("long") for x in ("start", "end"))
        return df.where(F.col(f"{p}_end").isNotNull()).withColumn(f"_{p}low", low).withColumn("_bin", F.explode(F.sequence(low, F.greatest(low, high))))

    meets = (F.col("l_start") < end_or_open("r_end")) & (F.col("r_start") < end_or_open("l_end"))
    both = binned(left, "l").join(binned(right, "r"), [*keys, "_bin"])
    closed = both.where(meets & (F.col("_bin") == F.greatest("_llow", "_rlow"))).drop("_bin", "_llow", "_rlow")
    open_left = left.where("l_end IS NULL").join(right, keys).where(meets)
    open_right = left.where("l_end IS NOT NULL").join(right.where("r_end IS NULL"), keys).where(meets)
    return closed.unionByName(open_left).unionByName(open_right)


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """Every left row with the latest right ``value`` of its key at or before its time: one shuffle on the key, both
    sides in one order, the last value carried on."""
    l = left.select("*", F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    names = [c for c in l.columns if c not in (key, "_ts", "_side", "_v")]
    r = right.select(F.col(key), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = W.partitionBy(key).orderBy("_ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    joined = l.unionByName(r, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return joined.where("_side = 1").select(key, *names, F.col("_v").alias(f"asof_{value}"))


def successors(df: DataFrame, keys: list[str], start: str, end: str, tolerance_s: int) -> DataFrame:
    """Each interval with the earliest later one of its key that starts within ``tolerance_s`` of its end."""
    order = W.partitionBy(*keys).orderBy(start, end)
    nxt = df.withColumn("next_start", F.lead(start).over(order))
    gap = (_micros(F.col("next_start")) - _micros(F.col(end))) / 1_000_000
    return nxt.withColumn("gap_s", gap).where((F.col("gap_s") >= 0) & (F.col("gap_s") <= tolerance_s))


def consistency_issues(edges: DataFrame) -> DataFrame:
    """(issue, source, target, type): inverted intervals, overlaps and gaps among the intervals of one edge."""
    key = ["source", "target", "type"]
    order = W.partitionBy(*key).orderBy("valid_from", "valid_until")
    e = edges.withColumn("_before", F.max(end_or_open("valid_until")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rules = (("inverted_interval", F.col("valid_until") < F.col("valid_from")), ("overlapping_same_edge", F.col("valid_from") < F.col("_before")), ("gap_after_restart", F.col("valid_from") > F.col("_before")))
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return e.select(F.explode(found).alias("issue"), *key)


def evolution(edges: DataFrame, unit: str = "month") -> DataFrame:
    """(period, edges, types, sources): what starts in each period."""
    return edges.groupBy(F.date_format(F.date_trunc(unit, "valid_from"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("edges"), F.countDistinct("type").alias("types"), F.countDistinct("source").alias("sources"))


def evolution_metrics(edges: DataFrame, unit: str = "month") -> DataFrame:
    """(period, edges, diversity, stability): of the distinct edges that start in each period, the entropy of their types in
    bits, and their Jaccard similarity with those of the period before; null for the first. Null times are left out."""
    period = F.date_format(F.date_trunc(unit, "valid_from"), "yyyy-MM-dd").alias("period")
    e = edges.where("valid_from IS NOT NULL").select(period, "source", "target", "type").distinct()
    kinds = e.groupBy("period", "type").agg(F.count("*").alias("_n"))
    total = kinds.groupBy("period").agg(F.sum("_n").alias("edges"), F.sum(F.col("_n") * F.log2("_n")).alias("_nlog"))
    spread = total.select("period", "edges", (F.log2("edges") - F.col("_nlog") / F.col("edges")).alias("diversity"))
    order = W.orderBy("period")
    known = spread.withColumns({"_before": F.lag("period").over(order), "_n": F.lag("edges").over(order)})
    after = known.where("_before IS NOT NULL").select(F.col("_before").alias("period"), F.col("period").alias("_next"))
    kept = e.join(after, "period").select(F.col("_next").alias("period"), "source", "target", "type").join(e, ["period", "source", "target", "type"], "left_semi").groupBy("period").agg(F.count("*").alias("_kept"))
    both = F.coalesce("_kept", F.lit(0))
    return known.join(kept, "period", "left").select("period", "edges", "diversity", F.when(F.col("_before").isNotNull(), both / (F.col("edges") + F.col("_n") - both)).alias("stability"))


def apply_revision(rows: DataFrame, revisions: DataFrame, at: Column) -> DataFrame:
    """Bi-temporal update. ``revisions`` (id, valid_from, valid_until) supersede the current rows of their ids at the
    time ``at``: the old row stays with superseded_at set, a new one with the new valid time follows."""
    new = revisions.select("id", F.col("valid_from").alias("_f"), F.col("valid_until").alias("_u"))
    hit = rows.join(new, "id", "left").withColumn("_hit", F.col("_f").isNotNull() & F.col("superseded_at").isNull())
    old = hit.withColumn("superseded_at", F.when(F.col("_hit"), at).otherwise(F.col("superseded_at"))).select(rows.columns)
    fresh = hit.where("_hit").withColumns({"valid_from": F.col("_f"), "valid_until": F.col("_u"), "recorded_at": at, "superseded_at": F.lit(None).cast("timestamp_ntz"), "id": F.concat("id", F.lit("__rev__"))}).select(rows.columns)
    return old.unionByName(fresh)


#: Relative phrases with the days from the reference date to their first and last day.
PHRASES = {"today": (0, 0), "yesterday": (-1, -1), "tomorrow": (1, 1), "last week": (-7, 0), "last month": (-30, 0), "last year": (-365, 0), "next week": (0, 7), "next month": (0, 30), "next year": (0, 365)}


def normalize_period(text, reference: Column) -> Column:
    """struct(first, last) dates of an expression: ISO date, year, year and quarter, year and month, or a relative
    phrase; null where none fits, as for dates with slashes, whose order is not known."""
    t = F.lower(F.trim(_c(text)))
    year = F.regexp_extract(t, r"^(\d{4})", 1)
    quarter = F.coalesce(F.nullif(F.regexp_extract(t, r"^\d{4}[- ]?q([1-4])$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^q([1-4])[- ]?\d{4}$", 1), F.lit("")))
    q_year = F.regexp_extract(t, r"(\d{4})", 1)
    day = lambda *parts: F.try_to_timestamp(F.concat(*parts), F.lit("yyyy-M-d")).cast("date")
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    q_first = day(q_year, F.lit("-"), (quarter.cast("int") * 3 - 2).cast("string"), F.lit("-1"))
    month_first = day(t, F.lit("-1"))
    out = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), span(day(t), day(t)))
    out = out.when(t.rlike(r"^\d{4}-\d{1,2}$"), span(month_first, F.last_day(month_first)))
    out = out.when(quarter.isNotNull(), span(q_first, F.last_day(F.add_months(q_first, 2))))
    out = out.when(t.rlike(r"^\d{4}$"), span(day(year, F.lit("-1-1")), day(year, F.lit("-12-31"))))
    for phrase, (a, b) in PHRASES.items():
        out = out.when(t == phrase, span(F.date_add(reference, a), F.date_add(reference, b)))
    return out


def temporal_intent(query) -> Column:
    """struct(intent, first, last, rest): what a question says about time: between, before, after, during or at."""
    q = _c(query)
    when = r"(\d{4}(?:-\d{1,2}(?:-\d{1,2})?)?)"
    rules = (("between", rf"(?i)\bbetween\s+{when}\s+and\s+{when}"), ("before", rf"(?i)\b(?:before|until|prior to)\s+{when}"), ("after", rf"(?i)\b(?:after|since)\s+{when}"), ("during", rf"(?i)\b(?:during|in)\s+{when}"), ("at", rf"(?i)\b(?:at|on|as of)\s+{when}"))
    out = None
    for intent, pattern in rules:
        rest = F.trim(F.regexp_replace(F.regexp_replace(q, pattern, ""), r"\s+", " "))
        second = F.regexp_extract(q, pattern, 2) if intent == "between" else F.lit(None).cast("string")
        hit = F.struct(F.lit(intent).alias("intent"), F.regexp_extract(q, pattern, 1).alias("first"), second.alias("last"), rest.alias("rest"))
        out = F.when(q.rlike(pattern), hit) if out is None else out.when(q.rlike(pattern), hit)
    return out
