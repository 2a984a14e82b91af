"""Temporal queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import temporal as T
from loomgraph.plans.tables import SQL, entities, relationships, table

ts = lambda s: F.lit(s).cast("timestamp_ntz")
text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _orders(spark, d):
    """Orders as intervals: from the order to the last shipment of the order."""
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"))
    o = table(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("start"), "end").where("start < end")


def _sessions(spark, d):
    """Events as intervals of half a day."""
    e = table(spark, d, "events")
    return e.select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 12 HOUR")).alias("end"))


def active_at_time(spark, d):
    return _orders(spark, d).where(T.active_at("start", "end", ts("1998-06-01 00:00:00"))).select("id", "cust")


def time_range_overlap(spark, d):
    return _orders(spark, d).where(T.overlaps("start", "end", ts("1998-01-01 00:00:00"), ts("1998-02-01 00:00:00"), meets=True)).select("id")


def time_range_covers(spark, d):
    return _orders(spark, d).where(T.covers("start", "end", ts("1998-01-10 00:00:00"), ts("1998-01-20 00:00:00"))).select("id")


def allen_relations(spark, d):
    o = _orders(spark, d)
    w = W.partitionBy("cust").orderBy("start", "id")
    pairs = o.withColumns({"s2": F.lead("start").over(w), "e2": F.lead("end").over(w)}).where("s2 IS NOT NULL")
    return pairs.groupBy(T.allen_relation("start", "end", "s2", "e2").alias("relation")).agg(F.count("*").alias("pairs"))


def merge_intervals_per_user(spark, d):
    return T.merge_intervals(_sessions(spark, d), ["user_id"]).select("user_id", text("start"), text("end"), "merged")


def gap_analysis_per_user(spark, d):
    return T.gaps(_sessions(spark, d), ["user_id"]).select("user_id", text("gap_start"), text("gap_end"))


def coverage_pct(spark, d):
    return T.coverage(_sessions(spark, d), ["user_id"], ts("2024-01-05 00:00:00"), ts("2024-01-25 00:00:00")).select("user_id", F.round("coverage", 6).alias("coverage"))


def timeline_of_customer(spark, d):
    return T.timeline(_orders(spark, d), "cust").select("cust", text("ts"), "event")


def retroactive_coverage(spark, d):
    return _orders(spark, d).groupBy(T.retroactive("start", "end", ts("1998-06-01 00:00:00")).alias("effect")).agg(F.count("*").alias("n"))


def snap_to_month(spark, d):
    a, b = T.snap("start", "end", "month")
    o = _orders(spark, d).select("id", a.alias("low"), b.alias("high"))
    return o.select("id", text("low"), F.date_format("high", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("high"))


def graph_at_time(spark, d):
    _, e = T.at_time(entities(spark, d), relationships(spark, d).withColumn("valid_until", F.col("valid_from") + F.expr("INTERVAL 400 DAY")), ts("1996-06-01 00:00:00"))
    return e.select("source", "target", "type")


def range_join_orders(spark, d):
    o = _orders(spark, d)
    l = o.select("cust", F.col("id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    r = o.select("cust", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return T.range_join(l, r, ["cust"], 30 * 86_400).where("l_id < r_id").select("cust", "l_id", "r_id")


def range_join_open(spark, d):
    """Orders that have not ended by 2000 are open."""
    o = _orders(spark, d).withColumn("end", F.when(F.col("end") < ts("2000-01-01 00:00:00"), F.col("end")))
    l = o.select("cust", F.col("id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    r = o.select("cust", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return T.range_join(l, r, ["cust"], 30 * 86_400).where("l_id < r_id").select("cust", "l_id", "r_id")


def asof_last_click(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click"))
    return T.as_of(left, right, "user_id", "ts", "ts", "click").select("user_id", "event_id", "asof_click")


def sequence_pairs(spark, d):
    return T.successors(_orders(spark, d), ["cust"], "start", "end", 20 * 86_400).select("cust", "id", text("next_start"))


def evolution_by_month(spark, d):
    return T.evolution(relationships(spark, d).where("valid_from IS NOT NULL"))


def temporal_issues(spark, d):
    o = _orders(spark, d).select(F.concat(F.lit("c:"), "cust").alias("source"), F.lit("shop").alias("target"), F.lit("ordered").alias("type"), F.col("start").alias("valid_from"), F.col("end").alias("valid_until"))
    return T.consistency_issues(o).groupBy("issue").agg(F.count("*").alias("n"))


def revision_supersedes(spark, d):
    none = F.lit(None).cast("timestamp_ntz")
    o = _orders(spark, d).select(F.concat(F.lit("o"), "id").alias("id"), F.col("start").alias("valid_from"), F.col("end").alias("valid_until"), F.col("start").alias("recorded_at"), none.alias("superseded_at"))
    r = o.where("id LIKE '%7'").select("id", "valid_from", (F.col("valid_until") + F.expr("INTERVAL 10 DAY")).alias("valid_until"))
    out = T.apply_revision(o, r, ts("2002-01-01 00:00:00"))
    return out.select("id", *[text(c) for c in ("valid_from", "valid_until", "recorded_at", "superseded_at")])


def period_expressions(spark, d):
    """The day of each order, its month, quarter (in two forms) and year, and what is none of these."""
    day = F.col("o_orderdate").cast("date")
    year, quarter = F.year(day).cast("string"), F.concat(F.lit("q"), F.quarter(day).cast("string"))
    forms = [F.date_format(day, "yyyy-MM-dd"), F.concat(year, F.lit("-"), F.month(day).cast("string")), F.concat(year, F.lit(" "), quarter), F.concat(quarter, F.lit(" "), year), year, F.date_format(day, "dd/MM/yyyy")]
    expression = F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int"))
    p = T.normalize_period("expression", F.lit("1998-06-01").cast("date"))
    found = table(spark, d, "orders").select("o_orderkey", expression.alias("expression"))
    return found.select("o_orderkey", "expression", F.date_format(p["first"], "yyyy-MM-dd").alias("first"), F.date_format(p["last"], "yyyy-MM-dd").alias("last"))


def temporal_intents(spark, d):
    """Questions about the day, month or year of each order."""
    day = F.col("o_orderdate").cast("date")
    year, month, date = F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy-MM-dd")
    forms = [F.concat(F.lit("orders between "), year, F.lit(" and "), date), F.concat(F.lit("parts shipped before "), date), F.concat(F.lit("who supplied since "), month), F.concat(F.lit("customers during "), year, F.lit(" alone")), F.concat(F.lit("state as of "), date), F.lit("all nations")]
    question = F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.temporal_intent(question).alias("x")).select("o_orderkey", "x.*")


Q = active_at_time, time_range_overlap, time_range_covers, allen_relations, merge_intervals_per_user, gap_analysis_per_user, coverage_pct, timeline_of_customer, retroactive_coverage, snap_to_month, graph_at_time, range_join_orders, range_join_open, asof_last_click, sequence_pairs, evolution_by_month, temporal_issues, revision_supersedes, period_expressions, temporal_intents
QUERIES = {f.__name__: f for f in Q}

O = 'WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate AS s, e FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderdate < e)'
S = 'WITH v AS (SELECT user_id, ts AS s, ts + INTERVAL 12 HOUR AS e FROM events)'
ISL = "r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r), m AS (SELECT user_id, k, min(s) AS s, max(e) AS e, count(*) AS merged FROM i GROUP BY 1, 2)"
fmt = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
ALLEN = "CASE WHEN e < s2 THEN 'before' WHEN s > e2 THEN 'after' WHEN s = s2 AND e = e2 THEN 'equals' WHEN e = s2 THEN 'meets' WHEN s = e2 THEN 'met_by' WHEN s = s2 AND e < e2 THEN 'starts' WHEN s = s2 THEN 'started_by' WHEN e = e2 AND s > s2 THEN 'finishes' WHEN e = e2 THEN 'finished_by' WHEN s > s2 AND e < e2 THEN 'during' WHEN s < s2 AND e > e2 THEN 'contains' WHEN s < s2 THEN 'overlaps' ELSE 'overlapped_by' END"
ORACLE_SQL = {
    "active_at_time": f"{O} SELECT id, cust FROM o WHERE s <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' < e",
    "time_range_overlap": f"{O} SELECT id FROM o WHERE s <= TIMESTAMP '1998-02-01' AND e >= TIMESTAMP '1998-01-01'",
    "time_range_covers": f"{O} SELECT id FROM o WHERE s <= TIMESTAMP '1998-01-10' AND e >= TIMESTAMP '1998-01-20'",
    "allen_relations": f"{O}, p AS (SELECT *, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM o WINDOW w AS (PARTITION BY cust ORDER BY s, id)) SELECT {ALLEN} AS relation, count(*) AS pairs FROM p WHERE s2 IS NOT NULL GROUP BY 1",
    "merge_intervals_per_user": f'{S}, {ISL} SELECT user_id, {fmt("s")} AS start, {fmt("e")} AS "end", merged FROM m',
    "gap_analysis_per_user": f"{S}, {ISL}, g AS (SELECT user_id, e AS a, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS b FROM m) SELECT user_id, {fmt('a')} AS gap_start, {fmt('b')} AS gap_end FROM g WHERE b IS NOT NULL",
    "coverage_pct": f"WITH v AS (SELECT user_id, greatest(ts, TIMESTAMP '2024-01-05') AS s, least(ts + INTERVAL 12 HOUR, TIMESTAMP '2024-01-25') AS e FROM events WHERE greatest(ts, TIMESTAMP '2024-01-05') < least(ts + INTERVAL 12 HOUR, TIMESTAMP '2024-01-25')), {ISL} SELECT user_id, round(sum(epoch_us(e) - epoch_us(s)) / (20 * 86400e6), 6) AS coverage FROM m GROUP BY 1",
    "timeline_of_customer": f"{O}, x AS (SELECT *, lead(s) OVER w = e AS c, lag(e) OVER w = s AS f FROM o WINDOW w AS (PARTITION BY cust ORDER BY s)) SELECT cust, {fmt('s')} AS ts, CASE WHEN f THEN 'modified' ELSE 'added' END AS event FROM x UNION ALL SELECT cust, {fmt('e')}, 'removed' FROM x WHERE NOT coalesce(c, false)",
    "retroactive_coverage": f"{O} SELECT CASE WHEN s >= TIMESTAMP '1998-06-01' THEN 'affected' WHEN e > TIMESTAMP '1998-06-01' THEN 'partial' ELSE 'unaffected' END AS effect, count(*) AS n FROM o GROUP BY 1",
    "snap_to_month": f"{O} SELECT id, {fmt('date_trunc($$month$$, s)')} AS low, strftime(date_trunc('month', e) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS high FROM o",
    "graph_at_time": f"WITH {SQL} SELECT source, target, type FROM rels WHERE valid_from IS NULL OR (valid_from <= TIMESTAMP '1996-06-01' AND TIMESTAMP '1996-06-01' < valid_from + INTERVAL 400 DAY)",
    "range_join_orders": f"{O} SELECT a.cust, a.id AS l_id, b.id AS r_id FROM o a JOIN o b ON a.cust = b.cust AND a.id < b.id AND a.s < b.e AND b.s < a.e",
    "range_join_open": f"{O}, v AS (SELECT id, cust, s, CASE WHEN e < TIMESTAMP '2000-01-01' THEN e ELSE TIMESTAMP '9999-12-31' END AS e FROM o) SELECT a.cust, a.id AS l_id, b.id AS r_id FROM v a JOIN v b ON a.cust = b.cust AND a.id < b.id AND a.s < b.e AND b.s < a.e",
    "asof_last_click": "WITH c AS (SELECT user_id, ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT p.user_id, p.event_id, c.click AS asof_click FROM events p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts WHERE p.event_type = 'purchase'",
    "sequence_pairs": f"{O}, x AS (SELECT *, lead(s) OVER (PARTITION BY cust ORDER BY s, e) AS n FROM o) SELECT cust, id, {fmt('n')} AS next_start FROM x WHERE n >= e AND n <= e + INTERVAL 20 DAY",
    "evolution_by_month": f"WITH {SQL} SELECT strftime(date_trunc('month', valid_from), '%Y-%m-%d') AS period, count(*) AS edges, count(DISTINCT type) AS types, count(DISTINCT source) AS sources FROM rels WHERE valid_from IS NOT NULL GROUP BY 1",
    "temporal_issues": f"{O}, x AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o) SELECT issue, count(*) AS n FROM (SELECT CASE WHEN s < b THEN 'overlapping_same_edge' WHEN s > b THEN 'gap_after_restart' END AS issue FROM x) WHERE issue IS NOT NULL GROUP BY 1",
    "revision_supersedes": f"{O}, r AS (SELECT 'o' || id AS id, s, e FROM o) SELECT id, {fmt('s')} AS valid_from, {fmt('e')} AS valid_until, {fmt('s')} AS recorded_at, CASE WHEN id LIKE '%7' THEN '2002-01-01 00:00:00' END AS superseded_at FROM r UNION ALL SELECT id || '__rev__', {fmt('s')}, {fmt('e + INTERVAL 10 DAY')}, '2002-01-01 00:00:00', NULL FROM r WHERE id LIKE '%7'",
    "period_expressions": """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate::DATE AS d FROM orders),
  x AS (SELECT *, CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' WHEN 3 THEN 'quarter' WHEN 4 THEN 'year' END AS unit FROM o)
  SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN year(d) || '-' || month(d) WHEN 2 THEN year(d) || ' q' || quarter(d) WHEN 3 THEN 'q' || quarter(d) || ' ' || year(d) WHEN 4 THEN year(d)::VARCHAR ELSE strftime(d, '%d/%m/%Y') END AS expression,
    CASE WHEN k < 5 THEN strftime(date_trunc(coalesce(unit, 'day'), d), '%Y-%m-%d') END AS first,
    strftime(CASE unit WHEN 'day' THEN d WHEN 'month' THEN last_day(d) WHEN 'quarter' THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY WHEN 'year' THEN date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY END, '%Y-%m-%d') AS last FROM x""",
    "temporal_intents": """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
  SELECT o_orderkey, ['between', 'before', 'after', 'during', 'at', NULL][k + 1] AS intent, [y, d, m, y, d, NULL][k + 1] AS first, CASE WHEN k = 0 THEN d END AS last, ['orders', 'parts shipped', 'who supplied', 'customers alone', 'state', NULL][k + 1] AS rest FROM o""",
}
