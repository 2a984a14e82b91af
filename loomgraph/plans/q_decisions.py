"""Decisions: orders as decisions, each customer's orders as chains of causes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import decisions as D
from loomgraph.plans.tables import table
from loomgraph.runtime import materialize

#: Policies as (id, version, category, rules).
POLICIES = (
    ("price", 1, None, {"max_total": 250000.0}),
    ("price", 2, None, {"max_total": 300000.0, "min_total": 2000.0}),
    ("lines", 1, "1-URGENT", {"min_lines": 2.0, "required_discount": 1.0}),
    ("tax", 1, "5-LOW", {"max_tax": 0.07, "lines": 1.0}),
)


def _decisions(spark, d):
    """(id, category, outcome, confidence, ts, entities, scenario) of orders; the entities are the customer and the parts,
    the scenario the words of the parts' names."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    held = lines.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p:"), F.col("l_partkey").cast("string"))).alias("parts"), F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("scenario"))
    o = table(spark, d, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customer = F.array(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")))
    return o.select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("outcome"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"), F.col("o_orderdate").alias("ts"),
        F.concat(customer, F.coalesce("parts", F.array().cast("array<string>"))).alias("entities"), "scenario", "o_custkey", "o_orderkey",
    )


def _rated(spark, d):
    """(id, confidence) of the same decisions: without what their lines hold, no line is read."""
    return table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"))


def _edges(spark, d):
    """From each order to the customer's next one: it caused it if the status is the same, else influenced it; and it is a
    precedent for the customer's next order of its priority."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("weight"))
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    same = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = o.withColumns({"next": F.lead("id").over(w), "status": F.lead("o_orderstatus").over(w), "like": F.lead("id").over(same)})
    caused = o.where("next IS NOT NULL").select(F.col("id").alias("source"), F.col("next").alias("target"), F.when(F.col("status") == F.col("o_orderstatus"), "CAUSED").otherwise("INFLUENCED").alias("type"), "weight")
    return caused.unionByName(o.where("like IS NOT NULL").select(F.col("id").alias("source"), F.col("like").alias("target"), F.lit("PRECEDENT_FOR").alias("type"), "weight"))


def _asked(spark, d):
    """The queries of a search: orders whose key is divisible by 100."""
    return _decisions(spark, d).where("o_orderkey % 100 = 0")


def causal_chain_upstream(spark, d):
    return D.causal_chain(_edges(spark, d), _asked(spark, d), "upstream")


def causal_chain_downstream(spark, d):
    return D.causal_chain(_edges(spark, d), _asked(spark, d), "downstream", 5)


def root_causes(spark, d):
    return D.root_causes(_edges(spark, d), _rated(spark, d), 100)


def causal_loops(spark, d):
    back = _edges(spark, d).where("type = 'PRECEDENT_FOR'").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("CAUSED").alias("type"), "weight")
    return D.causal_loops(_edges(spark, d).unionByName(back), 4).select(F.array_join("path", ">").alias("path"), "length")


def impact_scores(spark, d):
    return D.impact_scores(_edges(spark, d), _rated(spark, d)).select("id", "influenced", "precedents", F.round("score", 9).alias("score"))


def influence_scores(spark, d):
    return D.influences(_decisions(spark, d), _edges(spark, d)).select("source", "target", F.round("score", 9).alias("score"))


def precedents_by_scenario(spark, d):
    held = materialize(_decisions(spark, d).select("id", "category", "scenario", "o_orderkey"), "decisions")
    return D.precedents(held.where("o_orderkey % 100 = 0"), held, 0.3, 5).select("query", "id", F.round("similarity", 9).alias("similarity"), "rank")


def decision_insights(spark, d):
    rows = D.decision_insights(_decisions(spark, d), ["category", "outcome"])
    return rows.select("category", "outcome", "decisions", *[F.round(c, 9).alias(c) for c in ("mean", "least", "most", "median")])


def decisions_connected(spark, d):
    links = _decisions(spark, d).select(F.col("id").alias("source"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("target"))
    return D.connected_decisions(links, _decisions(spark, d), _asked(spark, d), 2)


def causal_distance(spark, d):
    found = D.causal_paths(_edges(spark, d), _asked(spark, d), 4)
    return found.select("origin", "id", "hops", F.round("decay", 9).alias("decay"), F.col("weakest.source").alias("weakest_source"), F.round("weakest.weight", 9).alias("weakest_weight"))


def _facts(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_tax").alias("tax"), F.max("l_discount").alias("discount"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    facts = F.create_map(F.lit("total"), F.col("o_totalprice"), F.lit("lines"), F.col("n").cast("double"), F.lit("tax"), F.col("tax"), F.lit("discount"), F.col("discount"))
    return o.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("category"), F.map_filter(facts, lambda k, v: v.isNotNull()).alias("facts"))


def _policies(spark):
    return spark.createDataFrame(list(POLICIES), "policy_id string, version int, category string, rules map<string,double>")


def policy_versions(spark, d):
    found = D.compliance(_facts(spark, d), _policies(spark))
    return found.groupBy("policy_id", "version", F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("decisions"))


def policy_change_impact(spark, d):
    return D.policy_impact(_facts(spark, d), _policies(spark), "price", {"max_total": 200000.0})


Q = causal_chain_upstream, causal_chain_downstream, root_causes, causal_loops, impact_scores, influence_scores, precedents_by_scenario, decision_insights, decisions_connected, causal_distance, policy_versions, policy_change_impact
QUERIES = {f.__name__: f for f in Q}

X = """o AS (SELECT 'o:' || o_orderkey AS id, o_orderkey AS k, o_custkey AS c, o_orderdate AS ts, o_orderstatus AS st, o_orderpriority AS pr, least(1.0::DOUBLE, o_totalprice / 500000) AS conf FROM orders),
n AS (SELECT *, lead(id) OVER w AS nx, lead(st) OVER w AS ns, lead(id) OVER v AS lk FROM o WINDOW w AS (PARTITION BY c ORDER BY ts, k), v AS (PARTITION BY c, pr ORDER BY ts, k)),
e AS (SELECT id AS s, nx AS t, CASE WHEN ns = st THEN 'CAUSED' ELSE 'INFLUENCED' END AS type, conf AS w FROM n WHERE nx IS NOT NULL UNION ALL SELECT id, lk, 'PRECEDENT_FOR', conf FROM n WHERE lk IS NOT NULL),
ef AS (SELECT DISTINCT s, t FROM e WHERE type <> 'PRECEDENT_FOR')"""
R = f"WITH RECURSIVE {X}"
_SETS = """pn AS (SELECT l_orderkey AS k, list_distinct(list('p:' || l_partkey)) AS parts, array_to_string(list_sort(list_distinct(list(p_name))), ' ') AS scenario FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
dec AS (SELECT o.*, list_concat(['c:' || c], coalesce(parts, [])) AS ents, scenario, list_filter(list_distinct(regexp_split_to_array(lower(coalesce(scenario, '')), '\\s+')), lambda x: x <> '') AS ws FROM o LEFT JOIN pn ON o.k = pn.k)"""
_DOWN = lambda edges, name, rounds, seeds: f"{name}(origin, id, d) AS (SELECT id, id, 0 FROM o WHERE {seeds} UNION SELECT origin, t, d + 1 FROM {name} JOIN {edges} ON id = s WHERE d < {rounds})"
_UP = lambda edges, name, rounds, seeds: f"{name}(origin, id, d) AS (SELECT id, id, 0 FROM o WHERE {seeds} UNION SELECT origin, s, d + 1 FROM {name} JOIN {edges} ON id = t WHERE d < {rounds})"
_FACTS = "f AS (SELECT 'o:' || o_orderkey AS id, o_orderpriority AS pr, o_totalprice AS total, n, tax, discount FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_tax) AS tax, max(l_discount) AS discount FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
ORACLE_SQL = {
    "causal_chain_upstream": f"{R}, {_UP('e', 'r', 10, 'k % 100 = 0')} SELECT origin, id, min(d)::INT AS distance FROM r WHERE origin <> id GROUP BY ALL",
    "causal_chain_downstream": f"{R}, {_DOWN('e', 'r', 5, 'k % 100 = 0')} SELECT origin, id, min(d)::INT AS distance FROM r WHERE origin <> id GROUP BY ALL",
    "root_causes": f"{R}, {_UP('ef', 'r', 100, 'true')} SELECT origin, id, min(d)::INT AS distance FROM r WHERE origin <> id AND id NOT IN (SELECT t FROM ef) GROUP BY ALL",
    "causal_loops": f"""{R}, x AS (SELECT s, t FROM ef UNION SELECT t, s FROM e WHERE type = 'PRECEDENT_FOR'),
      p(path, l) AS (SELECT [s, t], t FROM x WHERE s < t UNION ALL SELECT list_append(path, t), t FROM p JOIN x ON l = s WHERE t > path[1] AND NOT list_contains(path, t) AND len(path) < 4)
      SELECT array_to_string(path, '>') AS path, len(path)::INT AS length FROM p JOIN x ON l = x.s AND x.t = path[1]""",
    "impact_scores": f"""{R}, {_DOWN('ef', 'r', 5, 'true')}, pf AS (SELECT DISTINCT s, t FROM e WHERE type = 'PRECEDENT_FOR'), {_UP('pf', 'u', 5, 'true')},
      a AS (SELECT origin, count(*) AS n, sum(conf) AS z FROM (SELECT DISTINCT origin, id FROM r WHERE origin <> id) x JOIN o ON o.id = x.id GROUP BY 1),
      b AS (SELECT origin, count(*) AS n, sum(conf) AS z FROM (SELECT DISTINCT origin, id FROM u WHERE origin <> id) x JOIN o ON o.id = x.id GROUP BY 1)
      SELECT o.id, coalesce(a.n, 0) AS influenced, coalesce(b.n, 0) AS precedents, round(least(1.0::DOUBLE, (coalesce(a.z, 0) + 0.5::DOUBLE * coalesce(b.z, 0)) / (greatest(coalesce(a.n, 0), 1) + 0.5::DOUBLE * greatest(coalesce(b.n, 0), 1))), 9) AS score
      FROM o LEFT JOIN a ON a.origin = o.id LEFT JOIN b ON b.origin = o.id""",
    "influence_scores": f"""WITH {X}, {_SETS} SELECT x.s AS source, x.t AS target, round(0.5::DOUBLE * len(list_intersect(a.ents, b.ents)) / greatest(len(list_distinct(a.ents)), 1) + 0.3::DOUBLE * (a.pr = b.pr)::INT + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(epoch_us(a.ts) - epoch_us(b.ts)) / (86400000000.0::DOUBLE * 30)), 9) AS score
      FROM (SELECT DISTINCT s, t FROM e) x JOIN dec a ON a.id = x.s JOIN dec b ON b.id = x.t""",
    "precedents_by_scenario": f"""WITH {X}, {_SETS}, m AS (SELECT a.id AS query, b.id, 0.7::DOUBLE * (len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::DOUBLE) AS sim FROM dec a JOIN dec b ON a.pr = b.pr AND a.id <> b.id WHERE a.k % 100 = 0 AND len(a.ws) > 0 AND len(b.ws) > 0)
      SELECT query, id, round(sim, 9) AS similarity, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id)::INT AS rank FROM m WHERE sim >= 0.3 - 1e-12 QUALIFY rank <= 5""",
    "decision_insights": f"WITH {X} SELECT pr AS category, st AS outcome, count(*) AS decisions, round(avg(conf), 9) AS mean, round(min(conf), 9) AS least, round(max(conf), 9) AS most, round(list_sort(list(conf))[count(*) // 2 + 1], 9) AS median FROM o GROUP BY 1, 2",
    "decisions_connected": f"WITH {X} SELECT a.id AS origin, b.id, 2::INT AS hop FROM o a JOIN o b ON a.c = b.c AND a.id <> b.id WHERE a.k % 100 = 0",
    "causal_distance": f"""{R}, g AS (SELECT s, t, max(w) AS w FROM e GROUP BY 1, 2),
      p(origin, id, path, hops, decay, ws, ww) AS (SELECT id, id, [id], 0, 1.0::DOUBLE, NULL::VARCHAR, NULL::DOUBLE FROM o WHERE k % 100 = 0
        UNION ALL SELECT origin, t, list_append(path, t), hops + 1, decay * w, CASE WHEN ww IS NULL OR w < ww THEN s ELSE ws END, CASE WHEN ww IS NULL OR w < ww THEN w ELSE ww END FROM p JOIN g ON id = s WHERE hops < 4)
      SELECT origin, id, hops::INT AS hops, round(decay, 9) AS decay, ws AS weakest_source, round(ww, 9) AS weakest_weight FROM p WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY origin, id ORDER BY hops, path) = 1""",
    "policy_versions": f"""WITH {_FACTS}, v AS (
        SELECT 'price' AS policy_id, 2 AS version, concat_ws(',', CASE WHEN total > 300000 THEN 'max_total' END, CASE WHEN total IS NULL OR total < 2000 THEN 'min_total' END) AS violations FROM f
        UNION ALL SELECT 'lines', 1, concat_ws(',', CASE WHEN n IS NULL OR n < 2 THEN 'min_lines' END, CASE WHEN discount IS NULL THEN 'required_discount' END) FROM f WHERE pr = '1-URGENT'
        UNION ALL SELECT 'tax', 1, concat_ws(',', CASE WHEN n IS NULL THEN 'lines' END, CASE WHEN tax > 0.07 THEN 'max_tax' END) FROM f WHERE pr = '5-LOW')
      SELECT policy_id, version::INT AS version, violations, count(*) AS decisions FROM v GROUP BY ALL""",
    "policy_change_impact": f"WITH {_FACTS}, x AS (SELECT id, NOT (total > 300000 OR total < 2000) AS before, NOT (total > 200000) AS after FROM f) SELECT * FROM x WHERE before <> after",
}
