"""Graph, interval, duplicate and decision operators against brute force on small random inputs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import decisions as D
from loomgraph.operators import dedup as E
from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import search as H
from loomgraph.operators import temporal as T
from loomgraph.operators import text as X
from loomgraph.plans import q_graph as Q


def some_graph(seed: int, n: int = 14, m: int = 17) -> list[tuple[str, str]]:
    r = random.Random(seed)
    return [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)]


def neighbours(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def distances(nb, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in nb[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


@pytest.fixture(scope="module")
def frames(spark):
    return {seed: spark.createDataFrame(some_graph(seed), "source string, target string") for seed in (1, 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges(frames, seed):
    nb = neighbours(some_graph(seed))
    want = set()
    for a in nb:
        for b in nb[a]:
            if a < b:
                cut = {x: y - ({b} if x == a else {a} if x == b else set()) for x, y in nb.items()}
                if b not in distances(cut, a):
                    want.add((a, b))
    assert {tuple(r) for r in G.bridges(frames[seed]).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_centralities(frames, seed):
    nb = neighbours(some_graph(seed))
    d = {a: distances(nb, a) for a in nb}
    got = {r["node"]: r["closeness"] for r in G.closeness(frames[seed]).collect()}
    for a in nb:
        reached, total = len(d[a]) - 1, sum(d[a].values())
        assert abs(got[a] - reached / total * reached / (len(nb) - 1)) < 1e-9
    pairs = [x for a in nb for b, x in d[a].items() if a != b]
    mean = G.average_path_length(frames[seed]).first()
    assert mean["pairs"] == len(pairs) and abs(mean["mean_length"] - sum(pairs) / len(pairs)) < 1e-9
    between = Counter()
    for a, b in itertools.permutations(nb, 2):
        if b in d[a]:
            paths = [[a]]
            while paths[0][-1] != b:
                paths = [[*p, y] for p in paths for y in nb[p[-1]] if d[a][y] == d[a][p[-1]] + 1 and b in d[y] and d[y][b] == d[a][b] - d[a][y]]
            for p in paths:
                for v in p[1:-1]:
                    between[v] += 1 / len(paths) / 2
    found = {r["node"]: r["betweenness"] for r in G.betweenness(frames[seed]).collect()}
    assert all(abs(found.get(v, 0) - between[v]) < 1e-9 for v in nb)


def test_paths(spark):
    r = random.Random(5)
    edges = [(f"v{r.randrange(7)}", f"v{r.randrange(7)}", float(r.randrange(1, 6))) for _ in range(18)]
    df = spark.createDataFrame(edges, "source string, target string, weight double")
    least = {}
    for a, b, w in edges:
        least[a, b] = min(w, least.get((a, b), w))
    simple, todo = [], [(["v0"], 0.0)]
    while todo:
        path, cost = todo.pop()
        if path[-1] == "v3" and len(path) > 1:
            simple.append((cost, path))
            continue
        todo += [([*path, b], cost + w) for (a, b), w in least.items() if a == path[-1] and b not in path]
    want = sorted(simple)[:4]
    assert [(r["cost"], r["path"]) for r in G.k_shortest_paths(df, "v0", "v3", 4).orderBy("cost", "path").collect()] == want
    fewest = min((len(p) for _, p in simple), default=0)
    assert {tuple(r["path"]) for r in G.all_shortest_paths(df, "v0", "v3").collect()} == {tuple(p) for _, p in simple if len(p) == fewest}
    assert G.all_shortest_paths(df, "v0", "nowhere").collect() == []
    cheapest = {r["node"]: r["cost"] for r in G.shortest_paths(df, spark.createDataFrame([("v0",)], "node string")).collect()}
    assert not want or cheapest["v3"] == want[0][0]


def test_long_chains_come_to_their_end(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(12)], "source string, target string")
    assert G.in_cycles(chain).collect() == []
    loop = chain.unionByName(spark.createDataFrame([("n005", "n002")], "source string, target string"))
    assert {r[0] for r in G.in_cycles(loop).collect()} == {"n002", "n003", "n004", "n005"}
    assert O.lineage(chain.toDF("id", "parent")).count() == 12 * 13 // 2


def test_preferential_pairs(spark):
    r = random.Random(8)
    edges = [(f"h{i % 3}", f"v{r.randrange(40)}") for i in range(90)] + [(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(30)]
    nb = neighbours(edges)
    want = sorted((-len(nb[a]) * len(nb[b]), a, b) for a in nb for b in nb if a < b and b not in nb[a])[:7]
    got = G.top_preferential(spark.createDataFrame(edges, "source string, target string"), 7)
    assert sorted((-r["score"], r["a"], r["b"]) for r in got.collect()) == want


def test_link_scores_of_wide_nodes(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 4)
    edges = [("hub", f"v{i}") for i in range(11)] + [("other", f"v{i}") for i in range(3)]
    got = {(r["a"], r["b"]): r["common"] for r in G.link_scores(spark.createDataFrame(edges, "source string, target string")).collect()}
    nb = neighbours(edges)
    assert got == {(a, b): len(nb[a] & nb[b]) for a in nb for b in nb if a < b and b not in nb[a] and nb[a] & nb[b]}


def test_walks_follow_edges(spark):
    edges = some_graph(3)
    nb = neighbours(edges)
    walks = [r["walk"] for r in G.random_walks(spark.createDataFrame(edges, "source string, target string"), 6, 3).collect()]
    assert Counter(w[0] for w in walks) == {v: 3 for v in nb}
    assert all(len(w) == 6 and all(b in nb[a] for a, b in zip(w, w[1:], strict=False)) for w in walks)


def test_range_join_with_open_ends(spark):
    r = random.Random(2)
    rows = [(i, "k" if i % 5 else None, s, None if r.random() < 0.3 else s + r.randrange(1, 9)) for i in range(30) for s in [r.randrange(20)]]
    at = lambda p: spark.createDataFrame([(k, i, s, e) for i, k, s, e in rows], f"key string, {p}_id long, s long, e long").selectExpr("key", f"{p}_id", f"timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, int(s)) AS {p}_start", f"timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, int(e)) AS {p}_end")
    got = sorted((x["l_id"], x["r_id"]) for x in T.range_join(at("l"), at("r"), ["key"], 3 * 86_400).collect())
    end = lambda e: 10**6 if e is None else e
    assert got == sorted((i, j) for i, k, s, e in rows for j, k2, s2, e2 in rows if k and k == k2 and s < end(e2) and s2 < end(e))


def test_copies_and_short_names_meet(spark):
    copies = spark.createDataFrame([(i, "T", " Acme Works") for i in range(50)] + [(100, "T", "acme wörks"), (101, "U", "Acme Works"), (102, "T", None)], "id long, type string, name string")
    pairs = {tuple(r) for r in E.block_pairs(copies).collect()}
    assert {(0, i) for i in range(1, 50)} <= pairs and len(pairs) <= 51
    new = spark.createDataFrame([(1, "T", "HP"), (2, "T", "王芳"), (3, "T", "Jhonson"), (4, "T", "zzz")], "id long, type string, name string")
    old = spark.createDataFrame([(11, "T", "hp"), (12, "T", "王芳"), (13, "T", "Johnson"), (14, "V", "HP"), (15, "T", None), (16, "T", "HP")], "id long, type string, name string")
    assert {(r["l_id"], r["r_id"]) for r in E.detect_incremental(new, old).collect()} == {(1, 11), (1, 16), (2, 12), (3, 13)}


def test_groups_take_new_candidates(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "id long, group long")
    cands = spark.createDataFrame([(2, 4), (5, 9)], "l_id long, r_id long")
    assert {tuple(r) for r in E.update_groups(members, cands).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (9, 5)}


def test_chains_loops_and_missing_facts(spark):
    edges = spark.createDataFrame([("a", "b", "CAUSED", 0.5), ("b", "c", "INFLUENCED", 0.4), ("c", "a", "CAUSED", 0.9), ("b", "d", "SEEN", 1.0), (None, "a", "CAUSED", 1.0), ("c", "e", "PRECEDENT_FOR", 0.2)], "source string, target string, type string, weight double")
    seeds = spark.createDataFrame([("a",), (None,)], "id string")
    assert {(r["id"], r["distance"]) for r in D.causal_chain(edges, seeds, "downstream").collect()} == {("b", 1), ("c", 2), ("e", 3)}
    assert [(r["path"], r["length"]) for r in D.causal_loops(edges).collect()] == [(["a", "b", "c"], 3)]
    path = {r["id"]: r for r in D.causal_paths(edges, seeds.where("id IS NOT NULL")).collect()}["e"]
    assert path["path"] == ["a", "b", "c", "e"] and abs(path["decay"] - 0.04) < 1e-12 and path["weakest"]["weight"] == 0.2
    with pytest.raises(ValueError):
        D.causal_chain(edges, seeds, "sideways")
    facts = spark.createDataFrame([("x", "k", {"n": 3.0}), ("y", None, {})], "id string, category string, facts map<string,double>")
    policies = D.add_policy(D.add_policy(spark.createDataFrame([], "policy_id string, version int, category string, rules map<string,double>"), "p", {"max_n": 1.0}, None), "p", {"min_n": 2.0, "known": 1.0}, None)
    got = {r["id"]: (r["version"], r["violations"]) for r in D.compliance(facts, policies).collect()}
    assert got == {"x": (2, ["known"]), "y": (2, ["known", "min_n"])}


def test_pages_and_deltas(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(10)], "a long, b long")
    seen, after = [], None
    while batch := [tuple(r) for r in H.page(rows, ["a", "b"], after, 4).collect()]:
        seen, after = seen + batch, batch[-1]
    assert seen == sorted((i % 3, i) for i in range(10))
    t = lambda *x: spark.createDataFrame(x, "subject string, predicate string, object string")
    assert {tuple(r) for r in H.triple_delta(t(("a", "p", None), ("b", "p", "c"), ("b", "p", "c")), t(("a", "p", None), ("d", "p", "e"))).collect()} == {("removed", "b", "p", "c"), ("added", "d", "p", "e")}


def test_chunks_cover_their_texts():
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice(["word ", "x" * 30, ". ", "\n", "\n\n", "é"]) for _ in range(r.randrange(60)))
        spans = X.split_recursively(text, 40)
        assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= 40 for a, b in spans)
        windows = X.slide(text, 40, 10)
        assert (not text and not windows) or (windows[0][0] == 0 and windows[-1][1] == len(text))
        assert all(b - a <= 40 and c <= b and c > a for (a, b), (c, _) in zip(windows, windows[1:], strict=False))


def test_triangle_communities(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "f"), ("e", "g"), ("f", "g"), ("x", "y"), ("a", "a")]
    got = {}
    for r in G.triangle_communities(spark.createDataFrame(edges, "source string, target string")).collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert got == {"a": {"a", "b", "c", "d"}, "e": {"e", "f", "g"}}


def test_shapes_and_their_violations(spark):
    entities = spark.createDataFrame([("1", "T", "n"), ("2", "T", None), ("3", "U", " N "), (None, None, "x")], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "3", "likes"), ("1", "3", "likes"), ("1", "9", "knows"), ("2", "3", "likes"), (None, "3", "likes")], "source string, target string, type string")
    shapes = O.shapes(entities, edges)
    assert {(r["class"], r["property"], r["min_count"], r["max_count"], tuple(r["ranges"])) for r in shapes.collect()} == {("T", "likes", 1, 2, ("U",)), ("T", "knows", 0, 1, ())}
    less = edges.where("source <> '2'").unionByName(spark.createDataFrame([("1", "1", "likes")], "source string, target string, type string"))
    found = {tuple(r) for r in O.shape_violations(entities, less, shapes).collect()}
    assert found == {("2", "likes", "min_count"), ("1", "likes", "max_count"), ("1", "likes", "class"), ("1", "knows", "class")}
    uris = [r[0] for r in entities.select(O.entity_uri("http://x")).collect()]
    assert uris[0].startswith("http://x/T/") and uris[1] is None and uris[0][-16:] == uris[2][-16:] and uris[3].startswith("http://x/entity/")


def _distances(edges):
    """All distances of an undirected graph, by plain search: {origin: {node: d}}."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    out = {}
    for o in near:
        out[o], queue = {o: 0}, [o]
        for x in queue:
            for y in near[x] - out[o].keys():
                out[o][y] = out[o][x] + 1
                queue.append(y)
    return out


def _tangled():
    """Two cycles with trees on them, joined by a path, beside a tree, a pair, a star and a self-loop."""
    draw = random.Random(11)
    edges = [("c0", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c0"), ("c2", "m1"), ("m1", "m2"), ("m2", "d0"), ("d0", "d1"), ("d1", "d2"), ("d2", "d0"), ("d0", "c0")]
    held = ["c1", "c2", "m1", "d1"]
    for i in range(14):
        edges.append((draw.choice(held), f"t{i}"))
        held.append(f"t{i}")
    edges += [("u0", "u1"), ("u1", "u2"), ("u2", "u3"), ("u1", "u4"), ("u4", "u5"), ("v0", "v1"), ("z", "z")] + [("w", f"w{i}") for i in range(6)]
    return edges


def test_sums_of_paths_fold_trees_alone(spark):
    edges = _tangled()
    df, want = spark.createDataFrame(edges, "source string, target string"), _distances(edges)
    others = len(want) - 1
    close = {o: (len(d) - 1) / sum(d.values()) * (len(d) - 1) / others for o, d in want.items()}
    got = {r["node"]: r["closeness"] for r in G.closeness(df).collect()}
    assert got.keys() == close.keys() and all(abs(got[o] - close[o]) < 1e-12 for o in close)
    some = spark.createDataFrame([("t3",), ("c0",), ("w2",), ("t3",), ("none",)], "node string")
    assert {r["node"]: round(r["closeness"], 12) for r in G.closeness(df, some).collect()} == {o: round(close[o], 12) for o in ("t3", "c0", "w2")}
    lengths = [x for d in want.values() for x in d.values() if x]
    pairs, mean = G.average_path_length(df).first()
    assert pairs == len(lengths) and abs(mean - sum(lengths) / len(lengths)) < 1e-12
    assert tuple(G.average_path_length(df.where("source = 'z'")).first()) == (0, None)


def test_betweenness_of_trees_on_cycles(spark):
    edges = _tangled()
    near, dist = {}, _distances(edges)
    paths = {}
    for o, d in dist.items():
        near = {x: [y for y in d if dist[x].get(y) == 1] for x in d}
        paths[o] = {o: 1}
        for x in sorted(d, key=d.get):
            if x != o:
                paths[o][x] = sum(paths[o][y] for y in near[x] if d[y] == d[x] - 1)
    want = {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in dist[v] for t in dist[v] if len({s, v, t}) == 3 and dist[s][v] + dist[v][t] == dist[s][t]) / 2 for v in dist}
    got = {r["node"]: r["betweenness"] for r in G.betweenness(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_pairs_of_a_tree_are_not_made(spark):
    """A wide star: the square of its leaves is 4 million pairs, of which none is written."""
    star = spark.range(2_000).select(F.lit("hub").alias("source"), F.concat(F.lit("leaf"), "id").alias("target"))
    levels, core, links = G._fold(G.undirected(star))
    assert [x.count() for x in levels] == [2_000] and [tuple(r) for r in core.collect()] == [("hub", 2_001, 2_000, 2_000)] and links.isEmpty()


def test_root_causes_come_from_the_side_with_fewer_ends(spark):
    draw = random.Random(4)
    edges = [(f"d{a}", f"d{b}", draw.choice(("CAUSED", "INFLUENCED", "OTHER"))) for a, b in ((draw.randrange(12), draw.randrange(12)) for _ in range(22))]
    edges += [("r0", "d0", "CAUSED"), ("r1", "d5", "INFLUENCED"), (None, "d1", "CAUSED"), ("r2", "r2", "CAUSED"), ("r2", "d2", "CAUSED")]
    df = spark.createDataFrame(edges, "source string, target string, type string")
    ids = sorted({x for a, b, _ in edges for x in (a, b) if x})
    kept = [(a, b) for a, b, t in edges if t != "OTHER"]
    caused = {b for _, b in kept}
    for asked in (ids, ["d3"]):
        want = set()
        for o in asked:
            seen, queue = {o: 0}, [o]
            for x in queue:
                for y in {a for a, b in kept if b == x and a} - seen.keys():
                    if seen[x] < 3:
                        seen[y] = seen[x] + 1
                        queue.append(y)
            want |= {(o, y, n) for y, n in seen.items() if n and y not in caused}
        assert {tuple(r) for r in D.root_causes(df, spark.createDataFrame([(x,) for x in asked], "id string"), 3).collect()} == want


def test_ratings_of_decisions_read_no_lines(spark, sf_dir):
    from loomgraph.plans import q_decisions

    assert not [f for f in q_decisions._rated(spark, sf_dir).inputFiles() if "lineitem" in f]


def test_scores_of_eigenvector_do_not_pass_the_driver(spark, monkeypatch):
    plans, write = [], G.materialize

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(G, "materialize", seen)
    df = spark.createDataFrame(_tangled(), "source string, target string")
    assert G.eigenvector(df, 3, 0).count() == len(_distances(_tangled()))
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_timeline_of_equal_starts_is_the_same_in_every_order(spark):
    rows = [("k", 1, 5), ("k", 1, 3), ("k", 5, 6)]
    want = [(1, "added"), (1, "added"), (3, "removed"), (5, "modified"), (6, "removed")]
    for some in itertools.permutations(rows):
        df = spark.createDataFrame(some, "k string, start int, end int").coalesce(1)
        assert sorted((r["ts"], r["event"]) for r in T.timeline(df, "k").collect()) == want


@pytest.mark.parametrize("steps", [D.STEPS, (1,), ()])
def test_precedents_against_all_pairs(spark, monkeypatch, steps):
    monkeypatch.setattr(D, "STEPS", steps)
    r = random.Random(9)
    rows = [(f"d{i:03}", r.choice("xy"), " ".join(r.sample("abcdefgh", r.randrange(1, 6)))) for i in range(150)] + [(f"e{i}", "x", "a b c") for i in range(9)] + [("f1", "x", None), ("f2", None, "a b")]
    df = spark.createDataFrame(rows, "id string, category string, scenario string")
    words, want = {i: set((s or "").split()) for i, _, s in rows}, set()
    for a, c, _ in rows[::5]:
        both = [(b, len(words[a] & words[b]), len(words[a] | words[b])) for b, x, _ in rows if b != a and c and x == c and words[a] and words[b]]
        best = sorted((-0.7 * (n / u), b) for b, n, u in both if 0.7 * (n / u) >= 0.3 - 1e-12)[:4]
        want |= {(a, b, round(-s, 9), k + 1) for k, (s, b) in enumerate(best)}
    got = D.precedents(df.where(F.col("id").isin([a for a, _, _ in rows[::5]])), df, 0.3, 4).collect()
    assert {(x["query"], x["id"], round(x["similarity"], 9), x["rank"]) for x in got} == want


def test_triangle_communities_of_twins_and_groups(spark):
    """Against the communities of all triangles, listed one by one."""
    r = random.Random(3)
    for n in range(3):
        edges = [(f"v{r.randrange(12)}", f"v{r.randrange(12)}") for _ in range(10)] + [(a, b) for a, b in itertools.combinations([f"t{i}" for i in range(6)], 2)] + [(f"t{i}", "v1") for i in range(6)]
        groups = [(f"g{i}", f"h{i % 2}") for i in range(11)] + [("g0", "h1"), ("v2", "h0"), ("v3", "alone"), (None, "h0")] + [("v4", f"h{n}"), *((f"w{i}", "h9") for i in range(7))]
        pairs = edges + [("g1", "v5")] + [(f"g{i}", "v6") for i in range(0, 11, 2)]
        full = pairs + [(a, b) for a, g in groups for b, h in groups if g == h and a and b and a != b]
        nb = neighbours(full)
        one = {frozenset((a, b)) for a in nb for b in nb[a]}
        part = {e: e for e in one}

        def top(e):
            while part[e] != e:
                e = part[e]
            return e

        corners = [t for t in itertools.combinations(sorted(nb), 3) if all(frozenset(e) in one for e in itertools.combinations(t, 2))]
        for t in corners:
            x, *rest = (top(frozenset(e)) for e in itertools.combinations(t, 2))
            for y in rest:
                part[top(y)] = top(x)
        want = {}
        for t in corners:
            want.setdefault(top(frozenset(t[:2])), set()).update(t)
        got = G.triangle_communities(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(groups, "node string, group string"))
        assert sorted((x["node"], x["community"]) for x in got.collect()) == sorted((v, min(c)) for c in want.values() for v in c)


@pytest.mark.parametrize(("shipped", "paths"), [([(0, 1), (5, 1), (5, 2), (9, 2)], []), ([(0, 1), (0, 2), (9, 1), (9, 2), (5, 2)], ["s:0>p:1>s:9", "s:0>p:2>s:9"])])
def test_ties_of_shortest_paths_are_the_parts_of_both_suppliers(spark, sf_dir, tmp_path, shipped, paths):
    """Suppliers without a part of both have no path, as in the SQL, though one of four edges joins them."""
    con = pytest.importorskip("duckdb").connect()
    for name in ("region", "nation", "customer", "supplier", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    con.execute(f"COPY (SELECT s AS l_suppkey, p AS l_partkey, 1.0::DOUBLE AS l_quantity, TIMESTAMP '1998-01-01' AS l_shipdate FROM (VALUES {', '.join(map(str, shipped))}) v(s, p)) TO '{tmp_path}/lineitem.parquet'")
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    assert sorted(con.execute(Q.ORACLE_SQL["shortest_paths_ties"]).fetchall()) == [(p, 2) for p in paths]
    assert sorted(map(tuple, Q.shortest_paths_ties(spark, str(tmp_path)).collect())) == [(p, 2) for p in paths]


@pytest.mark.parametrize("bits", [0, 3, 63])
def test_precedents_of_few_words_are_dealt_out(spark, monkeypatch, bits):
    """Few words in many scenarios: no piece of a word's scenarios is larger than it may be, and words without a bit count."""
    monkeypatch.setattr(D, "BITS", bits)
    monkeypatch.setattr(D, "PIECE", 20)
    joined, near = [], D._near_scenarios
    monkeypatch.setattr(D, "_near_scenarios", lambda asked, held, *rest: joined.append(held) or near(asked, held, *rest))
    r = random.Random(4)
    rows = [(f"d{i:03}", "x", " ".join(r.sample("abcdefgh", r.randrange(2, 7)))) for i in range(200)]
    words = {i: set(s.split()) for i, _, s in rows}
    df = spark.createDataFrame(rows, "id string, category string, scenario string")
    asked, want = [i for i, _, _ in rows[::9]], set()
    for a in asked:
        best = sorted((-0.7 * (len(words[a] & words[b]) / len(words[a] | words[b])), b) for b in words if b != a)[:30]
        want |= {(a, b, round(-s, 9), k + 1) for k, (s, b) in enumerate(best) if -s >= 0.3 - 1e-12}
    assert {(x["query"], x["id"], round(x["similarity"], 9), x["rank"]) for x in D.precedents(df.where(F.col("id").isin(asked)), df, 0.3, 30).collect()} == want
    sizes = [x["count"] for x in joined[-1].groupBy("category", "word", "piece").count().collect()]
    assert len(sizes) > 16 and max(sizes) < 45
