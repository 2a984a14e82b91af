"""Label alignment, modularity communities, temporal paths and distance history against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import alignment as A
from loomgraph.operators import communities as C
from loomgraph.operators import graph as G
from loomgraph.operators import partners as N
from loomgraph.operators import temporal_paths as P


def plain_vectors(labels):
    grams = {}
    for label in set(labels):
        grams[label] = Counter(p[i : i + n] for w in label.split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(len(p) - n + 1))
    df = Counter(g for c in grams.values() for g in c)
    out = {}
    for label, c in grams.items():
        v = {g: n * (math.log((1 + len(grams)) / (1 + df[g])) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[label] = {g: x / size for g, x in v.items()}
    return out


def labels_of(seed, n):
    r = random.Random(seed)
    words = ["part", "parts", "has", "of", "name", "person", "agent", "place", "region", "a", "ab", "event", "évènement", "date", "time"]
    return [r.choice(["_", " ", "-", "  "]).join(r.choice([str, str.title, str.upper])(r.choice(words)) for _ in range(r.randrange(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 2000])
def test_suggestions_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK", block)
    left, right = [[*enumerate(labels_of(s, 60)), (100, None), (101, ""), (102, " _ ")] for s in (1, 2)]
    plain = lambda t: " ".join((t or "").lower().replace("_", " ").replace("-", " ").split())
    v = plain_vectors([p for _, t in left + right if (p := plain(t))])
    want = []
    for i, s in left:
        for j, t in right:
            a, b = plain(s), plain(t)
            if a and b:
                cosine = sum(x * v[b].get(g, 0) for g, x in v[a].items())
                x, y = set(a.split()), set(b.split())
                label = round(max(SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y)), 4)
                if 0.4 * label + 0.6 * cosine >= 0.65 + 1e-4:
                    want.append((i, j))
    frames = [spark.createDataFrame(x, "id long, label string").withColumn("a", F.lit(1)) for x in (left, right)]
    found = A.suggest_alignments(*frames).collect()
    assert set(want) <= {(r["source"], r["target"]) for r in found} and len(want) > 30
    assert all(r["score"] >= 0.65 for r in found) and len(found) <= len(want) + 3
    assert A.suggest_alignments(frames[0].limit(0), frames[1]).count() == 0
    with pytest.raises(ValueError):
        A.suggest_alignments(*frames, threshold=0.4)


def partition_value(pairs, name):
    """Modularity of a partition, by its definition."""
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    degree = Counter(n for p in links for n in p)
    inside, total = Counter(name[min(p)] for p in links if len({name[n] for n in p}) == 1), Counter()
    for n, d in degree.items():
        total[name[n]] += d
    m = len(links)
    return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in total)


def greedy_value(pairs):
    """Merging the two linked communities of largest gain, one pair at a time."""
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    name = {n: n for n in nodes}
    while True:
        now, best = partition_value(pairs, name), None
        for a, b in sorted({tuple(sorted((name[x], name[y]))) for x, y in pairs if x != y and name[x] != name[y]}):
            value = partition_value(pairs, {n: a if c == b else c for n, c in name.items()})
            if value > now + 1e-12 and (best is None or value > best[0]):
                best = (value, a, b)
        if best is None:
            return now, name
        name = {n: best[1] if c == best[2] else c for n, c in name.items()}


def communities(spark, pairs, **options):
    edges = spark.createDataFrame(pairs, "source string, target string")
    return {r["node"]: r["community"] for r in C.modularity_communities(edges, **options).collect()}


def test_cliques_in_a_ring_are_the_greedy_communities(spark):
    cliques = [[f"{k}{i}" for i in range(5)] for k in range(4)]
    pairs = [(x, y) for c in cliques for x in c for y in c if x < y] + [(cliques[k][0], cliques[(k + 1) % 4][1]) for k in range(4)] + [("00", "00"), ("00", "01")]
    got = communities(spark, pairs)
    value, name = greedy_value(pairs)
    assert {frozenset(n for n in got if got[n] == c) for c in got.values()} == {frozenset(n for n in name if name[n] == c) for c in name.values()} == {frozenset(c) for c in cliques}
    assert all(min(n for n in got if got[n] == c) == c for c in got.values()) and partition_value(pairs, got) == pytest.approx(value)


def test_no_merging_is_left_and_value_is_near_the_greedy_one(spark):
    r = random.Random(4)
    pairs = [(f"n{x:02}", f"n{y:02}") for x, y in ((r.randrange(30), r.randrange(30)) for _ in range(60))]
    got, now = communities(spark, pairs), None
    now = partition_value(pairs, got)
    for a, b in {tuple(sorted((got[x], got[y]))) for x, y in pairs if x != y and got[x] != got[y]}:
        assert partition_value(pairs, {n: a if c == b else c for n, c in got.items()}) <= now + 1e-9
    assert now >= 0.85 * greedy_value(pairs)[0]
    with pytest.raises(RuntimeError):
        communities(spark, pairs, max_rounds=1)
    star = [("hub", f"l{i}") for i in range(60)]
    assert len(communities(spark, star)) == 61
    assert communities(spark, [(None, "a"), ("b", "b")]) == {}


@pytest.mark.parametrize("resolution, sizes", [(1.0, {"p0": 13, "p1": 8, "p12": 10, "p14": 8, "p24": 12}), (0.7, {"p0": 19, "p13": 12, "p14": 20})])
def test_rounds_write_each_link_once_as_numbers_and_no_node_again(spark, monkeypatch, resolution, sizes):
    written, write = [], C.materialize

    def counted(df, name):
        out = write(df, name)
        written.append((name, out.count(), dict(out.dtypes)))
        return out

    monkeypatch.setattr(C, "materialize", counted)
    r = random.Random(9)
    pairs = [(f"s{r.randrange(12)}", f"p{r.randrange(40)}") for _ in range(150)]
    got = communities(spark, pairs, resolution=resolution)
    assert Counter(got.values()) == sizes and len(got) == len({n for p in pairs for n in p})
    links = [(rows, kinds) for name, rows, kinds in written if name == "links"]
    assert links[0][0] == len(set(pairs)) and all("string" not in kinds.values() for _, kinds in links)
    nodes = [rows for name, rows, _ in written if name in ("member", "turn")]
    assert nodes[0] == len(got) and nodes[-1] < len(got) / 2 and nodes == sorted(nodes, reverse=True)


DAY = datetime(2024, 1, 1)


def dated_edges(seed, n=40, nodes=10):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = None if r.random() < 0.1 else DAY + timedelta(days=r.randrange(20))
        e = None if r.random() < 0.2 else (s or DAY) + timedelta(days=r.randrange(8))
        out.append((r.choice("abcdefghij"[:nodes]), r.choice("abcdefghij"[:nodes]), s, e))
    return out


def plain_labels(edges, seed, order, most=8):
    """Best labels by number of edges, from all walks."""
    low, high = datetime.min, datetime.max
    best, front, out = {seed: low if order != "overlap" else high}, {(seed, low if order != "overlap" else high)}, []
    for hops in range(1, most + 1):
        step = defaultdict(set)
        for node, label in front:
            for a, b, s, e in edges:
                if a == node and (order == "loose" or s is None or (s >= label if order == "strict" else s <= label)):
                    step[b].add({"strict": s or low, "overlap": e or high, "loose": low}[order])
        front = set()
        for node, labels in step.items():
            label = max(labels) if order == "overlap" else min(labels)
            if node not in best or (label > best[node] if order == "overlap" else label < best[node]):
                best[node] = label
                front.add((node, label))
                out.append((node, hops, None if label in (low, high) else label))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", ["strict", "overlap", "loose"])
def test_temporal_paths_equal_all_walks(spark, order):
    edges = dated_edges(11)
    df = spark.createDataFrame([*edges, edges[0], (None, "a", None, None)], "source string, target string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    found = P.temporal_paths(df, seeds, order, max_hops=8).collect()
    assert sorted(((r["node"], r["hops"], r["label"]) for r in found), key=repr) == plain_labels(edges, "a", order)
    assert all(len(r["path"]) == r["hops"] + 1 and r["path"][0] == "a" and r["path"][-1] == r["node"] for r in found)
    assert P.temporal_paths(df.limit(0), seeds, order).count() == 0
    late = P.temporal_paths(df, seeds, order, start=F.lit(DAY + timedelta(days=30)).cast("timestamp_ntz")).collect()
    assert {r["node"] for r in late} <= {r["node"] for r in found}


def test_distance_history_equals_searches(spark):
    edges = dated_edges(5, 14, 6)
    df = spark.createDataFrame(edges, "source string, target string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    times = [DAY + timedelta(days=k) for k in range(0, 26, 2)]
    want, was = [], None
    for k, t in enumerate(times):
        held = [(a, b) for a, b, s, e in edges if (s is None or s <= t) and (e is None or t < e)]
        reach, level, hops = {"a"}, {"a"}, 0
        while level and "b" not in reach:
            level = {y for a, b in held for x, y in ((a, b), (b, a)) if x in level} - reach
            reach, hops = reach | level, hops + 1
        now = hops if "b" in reach else None
        event = None if k == 0 else "appeared" if was is None and now is not None else "vanished" if now is None and was is not None else "same" if now == was else "closer" if now < was else "farther"
        want.append((t, now, event))
        was = now
    at = spark.createDataFrame([(t,) for t in [*times, times[0], None]], "at timestamp_ntz")
    assert [tuple(r) for r in P.distance_history(df, at, "a", "b").orderBy("at").collect()] == want
    assert len({e for _, _, e in want}) > 3 and P.distance_history(df, at.limit(0), "a", "b").count() == 0


def test_distances_of_more_edges_than_asked_for_are_none(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(8)]
    edges = spark.createDataFrame([(a, b, None, None) for a, b in chain], "source string, target string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    times = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00' AS at")
    far = lambda target, most: P.distance_history(edges, times, "n0", target, most).first()["hops"]
    assert (far("n8", None), far("n8", 6), far("n6", 6)) == (8, None, 6)


def test_temporal_paths_without_paths_have_the_same_labels(spark):
    draw = random.Random(9)
    day = lambda k: datetime(2020, 1, 1) + timedelta(days=k)
    rows = [(f"n{draw.randrange(9)}", f"n{draw.randrange(9)}", *([None, None] if draw.random() < 0.1 else [day(s := draw.randrange(20)), day(s + draw.randrange(9))])) for _ in range(30)]
    edges = spark.createDataFrame(rows, "source string, target string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    seeds = spark.createDataFrame([("n0",), ("n1",)], "node string")
    for order in ("strict", "overlap", "loose"):
        plain = P.temporal_paths(edges, seeds, order, with_path=False)
        assert plain.columns == ["origin", "node", "hops", "label"]
        assert sorted(map(str, plain.collect())) == sorted(map(str, P.temporal_paths(edges, seeds, order).drop("path").collect()))


def test_an_edge_of_temporal_paths_is_moved_once_for_many_origins(spark, monkeypatch):
    """40 origins reach a hub with 50 edges on: these are 50 rows of the step, and what has no edges on is not joined again."""
    rows = [(f"o{i}", "hub", None, None) for i in range(40)] + [("hub", f"z{i}", DAY + timedelta(days=i % 7), None) for i in range(50)]
    edges = spark.createDataFrame(rows, "source string, target string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    seeds = spark.createDataFrame([(f"o{i}",) for i in range(40)], "node string")
    want = sorted([(f"o{i}", "hub", 1, None) for i in range(40)] + [(f"o{i}", f"z{j}", 2, DAY + timedelta(days=j % 7)) for i in range(40) for j in range(50)])
    written, write = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: written.append(name) or write(df, name))
    for few, together in ((500_000, 64), (0, 64), (0, 7)):
        monkeypatch.setattr(P, "FEW", few)
        monkeypatch.setattr(P, "TOGETHER", together)
        written.clear()
        got = P.temporal_paths(edges, seeds, with_path=False)
        assert sorted(map(tuple, got.collect())) == want
        moved = written.count("labels")
        assert moved == (3 if few == 0 else 4)


@pytest.mark.parametrize("piece", [8_000_000, 40])
def test_likely_partners_are_the_best_of_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(N, "PIECE", piece)
    r = random.Random(4)
    edges = [(f"h{r.randrange(3)}", f"v{i}") for i in range(30)] + [(f"v{r.randrange(30)}", f"w{r.randrange(25)}") for _ in range(80)] + [("a", "a"), ("p", "q")]
    df = spark.createDataFrame(edges, "source string, target string")
    rounded = lambda s: [s["a"], s["b"], s["common"], *(round(s[c], 9) for c in ("jaccard", "adamic_adar", "resource_allocation")), s["preferential"]]
    want = {}
    for s in sorted(G.link_scores(df).collect(), key=lambda s: (-round(s["adamic_adar"], 6), s["b"])):
        want.setdefault(s["a"], []).append(rounded(s))
    assert sorted(map(rounded, N.likely_partners(df, 3).collect())) == sorted(x for rows in want.values() for x in rows[:3])
