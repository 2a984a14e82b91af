"""Hierarchies against plain walks of small trees."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import hierarchy as H


def _links(spark, rows):
    return spark.createDataFrame(rows, "id string, parent string, depth int, low string")  # columns with clashing names


def _above(parents, node):
    out = []
    while parents.get(node) is not None:
        node = parents[node]
        out.append(node)
    return out


def test_labels_equal_plain_walks(spark):
    rnd = random.Random(3)
    parents = {f"n{k}": f"n{rnd.randrange(max(0, k - 6), k)}" if k and rnd.random() > 0.05 else None for k in range(150)}
    rows = [(a, b, 7, "x") for a, b in parents.items()] * 2 + [("n0", "n0", 1, None), (None, "n3", 1, None)]
    labels = H.tree_labels(_links(spark, rows)).cache()
    got = {r["id"]: r for r in labels.collect()}
    assert set(got) == set(parents)
    for a in parents:
        up = _above(parents, a)
        assert got[a]["depth"] == len(up) and got[a]["root"] == (up[-1] if up else a)
        inside = {b for b in parents if got[b]["root"] == got[a]["root"] and got[a]["low"] < got[b]["low"] < got[a]["high"]}
        assert inside == {b for b in parents if a in _above(parents, b)}
    pairs = sorted(map(tuple, H.below(labels, labels.select("id")).collect()))
    assert pairs == sorted((b, a, k + 1) for a in parents for k, b in enumerate(_above(parents, a)))


def test_a_long_chain_and_bins(spark):
    n = 1500
    labels = H.tree_labels(_links(spark, [(f"{k:04}", f"{k - 1:04}" if k else None, 0, "") for k in range(n)]))
    found = H.below(labels, _links(spark, [("0000", None, 0, ""), ("0700", None, 0, ""), ("none", None, 0, "")]))
    counts = {r["ancestor"]: (r["count"]) for r in found.groupBy("ancestor").count().collect()}
    assert counts == {"0000": n - 1, "0700": n - 701}


def test_what_is_no_tree_raises(spark):
    with pytest.raises(ValueError, match="2 parents"):
        H.tree_labels(_links(spark, [("a", "b", 0, ""), ("a", "c", 0, "")]))
    with pytest.raises(ValueError, match="cycle"):
        H.tree_labels(_links(spark, [("a", "b", 0, ""), ("b", "c", 0, ""), ("c", "a", 0, ""), ("d", "e", 0, "")]))
    assert H.tree_labels(_links(spark, [])).count() == 0


def test_parents_by_name(spark):
    names = ["Thing", "Resource", "Staff", "StaffMember", "Staff Member", "Staff Member Senior", "Cat", None, "Cat", ""]
    got = dict(map(tuple, H.class_parents(spark.createDataFrame([(n,) for n in names], "class string")).collect()))
    assert got == {"Thing": None, "Resource": "Thing", "Staff": "Thing", "StaffMember": "Thing", "Staff Member": "Staff", "Staff Member Senior": "StaffMember", "Cat": "Thing", "": "Thing"}
    assert dict(map(tuple, H.class_parents(spark.createDataFrame([("x y",), ("x",)], "class string")).collect())) == {"x y": "x", "x": None}


def test_concepts(spark):
    S = H.SKOS
    rows = [("c", H.RDF_TYPE, S + "Concept"), ("c", S + "prefLabel", "Cat"), ("c", S + "altLabel", "puss"), ("c", S + "altLabel", "puss"), ("c", S + "inScheme", "s"), ("e", H.RDF_TYPE, S + "Concept"), ("x", S + "prefLabel", "no concept"), (None, S + "prefLabel", "y"), ("e", S + "prefLabel", None), ("c", S + "broader", "e"), ("e", S + "narrower", "c")]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    assert sorted(map(tuple, H.skos_concepts(t).collect())) == [("c", "Cat", ["puss"]), ("e", "", [])]
    assert [tuple(r) for r in H.skos_concepts(t, "s").collect()] == [("c", "Cat", ["puss"])]
    assert [tuple(r) for r in H.search_concepts(t, "PUS").collect()] == [("c", "puss")]
    assert [tuple(r) for r in H.broader_links(t).collect()] == [("c", "e")]
