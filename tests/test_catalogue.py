"""Every registered query against its SQL on the smallest tables, and operators on awkward rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import cleaning as C
from loomgraph.operators import reasoning as R
from loomgraph.operators import retrieval as V
from loomgraph.operators import text as X
from loomgraph.operators.components import connected_components
from loomgraph.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame([*chain, *star, (200, 200), (None, 5), (7, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200}
    assert connected_components(edges.limit(0)).collect() == []


def test_similarities(spark):
    rows = [("martha", "marhta"), ("", "x"), ("same", " SAME "), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    jw = [r[0] for r in df.select(S.jaro_winkler("a", "b")).collect()]
    assert abs(jw[0] - 0.9611) < 1e-3 and jw[1] == 0 and jw[2] == 1
    lev = [r[0] for r in df.select(S.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert abs(lev[0] - (1 - 2 / 6)) < 1e-9 and lev[1] == 0 and lev[2] == 1


def test_rules_with_constants_and_repeated_variables(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("d", "a")], "arg0 string, arg1 string")
    x, y, z = R.variables("X Y Z")
    rules = [
        (R.Atom("path", (x, y)), [R.Atom("edge", (x, y))]),
        (R.Atom("path", (x, z)), [R.Atom("path", (x, y)), R.Atom("edge", (y, z))]),
        (R.Atom("loop", (x,)), [R.Atom("path", (x, x))]),
        (R.Atom("from_a", (y,)), [R.Atom("path", ("a", y))]),
    ]
    got = R.fixpoint(rules, {"edge": e})
    assert {tuple(r) for r in got["path"].collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("d", "a"), ("d", "b"), ("d", "c")}
    assert [r[0] for r in got["loop"].collect()] == ["c"]
    assert {r[0] for r in got["from_a"].collect()} == {"b", "c"}
    assert R.query([R.Atom("path", ("d", "c"))], got).count() == 1 and R.query([R.Atom("path", ("c", "d"))], got).count() == 0
    comma = spark.createDataFrame([("a, b)", "c")], "arg0 string, arg1 string")
    assert R.query([R.Atom("edge", ("a, b)", x))], {"edge": comma}).count() == 1


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "One. Two! Three? " + "x" * 30, "1,200.5"), (2, None, "5%"), (3, "", "$3k"), (4, "abc", "n/a")], "id long, t string, n string")
    assert [r[0] for r in df.orderBy("id").select(X.parse_number(F.col("n"))).collect()] == [1200.5, 0.05, 3000.0, None]
    assert [r["chunk_text"] for r in X.chunk_sentences(df.where("id = 1"), "t", 12).orderBy("chunk").collect()] == ["One. Two!", "Three?", "x" * 30]
    whole = X.chunk_characters(df, "t", 10, 3).orderBy("id", "chunk").collect()
    assert {r["id"] for r in whole} == {1, 4} and all(len(r["chunk_text"]) <= 10 for r in whole)
    text = "".join(r["chunk_text"] if r["chunk"] == 0 else r["chunk_text"][3:] for r in whole if r["id"] == 1)
    assert text == "One. Two! Three? " + "x" * 30
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x<1</script> c",)], "h string")
    assert html.select(X.strip_html(F.col("h"))).first()[0] == "a & b c"


def test_filters_policies_and_diffs(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, None, None), (3, 9, "y")], "id long, n int, s string")
    assert [r[0] for r in df.where(V.metadata_filter([("s", "ne", "y")])).select("id").collect()] == [1]
    bad = {r["id"]: r["violations"] for r in V.policy_violations(df, {"min_n": 6, "required_s": True, "allowed_s": ["x"]}).collect()}
    assert bad == {1: ["min_n"], 2: ["min_n", "required_s", "allowed_s"], 3: ["allowed_s"]}
    after = spark.createDataFrame([(1, 5, "z"), (3, 9, "y"), (4, 1, "w")], "id long, n int, s string")
    assert {tuple(r[:2]): r[2] for r in V.snapshot_diff(df, after, "id").collect()} == {(1, "modified"): ["s"], (2, "removed"): [], (4, "added"): []}


def test_cleaning_empty_tables(spark):
    df = spark.createDataFrame([], "id long, n int, s string")
    assert [r["percent"] for r in C.missing_profile(df).collect()] == [0.0, 0.0, 0.0]
    assert C.impute(df, "n").count() == 0 and C.clean(df, ["id"], ["s"]).count() == 0
    assert C.validate(df, {"n": {"required": True, "min": 1}}).count() == 0
