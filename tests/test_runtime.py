"""Written tables: which ones a sweep deletes."""

from __future__ import annotations

from loomgraph.runtime import materialize, sweep, valid, written


def test_sweep_keeps_what_it_is_told(spark):
    before = written(spark)
    first, second, third = (materialize(spark.range(n), "sweep") for n in (3, 4, 5))
    sweep(spark, since=before + 1, keep=(third,))
    assert written(spark) == before + 2 and first.count() == 3 and third.count() == 5
    assert not spark._jvm.java.io.File(second.inputFiles()[0].removeprefix("file:").lstrip("/").join(["/", ""])).exists()
    sweep(spark, since=before)
    assert written(spark) == before


def test_broken_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\xffb")), (2, bytearray("é".encode())), (3, None)], "id int, b binary")
    assert [r[0] for r in df.orderBy("id").select(valid(df.b.cast("string"))).collect()] == ["a�b", "é", None]


def test_pieces_follow_the_files_and_groups_need_no_other_shuffle(spark, sf_dir, monkeypatch):
    from loomgraph import runtime
    from loomgraph.plans.tables import relationships, table

    monkeypatch.setattr(runtime, "PIECE", 4_096)
    line = table(spark, sf_dir, "lineitem")
    assert runtime.dealt(line, "l_suppkey").rdd.getNumPartitions() >= 20
    plan = relationships(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_edges_are_told_apart_before_they_are_turned(spark):
    from loomgraph.operators import graph as G

    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "a"), ("b", "c")], "source string, target string")
    assert sorted(map(tuple, G.undirected(edges).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert "Expand" not in (plan := G.undirected(edges)._jdf.queryExecution().optimizedPlan().toString()) and "Union" not in plan


def test_ids_of_a_graph_at_a_time_are_not_broadcast(spark, sf_dir):
    from loomgraph.plans import catalogue

    plan = catalogue.queries()["graph_at_time"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_texts_reach_python_in_small_batches(spark, sf_dir):
    from loomgraph.plans import q_text

    for query in (q_text.unicode_forms, q_text.chunk_sliding):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        query(spark, sf_dir)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
