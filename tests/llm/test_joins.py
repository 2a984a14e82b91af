"""N-gram join, nearest neighbours, media, mixing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zlib
from urllib.parse import urlparse

import numpy as np
import pytest
from helpers import documents, empty, near_copies, rows_of
from pyspark.sql import functions as F

from loomgraph.llm.ann import nearest
from loomgraph.llm.media import pad, read_payloads, store_media
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.ngram_join import keep_one_of_each, link_documents
from loomgraph.llm.q_op8 import media_report
from loomgraph.llm.q_op10 import ORACLE_SQL


# n-gram join

def shingles(text: str | None, width: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows: list[tuple], width: int, num: int, den: int) -> list[tuple]:
    sets = [shingles(t, width) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    named = [i for i, (doc, _) in enumerate(rows) if doc is not None and sets[i]]
    for a in named:
        for b in named:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return sorted(((doc, len(s), None if doc is None else find(doc) if s else doc) for (doc, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 3, 90), (2, 5, 80), (3, 1, 60), (4, 2, 70)])
def test_components_by_brute_force(spark, seed, width, num):
    docs = documents(spark, near_copies(seed))
    got = link_documents(docs, width, num, 100)
    assert rows_of(got) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], width, num, 100)


def test_components_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, 3, 90, 100)
    assert rows_of(link_documents(docs, 3, 90, 100)) == want
    assert len({c for *_, c in want}) < len(rows)


def test_join_edge_cases(spark):
    assert link_documents(empty(spark)).collect() == []
    docs = documents(spark, near_copies(9, 40))
    clash = docs.withColumns({c: F.lit("x") for c in ("doc", "n", "key", "sig", "component", "n_shingles", "node")})
    assert rows_of(link_documents(clash)) == rows_of(link_documents(docs))
    linked = link_documents(docs)
    kept = keep_one_of_each(docs, linked)
    smallest = {c for _, _, c in rows_of(linked) if c is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == smallest
    assert kept.columns == docs.columns


def test_a_large_group_of_near_copies_gives_few_pairs(spark):
    """A block gives out a forest: pairs grow with the rows, not with their square, and all copies meet."""
    from loomgraph.llm import ngram_join as n

    made = []
    for m in (150, 600):
        base = [f"w{i}" for i in range(120)]
        rows = [(i, " ".join([*base[: 40 + i % 30], f"x{i}", *base[41 + i % 30 :]])) for i in range(m)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        seen = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(n, "_block_pairs", lambda *a, f=n._block_pairs, **k: seen.append(f(*a, **k)) or seen[-1])
            assert {r["component_id"] for r in link_documents(docs).collect()} == {0}
            made.append(sum(1 for _ in seen))
    assert made == [1, 1]
    sizes = np.full(500, 100)
    shingles = [np.unique(np.append(np.arange(100), 1000 + i)).astype(np.uint64) << np.uint64(40) for i in range(500)]
    block = n.Block(np.arange(500), sizes + 1, [n.sketch(s) for s in shingles], np.arange(500), 80, 100)
    every = np.arange(500)
    assert len(block.pairs(every, every, forest=True)) == 499
    assert len(n.Block(np.arange(500), sizes + 1, [n.sketch(s) for s in shingles], np.arange(500), 80, 100).pairs(every, every, forest=False)) == 500 * 499 // 2


def test_rejected_pairs_of_a_forest(spark, monkeypatch):
    """Where the bounds let through pairs that don't link, the blocks are gone through once more: no link is lost."""
    from loomgraph.llm import ngram_join as n

    monkeypatch.setattr(n.Block, "linked_by_pieces", lambda self, one, others: np.ones(len(others), bool))
    docs = documents(spark, near_copies(7, 120, groups=4))
    assert rows_of(link_documents(docs, 3, 90, 100)) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 90, 100)


def test_large_blocks_are_cut_into_pieces(spark, monkeypatch):
    """Near copies without any word in common positions still meet when a block takes several tasks."""
    monkeypatch.setattr("loomgraph.llm.ngram_join.CHUNK", 8)
    docs = documents(spark, near_copies(5, 200, groups=3))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(link_documents(docs, 3, 90, 100)) == brute_components(rows, 3, 90, 100)


# nearest neighbours

def brute_nearest(rows: dict[int, np.ndarray], query: int, k: int) -> list[tuple[int, float]]:
    ids = np.array([i for i in rows if i != query])
    if not len(ids):
        return []
    x = np.stack([rows[i] for i in ids]).astype(float)
    q = rows[query].astype(float)
    score = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score))[:k]]


def test_recall_and_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    found = nearest(vectors, vectors.where("vec_id % 10 = 0"), 5).collect()
    hits = total = 0
    for q in {r["query_id"] for r in found}:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        want = brute_nearest(rows, q, 5)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        for _, v, s in mine:
            exact = float(rows[v] @ rows[q] / (np.linalg.norm(rows[v]) * np.linalg.norm(rows[q])))
            assert abs(s - exact) < 1e-12
        hits += len({m[1] for m in mine} & {w[0] for w in want})
        total += 5
    assert hits / total >= 0.9


def test_recall_among_vectors_without_clusters(spark):
    x = np.random.default_rng(3).standard_normal((3000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = nearest(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
    rows = dict(enumerate(x))
    queries = range(0, 3000, 50)
    hits = sum(len({r["vec_id"] for r in found if r["query_id"] == q} & {v for v, _ in brute_nearest(rows, q, 5)}) for q in queries)
    assert hits / (5 * len(queries)) >= 0.9


def test_neighbour_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, score string, rank int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", 9) for r in rows], schema)
    got = sorted(map(tuple, nearest(vectors, vectors, 5).collect()))
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 8)]
    assert {g[0] for g in got} == {0, 1, 2, 8}
    assert nearest(vectors.limit(0), vectors.limit(0), 5).collect() == []
    assert nearest(vectors.where("vec_id = 0"), vectors.where("vec_id = 0"), 5).collect() == []
    copies = spark.createDataFrame([(i, [0.5, 0.25, 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = nearest(copies, copies.where("vec_id = 100"), 5)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_neighbours_of_repeated_ids(spark):
    """Copies under the query's id are no candidates, and each query row is answered."""
    r = np.random.default_rng(11)
    x = [(0, [1.0, 0.5, 0.25, 0.0])] * 10 + [(i, r.standard_normal(4).tolist()) for i in range(1, 40)]
    vectors = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    want = brute_nearest({i: np.array(v) for i, v in x}, 0, 5)
    got = nearest(vectors, vectors.where("vec_id = 0"), 5).collect()
    assert len(got) == 50
    for rank, (i, score) in enumerate(want, 1):
        mine = [g for g in got if g["rank"] == rank]
        assert {g["vec_id"] for g in mine} == {i} and len(mine) == 10 and all(abs(g["score"] - score) < 1e-12 for g in mine)


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_with_many_lists_and_groups(spark, monkeypatch, clusters):
    monkeypatch.setattr("loomgraph.llm.ann.GROUP_ROWS", 1000)
    monkeypatch.setattr("loomgraph.llm.ann.QUERY_ROWS", 50)
    r = np.random.default_rng(5)
    x = r.standard_normal((20_000, 24)).astype(np.float32)
    if clusters:
        x = 0.15 * x + r.standard_normal((clusters, 24)).astype(np.float32)[r.integers(0, clusters, len(x))]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    found = nearest(vectors, vectors.where("vec_id % 200 = 0"), 5).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 200):
        near = unit @ unit[q]
        near[q] = -2
        hits += len({f["vec_id"] for f in found if f["query_id"] == q} & set(np.argsort(-near)[:5].tolist()))
    assert len(found) == 500 and hits / 500 >= 0.9


# media

def test_media_round_trip(spark):
    docs = documents(spark)
    want = []
    for i, t in rows_of(docs.select("doc_id", "text")):
        payload = pad((t or "").encode())
        assert len(payload) % 64 == 0 and payload
        want.append((i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    report = media_report(docs)
    assert rows_of(report.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == sorted(want, key=repr)
    same = report.groupBy("payload_sha256").agg(F.countDistinct("media_sha256", "media_bytes", "feature").alias("n"))
    assert same.where("n <> 1").count() == 0
    assert media_report(empty(spark)).collect() == []


def test_shards_are_tar_files_that_hold_each_payload_once(spark):
    docs = documents(spark).repartition(1)
    media = store_media(docs)
    rows = media.collect()
    for url in {r["shard"] for r in rows}:
        data = open(urlparse(url).path, "rb").read()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            names = tar.getnames()
        assert len(names) == len(set(names))
        for r in rows:
            if r["shard"] == url:
                image = data[r["offset"] : r["offset"] + r["length"]]
                assert hashlib.sha256(image).hexdigest() == r["digest"] and r["digest"] + ".png" in names
    texts = sorted(((r["doc_id"], pad((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], bytes(r["payload"])) for r in read_payloads(media.withColumn("payload", F.lit(1))).collect()), key=repr) == texts


# mixing

def run_sql(docs, path) -> list[tuple]:
    duckdb = pytest.importorskip("duckdb")
    docs.write.parquet(f"{path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/d/*.parquet'")
    return [tuple(r) for r in con.execute(ORACLE_SQL["op10_mix_sources"]).fetchall()]


def test_mix_by_one_global_order(spark, tmp_path):
    docs = documents(spark, near_copies(4, 120)).where("doc_id is not null").dropDuplicates(["doc_id"])
    got, want = rows_of(mix_sources(docs)), sorted(run_sql(docs, tmp_path), key=repr)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])


def test_mix_comes_near_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    mixed = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, again))
    largest = max(r["size"] for r in mixed)
    total = sum(r["size"] for r in mixed)
    by_target = {}
    for r in mixed:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), 0)
        by_target[r["source_size"], r["target"]] += r["taken"]
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 2 * largest
    assert total - largest <= sum(r["taken"] for r in mixed) <= total


def test_mix_edge_cases(spark):
    assert mix_sources(empty(spark)).collect() == []
    docs = documents(spark)
    clash = docs.withColumns({c: F.lit("x") for c in ("size", "taken", "target", "_h", "_b", "_keep", "source_size", "copies")})
    assert rows_of(mix_sources(clash)) == rows_of(mix_sources(docs))
    assert mix_sources(docs).count() == docs.count()
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 1)], docs.schema)
    assert [r["taken"] for r in mix_sources(blank).collect()] == [0, 0]
    kept = mix_sources(docs, keep=["doc_id", "text"])
    assert kept.columns == ["doc_id", "text", "copies", "finish", "round"]


# pipeline

def test_each_stage_by_brute_force(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, texts = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    tables = dict(p.STAGES)
    known = tables["language_id"](spark, docs, sf_dir)
    assert known.columns == p.COLUMNS
    kept = {r["doc_id"]: r["text"] for r in known.collect()}
    assert kept.items() <= texts.items()
    assert not any(i in kept for i, t in texts.items() if not t or not any(map(str.isalpha, t)))
    usual = [i for i, t in texts.items() if t and len(t.split()) >= 20]
    assert sum(i in kept for i in usual) >= 0.97 * len(usual)

    one = tables["ngram_join"](spark, known, sf_dir)
    want = {c for _, _, c in brute_components(list(kept.items()), 5, 80, 100)}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == p.COLUMNS

    clean = tables["secret_scan"](spark, one, sf_dir)
    found = clean.collect()
    assert {r["doc_id"] for r in found} == want and clean.columns == p.COLUMNS
    for r in found:
        assert r["n_chars"] == len(r["text"])
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"])

    mixed = tables["mix_sources"](spark, clean, sf_dir)
    copies = mix_sources(clean, keep=["doc_id"])
    finish = {r["doc_id"]: r for r in mix_sources(clean, keep=["doc_id"]).collect()}
    seen, last = {}, 0.0
    for r in mixed.collect():  # in the order of finish times, copies one round of their source apart
        own = finish[r["doc_id"]]
        at = own["finish"] + seen.get(r["doc_id"], 0) * own["round"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        assert at >= last - 1e-12
        last = at
    assert mixed.count() == copies.agg(F.sum("copies")).first()[0] and mixed.columns == p.COLUMNS
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0

    last = tables["byte_bpe"](spark, mixed, sf_dir)
    digests = {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect()}
    assert {(r["doc_id"], r["decoded_sha256"]) for r in last.collect()} == digests
    assert before.count() >= one.count()


def test_stages_take_awkward_rows_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as p

    for docs in (documents(spark, near_copies(6, 30)), empty(spark)):
        for name, stage in p.STAGES:
            out = stage(spark, docs.withColumn("extra", F.lit(1)), sf_dir)
            assert out.count() <= 3 * docs.count()
            if name != "byte_bpe":
                assert out.columns == p.COLUMNS


def test_shared_signatures_whatever_the_batches(spark):
    from collections import defaultdict
    from random import Random

    from loomgraph.llm.ngram_join import _shared

    r = Random(8)
    rows = [(r.randrange(60) ** 2 // 40, r.randrange(9)) for _ in range(400)]
    keys = defaultdict(set)
    for sig, key in rows:
        keys[sig].add(key)
    want = sorted(((sig, key) for sig, found in keys.items() if len(found) > 1 for key in found), key=repr)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "2", "3", "7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert rows_of(_shared(spark.createDataFrame(rows, "sig long, key long"))) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_rows_of_a_repeated_id_do_not_fill_the_probed_lists(spark):
    r = np.random.default_rng(3)
    crowd = r.standard_normal(8)
    rows = [(0, (crowd + 0.01 * r.standard_normal(8)).tolist()) for _ in range(1500)] + [(i, r.standard_normal(8).tolist()) for i in range(1, 30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:3], vectors.schema)
    found = nearest(vectors, asked).collect()
    assert len(found) == 15 and all(x["vec_id"] != 0 for x in found)
    matrix = np.array([v for _, v in rows])
    for query in range(3):
        cosine = matrix @ matrix[query] / np.linalg.norm(matrix, axis=1) / np.linalg.norm(matrix[query])
        want = sorted((i for i in range(1500, 1529)), key=lambda i: -cosine[i])[:5]
        assert sum(sorted(x["vec_id"] for x in found).count(rows[i][0]) > 0 for i in want) == 5
