"""Chunks that keep things together, on awkward texts and against a plain search of borders."""

from __future__ import annotations

import random
import re

from loomgraph.operators import chunks as C
from loomgraph.operators import mentions as M


def _frame(spark, texts):
    rows = [(k, t, "x", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, text string, chunk string, held int")  # columns with clashing names


def _plain(text, spans, size, within):
    """The same by its definition: every border is looked at with every span."""
    text = re.sub(r"(?<=[.!?])\s+\Z", "", text)
    gaps = [m.span() for m in re.finditer(r"(?<=[.!?])\s+", text)]
    free = []
    for a, b in gaps:
        inside = any(s < b and e > a for s, e in spans)
        near = any(e <= a and s2 >= b and s2 - e < within for _, e in spans for s2, _ in spans)
        if not inside and not near:
            free.append((a, b))
    out, begin = [], 0
    pieces = [(x, y) for x, y in zip([0] + [b for _, b in free], [a for a, _ in free] + [len(text)], strict=True)]
    for k, (_, y) in enumerate(pieces):
        last = k + 1 == len(pieces)
        if last or pieces[k + 1][1] - begin > size:
            out.append((begin, y))
            begin = None if last else pieces[k + 1][0]
    return out


def test_chunks_by_mentions_equal_their_definition(spark):
    rnd = random.Random(5)
    words = ["so.", "it", "was", "Anna", "Berg", "1999", "Oslo City", "no!", "yes?", "Acme Corp.", "\n", "Dr.", "ж."]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    df = _frame(spark, texts)
    spans = {}
    for r in M.find_mentions(df, ["id"], "text").collect():
        spans.setdefault(r["id"], []).append((r["start"], r["end"]))
    for within, found in ((0, C.chunk_by_entities(df, ["id"], "text", 30)), (20, C.chunk_by_relations(df, ["id"], "text", 30, 20))):
        got = {}
        for r in found.orderBy("id", "chunk").collect():
            assert r["chunk"] == len(got.setdefault(r["id"], [])) and r["chunk_text"] == texts[r["id"]][r["start"]:r["end"]]
            assert r["held"] == sum(r["start"] <= s < r["end"] for s, _ in spans.get(r["id"], []))
            got[r["id"]].append((r["start"], r["end"]))
        assert got == {k: _plain(t, spans.get(k, []), 30, within) for k, t in enumerate(texts)}


def test_awkward_texts(spark):
    long = "Short one here. " * 20_000
    df = _frame(spark, [None, "", "   ", "no end", "A. B. ", long])
    whole, apart = [(0, 3), (0, 6), (0, 5)], [(0, 3), (0, 6), (0, 2), (3, 5)]
    for found, want in ((C.chunk_by_entities(df, ["id"], "text", 400), whole), (C.chunk_by_relations(df, ["id"], "text", 400), whole), (C.chunk_by_meaning(df, ["id"], "text", 400), apart)):
        rows = found.select("id", "start", "end").collect()
        assert [(r["start"], r["end"]) for r in sorted(rows) if r["id"] < 5] == want
        ends = sorted((r["start"], r["end"]) for r in rows if r["id"] == 5)
        assert ends[0][0] == 0 and ends[-1][1] == len(long) - 1
        assert all(e - s <= 400 for s, e in ends) and all(b[0] == a[1] + 1 for a, b in zip(ends, ends[1:], strict=False))
    assert C.chunk_by_meaning(df.limit(0), ["id"], "text").count() == 0


def test_chunks_by_meaning_cut_where_the_subject_changes(spark):
    text = "The cat sat. The cat ran. A cat sat. Bonds fell today. Bonds rose today. 5 % !"
    found = C.chunk_by_meaning(_frame(spark, [text]), ["id"], "text", 1000, 0.7).orderBy("chunk").collect()  # distances 1/3, 2/3, 1, 1/3, 1
    assert [r["chunk_text"] for r in found] == ["The cat sat. The cat ran. A cat sat.", "Bonds fell today. Bonds rose today.", "5 % !"]
    same = C.chunk_by_meaning(_frame(spark, ["Yes. Yes. Yes."]), ["id"], "text", 1000, 0.5)
    assert [r["chunk_text"] for r in same.collect()] == ["Yes. Yes. Yes."]
