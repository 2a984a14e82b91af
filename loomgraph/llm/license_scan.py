"""License scans by a positional index of rare template words, in DataFrame functions only.

Over all files the inverse document frequency of the template words is counted. Two kinds of templates are looked up:

- Key phrases (names of licences, the base phrases, the mandatory phrases of texts). The two rarest words of a phrase are its
  anchors; the place of an anchor in the file less its place in the phrase is where the phrase would have to start, the
  starts that both anchors give are intersected, and at each one left the phrase is verified word by word. As a phrase cannot
  stand anywhere without its anchors, no place is missed.
- Whole texts. The index lists the ``POSTINGS`` rarest words of each text with their places in it. A file is looked up by its
  ``LOOKED_UP`` highest-IDF index words; each of their places votes for a start of each text that holds the word. Starts fall
  into stretches of ``STRETCH`` words, so inserted, changed or dropped words do not matter; where ``VOTES`` different words
  agree within two neighbouring stretches the text may stand, and it does if all of its mandatory phrases stand there.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.license_texts import LICENSES, NAMES

#: What separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words of a text that the index holds, words of a file that are looked up, and those of them that must agree.
POSTINGS, LOOKED_UP, VOTES = 16, 16, 5
#: Words in a stretch of starts.
STRETCH = 24


@dataclass(frozen=True)
class Template:
    label: str | None  # None: a mandatory phrase, which gives no label by itself
    words: tuple[str, ...]
    base: bool


@dataclass(frozen=True)
class Text:
    label: str
    words: tuple[str, ...]
    mandatory: tuple[int, ...]  # places of its phrases among the templates


def plain_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def all_templates() -> list[Template]:
    phrase = lambda p, label, base=False: Template(label, tuple(p.split()), base)
    return [phrase(p, label, True) for p, label in BASE] + [phrase(p, label) for p, label in NAMES] + [phrase(p, None) for _, phrases, _ in LICENSES for p in phrases]


def all_texts() -> list[Text]:
    at, out = len(BASE) + len(NAMES), []
    for label, phrases, text in LICENSES:
        out.append(Text(label, plain_words(text), tuple(range(at, at + len(phrases)))))
        at += len(phrases)
    return out


def words_of(text: Column) -> Column:
    """Words of the whole text, A-Z in lower case; null counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    parts = F.split(low, SEPARATORS)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    # a text of separators alone gives one or two empty strings
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def template_idf(docs: DataFrame, templates: list[Template | Text], text_col: str = "text") -> dict[str, float]:
    """log((files + 1) / (files that hold the word + 1)) of every template word, over all files.

    One count for each template word and one for the files come to the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col(text_col)))
    rows = docs.select(F.explode(F.array_append(seen, F.lit(""))).alias("word")).groupBy("word").count().collect()
    files = {r["word"]: r["count"] for r in rows}
    return {w: math.log((files.get("", 0) + 1) / (files.get(w, 0) + 1)) for w in vocabulary}


def anchors(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The two rarest words of the template with their places; equals by place."""
    ranked = sorted(enumerate(template.words), key=lambda x: (-idf[x[1]], x[0]))
    return [(w, i) for i, w in ranked[:2]]


def postings(text: Text, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The POSTINGS rarest words of a text, equals by word, with their first places in it."""
    return [(w, text.words.index(w)) for w in sorted(set(text.words), key=lambda w: (-idf[w], w))[:POSTINGS]]


def _text_places(occurrences: Column, places: Column, texts: list[Text], idf: dict[str, float]) -> tuple[Column, Column]:
    """The votes (t, b, w) of a file, and from them, as column _votes, for each text the stretches in which it starts."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, text in enumerate(texts):
        for w, p in postings(text, idf):
            index.setdefault(w, []).append((t, p))
    known = sorted(index, key=lambda w: (-idf[w], w))
    rank = F.create_map(*[x for i, w in enumerate(known) for x in (F.lit(w), F.lit(i))])
    held = F.create_map(*[x for w in known for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in index[w]]))])
    own = F.filter(occurrences, lambda o: o["w"].isin(known))
    looked_up = F.slice(F.array_sort(F.array_distinct(F.transform(own, lambda o: F.element_at(rank, o["w"])))), 1, LOOKED_UP)
    chosen = F.filter(own, lambda o: F.array_contains(looked_up, F.element_at(rank, o["w"])))
    start = lambda o, e: F.floor((o["i"] - e["p"]) / STRETCH).cast("int")
    votes = F.flatten(F.transform(chosen, lambda o: F.transform(F.element_at(held, o["w"]), lambda e: F.struct(e["t"].alias("t"), start(o, e).alias("b"), F.element_at(rank, o["w"]).alias("w")))))

    def agreed(t: int) -> Column:
        """Stretches b for which enough different words vote in b - 1 and b together."""
        mine = F.array_sort(F.array_distinct(F.transform(F.filter("_votes", lambda v: v["t"] == t), lambda v: F.struct(v["b"], v["w"]))))
        none = F.array().cast("array<int>")
        zero = F.struct(F.lit(-2_000_000_000).alias("b"), none.alias("before"), none.alias("now"), none.alias("found"))

        def step(a: Column, v: Column) -> Column:
            before = F.when(v["b"] == a["b"], a["before"]).when(v["b"] == a["b"] + 1, a["now"]).otherwise(none)
            now = F.when(v["b"] == a["b"], F.array_append(a["now"], v["w"])).otherwise(F.array(v["w"]))
            found = F.when(F.size(F.array_union(before, now)) >= VOTES, F.array_union(a["found"], F.array(v["b"]))).otherwise(a["found"])
            return F.struct(v["b"].alias("b"), before.alias("before"), now.alias("now"), found.alias("found"))

        return F.aggregate(mine, zero, step, lambda a: a["found"])

    def standing(t: int) -> Column:
        text = texts[t]
        there = lambda b, k: F.exists(F.get(places, F.lit(k)), lambda p: (p >= (b - 1) * STRETCH) & (p < (b + 1) * STRETCH + len(text.words)))

        def every(b: Column) -> Column:
            keep = F.lit(True)
            for k in text.mandatory:
                keep &= there(b, k)
            return keep

        return F.filter(agreed(t), every)

    # the votes are laid out once, for all texts
    body = F.array(*map(standing, range(len(texts))))
    return votes, body


def scan_licenses(docs: DataFrame, templates: list[Template], texts: list[Text], idf: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, places (array<array<int>>: for each template where its phrase stands, in words from
    0, ascending), texts (array<array<int>>: for each text the stretches of STRETCH words in which it starts) and score:
    1 - exp(-w), w the largest summed inverse document frequency of a phrase found; 0 without one.

    A null or empty text has no words and no places. Existing columns of these names are replaced, and so are those
    named _words, _rare and _votes, which go.
    """
    rare = [anchors(t, idf) for t in templates]
    index = sorted({w for pair in rare for w, _ in pair} | {w for t in texts for w, _ in postings(t, idf)})
    none = F.array().cast("array<int>")
    words = F.col("_words")

    def places(k: int) -> Column:
        t = templates[k]
        start = lambda word, at: F.transform(F.filter("_rare", lambda x: x["w"] == word), lambda x: x["i"] - at)
        candidates = start(*rare[k][0])
        for word, at in rare[k][1:]:
            candidates = F.array_intersect(candidates, start(word, at))
        phrase = F.array(*map(F.lit, t.words))
        return F.filter(candidates, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, len(t.words)) == phrase))

    held = F.array(*map(F.lit, index))
    occurrences = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(index))
    empty = F.array().cast("array<struct<w:string,i:int>>")
    docs = docs.withColumn("_words", words_of(F.col(text_col)))
    docs = docs.withColumn("n_words", F.size("_words").cast("long"))
    docs = docs.withColumn("_rare", F.when(F.arrays_overlap("_words", held), occurrences).otherwise(empty))
    docs = docs.withColumn("places", F.when(F.size("_rare") > 0, F.array(*map(places, range(len(templates))))).otherwise(F.array_repeat(none, len(templates))))
    votes, standing = _text_places(F.col("_rare"), F.col("places"), texts, idf)
    # a text stands only where its mandatory phrases do, so few files come to the votes
    mandatory = F.exists(F.slice("places", min(k for t in texts for k in t.mandatory) + 1, len(templates)), lambda p: F.size(p) > 0) if texts else F.lit(False)
    docs = docs.withColumn("_votes", F.when(mandatory, votes))
    docs = docs.withColumn("texts", F.when(mandatory, standing).otherwise(F.array_repeat(none, len(texts))))
    weight = [sum(idf[w] for w in t.words) for t in templates]
    best = F.array_max(F.zip_with("places", F.array(*map(F.lit, weight)), lambda p, w: F.when(F.size(p) > 0, w).otherwise(F.lit(0.0))))
    return docs.withColumn("score", F.round(1 - F.exp(-best), 6)).drop("_words", "_rare", "_votes")


def labels_text(places: Column, labels: list[str | None], more: Column | None = None) -> Column:
    """The labels whose template has a place, and those of ``more``: distinct, sorted, comma-joined. A None label never
    counts."""
    named = F.array_compact(F.array(*[F.when(F.size(F.get(places, F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(labels) if label]))
    return F.array_join(F.array_sort(F.array_distinct(named if more is None else F.concat(named, more))), ",")
