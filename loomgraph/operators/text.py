"""Text cleaning, chunking and pattern extraction as columns; but for the places of recursive and sliding chunks all of it
runs inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import prepare


def normalize_whitespace(c: Column) -> Column:
    """Tabs and runs of spaces become one space, CR LF and CR become LF, runs of blank lines one; no outer space."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"\n{2,}", "\n\n"), r"^\s+|\s+$", "")


def normalize_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes and dots in ASCII."""
    return F.replace(F.translate(c, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))


def strip_html(c: Column) -> Column:
    """The text between tags, without scripts, styles and comments."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return normalize_whitespace(c)


def parse_number(c: Column) -> Column:
    """Numbers with thousands commas, currency signs, per cent (by 100) and k, m, b, t suffixes; else null."""
    plain = F.lower(F.regexp_replace(c, r"[,\s$€£¥]", ""))
    value = F.regexp_extract(plain, r"^([+-]?[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?)[kmbt%]?$", 1).try_cast("double")
    last = F.right(plain, F.lit(1))
    factor = F.when(last == "%", 0.01).when(last == "k", 1e3).when(last == "m", 1e6).when(last == "b", 1e9).when(last == "t", 1e12).otherwise(1.0)
    return value * factor


def fixed_windows(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of ``size`` over n units, each ``overlap`` units before the end of the one before; the last one
    ends at n."""
    step = size - overlap
    count = F.when(n > 0, F.ceil(F.greatest(n - size, F.lit(0)) / step) + 1).otherwise(0).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunk_characters(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``df`` with one row for each chunk: chunk (from 0), start, chunk_text. A null or empty text has none."""
    rows = df.select("*", F.posexplode(fixed_windows(F.length(text), size, overlap)).alias("chunk", "start"))
    return rows.withColumn("chunk_text", F.col(text).substr(F.col("start") + 1, F.lit(size)))


def chunk_words(df: DataFrame, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """The same over words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = df.withColumn("_words", words).select("*", F.posexplode(fixed_windows(F.size("_words"), size, overlap)).alias("chunk", "start"))
    return rows.withColumn("chunk_text", F.array_join(F.slice("_words", F.col("start") + 1, size), " ")).drop("_words")


def pack(parts: Column, size: int, glue: str = " ") -> Column:
    """Neighbouring parts put together as long as the sum stays within ``size``; a longer part stays alone."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, p: Column) -> Column:
        joined = F.concat(a["open"], F.lit(glue), p)
        fits = F.length(joined) <= size
        return F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), p.alias("open"))).when(fits, F.struct(a["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), p.alias("open")))

    return F.aggregate(parts, zero, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def chunk_sentences(df: DataFrame, text: str, size: int = 1000) -> DataFrame:
    """Sentences (ended by . ! ? and white space) packed up to ``size`` characters."""
    parts = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    return df.select("*", F.posexplode(pack(parts, size)).alias("chunk", "chunk_text"))


def chunk_paragraphs(df: DataFrame, text: str, size: int = 2000) -> DataFrame:
    """Paragraphs (set off by blank lines) packed up to ``size`` characters."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda s: s != "")
    return df.select("*", F.posexplode(pack(parts, size, "\n\n")).alias("chunk", "chunk_text"))


#: Patterns of entities with their labels.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "MONEY": r"[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?",
    "PERCENT": r"[0-9]+(?:\.[0-9]+)?\s?%",
    "DATE": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
}


def extract_entities(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one row for each match of a pattern: label, entity."""
    def matches(label: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda e: F.struct(F.lit(label).alias("label"), e.alias("entity")))

    found = [matches(label, pattern) for label, pattern in PATTERNS.items()]
    return df.select("*", F.explode(F.concat(*found)).alias("_e")).select("*", "_e.label", "_e.entity").drop("_e")


def chunk_tokens(df: DataFrame, text: str, budget: int = 500) -> DataFrame:
    """Sentences packed up to ``budget`` words."""
    parts = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        fits = (a["n"] == 0) | (a["n"] + count(p) <= budget)
        joined = F.when(a["n"] == 0, p).otherwise(F.concat(a["open"], F.lit(" "), p))
        return F.when(fits, F.struct(a["done"].alias("done"), joined.alias("open"), (a["n"] + count(p)).alias("n"))).otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), p.alias("open"), count(p).alias("n")))

    packed = F.aggregate(parts, zero, step, lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return df.select("*", F.posexplode(packed).alias("chunk", "chunk_text"))


#: What a text is split at, the widest first.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursively(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``size`` characters that cover a text: cut at the widest separator that it
    holds, too long parts at the next one, then neighbours put together as long as they fit."""
    def cut(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= size:
            return [(a, b)] if b > a else []
        glue = separators[level] if level < len(separators) else ""
        if not glue:
            return [(k, min(k + size, b)) for k in range(a, b, size)]
        out, at = [], a
        while at < b:
            found = text.find(glue, at, b)
            end = b if found < 0 else found + len(glue)
            out += cut(at, end, level + 1)
            at = end
        return out

    packed: list[tuple[int, int]] = []
    for a, b in cut(0, len(text), 0):
        if packed and b - packed[-1][0] <= size:
            packed[-1] = (packed[-1][0], b)
        else:
            packed.append((a, b))
    return packed


def _spans(df: DataFrame, text: str, spans_of) -> DataFrame:
    """``df`` with chunk, start, end and chunk_text for each span that ``spans_of(text)`` gives; only spans leave Python."""
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [] if not t else [{"start": a, "end": b} for a, b in spans_of(t)])

    prepare(df.sparkSession)  # long texts reach Python in small batches
    rows = df.select("*", F.posexplode(spans(F.coalesce(F.col(text), F.lit("")))).alias("chunk", "_span"))
    return rows.select("*", F.col("_span.start").alias("start"), F.col("_span.end").alias("end")).withColumn("chunk_text", F.col(text).substr(F.col("start") + 1, F.col("end") - F.col("start"))).drop("_span")


def chunk_recursively(df: DataFrame, text: str, size: int = 1000) -> DataFrame:
    """Pieces of at most ``size`` characters by ``split_recursively``, with their places. A null or empty text has none."""
    return _spans(df, text, lambda t: split_recursively(t, size))


def slide(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of at most ``size`` characters that end at a sentence, else at a word, if one ends in their second half; each
    begins ``overlap`` characters before the end of the one before, moved back to the start of a word."""
    out, a = [], 0
    while a < len(text):
        b = min(a + size, len(text))
        if b < len(text):
            half = a + size // 2
            ends = [m.end() for m in re.finditer(r"[.!?]\s", text[half:b])] or [m.end() for m in re.finditer(r"\s", text[half:b])]
            b = half + ends[-1] if ends else b
        out.append((a, b))
        if b == len(text):
            break
        back = max(b - overlap, a + 1)
        space = text.rfind(" ", a + 1, back + 1)
        a = space + 1 if overlap and a + 1 < space + 1 < b else back
    return out


def chunk_sliding(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows by ``slide``, with their places."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is less than the size")
    return _spans(df, text, lambda t: slide(t, size, overlap))


def chunk_structure(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one row for each block of lines of one kind: chunk, kind (heading, list, code, text), chunk_text. Blank
    lines part blocks; fences open and close code. A null or empty text has none."""
    lines = F.split(F.col(text), r"\r\n?|\n")
    zero = F.struct(F.array().cast("array<struct<kind:string,line:string>>").alias("done"), F.lit(False).alias("code"))

    def step(a: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*```")
        kind = F.when(a["code"] | fence, "code").when(line.rlike(r"^\s*#{1,6}\s"), "heading").when(line.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").when(line.rlike(r"^\s*$"), "").otherwise("text")
        return F.struct(F.array_append(a["done"], F.struct(kind.alias("kind"), line.alias("line"))).alias("done"), F.when(fence, ~a["code"]).otherwise(a["code"]).alias("code"))

    marked = F.aggregate(F.filter(lines, lambda x: F.length(F.col(text)) > 0), zero, step, lambda a: a["done"])
    start = F.struct(F.array().cast("array<struct<kind:string,chunk_text:string>>").alias("done"), F.lit("").alias("kind"))

    def join(a: Column, x: Column) -> Column:
        last = F.element_at(a["done"], -1)
        goes_on = (x["kind"] != "") & (x["kind"] == a["kind"]) & (x["kind"] != "heading")
        longer = F.array_append(F.slice(a["done"], 1, F.size(a["done"]) - 1), F.struct(last["kind"].alias("kind"), F.concat(last["chunk_text"], F.lit("\n"), x["line"]).alias("chunk_text")))
        added = F.array_append(a["done"], F.struct(x["kind"].alias("kind"), x["line"].alias("chunk_text")))
        return F.struct(F.when(goes_on, longer).when(x["kind"] == "", a["done"]).otherwise(added).alias("done"), x["kind"].alias("kind"))

    blocks = F.aggregate(marked, start, join, lambda a: a["done"])
    return df.select("*", F.posexplode(blocks).alias("chunk", "_b")).select("*", "_b.kind", "_b.chunk_text").drop("_b")


def chunk_hierarchy(df: DataFrame, text: str, key: str, sizes: tuple[int, ...] = (2000, 1000, 500)) -> DataFrame:
    """(key, level, chunk_id, parent_id, start, end, chunk_text): sections of the first size, each cut into paragraphs of the
    second, each into sentences of the third. Ids are key:start:end:level; a section has no parent. Offsets are those of the
    whole text, so a chunk's lineage is its text's place."""
    parent = df.select(key, F.col(text).alias("chunk_text"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("chunk_id"))
    out = None
    for level, size in enumerate(sizes):
        rows = chunk_recursively(parent.select(key, F.col("chunk_text").alias("_t"), F.col("start").alias("_at"), F.col("chunk_id").alias("parent_id")), "_t", size)
        rows = rows.withColumns({"start": F.col("start") + F.col("_at"), "end": F.col("end") + F.col("_at"), "level": F.lit(level)})
        rows = rows.withColumn("chunk_id", F.concat_ws(":", F.col(key).cast("string"), "start", "end", "level")).select(key, "level", "chunk_id", "parent_id", "start", "end", "chunk_text")
        out = rows if out is None else out.unionByName(rows)
        parent = rows
    return out


#: Relations with what is said between their subject and object.
RELATIONS = {"founded_by": "was founded by|founded by", "located_in": "is located in|located in|based in", "works_for": "works for|works at|is employed by", "born_in": "was born in|born in", "acquired": "acquired|has acquired"}
#: Possessive, as a matcher that may give back takes stack for each further word; what is said starts small, so nothing is lost.
NAME = r"[A-Z][\w#&-]*+(?: [A-Z][\w#&-]*+)*+"


def extract_relations(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one row for each relation that a pattern finds between two capitalised names: relation, subject, object,
    confidence 0.7."""
    def matches(relation: str, said: str) -> Column:
        pattern = rf"({NAME}) (?:{said}) ({NAME})"
        source = F.coalesce(F.col(text), F.lit(""))
        both = F.arrays_zip(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)).alias("s"), F.regexp_extract_all(source, F.lit(pattern), F.lit(2)).alias("o"))
        return F.transform(both, lambda x: F.struct(F.lit(relation).alias("relation"), x["s"].alias("subject"), x["o"].alias("object")))

    found = F.concat(*[matches(r, said) for r, said in RELATIONS.items()])
    return df.select("*", F.explode(found).alias("_r")).select("*", "_r.relation", "_r.subject", "_r.object", F.lit(0.7).alias("confidence")).drop("_r")


def triples(relations: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """(subject, predicate, object, confidence): whole relations over a confidence, each triple once with its best."""
    kept = relations.where(F.col("confidence") >= least_confidence).dropna(subset=["subject", "relation", "object"]).where("subject <> '' AND object <> '' AND subject <> object")
    return kept.groupBy("subject", F.col("relation").alias("predicate"), "object").agg(F.max("confidence").alias("confidence"))


#: Kinds of events with the words that tell of them.
EVENTS = {"acquisition": "acquired|bought|takeover", "launch": "launched|released|unveiled", "founding": "founded|established", "agreement": "signed|agreed|partnered", "movement": "moved|relocated|shipped"}


def detect_events(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one row for each sentence that tells of an event: kind, trigger (the first word that tells), sentence, and
    date, the first ISO date or year in it."""
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    rows = df.select("*", F.explode(sentences).alias("sentence"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.regexp_extract("sentence", rf"(?i)\b({said})\b", 1)).alias("trigger")) for k, said in EVENTS.items()])
    date = F.nullif(F.regexp_extract("sentence", r"\b(\d{4}-\d{2}-\d{2}|(?:19|20)\d{2})\b", 1), F.lit(""))
    return rows.withColumn("_k", F.explode(F.filter(kinds, lambda k: k["trigger"] != ""))).select("*", "_k.kind", "_k.trigger", date.alias("date")).drop("_k")
