"""Secret scans: fixed patterns plus character Markov models, in DataFrame functions only.

Spark's regular expressions give matches but no positions. Splitting a text at the same pattern gives the
stretches between the matches, so a running sum over the lengths of both gives every start and end.

The models: first-order Markov chains over the characters of random strings and of ordinary identifiers and words,
trained by counting character pairs of labelled samples. Pairs that a sample lacks are judged by their characters' kinds
(``train_pair_ratios``), so a rare pair of letters does not make a word of any language look random. Ordinary samples are
joined from word lists of four languages and taken from the documents themselves (``ordinary_words``). A long run of token characters, without the fixed patterns' spans in
it, is reported when its best contiguous stretch says "random": ordinary text beside a key in one run takes nothing
from the key's score.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kinds in the order in which spans with one start are listed, with pattern and least length.
ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Where none of these occurs, the pattern can't match; they only save work.
QUICK = {"assign": ASSIGN, "access": "AKIA", "hex": r"[0-9a-f]{24}"}
MARKOV = "markov"
#: Spans that are put together in one array before it is joined to others.
BLOCK = 512
#: What the models judge: runs of token characters of at least LEAST_STRETCH.
LEAST_STRETCH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_STRETCH},}}+"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: A span with the range that is judged.
PIECE = "array<struct<start:bigint,kind:int,end:bigint,low:bigint,high:bigint>>"

#: Words that the identifier samples are made of.
IDENTIFIER_WORDS = """get set add list item user name value index count total input output result buffer request response
handler service manager factory builder config option default version update delete create insert select
filter order group table column record field string number integer double float array object class method
function module package import export parse format print write read open close start stop begin end first last
next previous current parent child node edge graph tree path file folder directory resource context session
connection transaction message event listener callback thread process queue stack cache memory storage database
server client network protocol address internet information international representation responsibility
the and that this with from have which their there would about other into than then them these""".split()
#: Frequent words of German, French and Spanish in ASCII, joined to the long words that German likes.
COMMON_WORDS = {
    "de": """haupt stadt bahn hof strasse versicherung gesellschaft wirtschaft arbeit geber nehmer schutz gesetz recht kraft fahrzeug
haft pflicht schiff fahrt donau dampf kapitaen rind fleisch etikett ueberwachung aufgaben uebertragung leben mittel
geschwindigkeit begrenzung kranken haus schwester geschichte wissen schaft jahr hundert grund stueck verkehr genehmigung
zustaendig keit verantwortung freund lich selbst verstaendnis entwicklung zusammen hang unter nehmen ver waltung""".split(),
    "fr": """anticonstitutionnellement gouvernement developpement responsabilite environnement intergouvernemental representation
particulierement connaissance apprentissage bibliotheque quelque chose toujours beaucoup aujourd maintenant travail
entreprise internationale electrique psychologique extraordinairement photographie""".split(),
    "es": """desarrollo responsabilidad internacionalmente electroencefalografista gobierno ayuntamiento conocimiento
independientemente caracteristicas administracion otorrinolaringologo universidad trabajador extraordinariamente
aprendizaje comunicaciones transformacion desafortunadamente ciudad""".split(),
}


def ordinary_words(docs: DataFrame, max_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, random = false): the words, of four ASCII letters or more, of the ``max_docs`` documents whose id and text have
    the smallest hash; equal rows count once. What the fixed patterns find is cut out first, and so is what has a digit."""
    key = F.xxhash64(id_col, text_col)
    picked = docs.select(key.alias("_key")).orderBy("_key").limit(max_docs).distinct()  # max_docs numbers of 8 bytes
    texts = docs.select(key.alias("_key"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(picked), "_key", "left_semi")
    text = F.first("_text")
    for _, pattern, _, _ in BASE:
        text = F.regexp_replace(text, pattern, " 0 ")
    words = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}+(?![A-Za-z0-9+/_=-])"), F.lit(0))
    return texts.groupBy("_key").agg(words.alias("words")).select(F.explode("words").alias("text"), F.lit(False).alias("random"))


def compound_words(spark: SparkSession, n: int) -> DataFrame:
    """(text, random = false): n words of each language, each joined of one to four of COMMON_WORDS, in small letters, with
    a capital first or in capitals alone."""
    ids, parts = spark.range(n), []
    for lang, listed in sorted(COMMON_WORDS.items()):
        words = F.array(*map(F.lit, listed))
        draw = lambda k, m, lang=lang: F.pmod(F.xxhash64(F.lit(lang), F.lit(k), "id"), F.lit(m)).cast("int")
        joined = F.array_join(F.slice(F.array(*[F.get(words, draw(k, len(listed))) for k in range(4)]), F.lit(1), 1 + draw(9, 4)), "")
        parts.append(ids.select(F.when(draw(8, 8) == 0, F.upper(joined)).when(draw(8, 8) < 4, F.initcap(joined)).otherwise(joined).alias("text"), F.lit(False).alias("random")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def training_samples(spark: SparkSession, n: int = 3000, docs: DataFrame | None = None) -> DataFrame:
    """(text, random): labelled strings, to which ``docs`` add their ``ordinary_words``. Random ones are digests written in base 64, base 36 style capitals and
    hexadecimal; identifiers join ordinary words in the usual ways, in paths and assignments with numbers and dates too,
    and separator lines repeat one or two characters."""
    ids = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    base64 = F.translate(F.base64(F.unhex("digest")), "=", "")
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    word = lambda k: F.get(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    title = lambda k: F.initcap(word(k))
    upper = lambda k: F.upper(word(k))
    number, digit = F.col("id").cast("string"), lambda m: F.lpad((F.col("id") % m + 1).cast("string"), 2, "0")
    date = F.concat_ws("-", (1990 + F.col("id") % 40).cast("string"), digit(12), digit(28))
    rule = lambda n, chars: F.get(F.array(*map(F.lit, chars)), F.pmod(n, F.lit(len(chars))).cast("int"))
    repeated = lambda text, n: F.repeat(text, n.cast("int"))
    random = F.array(base64, F.upper(F.regexp_replace(base64, "[+/]", "")), F.col("digest"), F.substring(base64, 3, 24), F.translate(base64, "+/", "-_"))
    ordinary = F.array(
        F.concat(word(1), word(2), word(3)),
        F.concat_ws("_", word(4), word(5), word(6), word(7)),
        F.concat(word(8), title(9), title(10), title(11)),
        F.upper(F.concat_ws("_", word(12), word(13), word(14))),
        F.concat_ws("/", word(15), word(16), word(17), F.concat(word(18), F.pmod("id", F.lit(100)).cast("string"))),
        F.concat_ws("-", word(19), word(20), word(21)),
        F.concat_ws("/", word(22), F.concat(word(23), title(24)), F.concat_ws("_", upper(25), upper(26)), F.concat(word(27), number), date, F.concat_ws("-", word(28), word(29))),
        F.concat(word(30), F.lit("="), F.concat_ws("/", F.concat(title(31), title(32), F.lit("-"), number, F.lit("_"), word(33)), title(34), F.translate(date, "-", "/"), F.concat_ws("=", upper(35), word(36)))),
        repeated(rule(F.col("id"), "-_=+/xX0"), 20 + F.col("id") % 60),
        repeated(F.concat(rule(F.col("id"), "-_=+/"), rule(F.floor(F.col("id") / 5), "-_=+/")), 10 + F.col("id") % 30),
    )
    one = lambda texts, label: ids.select(F.explode(texts).alias("text"), F.lit(label).alias("random"))
    samples = one(random, True).unionByName(one(ordinary, False)).unionByName(compound_words(spark, n))
    return samples.unionByName(ordinary_words(docs)) if docs is not None else samples


#: Characters of token runs by kind.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-")


def train_pair_ratios(samples: DataFrame, weight: float = 30.0) -> list[float]:
    """log2 P(b | a, random) - log2 P(b | a, ordinary) for all pairs of characters of token runs, at index 128 a + b, and
    0 for all others.

    P(b | a) of a label is its share among the pairs that start with a, with ``weight`` further pairs shared out by kind: the
    share of b's kind after a's kind, each character of a kind alike. So a pair of small letters that no ordinary sample
    has is still likelier than one that changes kind.

    What comes to the driver is at most 2 x 128 x 128 counts, however many samples there are."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = samples.where(F.length("text") > 1).select("random", "text", at.alias("i")).select("random", F.ascii(F.col("text").substr(F.col("i"), F.lit(1))).alias("a"), F.ascii(F.col("text").substr(F.col("i") + 1, F.lit(1))).alias("b"))
    counts = {(r["random"], r["a"], r["b"]): r["count"] for r in pairs.where("a < 128 AND b < 128").groupBy("random", "a", "b").count().collect()}
    kind = {ord(c): k for k, chars in enumerate(KINDS) for c in chars}
    after, changes, total = {}, {}, {}
    for (label, a, b), n in counts.items():
        if a in kind and b in kind:
            total[label, a] = total.get((label, a), 0) + n
            after[label, kind[a]] = after.get((label, kind[a]), 0) + n
            changes[label, kind[a], kind[b]] = changes.get((label, kind[a], kind[b]), 0) + n

    def score(label: bool, a: int, b: int) -> float:
        share = (changes.get((label, kind[a], kind[b]), 0) + 1) / (after.get((label, kind[a]), 0) + len(KINDS))
        guess = share / len(KINDS[kind[b]])
        return math.log2((counts.get((label, a, b), 0) + weight * guess) / (total.get((label, a), 0) + weight))

    return [score(True, a, b) - score(False, a, b) if a in kind and b in kind else 0.0 for a in range(128) for b in range(128)]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of BLOCK elements; an empty one gives one empty array."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))


def _in_blocks(rows: Column, total: Callable[[Column], Column], add: Callable[[Column, Column], Column], use: Callable[[Column, Column], Column]) -> Column:
    """All that ``use(block, start)`` gives for the blocks of an array, one after the other. ``start`` is ``add`` over the totals of the
    blocks before. An array that grows by one element is copied whole each time; blocks keep that short."""

    def with_starts(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        step = lambda acc, n: F.struct(add(acc["at"], n).cast("bigint").alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        starts = F.aggregate(F.transform(blocks, total), zero, step, lambda acc: acc["starts"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("start")), lambda x: use(x["block"], x["start"])))

    return _bound(_blocks(rows), with_starts)


def _all_matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all matches whose group is long enough."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("match"), F.transform(groups, F.length).alias("group"))
    width = lambda row: row["gap"] + F.coalesce(row["match"], F.lit(0))

    def step(acc: Column, row: Column) -> Column:
        start, end = (acc["at"] + row["gap"]).cast("bigint"), (acc["at"] + width(row)).cast("bigint")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.coalesce(row["group"] >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def spans(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])

    length = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda acc, row: acc + width(row))
    return _bound(rows, lambda rows: _in_blocks(rows, length, lambda at, n: at + n, spans))


def _pieces(run: Column, base: Column) -> Column:
    """What is left of a run after cutting out the base spans, with the stretch to judge: a piece also has the
    characters of the run next to it."""
    piece = lambda start, end: F.struct(
        start.alias("start"), run["kind"].alias("kind"), end.alias("end"),
        F.greatest(run["start"], start - 1).alias("low"), F.least(run["end"], end + 1).alias("high"),
    )
    zero = F.struct(run["start"].alias("at"), F.array().cast(PIECE).alias("pieces"))

    def step(acc: Column, b: Column) -> Column:
        more = F.when(b["start"] > acc["at"], F.concat(acc["pieces"], F.array(piece(acc["at"], b["start"])))).otherwise(acc["pieces"])
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), more.alias("pieces"))

    def finish(acc: Column) -> Column:
        return F.when(acc["at"] < run["end"], F.concat(acc["pieces"], F.array(piece(acc["at"], run["end"])))).otherwise(acc["pieces"])

    inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.aggregate(inside, zero, step, finish)


def find_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text", least_mean: float = 0.6, least_bits: float = 25.0) -> DataFrame:
    """``docs`` with ``base_spans`` and ``added_spans``: array<struct<start, kind, end>> in code points, end
    exclusive, kind an index into the listed kinds (3: found by the models), in order.

    A null or empty text has no spans. The models judge what is left of a run without the base spans in it, so no span
    of theirs overlaps one. A piece is added whole if any stretch of at least LEAST_STRETCH characters in it has
    log-likelihood ratios that sum to ``least_bits`` over ``least_mean`` a pair. A shorter piece lies beside a base
    span; it is the rest of a longer key, and added, if the mean of its pairs reaches ``least_mean``.
    Existing columns of the two names are replaced; all other columns stay as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPAN)
    found = [F.when(text.rlike(QUICK[kind]), _all_matches(text, pattern, k, group, least)).otherwise(none) for k, (kind, pattern, group, least) in enumerate(BASE)]
    docs = docs.withColumn("base_spans", F.array_sort(F.concat(*found)))

    table, pairs = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>"), LEAST_STRETCH - 1
    zero = F.struct(*[F.lit(x).cast("double").alias(name) for name, x in (("sum", 0), ("late", 0), ("low", 0), ("best", -1e18))])

    def best_stretch(gains: Column) -> Column:
        """(sum, best) of the gains: of all, and of the best stretch of enough pairs. ``late`` is the running sum where
        the shortest stretch that ends here begins, ``low`` the least of those up to here."""

        def step(acc: Column, i: Column) -> Column:
            total = acc["sum"] + F.get(gains, i)
            late = acc["late"] + F.when(i >= pairs, F.get(gains, i - pairs)).otherwise(0.0)
            low = F.least(acc["low"], late)
            best = F.when(i >= pairs - 1, F.greatest(acc["best"], total - low)).otherwise(acc["best"])
            return F.struct(total.alias("sum"), late.alias("late"), low.alias("low"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(gains) - 1), zero, step)

    def looks_random(piece: Column, part: Column, offset: Column) -> Column:
        whole = piece["end"] - piece["start"] >= LEAST_STRETCH
        low, high = F.when(whole, piece["start"]).otherwise(piece["low"]), F.when(whole, piece["end"]).otherwise(piece["high"])
        run = part.substr((low - offset + 1).cast("int"), (high - low).cast("int"))
        gain = lambda codes, i: F.get(table, F.get(codes, i) * 128 + F.get(codes, i + 1)) - least_mean
        gains = _bound(F.transform(F.split(run, ""), F.ascii), lambda codes: F.transform(F.sequence(F.lit(0), (high - low - 2).cast("int")), lambda i: gain(codes, i)))
        return _bound(_bound(gains, best_stretch), lambda found: F.when(whole, found["best"] >= least_bits).otherwise(found["sum"] >= 0))

    runs = F.when(text.rlike(rf"[A-Za-z0-9+/_=-]{{{LEAST_STRETCH}}}"), _all_matches(text, CANDIDATE, len(BASE), 0, LEAST_STRETCH)).otherwise(none)
    ranges = F.transform(_blocks(F.col("base_spans")), lambda b: F.struct(b.alias("spans"), F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high")))
    near = lambda run, r: F.flatten(F.transform(F.filter(r, lambda b: (b["low"] < run["end"]) & (run["start"] < b["high"])), lambda b: b["spans"]))
    pieces = _bound(ranges, lambda r: F.flatten(F.transform(runs, lambda run: _pieces(run, near(run, r)))))

    def random_ones(block: Column) -> Column:
        """Those of a block of pieces that look random. A place in a text is found by counting from its start, so the stretch that
        holds the block is cut out once."""
        low, high = F.array_min(F.transform(block, lambda p: p["low"])), F.array_max(F.transform(block, lambda p: p["high"]))
        stretch = F.struct(text.substr((low + 1).cast("int"), (high - low).cast("int")).alias("part"), low.alias("offset"))
        return _bound(stretch, lambda x: F.filter(block, lambda p: looks_random(p, x["part"], x["offset"])))

    random = F.flatten(F.transform(_bound(pieces, _blocks), random_ones))
    return docs.withColumn("added_spans", F.transform(random, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind, *_ in BASE], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or stretch of overlapping spans, replaced by ``mark``."""
    def step(acc: Column, s: Column, part: Column, offset: Column) -> Column:
        gap = part.substr((acc["at"] - offset + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.concat(gap, F.lit(mark))))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("parts"))

    def parts(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<string>").alias("parts"))
        stretch = text.substr((start + 1).cast("int"), (ends(block) - start).cast("int"))
        return _bound(stretch, lambda part: F.aggregate(block, zero, lambda acc, s: step(acc, s, part, start), lambda acc: acc["parts"]))

    ends = lambda some: F.array_max(F.transform(some, lambda s: s["end"]))
    kept = F.array_join(_in_blocks(F.array_sort(spans), ends, F.greatest, parts), "")
    return F.when(F.size(spans) > 0, F.concat(kept, text.substr((ends(spans) + 1).cast("int"), F.length(text)))).otherwise(text)
