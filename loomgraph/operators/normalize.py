"""Normalisation of texts, names, dates, quantities and currency as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.text import normalize_punctuation, normalize_whitespace, parse_number

#: Titles before a name and forms after a company's name, without their dots.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "rev", "hon")
FORMS = ("inc", "corp", "llc", "ltd", "co", "gmbh", "plc")
#: Units with their dimension and how many base units (m, kg, l) they have.
UNITS = {
    "mm": ("length", 0.001), "cm": ("length", 0.01), "m": ("length", 1.0), "km": ("length", 1000.0), "in": ("length", 0.0254), "ft": ("length", 0.3048), "mi": ("length", 1609.344),
    "mg": ("weight", 1e-6), "g": ("weight", 0.001), "kg": ("weight", 1.0), "t": ("weight", 1000.0), "oz": ("weight", 0.028349523125), "lb": ("weight", 0.45359237),
    "ml": ("volume", 0.001), "l": ("volume", 1.0), "gal": ("volume", 3.785411784),
}
#: Signs of currencies with their codes.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CODES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD")


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    """The text in a Unicode normal form: NFC, NFD, NFKC or NFKD. A null stays null."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no such form: {form}")

    @F.pandas_udf(T.StringType())
    def normal(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    # plain ASCII is normal in every form: such texts stay where they are, and Python gets nulls in their place
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, c).otherwise(normal(F.when(~ascii_only, c)))


@F.pandas_udf(T.StringType())
def strip_diacritics(x: pd.Series) -> pd.Series:
    """Letters without their marks: decomposed, less the non-spacing marks."""
    return x.map(lambda t: "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn"), na_action="ignore")


def normalize_text(c: Column, form: str = "NFC", case: str = "preserve") -> Column:
    """Unicode form, white space, punctuation, case (preserve, lower, upper, title) and outer space, in this order."""
    c = normalize_punctuation(normalize_whitespace(normalize_unicode(c, form)))
    return F.trim({"preserve": lambda x: x, "lower": F.lower, "upper": F.upper, "title": F.initcap}[case](c))


def entity_name(c: Column) -> Column:
    """A name without titles before it and company forms after it, with single spaces, each word capitalised if the name
    is in one case only. A name of titles alone stays as it is."""
    plain = F.trim(F.regexp_replace(c, r"\s+", " "))
    bare = F.regexp_replace(plain, rf"(?i)^(?:(?:{'|'.join(TITLES)})\.?\s+)+", "")
    bare = F.regexp_replace(bare, rf"(?i)(?:,?\s+(?:{'|'.join(FORMS)})\.?)+$", "")
    bare = F.when(bare == "", plain).otherwise(bare)
    return F.when((bare == F.lower(bare)) | (bare == F.upper(bare)), F.initcap(bare)).otherwise(bare)


def resolve_aliases(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``canonical``: the name that ``aliases`` (alias, canonical; the smallest of several) has for it, without
    case, else the name itself."""
    known = aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    return df.withColumn("_alias", F.lower(F.trim(name))).join(known, "_alias", "left").withColumn("canonical", F.coalesce("_canonical", F.col(name))).drop("_alias", "_canonical")


def quantity(c: Column) -> Column:
    """struct(value, unit, dimension, base) of a text such as "5 km" or "1,200 lb"; base is the value in m, kg or l. Null
    where no known unit stands."""
    found = F.regexp_extract(F.trim(c), r"^([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*([A-Za-z]+)$", 1)
    unit = F.lower(F.regexp_extract(F.trim(c), r"^[+-]?[0-9][0-9,]*(?:\.[0-9]+)?\s*([A-Za-z]+)$", 1))
    table = F.create_map(*[x for u, (dimension, factor) in UNITS.items() for x in (F.lit(u), F.struct(F.lit(dimension).alias("dimension"), F.lit(factor).alias("factor")))])
    known = F.try_element_at(table, unit)
    value = F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    return F.when(known.isNotNull() & value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit"), known["dimension"].alias("dimension"), (value * known["factor"]).alias("base")))


def convert(value: Column, source: str, target: str) -> Column:
    """A value of one unit in another of the same dimension."""
    (d1, f1), (d2, f2) = UNITS[source], UNITS[target]
    if d1 != d2:
        raise ValueError(f"{source} is a {d1}, {target} a {d2}")
    return value * F.lit(f1 / f2)


def money(c: Column) -> Column:
    """struct(amount, currency) of a text with a currency sign or code; an amount alone is in USD. Null without one."""
    t = F.trim(c)
    code = F.upper(F.regexp_extract(t, rf"(?i)\b({'|'.join(CODES)})\b", 1))
    sign = F.lit(None).cast("string")
    for s, known in CURRENCIES.items():
        sign = F.when(t.contains(s), known).otherwise(sign)
    amount = parse_number(F.regexp_replace(t, rf"(?i)\b(?:{'|'.join(CODES)})\b", ""))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), F.coalesce(F.nullif(code, F.lit("")), sign, F.lit("USD")).alias("currency")))


def relative_time(c: Column, reference: Column) -> Column:
    """The time of "N units ago" or "N units from now" (second to year); null for anything else."""
    t = F.lower(F.trim(c))
    pattern = r"^(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+(ago|from now)$"
    n = F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("int")
    unit, sign = F.regexp_extract(t, pattern, 2), F.when(F.regexp_extract(t, pattern, 3) == "ago", -1).otherwise(1)
    n, zero, out = n * sign, F.lit(0), F.lit(None).cast("timestamp_ntz")
    for k, name in enumerate(("year", "month", "week", "day", "hour", "minute", "second")):
        parts = [zero] * 7
        parts[k] = n
        out = F.when(unit == name, reference + F.make_interval(*parts)).otherwise(out)
    return F.when(n.isNotNull(), out)


def to_utc(ts: Column, zone: str) -> Column:
    """A wall-clock time of a zone in UTC; daylight saving is the zone's at that time."""
    return F.to_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def _singular(word: Column) -> Column:
    """An English plural without its ending; words in ss, us and is stay."""
    cut = lambda n, more="": F.concat(word.substr(F.lit(1), F.length(word) - n), F.lit(more))
    return F.when(word.rlike("(?i)[^aeiou]ies$"), cut(3, "y")).when(word.rlike("(?i)(?:s|x|z|ch|sh)es$"), cut(2)).when(word.rlike("(?i)[^siu]s$"), cut(1)).otherwise(word)


def _joined(c: Column) -> Column:
    words = F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # a word with capitals inside has its form already
    form = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.when(w.rlike(r"\p{Ll}\p{Lu}"), F.substring(w, 2, 1_000_000)).otherwise(F.lower(F.substring(w, 2, 1_000_000))))
    return F.array_join(F.transform(words, form), "")


def class_name(c: Column) -> Column:
    """Words run together, each capitalised, the last one in singular: the form of class names. Letters of any language count;
    a name without a letter or digit is empty."""
    return _singular(_joined(c))


def property_name(c: Column) -> Column:
    """Words run together, each but the first capitalised: the form of property names. A name that has it already stays."""
    name = _joined(c)
    return F.concat(F.lower(F.left(name, F.lit(1))), F.substring(name, 2, 1_000_000))


def safe_filename(c: Column, longest: int = 255) -> Column:
    """A text as a file name: characters that file systems refuse become underscores, outer dots and spaces go."""
    return F.left(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"^[. ]+|[. ]+$", ""), F.lit(longest))


def table_checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): one digest of a table, whatever the order and layout of its rows: the number of rows and the sums of four
    60-bit parts of each row's SHA-256, hashed. Sums commute, so they are made where the rows are, and nothing is listed.
    Nulls and empty texts differ; a repeated row counts each time."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("_h", k, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string")
    sums = df.select(row.alias("_h")).agg(F.count("*").alias("rows"), *[part(k).alias(f"_s{k}") for k in (1, 16, 31, 46)])
    return sums.select("rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), "_s1", "_s16", "_s31", "_s46"), 256).alias("checksum"))
