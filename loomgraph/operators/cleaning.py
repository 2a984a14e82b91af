"""Record cleaning: missing values, imputation, validation, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ("", "N/A", "null", "NULL")
TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


def is_missing(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).cast("string").isin(*MISSING)


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, missing, percent): one pass over the rows."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.sum(is_missing(c).cast("long")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit(0)).alias("missing")) for c in columns]))
    return one.select("_n", rows.alias("x")).select("x.field", "x.missing", F.when(F.col("_n") > 0, 100 * F.col("x.missing") / F.col("_n")).otherwise(0.0).alias("percent"))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep &= ~is_missing(c)
    return df.where(keep)


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.when(is_missing(c), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def impute(df: DataFrame, column: str, method: str = "mean") -> DataFrame:
    """Missing numbers as the column's mean, median (of an even number the upper one) or zero."""
    num = F.when(is_missing(column), None).otherwise(F.col(column).try_cast("double"))
    if method == "zero":
        return df.withColumn(column, F.coalesce(num, F.lit(0.0)))
    known = df.select(num.alias("v")).where("v IS NOT NULL")
    if method == "mean":
        value = known.agg(F.avg("v").alias("_fill"))
    else:
        upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)")
        value = known.agg(upper.alias("_fill"))
    return df.join(F.broadcast(value), F.lit(True)).withColumn(column, F.coalesce(num, "_fill")).drop("_fill")


def validate(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """``df`` with ``errors`` array<string>. Rules of a field: required, type (str, int, float, bool), min, max,
    pattern, choices, min_length, max_length; a missing optional field passes."""
    found = []
    for field, rules in schema.items():
        c, missing = F.col(field), is_missing(field)
        say = lambda what, when, field=field: F.when(when, F.lit(f"{field}: {what}"))
        if rules.get("required"):
            found.append(say("missing", missing))
        checks = []
        if "type" in rules:
            checks.append(("wrong type", c.try_cast(TYPES.get(rules["type"], "string")).isNull()))
        if "min" in rules:
            checks.append(("too small", c.try_cast("double") < rules["min"]))
        if "max" in rules:
            checks.append(("too large", c.try_cast("double") > rules["max"]))
        if "pattern" in rules:
            checks.append(("wrong form", ~c.cast("string").rlike(rules["pattern"])))
        if "choices" in rules:
            checks.append(("not a choice", ~c.isin(*rules["choices"])))
        if "min_length" in rules:
            checks.append(("too short", F.length(c.cast("string")) < rules["min_length"]))
        if "max_length" in rules:
            checks.append(("too long", F.length(c.cast("string")) > rules["max_length"]))
        found += [say(what, ~missing & bad) for what, bad in checks]
    return df.withColumn("errors", F.array_compact(F.array(*found)))


EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
URL = r"^https?://[^\s/$.?#][^\s]*$"


def keep_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))).where("_rank = 1").drop("_rank")


def merge_duplicates(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key with its nulls filled from later rows."""
    w = W.partitionBy(*keys).orderBy(*order_by)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = df.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in df.columns if c not in keys and c not in order_by})
    return filled.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clean(df: DataFrame, keys: list[str], required: list[str], defaults: dict | None = None) -> DataFrame:
    """Rows with a missing required field go, duplicates by key go, other missing values take their defaults."""
    kept = keep_first(drop_missing(df, required), keys, [c for c in df.columns if c not in keys] or keys)
    return fill_missing(kept, defaults or {})
