"""URL filters: block and allow rules, and gradient-boosted trees on lexical features for the rest.

The trees (Spark ML) see the length, depth, digit ratio, entropy, parameters, hyphens and suffix statistics of a
URL and are trained from labelled URLs; ``labelled_urls`` builds a set of fixed size by a rule. The trees see no
words: they judge the shape of a URL, above all of its host, not what it is called. Codes in paths and parameters are as
frequent in both classes, so they say little.
"""

from __future__ import annotations

import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path); a rule's text is host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words that the hosts and paths of the labelled URLs are made of.
UNWANTED = "spam farm cheap pills casino bonus win free viagra loan credit fast cash poker bet adult xxx hot deal replica watch crypto prize click".split()
WANTED = "news blog docs wiki school library museum city weather science music garden travel history research open data health sport kitchen".split()
#: How URLs of either class (is it bad?) are made: values that are drawn alike, and shares in percent.
SHAPES = {
    False: {
        "words": (1, 1, 1, 2, 2, 3), "hyphens": 25, "code_label": 4, "word_label": 35, "host_digits": (0,) * 9 + (2,),
        "suffixes": ("org",) * 6 + ("com",) * 6 + ("net",) * 3 + ("edu",) * 3 + ("info", "site"),
        "code_segment": 30, "depths": (0, 1, 1, 2, 2, 2, 3, 4), "parameters": (0,) * 6 + (1, 1, 2, 3), "code_value": 40,
    },
    True: {
        "words": (1, 2, 2, 3, 3, 4), "hyphens": 80, "code_label": 40, "word_label": 20, "host_digits": (0, 0, 0, 1, 2, 2, 3, 4),
        "suffixes": ("com",) * 5 + ("org", "net") + ("info",) * 4 + ("site",) * 5 + ("biz",) * 4,
        "code_segment": 30, "depths": (0, 1, 2, 3, 3, 4, 5, 6), "parameters": (0, 0, 1, 2, 2, 3, 3, 4), "code_value": 40,
    },
}
FEATURES = ("url_length", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "hyphens", "labels_in_host", "suffix_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; without :// or url: empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; without :// or url: empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains
    where the path starts with the rule's; of two equally long ones the earlier wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


def entropy(text: Column) -> Column:
    """Bits of a character of ``text`` under its own frequencies; 0 for an empty one. Sorted characters stand in stretches of
    equal ones, so one pass finds every frequency."""
    zero = F.struct(F.lit("").alias("char"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    part = lambda run: F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = acc["char"] == c
        return F.struct(c.alias("char"), F.when(same, acc["run"] + 1).otherwise(1).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + part(acc["run"])).alias("sum"))

    total = F.aggregate(F.array_sort(F.split(text, "")), zero, step, lambda acc: acc["sum"] + part(acc["run"]))
    return F.when(text == "", 0.0).otherwise(F.log2(F.length(text).cast("double")) - total / F.length(text))


def lexical_features(urls: DataFrame, url_col: str, suffix_rates: dict[str, float]) -> DataFrame:
    """``urls`` with one double column for each of FEATURES. A null url has the features of an empty one."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), host_of(F.col(url_col)), path_of(F.col(url_col))
    digits = lambda text: F.when(text == "", 0.0).otherwise(F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text))
    rate = F.lit(0.5)
    for suffix, value in sorted(suffix_rates.items()):
        rate = F.when(suffix_of(host) == suffix, value).otherwise(rate)
    made = {
        "url_length": F.length(url),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "digit_ratio": digits(url),
        "host_digit_ratio": digits(host),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.regexp_count(url, F.lit("[?&][^?&#=]+=")),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "labels_in_host": F.size(F.split(host, r"\.")),
        "suffix_rate": rate,
    }
    return urls.withColumns({k: v.cast("double") for k, v in made.items()})


def labelled_urls(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(url, bad): n URLs of each class, put together from word lists by the hash of their number.

    Every part has each of its forms in both classes, at the rates of SHAPES: no single feature separates them."""
    ids = spark.range(n)

    def one(bad: bool) -> DataFrame:
        shape, words = SHAPES[bad], UNWANTED if bad else WANTED
        draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), F.lit(bad), "id"), F.lit(m)).cast("int")
        pick = lambda values, k: F.get(F.array(*map(F.lit, values)), draw(k, len(values)))
        code = lambda k, length: F.substring(F.sha2(F.concat_ws(":", F.lit(k), F.lit(bad), "id"), 256), F.lit(1), length)
        digits = lambda k, length: F.substring(F.translate(code(k, F.lit(64)), "abcdef", ""), F.lit(1), length)
        chance = lambda k, share: draw(k, 100) < share

        name = F.slice(F.array(*[pick(words, 10 + i) for i in range(4)]), F.lit(1), pick(shape["words"], 1))
        name = F.when(chance(2, shape["hyphens"]), F.array_join(name, "-")).otherwise(F.array_join(name, ""))
        below = F.when(chance(3, shape["code_label"]), F.concat(code(4, 3 + draw(5, 6)), F.lit("."))).when(chance(6, shape["word_label"]), F.concat(pick(words, 7), F.lit("."))).otherwise("")
        host = F.concat(below, name, digits(8, pick(shape["host_digits"], 9)), F.lit("."), pick(shape["suffixes"], 20))
        segment = lambda k: F.when(chance(k, shape["code_segment"]), code(k + 1, 4 + draw(k + 2, 9))).otherwise(pick(words, k + 3))
        path = F.array_join(F.slice(F.array(*[segment(30 + 10 * i) for i in range(6)]), F.lit(1), pick(shape["depths"], 21)), "/")
        parameter = lambda k: F.concat(pick(("q", "v", "key", "sort", "cat", "c"), k), F.lit("="), F.when(chance(k + 1, shape["code_value"]), code(k + 2, 6 + draw(k + 3, 11))).otherwise(pick(words, k + 4)))
        parameters = F.array_join(F.slice(F.array(*[parameter(100 + 10 * i) for i in range(4)]), F.lit(1), pick(shape["parameters"], 22)), "&")
        tail = F.when(parameters == "", "").otherwise(F.concat(F.lit("?"), parameters))
        return ids.select(F.concat(pick(["http://", "https://"], 23), host, F.lit("/"), path, tail).alias("url"), F.lit(bad).alias("bad"))

    return one(True).unionByName(one(False))


def train_url_model(labelled: DataFrame, url_col: str = "url", label_col: str = "bad", max_rows: int = 20_000, max_suffixes: int = 200, features: tuple[str, ...] = FEATURES) -> tuple[PipelineModel, dict[str, float]]:
    """The trees and the share of bad URLs by suffix, smoothed, from at most ``max_rows`` labelled rows (those
    whose URL has the smallest hash); of the suffixes the ``max_suffixes`` most frequent count.
    The trees see ``features`` only."""
    sample = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    rates = sample.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.count("*").alias("n"), ((F.sum("label") + 1) / (F.count("*") + 2)).alias("rate")).orderBy(F.desc("n"), "suffix").limit(max_suffixes)
    suffix_rates = {r["suffix"]: r["rate"] for r in rates.collect()}
    rows = lexical_features(sample, "url", suffix_rates).coalesce(1)
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), GBTClassifier(maxIter=10, maxDepth=3, seed=7)]
    return Pipeline(stages=stages).fit(rows), suffix_rates


def filter_urls(pages: DataFrame, model: PipelineModel, suffix_rates: dict[str, float], rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row. verdict: "allow" or "block", that of the longest rule
    that fits, else "block" where ``score``, the trees' probability that the URL is bad, is over one half.

    A null url, or one without ://, has an empty host and path; it fits no rule. Repeated rows stay repeated;
    other columns are not read."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    scored = model.transform(lexical_features(rows, "_url", suffix_rates))
    score = F.round(vector_to_array("probability")[1], 9)
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
