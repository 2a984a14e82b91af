"""Column functions of normalisation on single values, checksums and distances of a set."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import normalize as N
from loomgraph.operators import search as H
from loomgraph.operators import temporal as T

NOON = "1998-06-01 12:00:00"


def values(spark, given, use):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    return [r[0] for r in df.orderBy("i").select(use(F.col("g"))).collect()]


def test_names(spark):
    given = {"Dr. Jane  DOE": "Jane DOE", "ACME CORP.": "Acme", "mr. john smith": "John Smith", "Widget Works, Inc.": "Widget Works", "Prof. Dr. Ada Lovelace": "Ada Lovelace", "Dr.": "Dr.", None: None}
    assert values(spark, given, N.entity_name) == list(given.values())
    given = {"a/b:c?.txt": "a_b_c_.txt", " ..hidden. ": "hidden", "plain": "plain", None: None}
    assert values(spark, given, N.safe_filename) == list(given.values())


def test_forms_of_classes_and_properties(spark):
    given = {"hasPart": "HasPart", "red widgets": "RedWidget", "big_boxes": "BigBox", "été works": "ÉtéWork", "cities": "City", "glass": "Glass", "bus": "Bus", "thesis": "Thesis", "HTTP server": "HttpServer", "--": "", None: None}
    assert values(spark, given, N.class_name) == list(given.values())
    given = {"hasPart": "hasPart", "Has Part": "hasPart", "has_parts": "hasParts", "été works": "étéWorks", "": "", None: None}
    assert values(spark, given, N.property_name) == list(given.values())


def test_quantities_money_and_times(spark):
    given = {"5 km": (5.0, "km", "length", 5000.0), "1,200 lb": (1200.0, "lb", "weight", pytest.approx(544.310844)), "250ml": (250.0, "ml", "volume", 0.25), "3 parsecs": None, "km": None, None: None}
    assert [r and tuple(r) for r in values(spark, given, N.quantity)] == list(given.values())
    given = {"$1,200.50": (1200.5, "USD"), "EUR 3k": (3000.0, "EUR"), "£2m": (2000000.0, "GBP"), "99": (99.0, "USD"), "none": None, None: None}
    assert [r and tuple(r) for r in values(spark, given, N.money)] == list(given.values())
    given = {"3 days ago": "1998-05-29 12:00:00", "2 weeks from now": "1998-06-15 12:00:00", "1 month ago": "1998-05-01 12:00:00", "36 hours ago": "1998-05-31 00:00:00", "1 year from now": "1999-06-01 12:00:00", "soon": None, None: None}
    assert [r and str(r) for r in values(spark, given, lambda c: N.relative_time(c, F.lit(NOON).cast("timestamp_ntz")))] == list(given.values())


def test_periods_and_intents(spark):
    given = {"1998": ("1998-01-01", "1998-12-31"), "1998-6": ("1998-06-01", "1998-06-30"), "1998 q2": ("1998-04-01", "1998-06-30"), "q3 1997": ("1997-07-01", "1997-09-30"), "last week": ("1998-05-25", "1998-06-01"), "yesterday": ("1998-05-31", "1998-05-31"), "next year": ("1998-06-01", "1999-06-01"), "03/04/1998": None, "someday": None, None: None}
    assert [r and tuple(map(str, r)) for r in values(spark, given, lambda c: T.normalize_period(c, F.lit("1998-06-01").cast("date")))] == list(given.values())
    given = {"orders between 1997 and 1998": ("between", "1997", "1998", "orders"), "who supplied since 1996-03": ("after", "1996-03", None, "who supplied"), "all nations": None, None: None}
    assert [r and tuple(r) for r in values(spark, given, T.temporal_intent)] == list(given.values())


def test_unicode_forms_of_plain_and_other_texts(spark):
    given = ["plain\n\t", "été", "ﬁ", "", None]
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert values(spark, given, lambda c: N.normalize_unicode(c, form)) == [g and unicodedata.normalize(form, g) for g in given]  # noqa: B023


def test_checksums(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "")]
    one = spark.createDataFrame(rows, "x int, y string")
    sums = [N.table_checksum(df).first()["checksum"] for df in (one, one.repartition(3).select("y", "x"), one.distinct(), one.fillna("n"), one.where("x > 9"))]
    assert sums[0] == sums[1] and len(set(sums)) == 4 and N.table_checksum(one.where("x > 9")).first()["rows"] == 0


def test_distances_of_a_set_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)] + [(None, [0.0, 0.0])], "vec_id long, embedding array<double>")
    ids = vectors.select("vec_id").where("vec_id % 2 = 0").unionByName(vectors.select("vec_id").where("vec_id = 4"))
    found = H.pairwise_distances(vectors, ids, lambda a, b: F.abs(a[0] - b[0]), block=3)
    assert sorted((r["a"], r["b"], r["distance"]) for r in found.collect()) == [(i, j, float(j - i)) for i in range(0, 40, 2) for j in range(i + 2, 40, 2)]
