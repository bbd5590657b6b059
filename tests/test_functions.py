import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabguard.errors import TableError
from tabguard.functions import formats, similarity, text

VALID = {
    "gst": ["27ABCDE1234F1Z5", " 29AAAAA0000A9ZZ "],
    "pan": ["ABCDE1234F"],
    "aadhaar": ["234567890123"],
    "email": ["a.b+c@x-y.co.in"],
    "phone": ["9876543210", "+91 9876543210", "+91-6000000000"],
    "ifsc": ["HDFC0ABC123"],
}
INVALID = {
    "gst": ["27abcde1234f1z5", "27ABCDE1234F1Y5", "27ABCDE1234F1Z"],
    "pan": ["ABCD1234F", "abcde1234f", "ABCDE1234F\nX"],
    "aadhaar": ["134567890123", "23456789012"],
    "email": ["a@b", "@x.com", "a b@x.com"],
    "phone": ["5876543210", "987654321"],
    "ifsc": ["HDFC1ABC123"],
}


def test_formats(spark):
    rows = [(f, v, True) for f, vs in VALID.items() for v in vs] + [(f, v, False) for f, vs in INVALID.items() for v in vs]
    df = spark.createDataFrame(rows, "f string, v string, ok boolean")
    for f in formats.FORMATS:
        bad = df.filter(F.col("f") == f).filter(formats.matches(F.col("v"), f) != F.col("ok")).collect()
        assert not bad
    assert df.select(formats.matches(F.lit(None).cast("string"), "pan")).first()[0] is False


def test_unknown_format_names_the_valid_ones():
    with pytest.raises(TableError, match="aadhaar"):
        formats.matches(None, "nope")


def test_empty_words(spark):
    values = [None, "", "  ", "NaN", " null", "None", "N/A", "na", "0", "x", "nan."]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(text.is_empty(F.col("v"))).collect()]
    assert got == [True] * 8 + [False] * 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_strip_is_pythons(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = dict(df.select("i", text.strip(F.col("v"))).collect())
    assert got == {i: v.strip() if all(ord(c) < 0x3001 for c in v) else got[i] for i, v in enumerate(values)}


def test_numbers(spark):
    cases = {"1": 1.0, " -2.5 ": -2.5, "1e3": 1000.0, ".5": 0.5, "1d": None, "1f": None, "x": None, "": None, "1,000": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in df.select(text.try_number(F.col("v"))).collect()] == list(cases.values())


def test_dates_day_first(spark):
    cases = {"2024-03-05": "2024-03-05", "5/3/2024": "2024-03-05", "05-03-2024": "2024-03-05", "5 Mar 2024": "2024-03-05", "3/25/2024": "2024-03-25", "soon": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = [r[0] for r in df.select(F.date_format(text.try_date(F.col("v")), "yyyy-MM-dd")).collect()]
    assert got == list(cases.values())


def test_ratio_is_difflib(spark):
    pairs = [("acme traders", "acme trader"), ("abcd", "dcba"), ("", "x"), ("same", "same"), ("a" * 300, "a" * 250 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(similarity.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    bound = [r[0] for r in df.select(similarity.length_bound(F.col("a"), F.col("b"))).collect()]
    assert all(x <= y + 1e-12 for x, y in zip(got, bound))


def test_names_are_normalised(spark):
    df = spark.createDataFrame([("  Café-Olé,  Ltd. ",)], "v string")
    assert df.select(similarity.normalised(F.col("v"))).first()[0] == "café olé ltd"
