"""Profile of a table: types, null rates, cardinality, ranges, frequent values, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions import formats
from tabguard.functions.text import (
    CURRENCY,
    col,
    data_columns,
    is_date,
    is_empty,
    is_number,
    number_text,
    strip,
    try_date,
    try_number,
    type_of,
)

MONEY = rf"\A[{CURRENCY}]\s*-?[0-9,]+(?:\.[0-9]+)?\z"
TOP = 5
PARTS = 64


def _kind(df: DataFrame, name: str) -> str:
    kind = type_of(df, name)
    return "number" if is_number(kind) else "date" if is_date(kind) else "text"


def value_counts(df: DataFrame) -> DataFrame:
    """column, kind, value and n: how often each cell text occurs; empty cells are the null value.

    Everything else is computed from these counts, so a pattern is matched once for
    each distinct value, and a frequent value is counted before the shuffle.
    """
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(_kind(df, c)).alias("kind"),
            F.when(~is_empty(col(c), type_of(df, c)), strip(number_text(col(c), type_of(df, c)))).alias("value"),
        )
        for c in data_columns(df)
    ]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "kind", "value").agg(F.count("*").alias("n"))


def profile_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per column."""
    counts = value_counts(df) if counts is None else counts
    v, n = F.col("value"), F.col("n")
    filled = F.when(v.isNotNull(), n)
    text = F.col("kind") == "text"
    number = F.when(F.col("kind") == "number", v.try_cast("double")).when(text, try_number(v))
    tests = {f"is_{f}": formats.matches(v, f) if f in formats.DIGITS else text & formats.matches(v, f) for f in formats.FORMATS}
    # what a column of numbers or dates is needs no test of its values
    tests |= {"is_money": text & v.rlike(MONEY), "is_number": text & try_number(F.regexp_replace(v, ",", "")).isNotNull(), "is_date": text & try_date(v).isNotNull()}
    rows = counts.withColumn("x", number).withColumns(tests)
    share = lambda t: F.coalesce(F.sum(F.when(F.col(t), filled)), F.lit(0)) / F.sum(filled)
    s = rows.groupBy("column", "kind").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(filled), F.lit(0)).alias("filled"),
        F.count("value").alias("cardinality"),
        F.min("x").alias("min_num"),
        F.max("x").alias("max_num"),
        (F.sum(F.col("x") * n) / F.sum(F.when(F.col("x").isNotNull(), n))).alias("mean"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        *[share(t).alias(t) for t in tests],
    )
    fmt = F.lit(None).cast("string")
    for f in reversed(formats.FORMATS):
        fmt = F.when(F.col(f"is_{f}") >= 0.9, f).otherwise(fmt)
    fmt = F.when(F.col("kind") != "date", fmt)
    few = F.greatest(F.lit(20), F.floor(0.05 * F.col("filled")))
    inferred = (
        F.when(F.col("fmt").isin(*formats.IDENTIFIERS), "id")
        .when(F.col("kind") != "text", F.col("kind"))
        .when(F.col("filled") == 0, "text")
        .when(F.col("is_money") >= 0.8, "currency")
        .when(F.col("is_number") >= 0.9, "number")
        .when(F.col("is_date") >= 0.9, "date")
        .when((F.col("cardinality") > 0.95 * F.col("filled")) & (F.col("filled") > 10), "id")
        .when(F.col("cardinality") <= few, "categorical")
        .otherwise("text")
    )
    worded = F.col("min_num").isNull()
    return s.withColumn("fmt", fmt).select(
        F.col("column").alias("name"),
        inferred.alias("inferred_type"),
        F.round(1 - F.col("filled") / F.col("rows"), 4).alias("null_rate"),
        "cardinality",
        "min_num",
        "max_num",
        F.when(worded, F.col("min_text")).alias("min_text"),
        F.when(worded, F.col("max_text")).alias("max_text"),
        F.round("mean", 4).alias("mean"),
        F.col("fmt").alias("detected_format"),
    )


def cells(df: DataFrame) -> DataFrame:
    """One row per non-empty cell: column and value (trimmed text)."""
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(~is_empty(col(c), type_of(df, c)), strip(number_text(col(c), type_of(df, c)))).alias("value"),
        )
        for c in data_columns(df)
    ]
    return df.select(F.inline(F.array(*pairs))).filter("value IS NOT NULL")


def top_values(df: DataFrame, n: int = TOP, counts: DataFrame | None = None) -> DataFrame:
    """column, value, n and rank of the most frequent values; equal counts by value."""
    counts = (value_counts(df) if counts is None else counts).filter("value IS NOT NULL")
    # the n best of each of many parts of a column, then of these
    part = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(PARTS))).orderBy(F.desc("n"), "value")
    best = counts.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= n)
    last = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return best.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= n).select("column", "value", "n", "rank")


def top_values_approximate(df: DataFrame, n: int = TOP, counters: int = 10_000) -> DataFrame:
    """As top_values, in bounded memory for each column."""
    top = cells(df).groupBy("column").agg(F.expr(f"approx_top_k(value, {n}, {counters})").alias("top"))
    return top.select("column", F.inline("top")).select("column", F.col("item").alias("value"), F.col("count").alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """profile_columns with the most frequent values of each column as an array."""
    counts = value_counts(df)
    top = top_values(df, TOP, counts).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("t"))
    top = top.select("column", F.transform("t", lambda x: x["value"]).alias("top_values"))
    found = profile_columns(df, counts)
    return found.join(top, found["name"] == top["column"], "left").drop("column")
