"""Validation, duplicates and profiles over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import TableError
from tabguard.functions import formats
from tabguard.functions.text import ROW, col, data_columns, is_empty, number_text, strip, try_number, type_of
from tabguard.operators.validate import explicit_checks


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def validate_stream(stream: DataFrame, rules: dict) -> DataFrame:
    """Findings of the rules that judge a cell or row by itself; needs _row."""
    if stateful := {k for k in ("unique",) if rules.get(k)}:
        raise TableError(f"{', '.join(stateful)} needs the rows before; use duplicate_sightings()")
    return explicit_checks(stream, {k: v for k, v in rules.items() if k != "auto"})


def infer_rules(first: DataFrame, least: int = 20, share: float = 0.8) -> dict:
    """Rules for a stream from its first rows: the format that most of a column's cells have, if there are enough."""
    names, parts = data_columns(first), []
    for i, c in enumerate(names):
        text = F.when(~is_empty(col(c), type_of(first, c)), strip(number_text(col(c), type_of(first, c))))
        parts += [F.count(text).alias(f"n{i}"), *[F.count_if(formats.matches(text, f)).alias(f"{f}{i}") for f in formats.FORMATS]]
    if not names:
        return {}
    s = first.agg(*parts).first()
    found = {c: next((f for f in formats.FORMATS if s[f"n{i}"] >= least and s[f"{f}{i}"] >= share * s[f"n{i}"]), None) for i, c in enumerate(names)}
    return {"formats": {c: f for c, f in found.items() if f}}


def duplicate_rows(stream: DataFrame, time: str, watermark: str) -> DataFrame:
    """The hash, number and first row number of rows that are the same in all columns but their number, within the windows."""
    names = [c for c in data_columns(stream) if c != time]
    key = F.xxhash64(*[F.coalesce(number_text(col(c), type_of(stream, c)), F.lit("\0")) for c in names])
    rows = stream.withWatermark(time, watermark).groupBy(F.window(col(time), watermark).alias("w"), key.alias("row_hash"))
    return rows.agg(F.count("*").alias("n"), F.min(col(ROW)).alias("first_row")).filter("n > 1").select(F.col("w.start").alias("window_start"), "row_hash", "n", "first_row")


def duplicate_sightings(stream: DataFrame, column: str, time: str, watermark: str) -> DataFrame:
    """value, n and the first time of values seen again within the watermark's windows."""
    value = strip(number_text(col(column), type_of(stream, column)))
    rows = stream.filter(~is_empty(col(column), type_of(stream, column))).withWatermark(time, watermark)
    return (
        rows.groupBy(F.window(col(time), watermark).alias("w"), value.alias("value"))
        .agg(F.count("*").alias("n"), F.min(col(time)).alias("first_seen"))
        .filter("n > 1")
        .select(F.col("w.start").alias("window_start"), "value", "n", "first_seen")
    )


def first_sightings(stream: DataFrame, column: str, time: str, watermark: str) -> DataFrame:
    """The rows without those whose value came before, within the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([column])


def profile_stream(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Running counts and ranges of columns; for output mode complete or update."""
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            is_empty(col(c), type_of(stream, c)).alias("empty"),
            number_text(col(c), type_of(stream, c)).alias("value"),
            try_number(col(c), type_of(stream, c)).alias("number"),
        )
        for c in columns
    ]
    cells = stream.select(F.inline(F.array(*pairs)))
    return cells.groupBy("column").agg(
        F.count("*").alias("n_rows"),
        F.count_if("empty").alias("n_empty"),
        F.approx_count_distinct("value").alias("about_distinct"),
        F.min("number").alias("min_num"),
        F.max("number").alias("max_num"),
    )
