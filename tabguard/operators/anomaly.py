"""Statistical flags: (row, kind, confidence, reason, columns)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.errors import TableError
from tabguard.functions.similarity import length_bound, ratio
from tabguard.functions.text import ROW, col, data_columns, is_empty, is_number, norm_text, number_text, shape, strip, try_number, type_of
from tabguard.operators.graph import cut
from tabguard.operators.iforest import Forest, fit_forest
from tabguard.operators.ordered import neighbours
from tabguard.operators.quantiles import quantiles

FLAG = "row bigint, kind string, confidence double, reason string, columns array<string>"
NEIGHBOURS, NEAR = 3, 0.9
SAMPLE = 256
#: Rows of the pool from which the trees of a forest draw theirs.
POOL_ROWS = 16 * SAMPLE


def _flag(kind: str, confidence: Column, reason: Column, columns: Column) -> list[Column]:
    return [
        col(ROW).cast("long").alias("row"),
        F.lit(kind).alias("kind"),
        F.round(confidence.cast("double"), 3).alias("confidence"),
        reason.alias("reason"),
        columns.cast("array<string>").alias("columns"),
    ]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns, and text columns of which at least half the cells are numbers."""
    out, texts = [], []
    for c in data_columns(df):
        (out if is_number(type_of(df, c)) else texts).append(c)
    texts = [c for c in texts if type_of(df, c).simpleString() == "string"]
    if texts:
        share = df.agg(*[F.avg(try_number(col(c)).isNotNull().cast("int")).alias(f"s{i}") for i, c in enumerate(texts)]).first()
        out += [c for i, c in enumerate(texts) if (share[f"s{i}"] or 0) >= 0.5]
    return [c for c in data_columns(df) if c in out]


def numeric_view(df: DataFrame, names: list[str]) -> DataFrame:
    """The row number and the numbers, with missing ones replaced by the median."""
    numbers = [try_number(col(c), type_of(df, c)).alias(f"x{i}") for i, c in enumerate(names)]
    view = df.select(ROW, *numbers)
    if not names:
        return view
    middle = quantiles(view, [f"x{i}" for i in range(len(names))], [0.5])
    return view.select(ROW, *[F.coalesce(F.col(x), F.lit(m[0] if m else 0.0)).alias(x) for x, m in middle.items()])


def column_outliers(df: DataFrame) -> DataFrame:
    """Values more than three quartile ranges outside the quartiles."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], FLAG)
    view = numeric_view(df, names)
    stats = quantiles(view, [f"x{i}" for i in range(len(names))], [0.25, 0.75])
    tests = []
    for i, c in enumerate(names):
        if stats[f"x{i}"] is None:
            continue
        q1, q3 = stats[f"x{i}"]
        span = q3 - q1
        if span == 0:
            continue
        low, high, x = q1 - 3 * span, q3 + 3 * span, F.col(f"x{i}")
        distance = F.when(x < low, low - x).otherwise(x - high)
        confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.5), 0.5 + 0.5 * (distance / (3 * span))))
        reason = F.concat(F.lit(f"'{c}' is "), number_text(x, view.schema[f"x{i}"].dataType), F.lit(f", far outside its usual range {q1:g} to {q3:g}"))
        tests.append(F.when((x < low) | (x > high), F.struct(*_flag("column_outlier", confidence, reason, F.array(F.lit(c))))))
    if not tests:
        return df.sparkSession.createDataFrame([], FLAG)
    return view.select(F.inline(F.array_compact(F.array(*tests))))


def _values(df: DataFrame, names: list[str]) -> DataFrame:
    """_row, column and trimmed text of the non-empty cells."""
    pairs = []
    for c in names:
        text = strip(number_text(col(c), type_of(df, c)))
        pairs.append(F.struct(F.lit(c).alias("column"), F.when(~is_empty(col(c), type_of(df, c)), text).alias("value")))
    return df.select(ROW, F.inline(F.array(*pairs))).filter("value IS NOT NULL")


def rare_categories(df: DataFrame) -> DataFrame:
    """Values that hardly occur in a column of few distinct values."""
    cells = _values(df, data_columns(df))
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    columns = counts.groupBy("column").agg(F.sum("n").alias("all"), F.count("*").alias("distinct"))
    columns = columns.filter((F.col("all") >= 20) & (F.col("distinct") <= F.greatest(F.lit(10.0), 0.1 * F.col("all"))))
    # a row per column of the table, so its size is that of the schema
    rare = counts.join(F.broadcast(columns), "column").filter(F.col("n") <= F.greatest(F.lit(1), F.floor(0.01 * F.col("all"))))
    reason = F.format_string("'%s' value '%s' occurs only %d of %d times", "column", "value", "n", "all")
    found = cells.join(rare, ["column", "value"])
    return found.select(*_flag("rare_category", 1 - F.col("n") / F.col("all"), reason, F.array("column")))


def pattern_breaks(df: DataFrame) -> DataFrame:
    """Cells whose shape differs from the one that nearly all of the column has."""
    names = [c for c in data_columns(df) if not is_number(type_of(df, c))]
    if not names:
        return df.sparkSession.createDataFrame([], FLAG)
    cells = _values(df, names).withColumn("shape", shape(F.col("value")))
    counts = cells.groupBy("column", "shape").agg(F.count("*").alias("n"))
    top = counts.groupBy("column").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "shape")).alias("top")
    )
    share = F.col("top.n") / F.col("all")
    top = top.filter((F.col("all") >= 20) & (share >= 0.9) & (share < 1)).select("column", F.col("top.shape").alias("usual"), share.alias("share"))
    odd = cells.join(F.broadcast(top), "column").filter(F.col("shape") != F.col("usual"))
    reason = F.format_string("'%s' values nearly always look like '%s', but '%s' looks like '%s'", "column", "usual", "value", "shape")
    return odd.select(*_flag("pattern_break", F.col("share"), reason, F.array("column")))


def near_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that are nearly the same text as one of the next few in sorted order."""
    names = data_columns(df)
    parts = [F.coalesce(norm_text(number_text(col(c), type_of(df, c))), F.lit("")) for c in names]
    rows = df.select(ROW, F.concat_ws(" | ", *parts).alias("text"), F.array(*parts).alias("cells"))
    pairs = neighbours(rows, ["text", ROW], NEIGHBOURS)
    a, b = F.col("a.text"), F.col("b.text")
    close = pairs.filter((a != b) & (length_bound(a, b) >= NEAR)).withColumn("r", ratio(a, b, NEAR)).filter(F.col("r") >= NEAR)
    differ = F.filter(
        F.transform(F.arrays_zip(F.col("a.cells").alias("x"), F.col("b.cells").alias("y")), lambda z, i: F.when(z["x"] != z["y"], F.get(F.array(*[F.lit(c) for c in names]), i))),
        lambda x: x.isNotNull(),
    )
    differ = F.slice(differ, 1, 5)
    reason = F.format_string("Row %d is %.0f%% the same as row %d; they differ in: %s", F.col(f"a.{ROW}"), F.round(100 * F.col("r"), 0), F.col(f"b.{ROW}"), F.array_join(differ, ", "))
    return close.select(
        F.col(f"a.{ROW}").cast("long").alias("row"),
        F.lit("near_duplicate").alias("kind"),
        F.round("r", 3).alias("confidence"),
        reason.alias("reason"),
        differ.alias("columns"),
    )


def multivariate_outliers(df: DataFrame, sensitivity: float, seed: int = 42, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Rows that an isolation forest separates soonest, as many as the sensitivity says.

    The trees draw their rows from a pool of pool_rows rows; all rows are scored.
    """
    names = numeric_columns(df)
    view = numeric_view(df, names)
    if not names or view.limit(10).count() < 10:
        return df.sparkSession.createDataFrame([], FLAG)
    draw, n = F.xxhash64(ROW, F.lit(seed)), view.count()
    # twice as many rows as are wanted pass a filter, so that a task sends few, however many tasks there are
    few = view.filter(F.pmod(draw, F.lit(1 << 40)) < int(min(1.0, (2 * pool_rows + 100) / n) * (1 << 40)))
    sample = few.orderBy(draw, ROW).limit(pool_rows).drop(ROW).toPandas()  # bounded
    forest: Forest = fit_forest(sample.to_numpy(float), SAMPLE, seed)
    width = len(names)

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        return pd.Series(forest.score(pd.concat(x, axis=1).to_numpy(float)))

    xs = [F.col(f"x{i}") for i in range(width)]
    scored = cut(view.withColumn("s", score(*xs)))
    least = quantiles(scored, ["s"], [sensitivity])["s"][0]
    stats = scored.agg(
        F.max("s").alias("high"),
        F.min("s").alias("low"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
        *[F.stddev_samp(x).alias(f"d{i}") for i, x in enumerate(xs)],
    ).first()
    span = (stats["high"] - stats["low"]) or 1.0
    z = [
        F.struct((-F.abs((x - stats[f"m{i}"]) / (stats[f"d{i}"] or 1.0))).alias("z"), F.lit(i).alias("i"), F.lit(c).alias("c"), number_text(x, view.schema[f"x{i}"].dataType).alias("v"))
        for i, (x, c) in enumerate(zip(xs, names))
    ]
    top = F.slice(F.sort_array(F.array(*z)), 1, 3)
    strong = F.filter(top, lambda t: t["z"] < -1.5)
    told = F.when(F.size(strong) > 0, strong).otherwise(F.slice(top, 1, 1))
    detail = F.array_join(F.transform(told, lambda t: F.concat(t["c"], F.lit("="), t["v"])), "; ")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(stats["high"]) - F.col("s")) / span))
    reason = F.concat(F.lit("Row doesn't fit the pattern of the table; most unusual: "), detail)
    return scored.filter(F.col("s") < least).select(*_flag("multivariate_outlier", confidence, reason, F.transform(told, lambda t: t["c"])))


def flags(df: DataFrame, sensitivity: float = 0.05) -> DataFrame:
    """All flags, in no order."""
    if not 0 < sensitivity < 0.5:
        raise TableError("sensitivity must lie between 0 and 0.5")
    parts = [multivariate_outliers(df, sensitivity), column_outliers(df), rare_categories(df), near_duplicate_rows(df), pattern_breaks(df)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_anomalies(df: DataFrame, sensitivity: float = 0.05) -> DataFrame:
    """All flags, by row and falling confidence."""
    # written first, as a sort by ranges would find them twice
    return cut(flags(df, sensitivity)).orderBy("row", F.desc("confidence"), "kind")
