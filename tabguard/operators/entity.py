"""Name matching and resolution of duplicate entities."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import TableError, need
from tabguard.functions.similarity import length_bound, name_similarity, normalised, ratio
from tabguard.functions.text import ROW, col, data_columns, norm_text, number_text, type_of
from tabguard.operators.graph import components, cut
from tabguard.operators.ordered import neighbours

MOST_PAIRS = 20_000
NEIGHBOURS = 8


def pairwise(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row, both names and their similarity; rows with an empty side are left out."""
    for c in (a, b):
        need(c, data_columns(df), "column")
    rows = df.filter(col(a).isNotNull() & col(b).isNotNull())
    return rows.select(col(ROW).alias("row"), col(a).cast("string").alias("name_a"), col(b).cast("string").alias("name_b"), name_similarity(col(a), col(b)).alias("similarity"))


def pair_count(df: DataFrame, name: str, group_by: str | None = None) -> int:
    """How many pairs cross matching would compare."""
    rows = df.filter(col(name).isNotNull())
    rows = rows.groupBy(norm_text(col(group_by))) if group_by else rows.groupBy(F.lit("all").alias("g"))
    n = F.col("n")
    return int(rows.agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0))).first()[0])


def cross(df: DataFrame, name: str, group_by: str | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """All unordered pairs within a group; more than most_pairs is an error."""
    for c in (name, *([group_by] if group_by else [])):
        need(c, data_columns(df), "column")
    n = pair_count(df, name, group_by)
    if n > most_pairs:
        raise TableError(f"{n} pairs exceed the bound of {most_pairs}; group by a column or raise the bound")
    group = norm_text(col(group_by)) if group_by else F.lit("")
    rows = df.filter(col(name).isNotNull()).select(F.coalesce(group, F.lit("\0")).alias("g"), col(ROW).alias("row"), col(name).cast("string").alias("name"))
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.row") < F.col("b.row")))
    return pairs.select(
        F.col("a.row").alias("row_a"),
        F.col("b.row").alias("row_b"),
        F.col("a.name").alias("name_a"),
        F.col("b.name").alias("name_b"),
        name_similarity(F.col("a.name"), F.col("b.name")).alias("similarity"),
    )


def match_names(
    df: DataFrame,
    name_a: str,
    name_b: str | None = None,
    group_by: str | None = None,
    threshold: float = 80,
    judge: Callable[[str, str], str] | None = None,
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """Candidates at or above the threshold; a judge may add match, no_match or unverified."""
    found = pairwise(df, name_a, name_b) if name_b else cross(df, name_a, group_by, most_pairs)
    found = found.filter(F.col("similarity") >= threshold)
    if judge is None:
        return found

    def run(batches):
        for batch in batches:
            verdicts = []
            for x, y in zip(batch["name_a"], batch["name_b"]):
                try:
                    verdict = judge(x, y)
                except Exception:  # a judge may fail in any way
                    verdict = None
                verdicts.append(verdict if verdict in ("match", "no_match") else "unverified")
            yield batch.assign(verdict=pd.Series(verdicts, index=batch.index, dtype="object"))

    return found.mapInPandas(run, T.StructType([*found.schema.fields, T.StructField("verdict", T.StringType())]))


def _text(df: DataFrame, c: str):
    return F.coalesce(number_text(col(c), type_of(df, c)), F.lit(""))


def duplicate_edges(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """row_a, row_b and score of neighbours in sorted order that are similar enough."""
    for c in columns:
        need(c, data_columns(df), "column")
    rows = df.select(ROW, normalised(F.concat_ws(" ", *[_text(df, c) for c in columns])).alias("text"))
    pairs = neighbours(rows, ["text", ROW], NEIGHBOURS)
    a, b = F.col("a.text"), F.col("b.text")
    close = pairs.filter(100 * length_bound(a, b) >= threshold).withColumn("score", F.round(100 * ratio(a, b, (threshold - 0.01) / 100), 2))
    return close.filter((F.col("score") >= threshold) & (a != "") & (b != "")).select(F.col(f"a.{ROW}").alias("row_a"), F.col(f"b.{ROW}").alias("row_b"), "score")


def dedupe_entities(df: DataFrame, columns: list[str], threshold: float = 85, keep: str = "most_complete") -> tuple[DataFrame, DataFrame]:
    """df with one row for each entity, and a log (canonical_row, merged_rows)."""
    need(keep, {"first", "last", "most_complete"}, "keep")
    edges = duplicate_edges(df, columns, threshold).select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    labels = components(edges).withColumnRenamed("node", "__n")
    filled = sum((F.when(col(c).isNotNull(), 1).otherwise(0) for c in data_columns(df)), F.lit(0))
    order = {"first": F.struct(col(ROW)), "last": F.struct(-col(ROW)), "most_complete": F.struct(-filled, col(ROW))}[keep]
    members = df.select(ROW, order.alias("__o")).join(labels, col(ROW) == F.col("__n"))
    log = cut(
        members.groupBy("label")
        .agg(F.min_by(col(ROW), "__o").alias("canonical_row"), F.sort_array(F.collect_list(ROW)).alias("rows"))
        .select("canonical_row", F.array_remove(F.col("rows"), F.col("canonical_row")).alias("merged_rows"))
    )
    gone = log.select(F.explode("merged_rows").alias("__gone"))
    return df.join(gone, col(ROW) == F.col("__gone"), "left_anti"), log
