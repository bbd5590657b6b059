"""Health score with its working, highlights of cells, and the frames of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.functions.text import ROW, col
from tabguard.operators.anomaly import flags
from tabguard.operators.graph import cut
from tabguard.operators.profile import profile
from tabguard.operators.reconcile import bucket_counts, buckets, summary, variance_by_field
from tabguard.operators.validate import findings
from tabguard.sources.xlsx import Sheet, write_xlsx

#: Points taken for each percent of rows affected, in order of priority.
WEIGHTS = {"outlier": 0.8, "duplicate": 0.2, "mixed": 0.5, "format": 0.3, "missing": 0.4}
#: Categories of rules and kinds; others have none.
CATEGORIES = {
    "multivariate_outlier": "outlier",
    "column_outlier": "outlier",
    "pattern_break": "outlier",
    "duplicate_row": "duplicate",
    "duplicate_id": "duplicate",
    "unique": "duplicate",
    "near_duplicate": "duplicate",
    "mixed_types": "mixed",
    "reference": "format",
    "missing_value": "missing",
    "required_field": "missing",
}
#: The colours of cells by category, and the rows that the data sheet of a report holds.
FILLS = {"outlier": "FFC7CE", "duplicate": "FFD966", "mixed": "BDD7EE", "format": "F8CBAD", "missing": "E7E6E6"}
MOST_DATA_ROWS = 100_000


def category(name: Column) -> Column:
    out = F.when(F.startswith(name, F.lit("format_")), "format")
    for k, v in CATEGORIES.items():
        out = out.when(name == k, v)
    return out


def health_breakdown(rows: int | Column, findings: DataFrame, flags: DataFrame) -> DataFrame:
    """category, rows_affected, pct_of_rows, weight_per_pct and deduction of each category affected."""
    marked = findings.select("row", category(F.col("rule_name")).alias("category")).unionByName(
        flags.select("row", category(F.col("kind")).alias("category"))
    )
    weight = F.lit(None).cast("double")
    for k, v in WEIGHTS.items():
        weight = F.when(F.col("category") == k, v).otherwise(weight)
    n = F.lit(rows) if isinstance(rows, int) else rows
    pct = 100.0 * F.col("rows_affected") / n
    counted = marked.filter("category IS NOT NULL").groupBy("category").agg(F.count_distinct("row").alias("rows_affected"))
    return counted.select(
        "category", "rows_affected", F.round(pct, 2).alias("pct_of_rows"), weight.alias("weight_per_pct"), F.round(weight * pct, 2).alias("deduction")
    )


def health_score(rows: int, findings: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: score (0 to 100), the deductions that lead to it, and a note."""
    if not rows:
        findings, flags, rows = findings.limit(0), flags.limit(0), 1
    parts = health_breakdown(rows, findings, flags)
    item = F.struct("category", "rows_affected", "pct_of_rows", "weight_per_pct", "deduction")
    return parts.agg(
        F.greatest(F.lit(0), F.bround(100 - F.coalesce(F.sum("deduction"), F.lit(0.0)), 0)).cast("int").alias("score"),
        F.sort_array(F.collect_list(item)).alias("breakdown"),
        F.lit("score = 100 - sum of weight x percent of rows affected").alias("note"),
    )


def highlights(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """row, column (* for the whole row) and the category that wins there."""
    order = F.lit(None).cast("int")
    for i, k in enumerate(WEIGHTS):
        order = F.when(F.col("category") == k, i).otherwise(order)
    cells = findings.select("row", "column", category(F.col("rule_name")).alias("category"))
    places = F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.array(F.lit("*")))
    cells = cells.unionByName(flags.select("row", F.explode(places).alias("column"), category(F.col("kind")).alias("category")))
    cells = cells.filter("category IS NOT NULL").withColumn("o", order)
    return cells.groupBy("row", "column").agg(F.min_by("category", "o").alias("category"))


def report_frames(df: DataFrame, ruleset=None, sensitivity: float = 0.05, saved: dict | None = None) -> dict[str, DataFrame]:
    """summary, profile, data (with highlights; the first MOST_DATA_ROWS rows), issues and anomalies, which are complete."""
    found, flagged = cut(findings(df, ruleset, saved)), cut(flags(df, sensitivity))
    marks = highlights(found, flagged).groupBy("row").agg(F.collect_list(F.struct("column", "category")).alias("highlights"))
    data = df.orderBy(ROW).limit(MOST_DATA_ROWS).join(marks, col(ROW) == F.col("row"), "left").drop("row")
    order = lambda x: x.orderBy("row", *x.columns[1:3])
    return {"summary": health_score(df.count(), found, flagged), "profile": profile(df), "data": data, "issues": order(found), "anomalies": order(flagged)}


def reconciliation_frames(result: DataFrame) -> dict[str, DataFrame]:
    """summary, counts, variance and the four buckets; discrepancies have a row for each field.

    Records are flat: in matched and discrepancy the columns of both sides, as a.name and
    b.name, in the others their own.
    """
    flat = lambda *sides: [F.col(s).getField(f).alias(f"{s}.{f}" if len(sides) > 1 else f) for s in sides for f in result.schema[s].dataType.names]
    parts = buckets(result)
    one = parts["discrepancy"].select("match_level", "key_similarity", *flat("a", "b"), F.explode("differences").alias("d"))
    names = [col(c) for c in one.columns[:-1]]
    fields = [F.col("d").getField(f).alias(n) for f, n in zip(("field", "a", "b", "diff_abs", "diff_pct"), ("field", "value_a", "value_b", "diff_abs", "diff_pct"))]
    return {
        "summary": summary(result),
        "counts": bucket_counts(result),
        "variance": variance_by_field(result),
        "matched": parts["matched"].select("match_level", "key_similarity", *flat("a", "b")),
        "only_in_a": parts["only_in_a"].select(*flat("a")),
        "only_in_b": parts["only_in_b"].select(*flat("b")),
        "discrepancy": one.select(*names, *fields),
    }


def _lines(df: DataFrame, rows: list[tuple], width: int) -> DataFrame:
    """A few labelled values as a frame."""
    text = lambda v: v if v is None else str(v)
    names = ", ".join(["label string", "value string", *[f"value_{i} string" for i in range(2, width)]])
    return df.sparkSession.createDataFrame([tuple(map(text, (*r, *[None] * (width - len(r))))) for r in rows], names).coalesce(1)


def export_report(df: DataFrame, path: str, ruleset=None, sensitivity: float = 0.05, saved: dict | None = None) -> str:
    """A new workbook: data with coloured cells, all issues, all anomalies, a summary, its working, which is the legend too, and a profile."""
    frames = report_frames(df, ruleset, sensitivity, saved)
    n = df.count()
    counts = {"rows": n, "issues": frames["issues"].count(), "anomaly_flags": frames["anomalies"].count()}
    found = {r["category"]: r for r in frames["summary"].first()["breakdown"]}
    names = ("category", "rows_affected", "pct_of_rows", "weight_per_pct", "deduction")
    working = [tuple(found[k][x] for x in names) if k in found else (k, 0, 0.0, WEIGHTS[k], 0.0) for k in WEIGHTS]
    legend = df.sparkSession.createDataFrame(working, "category string, rows_affected long, pct_of_rows double, weight_per_pct double, deduction double").coalesce(1)
    mark = F.array(F.struct(F.lit("category").alias("column"), col("category").alias("category")))
    note = f"... truncated: the first {MOST_DATA_ROWS} of {n} rows (issues and anomalies are complete)" if n > MOST_DATA_ROWS else None
    data = _flat(frames["data"].orderBy(ROW), "highlights").withColumnRenamed(ROW, "row_number")
    sheets = {
        "Data": Sheet(data, "highlights", note),
        "Issues": _flat(frames["issues"]),
        "Anomalies": _flat(frames["anomalies"]),
        "Summary": _flat(frames["summary"].select("score", *[F.lit(v).alias(k) for k, v in counts.items()], "breakdown", "note")),
        "Working": Sheet(legend.withColumn("__style", mark), "__style"),
        "Profile": _flat(frames["profile"]),
    }
    return write_xlsx(sheets, path, FILLS)


def export_reconciliation(result: DataFrame, path: str, profile: str | None = None) -> str:
    """A new workbook: a summary and the four buckets, whole."""
    result = cut(result)
    frames = reconciliation_frames(result)
    s = frames["summary"].first()
    lines = [(k, s[k]) for k in ("matched", "discrepancies", "only_in_a", "only_in_b", "match_rate")] + [("profile", profile), ("match levels",)]
    lines += [(f"L{i}", s[f"level_{i}"]) for i in (1, 2, 3) if s[f"level_{i}"]] + [("variance totals (abs)",)]
    lines += [(r["field"], r["total_abs"]) for r in frames["variance"].orderBy("field").collect()]  # a row for each field
    sheets = {"Summary": _lines(result, lines, 2)}
    for title, k in (("Matched", "matched"), ("Only-in-A", "only_in_a"), ("Only-in-B", "only_in_b"), ("Discrepancies", "discrepancy")):
        sheets[title] = _flat(frames[k])
    return write_xlsx(sheets, path)


def _flat(df: DataFrame, but: str | None = None) -> DataFrame:
    """Nested columns as JSON, for cells that hold text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map") and f.name != but]
    return df.withColumns({c: F.to_json(col(c)) for c in nested}) if nested else df
