"""Whitelisted query plans: filters, group_by, aggregates, sort and limit as a dict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import PlanError, need
from tabguard.functions.text import ROW, col, is_empty, is_number, norm_text, strip, try_number, type_of

KEYS = {"filters", "group_by", "aggregates", "sort", "limit"}
FILTERS = {"eq", "ne", "gt", "ge", "lt", "le", "contains", "startswith", "in", "isnull", "notnull"}
FUNCTIONS = {"count", "sum", "mean", "min", "max", "nunique"}
DEFAULT_LIMIT, MOST = 50, 1000


def _column(df: DataFrame, name) -> str:
    return need(name, [c for c in df.columns if c != ROW], "column", PlanError)


def _as_list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def _equals(df: DataFrame, name: str, value) -> Column:
    """Trimmed lower-case text, or numbers where both are; never null."""
    c, kind = col(name), type_of(df, name)
    if value is None:
        return c.isNull()
    number = value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if number is None and is_number(kind):
        try:
            number = float(str(value))
        except ValueError:
            return F.lit(False)
    if number is not None:
        return F.coalesce(try_number(c, kind) == F.lit(float(number)), F.lit(False))
    return F.coalesce(norm_text(c) == F.lit(str(value).strip().lower()), F.lit(False))


def _filter(df: DataFrame, spec: dict) -> Column:
    if not isinstance(spec, dict):
        raise PlanError(f"a filter is a dict with column, op and value, not {spec!r}")
    name = _column(df, spec.get("column"))
    op, value = need(spec.get("op"), FILTERS, "filter op", PlanError), spec.get("value")
    c, kind = col(name), type_of(df, name)
    if op in ("gt", "ge", "lt", "le"):
        try:
            bound = F.lit(float(value))
        except (TypeError, ValueError):
            return F.lit(False)
        x = try_number(c, kind)
        return {"gt": x > bound, "ge": x >= bound, "lt": x < bound, "le": x <= bound}[op]
    if op == "eq":
        return _equals(df, name, value)
    if op == "ne":
        return ~_equals(df, name, value)
    if op in ("contains", "startswith"):
        text, part = F.lower(c.cast("string")), F.lit(str(value).lower())
        return F.contains(text, part) if op == "contains" else F.startswith(text, part)
    if op == "in":
        out = F.lit(False)
        if not is_number(kind):
            return F.coalesce(norm_text(c).isin([str(v).strip().lower() for v in _as_list(value)]), F.lit(False))
        for v in _as_list(value):
            out = out | _equals(df, name, v)
        return out
    blank = c.isNull() | (strip(c) == "") if isinstance(kind, T.StringType) else is_empty(c, kind)
    return blank if op == "isnull" else ~blank


def _aggregate(df: DataFrame, spec: dict) -> tuple[str, Column]:
    name = _column(df, spec.get("column"))
    fn = need(spec.get("fn"), FUNCTIONS, "aggregate", PlanError)
    c, kind = col(name), type_of(df, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    x = try_number(c, kind)
    if kind in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()):
        x = c.cast("long")
    made = {
        "count": F.count(c),
        "sum": F.coalesce(F.sum(x), F.lit(0).cast("long") if x is not None and isinstance(kind, T.LongType) else F.lit(0.0)),
        "mean": F.avg(x),
        "min": F.min(x),
        "max": F.max(x),
        "nunique": F.count_distinct(c),
    }
    return spec.get("as") or f"{fn}_{name}", made[fn]


def execute_plan(df: DataFrame, plan: dict) -> DataFrame:
    """The plan as a lazy DataFrame; anything not on the lists raises PlanError."""
    if not isinstance(plan, dict):
        raise PlanError("a plan is a dict")
    for key in plan:
        need(key, KEYS, "plan key", PlanError)
    out = df.drop(ROW)
    for spec in _as_list(plan.get("filters")):
        out = out.filter(_filter(df, spec))
    groups = [_column(df, g) for g in _as_list(plan.get("group_by"))]
    # a label that is given twice: the last one counts
    aggregates = dict(_aggregate(df, a) for a in _as_list(plan.get("aggregates")))
    for label in aggregates:
        if label in groups:
            raise PlanError(f"aggregate label {label!r} is a group column")
    if aggregates:
        made = [e.alias(k) for k, e in aggregates.items()]
        out = out.groupBy(*map(col, groups)).agg(*made) if groups else out.agg(*made)
    elif groups:
        out = out.groupBy(*map(col, groups)).agg(F.count("*").alias("count"))
    order = []
    for key in _as_list(plan.get("sort")):
        key = key if isinstance(key, dict) else {"by": key}
        name = need(key.get("by", key.get("column")), out.columns, "sort column", PlanError)
        descending = bool(key.get("desc") or key.get("descending") or str(key.get("order", "")).lower() == "desc")
        order.insert(0, col(name).desc_nulls_last() if descending else col(name).asc_nulls_last())
    if order:  # the last key dominates
        out = out.orderBy(*order)
    limit = plan.get("limit", DEFAULT_LIMIT)
    valid = isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MOST
    return out.limit(limit if valid else DEFAULT_LIMIT)
