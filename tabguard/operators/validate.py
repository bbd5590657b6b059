"""Validation against declarative rulesets and against checks inferred from the data.

A finding is (row, column, rule_name, severity, reason, value). Rules that judge a
cell by itself are compiled into one array per row, so the table is scanned once for
all of them; rules on repeated values count the values first and join the few that
repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import PlanError, TableError, need
from tabguard.functions import formats
from tabguard.functions.text import ROW, category, col, data_columns, is_empty, number_text, strip, try_number, type_of
from tabguard.operators.graph import cut
from tabguard.plans.expressions import compile_expression

FINDING = "row bigint, column string, rule_name string, severity string, reason string, value string"
KEYS = {"required", "formats", "ranges", "unique", "references", "expressions", "auto"}
CELL_KINDS = ("bool", "datetime", "number", "other", "string")
#: References of more values than this are joined instead of listed.
LISTED = 1000

#: The built-in rulesets.
RULESETS = {
    "default": {},
    "kyc": {
        "formats": {"pan": "pan", "aadhaar": "aadhaar", "email": "email", "phone": "phone"},
        "unique": ["pan", "aadhaar"],
    },
    "invoice": {
        "formats": {"gstin": "gst", "gst": "gst", "ifsc": "ifsc", "email": "email"},
        "expressions": [{"name": "amount_positive", "expr": "amount > 0", "severity": "error"}],
    },
    "payroll": {
        "formats": {"pan": "pan", "email": "email", "phone": "phone", "ifsc": "ifsc"},
        "unique": ["employee_id", "pan"],
        "expressions": [{"name": "net_not_above_gross", "expr": "net_pay <= gross_pay", "severity": "error"}],
    },
    "bank-statement": {
        "formats": {"ifsc": "ifsc"},
        "expressions": [{"name": "amount_nonzero", "expr": "amount != 0", "severity": "warning"}],
    },
}


def resolve_ruleset(ruleset: str | dict | None, saved: dict[str, dict] | None = None) -> dict:
    """A ruleset by name (built-in, then saved) or as given."""
    if ruleset is None or isinstance(ruleset, dict):
        rules = ruleset or {}
    else:
        rules = {**(saved or {}), **RULESETS}[need(ruleset, {*RULESETS, *(saved or {})}, "ruleset")]
    for key in rules:
        need(key, KEYS, "ruleset key")
    return rules


def list_rulesets(saved: dict[str, dict] | None = None) -> list[str]:
    return [*RULESETS, *sorted(set(saved or {}) - set(RULESETS))]


def check_format(df: DataFrame, column: str, fmt: str, name: str = "valid") -> DataFrame:
    """df with a boolean: does the cell have the format? Empty cells don't."""
    return df.withColumn(name, formats.matches(col(column), fmt))


def _finding(column: str, rule: str, severity: str, reason: Column | str, value: Column | None = None) -> Column:
    return F.struct(
        col(ROW).cast("long").alias("row"),
        F.lit(column).alias("column"),
        F.lit(rule).alias("rule_name"),
        F.lit(severity).alias("severity"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
    )


def _cells(df: DataFrame, tests: list[tuple[Column, Column]]) -> DataFrame:
    """The findings of all tests that hold, in one scan."""
    if not tests:
        return df.sparkSession.createDataFrame([], FINDING)
    found = F.array_compact(F.array(*[F.when(test, finding) for test, finding in tests]))
    return df.select(F.inline(found))


def _once(df: DataFrame, findings: list[tuple[str, str, str, str]]) -> DataFrame:
    """Findings about the table, at row 1."""
    rows = [(1, c, rule, severity, reason, None) for c, rule, severity, reason in findings]
    return df.sparkSession.createDataFrame(rows, FINDING)


def _repeated(df: DataFrame, column: str, value: Column, rule: str, severity: str, reason: str) -> DataFrame:
    """A finding for each row whose value (null: left out) occurs more than once."""
    rows = df.select(ROW, value.alias("__v")).filter("__v IS NOT NULL")
    often = rows.groupBy("__v").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("__v").alias("__w"))
    return rows.join(often, F.col("__v") == F.col("__w"), "left_semi").select(
        _finding(column, rule, severity, reason, F.col("__v")).alias("f")
    ).select("f.*")


def explicit_checks(df: DataFrame, rules: dict) -> DataFrame:
    have, tests, once, more = set(data_columns(df)), [], [], []
    for c in rules.get("required", []):
        if c not in have:
            once.append((c, "required_column", "error", f"Required column '{c}' is not in the table"))
            continue
        tests.append((is_empty(col(c), type_of(df, c)), _finding(c, "required_field", "error", f"'{c}' must not be empty")))
    for c, fmt in rules.get("formats", {}).items():
        need(fmt, formats.FORMATS, "format")
        if c in have:
            text = strip(number_text(col(c), type_of(df, c)))
            wrong = ~is_empty(col(c), type_of(df, c)) & ~formats.matches(text, fmt)
            tests.append((wrong, _finding(c, f"format_{fmt}", "error", f"Not a valid {fmt.upper()} value", text)))
    for c, bounds in rules.get("ranges", {}).items():
        if c in have:
            x, low, high = try_number(col(c), type_of(df, c)), bounds.get("min"), bounds.get("max")
            for bound, test, word in ((low, x < F.lit(low), "below the minimum"), (high, x > F.lit(high), "above the maximum")):
                if bound is not None:
                    tests.append((test, _finding(c, "range", "error", f"Value is {word} {bound}", number_text(col(c), type_of(df, c)))))
    for c in rules.get("unique", []):
        if c in have:
            text = F.when(~is_empty(col(c), type_of(df, c)), strip(number_text(col(c), type_of(df, c))))
            more.append(_repeated(df, c, text, "unique", "error", f"'{c}' must be unique and this value repeats"))
    for c, allowed in rules.get("references", {}).items():
        if c not in have:
            continue
        text = strip(number_text(col(c), type_of(df, c)))
        full, known = ~is_empty(col(c), type_of(df, c)), sorted({str(v).strip().lower() for v in allowed})
        finding = _finding(c, "reference", "error", f"Value is not in the lookup list of '{c}'", text)
        if len(known) <= LISTED:
            tests.append((full & ~F.lower(text).isin(known), finding))
        else:
            lookup = df.sparkSession.createDataFrame([(v,) for v in known], "__known string")
            rest = df.filter(full).join(lookup, F.lower(text) == F.col("__known"), "left_anti")
            more.append(rest.select(finding.alias("f")).select("f.*"))
    for i, rule in enumerate(rules.get("expressions", [])):
        name, severity = rule.get("name") or f"expression_{i + 1}", rule.get("severity") or "error"
        try:
            test = compile_expression(df, rule["expr"])
        except (PlanError, KeyError) as e:
            once.append(("*", name, "warning", f"Rule could not be evaluated: {e}"))
            continue
        tests.append((~test, _finding("*", name, severity, f"Row breaks the rule: {rule['expr']}")))
    out = _cells(df, tests)
    if once:
        out = out.unionByName(_once(df, once))
    for x in more:
        out = out.unionByName(x)
    return out


def auto_checks(df: DataFrame) -> DataFrame:
    """Checks inferred from the data: one pass of statistics, one of findings."""
    names = data_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], FINDING)
    texts, full, parts = {}, {}, []
    for i, c in enumerate(names):
        kind = type_of(df, c)
        full[c] = ~is_empty(col(c), kind)
        texts[c] = F.when(full[c], strip(number_text(col(c), kind)))
        parts += [F.count_if(full[c]).alias(f"n{i}")]
        parts += [F.count_if(formats.matches(texts[c], f)).alias(f"{f}{i}") for f in formats.possible(kind)]
        if not isinstance(kind, (T.NumericType, T.DatetimeType, T.BooleanType)):  # those are of one category
            for kind_name in CELL_KINDS:
                parts.append(F.count_if(full[c] & (category(col(c), kind) == kind_name)).alias(f"is_{kind_name}{i}"))
    stats = df.agg(F.count("*").alias("rows"), *parts).first()  # one row
    rows, tests, more = stats["rows"], [], []
    for i, c in enumerate(names):
        n, kind = stats[f"n{i}"], type_of(df, c)
        if not n:
            continue
        if 0.5 <= n / rows < 1:
            tests.append((~full[c], _finding(c, "missing_value", "warning", f"Cell is empty, though most of '{c}' is filled")))
        fmt = next((f for f in formats.possible(kind) if stats[f"{f}{i}"] / n >= 0.8), None)
        if fmt:
            fits = formats.matches(texts[c], fmt)
            reason = f"Most of '{c}' are {fmt.upper()} values, this one is not"
            tests.append((full[c] & ~fits, _finding(c, f"format_{fmt}", "error", reason, texts[c])))
            if fmt in formats.IDENTIFIERS:
                more.append(_repeated(df, c, F.when(fits, texts[c]), "duplicate_id", "warning", f"This {fmt.upper()} value occurs more than once"))
        counts = {k: stats[f"is_{k}{i}"] for k in CELL_KINDS if f"is_{k}{i}" in stats}
        if sum(v > 0 for v in counts.values()) > 1:
            usual = max(counts, key=lambda k: counts[k])  # the first in the alphabet on ties
            own = category(col(c), kind)
            reason = F.concat(F.lit(f"Most of '{c}' is {usual}, this cell is "), own)
            tests.append((full[c] & (own != usual), _finding(c, "mixed_types", "warning", reason, texts[c])))
    out = _cells(df, tests)
    for x in more:
        out = out.unionByName(x)
    whole = F.struct(*[col(c) for c in names])
    keyed = df.select(ROW, whole.alias("__v"))
    often = keyed.groupBy("__v").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("__v").alias("__w"))
    twice = keyed.join(often, F.col("__v") == F.col("__w"), "left_semi")
    finding = _finding("*", "duplicate_row", "warning", "The whole row occurs more than once")
    return out.unionByName(twice.select(finding.alias("f")).select("f.*"))


def findings(df: DataFrame, ruleset: str | dict | None = None, saved: dict[str, dict] | None = None) -> DataFrame:
    """All findings, in no order."""
    if ROW not in df.columns:
        raise TableError(f"the table has no {ROW}; add it with with_row_id()")
    rules = resolve_ruleset(ruleset, saved)
    out = explicit_checks(df, rules)
    if rules.get("auto", True):
        out = out.unionByName(auto_checks(df))
    return out


def validate(df: DataFrame, ruleset: str | dict | None = None, saved: dict[str, dict] | None = None) -> DataFrame:
    """All findings, by row and column."""
    # written first, as a sort by ranges would find them twice
    return cut(findings(df, ruleset, saved)).orderBy("row", "column", "rule_name")
