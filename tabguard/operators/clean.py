"""Cleaning operations: a registry of named steps on DataFrames, and their runner."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import RecipeError, TableError, need
from tabguard.functions.text import CURRENCY, ROW, col, data_columns, is_empty, is_number, number_text, strip, try_date, try_number, type_of
from tabguard.operators.ordered import fill_down as _fill_down

OPS: dict[str, Callable[..., DataFrame]] = {}
#: Blanks for fill_down, which are fewer than the empty cells elsewhere.
BLANKS = ("", "nan", "none")


def op(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    OPS[f.__name__] = f
    return f


def list_ops() -> dict[str, str]:
    return {name: (f.__doc__ or "").strip().split("\n")[0] for name, f in sorted(OPS.items())}


def _columns(df: DataFrame, names) -> list[str]:
    """The columns named, or all."""
    if names is None:
        return data_columns(df)
    return [need(n, data_columns(df), "column") for n in ([names] if isinstance(names, str) else names)]


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(type_of(df, c), T.StringType)


def _text(df: DataFrame, c: str) -> Column:
    return number_text(col(c), type_of(df, c))


@op
def trim(df: DataFrame, columns=None) -> DataFrame:
    """Collapse white space to one space and strip it at the ends; text columns only."""
    new = {c: strip(F.regexp_replace(col(c), r"(?U)\s+", " ")) for c in _columns(df, columns) if _is_text(df, c)}
    return df.withColumns(new) if new else df


def _given(value, synonym):
    """A parameter, or its synonym."""
    return value if synonym is None else synonym


def _title(c: Column) -> Column:
    """Each run of cased letters with a capital first; anything else, an apostrophe too, ends a run."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"), F.lit(0))
    # the capital of one letter may be two (ss for a sharp s), of which the second stays small
    first = lambda x: F.upper(F.left(x, F.lit(1)))
    capital = lambda x: F.concat(F.left(first(x), F.lit(1)), F.lower(F.substr(first(x), F.lit(2))), F.lower(F.substr(x, F.lit(2))))
    return F.array_join(F.transform(runs, capital), "")


@op
def case(df: DataFrame, columns=None, to: str = "title", mode: str | None = None) -> DataFrame:
    """Change case: to (or mode) upper, lower, title or sentence."""
    to = _given(to, mode)
    modes = {
        "upper": F.upper,
        "lower": F.lower,
        "title": _title,
        "sentence": lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2)))),
    }
    change = modes[need(to, modes, "case")]
    new = {c: change(col(c)) for c in _columns(df, columns) if _is_text(df, c)}
    return df.withColumns(new) if new else df


@op
def replace_text(df: DataFrame, columns=None, find: str = "", replace: str = "", regex: bool = False) -> DataFrame:
    """Replace a text, or a regular expression with groups as \\1."""
    if regex:
        to = re.sub(r"\\(\d)", r"$\1", replace.replace("$", r"\$"))
        change = lambda c: F.regexp_replace(c, find, to)
    else:
        change = lambda c: F.replace(c, F.lit(find), F.lit(replace))
    new = {c: change(col(c)) for c in _columns(df, columns) if _is_text(df, c)}
    return df.withColumns(new) if new else df


@op
def remove_chars(df: DataFrame, columns=None, chars: str = "") -> DataFrame:
    """Delete the characters listed."""
    new = {c: F.translate(col(c), chars, "") for c in _columns(df, columns) if _is_text(df, c)}
    return df.withColumns(new) if new else df


@op
def split_column(df: DataFrame, column: str, delimiter: str, into: list[str] | None = None) -> DataFrame:
    """Split into named columns, or into column_1 and so on as far as the widest row."""
    (c,) = _columns(df, column)
    pattern = rf"\Q{delimiter}\E" if len(delimiter) == 1 else delimiter
    parts = F.split(_text(df, c), pattern)
    if into is None:
        widest = df.agg(F.max(F.size(parts)).alias("n")).first()["n"] or 0
        into = [f"{c}_{i + 1}" for i in range(max(0, widest))]
    return df.withColumns({name: strip(F.get(parts, F.lit(i))) for i, name in enumerate(into)})


@op
def concat_columns(df: DataFrame, columns, into: str, separator: str = " ") -> DataFrame:
    """Join columns with a separator; empty cells are left out."""
    return df.withColumn(into, F.concat_ws(separator, *[_text(df, c) for c in _columns(df, columns)]))


@op
def slice_text(df: DataFrame, columns=None, side: str = "left", length: int = 1, start: int = 1, into: str | None = None, column: str | None = None, mode: str | None = None) -> DataFrame:
    """The left or right characters (side, or mode), or with mid those from a place on (counted from 1)."""
    names = _columns(df, _given(columns, column))
    if into and len(names) != 1:
        raise TableError("into takes one column")
    side, new = _given(side, mode), {}
    for c in names:
        text = _text(df, c)
        sides = {
            "left": F.left(text, F.lit(length)),
            "right": text if length == 0 else F.right(text, F.lit(length)),
            "mid": F.substr(text, F.lit(max(1, start)), F.lit(length)),
        }
        new[into or c] = sides[need(side, sides, "side")]
    return df.withColumns(new)


def _operand(df: DataFrame, x) -> Column:
    """A column by its name, or a number."""
    if isinstance(x, str) and x in df.columns:
        return try_number(col(x), type_of(df, x))
    try:
        return F.lit(float(x))
    except (TypeError, ValueError):
        need(x, data_columns(df), "column")


@op
def math(df: DataFrame, left=None, op: str | None = None, right=None, into: str | None = None, column: str | None = None, operator: str | None = None, operand=None) -> DataFrame:
    """left op right (or column operator operand), with + - * /, of columns or numbers; by zero gives nothing."""
    left, op, right = _given(left, column), _given(op, operator), _given(right, operand)
    a, b = _operand(df, left), _operand(df, right)
    if not into and not (isinstance(left, str) and left in df.columns):
        raise TableError("into must name a column where left is a number")
    made = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}
    return df.withColumn(into or left, made[need(op, made, "operator")])


@op
def absolute(df: DataFrame, columns=None) -> DataFrame:
    """The value without sign; what is no number becomes empty."""
    return df.withColumns({c: F.abs(try_number(col(c), type_of(df, c))) for c in _columns(df, columns)})


@op
def strip_currency(df: DataFrame, columns=None) -> DataFrame:
    """Remove currency signs, commas and white space, and read the number."""
    new = {}
    for c in _columns(df, columns):
        kind = type_of(df, c)
        new[c] = try_number(col(c), kind) if is_number(kind) else try_number(F.regexp_replace(col(c).cast("string"), rf"(?U)[{CURRENCY},\s]", ""))
    return df.withColumns(new)


#: strftime directives and their patterns here.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%j": "DDD", "%%": "%"}


def date_pattern(strftime: str) -> str:
    out = []
    for piece in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", strftime):
        if piece.startswith("%"):
            out.append(DIRECTIVES[need(piece, DIRECTIVES, "date directive")])
        else:
            out.append(f"'{piece}'" if piece.isalpha() else piece)
    return "".join(out)


@op
def parse_date(df: DataFrame, columns=None, output_format: str = "%Y-%m-%d", format: str | None = None) -> DataFrame:
    """Read dates in mixed formats, day first, and write them in one (output_format, or format); others stay."""
    pattern, new = date_pattern(_given(output_format, format)), {}
    for c in _columns(df, columns):
        when = try_date(col(c), type_of(df, c))
        new[c] = F.coalesce(F.date_format(when, pattern), _text(df, c))
    return df.withColumns(new)


@op
def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows of which every cell is empty."""
    empty = F.lit(True)
    for c in data_columns(df):
        empty = empty & is_empty(col(c), type_of(df, c))
    return df.filter(~empty)


@op
def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns of which every cell is empty."""
    names = data_columns(df)
    if not names:
        return df
    full = df.agg(*[F.count_if(~is_empty(col(c), type_of(df, c))).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return df.drop(*[c for i, c in enumerate(names) if not full[f"n{i}"]])


@op
def set_header(df: DataFrame, row: int) -> DataFrame:
    """Row number `row` becomes the header; the rows above it are dropped."""
    names = data_columns(df)
    head = df.filter(col(ROW) == row).select(*[_text(df, c).alias(f"c{i}") for i, c in enumerate(names)]).first()
    if head is None:
        raise TableError(f"there is no row {row}")
    titles, seen = [], set()
    for i, c in enumerate(names):
        title = (head[f"c{i}"] or c).strip() or c
        while title in seen:
            title += "_"
        seen.add(title)
        titles.append(title)
    below = df.filter(col(ROW) > row)
    return below.select((col(ROW) - F.lit(row) + 1).alias(ROW), *[col(c).alias(t) for c, t in zip(names, titles)])


@op
def fill_down(df: DataFrame, columns=None) -> DataFrame:
    """Blank cells take the nearest value above."""
    for c in _columns(df, columns):
        blank = col(c).isNull()
        if _is_text(df, c):
            blank = blank | strip(col(c)).isin(*BLANKS)
        elif isinstance(type_of(df, c), (T.FloatType, T.DoubleType)):
            blank = blank | F.isnan(col(c))
        df = _fill_down(df, c, blank)
    return df


@op
def dedupe(df: DataFrame, columns=None, keep: str = "first", aggregate: dict[str, str] | None = None, keys=None, aggregations: dict[str, str] | None = None) -> DataFrame:
    """One row per columns (or keys): the first, the last, or aggregate (or aggregations): sum, max, min, mean, first, last."""
    aggregations = _given(aggregate, aggregations)
    keep = "aggregate" if aggregations else need(keep, {"first", "last", "aggregate"}, "keep")
    names = _columns(df, _given(columns, keys) or None)
    others = [c for c in data_columns(df) if c not in names]
    if keep != "aggregate":
        # the row itself travels as the value of a mergeable aggregate, so no key's rows meet unmerged
        pick = F.min_by if keep == "first" else F.max_by
        rest = F.struct(col(ROW), *map(col, others))
        out = df.groupBy(*map(col, names)).agg(pick(rest, col(ROW)).alias("_r"))
        return out.select(*[(col(c) if c in names else F.col("_r").getField(c)).alias(c) for c in df.columns])
    made = []
    for c in others:
        fn = need((aggregations or {}).get(c, "first"), {"sum", "max", "min", "mean", "first", "last"}, "aggregation")
        x = try_number(col(c), type_of(df, c))
        full = F.when(col(c).isNotNull(), col(ROW))
        made.append(
            {
                "sum": F.coalesce(F.sum(x), F.lit(0.0)),
                "max": F.max(x),
                "min": F.min(x),
                "mean": F.avg(x),
                "first": F.min_by(col(c), full),
                "last": F.max_by(col(c), full),
            }[fn].alias(c)
        )
    for c in aggregations or {}:
        need(c, others, "column")
    out = df.groupBy(*map(col, names)).agg(F.min(col(ROW)).alias(ROW), *made)
    return out.select(*df.columns).orderBy(*map(col, names))


def apply_ops(df: DataFrame, steps: list[dict]) -> DataFrame:
    """The steps in order; an error names the step."""
    for i, step in enumerate(steps):
        try:
            f = OPS[need(step.get("op"), OPS, "op", RecipeError)]
            df = f(df, **step.get("params", {}))
        except (TableError, TypeError) as e:
            raise RecipeError(f"step {i} ({step.get('op')}): {e}") from e
    return df
