"""Column expressions on cell values; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that holds a row's number: header 1, first data row 2.
ROW = "_row"
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What counts as an empty cell, besides null.
EMPTY_WORDS = ("", "nan", "null", "none", "n/a", "na")
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
CURRENCY = "₹$€£"
#: Day-first patterns, the first that fits wins, and the shape that a text must have to be tried with each.
DATE_PATTERNS = {
    "yyyy-MM-dd HH:mm:ss": "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
    "yyyy-MM-dd'T'HH:mm:ss": "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}",
    "yyyy-MM-dd": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "yyyy/M/d": "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}",
    "d/M/yyyy": "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "d-M-yyyy": "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "d.M.yyyy": "[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}",
    "d MMM yyyy": "[0-9]{1,2} [A-Za-z]{3,4} [0-9]{4}",
    "d-MMM-yyyy": "[0-9]{1,2}-[A-Za-z]{3,4}-[0-9]{4}",
    "d MMMM yyyy": "[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}",
    "MMM d, yyyy": "[A-Za-z]{3,4} [0-9]{1,2}, [0-9]{4}",
    "MMMM d, yyyy": "[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}",
    "M/d/yyyy": "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "yyyyMMdd": "[0-9]{8}",
}


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def strip(c: Column) -> Column:
    return F.trim(c.cast("string"), F.lit(WHITESPACE))


def norm_text(c: Column) -> Column:
    return F.lower(strip(c))


def is_empty(c: Column, kind: T.DataType | None = None) -> Column:
    """Null, NaN, or a word for nothing."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if kind is not None and not isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return c.isNull()
    return c.isNull() | norm_text(c).isin(*EMPTY_WORDS)


def try_number(c: Column, kind: T.DataType | None = None) -> Column:
    """The number in a cell, or null; dates and booleans are no numbers."""
    if kind is not None and is_number(kind):
        value = c.cast("double")
        return F.when(F.isnan(value), None).otherwise(value)
    if kind is not None and not isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def try_date(c: Column, kind: T.DataType | None = None) -> Column:
    """The time in a cell, or null; text is read day first."""
    if kind is not None and is_date(kind):
        return c.cast("timestamp_ntz")
    if kind is not None and not isinstance(kind, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = strip(c)
    # a text that doesn't fit costs an exception, so its shape is tested first
    tried = lambda p, shape: F.when(text.rlike(rf"\A{shape}\z"), F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz"))
    found = F.coalesce(*[tried(p, shape) for p, shape in DATE_PATTERNS.items()])
    return F.when(text.rlike(r"\A[0-9A-Za-z][0-9A-Za-z ,./:-]{5,18}\z"), found)


def shape(c: Column) -> Column:
    """Digits as 9, ASCII letters as A."""
    return F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Za-z]", "A")


def category(c: Column, kind: T.DataType) -> Column:
    """The physical kind of a non-empty cell: number, bool, datetime, string."""
    if isinstance(kind, T.BooleanType):
        return F.lit("bool")
    if is_number(kind):
        return F.lit("number")
    if is_date(kind):
        return F.lit("datetime")
    if isinstance(kind, T.VariantType):
        name = F.schema_of_variant(c)
        return (
            F.when(name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), "number")
            .when(name == "BOOLEAN", "bool")
            .when(name.rlike("^(DATE|TIMESTAMP)"), "datetime")
            .when(name == "STRING", "string")
            .otherwise("other")
        )
    # text cells as a spreadsheet would type them
    text = strip(c)
    return (
        F.when(text.rlike(NUMBER), "number")
        .when(F.lower(text).isin("true", "false"), "bool")
        .otherwise("string")
    )


def number_text(c: Column, kind: T.DataType) -> Column:
    """A cell as text; whole doubles without exponent."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.concat(F.floor(c).cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    return c.cast("string")
