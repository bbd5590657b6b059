"""Formats of identifiers and contact data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import need
from tabguard.functions.text import strip

#: The patterns, matched against the whole trimmed value.
FORMATS = {
    "gst": r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]",
    "pan": r"[A-Z]{5}[0-9]{4}[A-Z]",
    "aadhaar": r"[2-9][0-9]{11}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+91[\s-]?)?[6-9][0-9]{9}",
    "ifsc": r"[A-Z]{4}0[A-Z0-9]{6}",
}
#: Formats that identify something, so that a value should occur once.
IDENTIFIERS = ("gst", "pan", "aadhaar", "ifsc")


#: Formats of digits alone, which a column of whole numbers can have.
DIGITS = ("aadhaar", "phone")


def possible(kind: T.DataType) -> list[str]:
    """The formats that cells of a type can have: fractions, dates and truth values have none."""
    if isinstance(kind, T.IntegralType):
        return list(DIGITS)
    return list(FORMATS) if isinstance(kind, (T.StringType, T.DecimalType, T.VariantType)) else []


def matches(c: Column, name: str) -> Column:
    """True where the trimmed value has the format; null is false."""
    pattern = FORMATS[need(name, FORMATS, "format")]
    return F.coalesce(strip(c).rlike(rf"\A(?:{pattern})\z"), F.lit(False))
