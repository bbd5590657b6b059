"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.operators.graph import cut  # noqa: F401

#: Fixed value: the characters that separate words.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text and rows that a slice of an Arrow batch holds, about.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def append(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the given columns at its end; a column of df with such a name gives way."""
    taken = {c.lower() for c in columns}
    kept = [c for c in df.columns if c.lower() not in taken]
    return df.select(*[quoted(c) for c in kept], *[e.alias(k) for k, e in columns.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shielded(df: DataFrame, needed: tuple[str, ...], new: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(df), where other columns than those needed bear names that clash with none and then get their own back.

    Columns with the names of new ones give way.
    """
    gone = {c.lower() for c in new}
    inner, back = [], {}
    for i, c in enumerate(df.columns):
        if c.lower() in gone:
            continue
        name = c.lower() if c.lower() in needed else f"__{i}_"
        inner.append(quoted(c).alias(name))
        back[name] = c
    out = work(df.select(*inner))
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema); run finds the columns by place.

    At the end of a task its memory goes back to the system, as workers outlive tasks.
    """

    def whole(batches):
        yield from run(batches)
        free()

    # names with dots or repeated ones can't be resolved there
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(whole, schema)


def free() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


@cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # another C library has none


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text in column at, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
