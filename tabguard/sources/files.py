"""Files to tables and back: csv, tsv, xlsx, parquet; rows are numbered at ingest."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import IngestError, TableError
from tabguard.functions.text import ROW, col, is_empty, try_number
from tabguard.sources import store
from tabguard.sources.xls import read_xls
from tabguard.sources.xlsx import read_xlsx, write_xlsx

EXTENSIONS = (".xlsx", ".xlsm", ".xls", ".csv", ".tsv", ".parquet")
DELIMITERS = (",", ";", "\t", "|")
#: The encodings that are tried, in this order.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin1")
OVERFLOW = "_overflow"
HEAD_BYTES = 1 << 16


def with_row_id(df: DataFrame, first: int = 2) -> DataFrame:
    """df with its row numbers, the order being that of the partitions of the scan.

    Only the counts of the partitions are collected: one number for each of them.
    """
    at = F.monotonically_increasing_id()
    numbered = df.withColumn("__id", at)
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().orderBy("p").collect()
    starts, total = {}, first
    for r in sizes:
        starts[r["p"]], total = total, total + r["count"]
    if not starts:
        return df.withColumn(ROW, F.lit(first).cast("long"))
    table = df.sparkSession.createDataFrame(list(starts.items()), "__p long, __start long")
    out = numbered.withColumn("__p", part).join(F.broadcast(table), "__p")
    return out.select((F.col("__start") + place).cast("long").alias(ROW), *[col(c) for c in df.columns])


def _head(spark: SparkSession, path: str) -> bytes:
    """The first part of a file, through Spark's own file systems; no more of it is read."""
    if (first := store.first_file(spark, path)) is None:
        raise IngestError(f"{path} holds no file")
    with store.reader(spark, first) as f:
        return f.read(HEAD_BYTES)


def sniff(head: bytes) -> tuple[str, str, list[str]]:
    """Encoding, delimiter and header of a delimited text."""
    text = None
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
            break
        except UnicodeDecodeError as e:
            # a character may be cut at the end of the head
            if e.start >= len(head) - 4 and encoding.startswith("utf"):
                text = head[: e.start].decode(encoding)
                break
    if encoding == "utf-8" and text.startswith("﻿"):
        encoding, text = "utf-8-sig", text[1:]
    line = next((x for x in text.splitlines() if x.strip()), "")
    if not line:
        raise IngestError("the file has no header")
    delimiter = max(DELIMITERS, key=line.count)
    names = [x.strip().strip('"') for x in line.split(delimiter)]
    return encoding, delimiter, names


def _has_long_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes over several lines: then a line has an odd number of quotes."""
    lines = spark.read.text(path)
    return not lines.filter(F.pmod(F.length(F.regexp_replace("value", '[^"]', "")), F.lit(2)) == 1).isEmpty()


def _read_delimited(spark: SparkSession, path: str, delimiter: str | None, header: bool = True, multiline: bool | None = None) -> DataFrame:
    """multiline: whether cells may go over several lines, which makes a task of each file; None: if any does."""
    encoding, found, names = sniff(_head(spark, path))
    delimiter, path = delimiter or found, store.plain_path(path)
    if multiline is None:
        multiline = _has_long_cells(spark, path)
    # one column more than the header has: a row that fills it is too long, and left out
    reader = (
        spark.read.option("sep", delimiter)
        .option("encoding", "ISO-8859-1" if encoding in ("cp1252", "latin1") else "UTF-8")
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
    )
    top = reader.option("header", True).csv(path).columns if header else [f"c{i + 1}" for i in range(len(names))]
    if len(top) == 1 and any(d in top[0] for d in DELIMITERS if d != delimiter):
        raise IngestError(f"{path} has one column named {top[0]!r}; the delimiter is probably another one")
    if encoding == "cp1252":
        top = [c.translate({ord(a): b for a, b in zip(*_cp1252())}) for c in top]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*top, OVERFLOW]])
    out = reader.option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    out = out.filter(F.col(OVERFLOW).isNull()).drop(OVERFLOW)
    if encoding == "cp1252":
        out = out.select(*[F.translate(col(c), *_cp1252()).alias(c) for c in top])
    return out


def _cp1252() -> tuple[str, str]:
    """Characters that the reader, which knows latin1 only, gives for those of cp1252, and these."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns of which every filled cell is a number become numbers."""
    texts = [c for c in df.columns if c != ROW and isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return df
    full = {c: ~is_empty(col(c), T.StringType()) for c in texts}
    parts = []
    for i, c in enumerate(texts):
        parts += [F.count_if(full[c]).alias(f"n{i}"), F.count_if(full[c] & try_number(col(c)).isNotNull()).alias(f"x{i}")]
    s = df.agg(*parts).first()
    new = {c: try_number(col(c)) for i, c in enumerate(texts) if s[f"n{i}"] and s[f"n{i}"] == s[f"x{i}"]}
    return df.withColumns(new) if new else df


def load(spark: SparkSession, path: str, sheet: str | None = None, infer: bool = True, multiline: bool | None = None) -> DataFrame:
    """A file as a table with row numbers.

    A csv is split among tasks, unless a quoted cell goes over several lines. That is found
    by a scan of the quotes, or given.
    """
    suffix = PurePosixPath(path).suffix.lower()
    sheet = normalise_optional(sheet)
    if suffix not in EXTENSIONS:
        raise IngestError(f"can't read {suffix or 'a file without extension'}; valid: {', '.join(EXTENSIONS)}")
    if suffix == ".parquet":
        return with_row_id(spark.read.parquet(path))
    if suffix in (".xlsx", ".xlsm"):
        df = read_xlsx(spark, path, sheet)
    elif suffix == ".xls":
        df = read_xls(spark, path, sheet)
    else:
        df = with_row_id(_read_delimited(spark, path, "\t" if suffix == ".tsv" else None, multiline=multiline))
    return infer_types(df) if infer else df


def normalise_optional(value: str | None) -> str | None:
    """None for the words that callers send instead of nothing."""
    return None if value is None or value.strip().lower() in ("", "null", "none", "undefined", "string") else value


def from_values(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    """Values held in memory as a table; a column of mixed kinds becomes text."""
    for i, r in enumerate(rows):
        if len(r) != len(columns):
            raise IngestError(f"row {i} has {len(r)} values for {len(columns)} columns")
    fields, casts = [], []
    for j, name in enumerate(columns):
        kinds = {type(r[j]) for r in rows if r[j] is not None}
        if kinds and kinds <= {int}:
            fields.append(T.StructField(name, T.LongType()))
            casts.append(int)
        elif kinds and kinds <= {int, float}:
            fields.append(T.StructField(name, T.DoubleType()))
            casts.append(float)
        elif kinds == {bool}:
            fields.append(T.StructField(name, T.BooleanType()))
            casts.append(bool)
        else:
            fields.append(T.StructField(name, T.StringType()))
            casts.append(str)
    data = [(i + 2, *[None if v is None else f(v) for v, f in zip(r, casts)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType([T.StructField(ROW, T.LongType()), *fields]))


def write(df: DataFrame, path: str, source: str | None = None) -> str:
    """Write a table; never onto what it came from, nor onto anything that exists."""
    if source is not None and path.rstrip("/") == source.rstrip("/"):
        raise TableError("the result can't overwrite its input")
    suffix = PurePosixPath(path).suffix.lower()
    out = df.drop(ROW).write.mode("errorifexists")
    if suffix == ".csv":
        out.option("header", True).option("escape", '"').csv(path)
    elif suffix == ".tsv":
        out.option("header", True).option("sep", "\t").csv(path)
    elif suffix == ".xlsx":
        write_xlsx({"Sheet1": df.drop(ROW)}, path)
    else:
        out.parquet(path)
    return path


def sample(df: DataFrame, n: int = 20) -> list[str]:
    """The first rows as JSON."""
    return df.drop(ROW).limit(n).toJSON().collect()
