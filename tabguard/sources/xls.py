"""Old binary workbooks: records in a stream of a compound file.

A sheet has 65,536 rows at most, and is read by one task. Cells come out as texts, as
those of new workbooks do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from struct import unpack_from

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import IngestError
from tabguard.functions.text import ROW
from tabguard.sources import store

#: Marks of the file format, and kinds of records.
MAGIC, END = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA
BOF, EOF, CONTINUE, SST, SHEET, FORMAT, XF, DATE_MODE, PASSWORD = 0x809, 0x0A, 0x3C, 0xFC, 0x85, 0x41E, 0xE0, 0x22, 0x2F
LABEL, LABEL_SST, NUMBER, RK, MANY_RK, BOOL, FORMULA, STRING = 0x204, 0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207


def stream(data: bytes, path: str) -> bytes:
    """The stream of the workbook in a compound file."""
    if data[:8] != MAGIC:
        raise IngestError(f"{path} is no old workbook")
    size, small = 1 << unpack_from("<H", data, 30)[0], 1 << unpack_from("<H", data, 32)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    number = lambda block: list(unpack_from(f"<{len(block) // 4}I", block))
    directory, limit, first_small, _, extra, n_extra = (unpack_from("<I", data, at)[0] for at in (48, 56, 60, 64, 68, 72))
    tables = number(data[76:512])
    for _ in range(n_extra):
        *more, extra = number(sector(extra))
        tables += more
    following = [x for t in tables if t < END for x in number(sector(t))]

    def chain(start: int, table: list[int], block) -> bytes:
        out, seen = [], 0
        while start < END and seen <= len(table):
            out.append(block(start))
            start, seen = table[start], seen + 1
        return b"".join(out)

    entries = chain(directory, following, sector)
    found = {}
    for at in range(0, len(entries), 128):
        length = unpack_from("<H", entries, at + 64)[0]
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        found[name] = unpack_from("<II", entries, at + 116)
    root = found.get("Root Entry")
    start, length = found.get("Workbook") or found.get("Book") or (None, 0)
    if start is None or root is None:
        raise IngestError(f"{path} holds no workbook")
    if length >= limit:
        return chain(start, following, sector)[:length]
    inside = chain(root[0], following, sector)
    small_table = number(chain(first_small, following, sector))
    return chain(start, small_table, lambda n: inside[n * small : (n + 1) * small])[:length]


def records(data: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Kinds and contents of the records up to the end of a part; a record and what continues it are one."""
    kind, parts = 0, []
    while at + 4 <= len(data):
        k, n = unpack_from("<HH", data, at)
        content = data[at + 4 : at + 4 + n]
        at += 4 + n
        if k == CONTINUE:
            parts.append(content)
            continue
        if parts:
            yield kind, parts
        kind, parts = k, [content]
        if k == EOF:
            return
    if parts:
        yield kind, parts


def _text(data: bytes, at: int, wide_length: bool = True) -> str:
    """A text with its length before it, within one record."""
    n, at = (unpack_from("<H", data, at)[0], at + 2) if wide_length else (data[at], at + 1)
    if data[at] & 1:
        return data[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace")
    return data[at + 1 : at + 1 + n].decode("latin-1")


def shared_texts(parts: list[bytes]) -> list[str]:
    """The table of texts; where a text goes over to the next part, that begins with a mark of its own."""
    total, part, at, out = unpack_from("<I", parts[0], 4)[0], 0, 8, []

    def skip(n: int) -> None:
        nonlocal part, at
        while n > len(parts[part]) - at and part + 1 < len(parts):
            n -= len(parts[part]) - at
            part, at = part + 1, 0
        at += n

    for _ in range(total):
        while at >= len(parts[part]) and part + 1 < len(parts):
            part, at = part + 1, 0
        n, mark = unpack_from("<HB", parts[part], at)
        at += 3
        runs = extra = 0
        if mark & 8:
            runs = unpack_from("<H", parts[part], at)[0]
            at += 2
        if mark & 4:
            extra = unpack_from("<I", parts[part], at)[0]
            at += 4
        text = []
        while n:
            if at >= len(parts[part]):
                if part + 1 == len(parts):
                    break
                part, at, mark = part + 1, 1, parts[part + 1][0]
            width = 2 if mark & 1 else 1
            k = min(n, (len(parts[part]) - at) // width)
            text.append(parts[part][at : at + k * width].decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            at, n = at + k * width, n - k
        out.append("".join(text))
        skip(4 * runs + extra)
    return out


class Book:
    def __init__(self, data: bytes, path: str):
        self.data = stream(data, path)
        self.sheets: dict[str, int] = {}
        self.texts: list[str] = []
        formats, styles, self.first_day = {}, [], datetime(1899, 12, 30)
        for kind, parts in records(self.data, 0):
            content = parts[0]
            if kind == BOF and unpack_from("<H", content)[0] != 0x600:
                raise IngestError(f"{path} is older than any workbook that can be read; save it as .xlsx")
            if kind == PASSWORD:
                raise IngestError(f"{path} is protected by a password")
            if kind == SHEET and content[5] == 0:
                self.sheets[_text(content, 6, False)] = unpack_from("<I", content)[0]
            elif kind == SST:
                self.texts = shared_texts(parts)
            elif kind == FORMAT:
                formats[unpack_from("<H", content)[0]] = _text(content, 2)
            elif kind == XF:
                styles.append(unpack_from("<H", content, 2)[0])
            elif kind == DATE_MODE and content[0]:
                self.first_day = datetime(1904, 1, 1)
        dates = {i for i, code in formats.items() if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code), re.I) and code != "General"}
        self.dates = {i for i, n in enumerate(styles) if n in dates or 14 <= n <= 22 or 45 <= n <= 47}

    def number(self, x: float, style: int) -> str:
        if style in self.dates:
            when = self.first_day + timedelta(days=x)
            return when.strftime("%Y-%m-%d" if when.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)

    def cells(self, sheet: str | None) -> Iterator[tuple[int, int, str]]:
        """Row, column (both from 0) and text of the cells of a sheet."""
        if sheet is None:
            start = next(iter(self.sheets.values()))
        else:
            names = {k.lower(): v for k, v in self.sheets.items()}
            if sheet.lower() not in names:
                raise IngestError(f"no sheet {sheet!r}; valid: {', '.join(self.sheets)}")
            start = names[sheet.lower()]
        waiting = None
        for kind, parts in records(self.data, start):
            c = parts[0]
            if kind == STRING and waiting:
                yield *waiting, _text(b"".join(parts), 0)
                waiting = None
            if kind not in (LABEL, LABEL_SST, NUMBER, RK, MANY_RK, BOOL, FORMULA):
                continue
            row, column, style = unpack_from("<HHH", c)
            if kind == LABEL_SST:
                yield row, column, self.texts[unpack_from("<I", c, 6)[0]]
            elif kind == LABEL:
                yield row, column, _text(c, 6)
            elif kind == NUMBER:
                yield row, column, self.number(unpack_from("<d", c, 6)[0], style)
            elif kind == RK:
                yield row, column, self.number(_rk(unpack_from("<I", c, 6)[0]), style)
            elif kind == MANY_RK:
                for i in range((len(c) - 6) // 6):
                    style, value = unpack_from("<HI", c, 4 + 6 * i)
                    yield row, column + i, self.number(_rk(value), style)
            elif kind == BOOL:
                if not c[7]:
                    yield row, column, "true" if c[6] else "false"
            elif c[12:14] != b"\xff\xff":
                yield row, column, self.number(unpack_from("<d", c, 6)[0], style)
            elif c[6] == 0:
                waiting = (row, column)
            elif c[6] == 1:
                yield row, column, "true" if c[8] else "false"

    def rows(self, sheet: str | None) -> Iterator[tuple[int, list]]:
        """Row numbers and cells."""
        now, line = None, []
        for row, column, text in self.cells(sheet):
            if row != now:
                if now is not None:
                    yield now + 1, line
                now, line = row, []
            line += [None] * (column + 1 - len(line))
            line[column] = text
        if now is not None:
            yield now + 1, line


def _rk(value: int) -> float:
    """A number packed into 30 bits, of which two say how."""
    if value & 2:
        x = float((value >> 2) - (1 << 30 if value & 0x80000000 else 0))
    else:
        x = unpack_from("<d", b"\0\0\0\0" + (value & 0xFFFFFFFC).to_bytes(4, "little"))[0]
    return x / 100 if value & 1 else x


def read_xls(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A worksheet as a table of texts with row numbers."""
    from tabguard.sources.xlsx import _batches, header

    if not store.exists(spark, path):
        raise FileNotFoundError(path)
    with store.reader(spark, path) as f:
        names = header(cells for _, cells in Book(f.read(), path).rows(sheet))
    width = len(names)
    schema = T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(x, T.StringType()) for x in names]])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                found = Book(content.as_py(), path).rows(sheet)
                next(found, None)
                yield from _batches(found, width, schema.names)

    return spark.read.format("binaryFile").load(store.plain_path(path)).select(F.col("content")).mapInArrow(parse, schema)
