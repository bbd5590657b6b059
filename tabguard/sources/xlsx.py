"""Workbooks, over the standard library's zip and XML readers.

A worksheet is one compressed XML stream. A large one is read by several tasks: each
unpacks the stream, which is quick, and parses the rows that begin in its part. Files
come and go through Spark's file systems. Memory holds the file, the shared strings
and one batch.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import IngestError, TableError
from tabguard.functions.text import ROW
from tabguard.sources import store

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes of an unpacked worksheet that one task parses; bytes read and rows handed on at a time.
PART_BYTES, CHUNK, BATCH = 32 << 20, 1 << 20, 5000
#: Fixed value: rows of a worksheet, without its header.
MOST_ROWS = (1 << 20) - 1
_ROW = re.compile(rb"<(?:\w+:)?row[\s>/]")
_SHEET = re.compile(rb"<(?:\w+:)?worksheet\b[^>]*>")
_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")


def _column_index(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of the worksheets and their parts."""
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels}
    out = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        part = target[s.get(_REL)]
        out[s.get("name")] = part.lstrip("/") if part.startswith("/") else f"xl/{part}"
    return out


def _part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of a worksheet, the first one without a name; as in a workbook, case doesn't tell names apart."""
    parts = sheets(book)
    if sheet is None:
        return next(iter(parts.values()))
    for name, part in sorted(parts.items(), key=lambda x: x[0] != sheet):
        if name.lower() == sheet.lower():
            return part
    raise IngestError(f"no sheet {sheet!r}; valid: {', '.join(parts)}")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indices of the cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{_NS}numFmt")}
    dates = {i for i, code in own.items() if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code), re.I)}
    cells = root.find(f"{_NS}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {i for i, n in enumerate(ids) if n in dates or 14 <= n <= 22 or 45 <= n <= 47}


def _elements(f, low: int, high: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Numbers and XML of the rows that begin at low <= place < high, and the XML around them."""
    buffer, base, head, count, more = b"", 0, None, 0, True
    start = None  # where, in the buffer, the row begins that is being read
    while more:
        chunk = f.read(CHUNK)
        more = bool(chunk)
        buffer += chunk
        if head is None:
            m = _SHEET.search(buffer)
            if m is None and more:
                continue
            head = m[0] if m else b"<worksheet>"
        end = _END.search(buffer)
        size = end.start() if end else len(buffer)
        more &= end is None
        at = 0 if start is None else start + 4
        while m := _ROW.search(buffer, at, size if not more else max(0, size - 64)):
            if start is not None:
                yield count, buffer[start : m.start()], head
                start = None
            if base + m.start() >= high:
                return
            count += 1
            at = m.start() + 4
            if base + m.start() >= low:
                start = m.start()
        if not more:
            break
        # what is done with goes; of the rest a beginning of a row may be cut, which may lie across the end of the search
        gone = start if start is not None else max(at, len(buffer) - 128, 0)
        buffer, base = buffer[gone:], base + gone
        start = 0 if start is not None else None
    if start is not None:
        yield count, buffer[start:size], head


def rows(book: zipfile.ZipFile, sheet: str | None = None, low: int = 0, high: int = 1 << 62) -> Iterator[tuple[int, list]]:
    """Row numbers and cells of a worksheet, of the rows that begin in a part of its XML."""
    strings, dates = _strings(book), _date_styles(book)
    with book.open(_part(book, sheet)) as f:
        for number, xml, head in _elements(f, low, high):
            close = b"</" + head[1:].split(None, 1)[0].rstrip(b">") + b">"
            e = ElementTree.fromstring(head + xml + close)[0]
            cells: list = []
            for c in e.iter(f"{_NS}c"):
                at = _column_index(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(_cell(c, strings, dates))
            yield int(e.get("r", number)), cells


def _book(f, path: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(f)
    except zipfile.BadZipFile:
        raise IngestError(f"{path} is no workbook") from None


def _cell(c, strings: list[str], dates: set[int]) -> str | None:
    kind, value = c.get("t", "n"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if value is None or value.text is None:
        return None
    text = value.text
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    if kind == "n" and int(c.get("s", 0)) in dates:
        when = datetime(1899, 12, 30) + timedelta(days=float(text))
        return when.strftime("%Y-%m-%d" if when.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    return text


def header(found: Iterator[list]) -> list[str]:
    """Names of the columns from the first row."""
    for cells in found:
        names, seen = [], {ROW}
        for i, c in enumerate(cells):
            name = str(c).strip() if c not in (None, "") else f"Unnamed: {i}"
            while name in seen:
                name += ".1"
            seen.add(name)
            names.append(name)
        return names
    raise IngestError("the sheet has no header")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """A worksheet as a table of texts with row numbers."""
    if not store.exists(spark, path):
        raise FileNotFoundError(path)
    with store.reader(spark, path) as f, _book(f, path) as book:
        names = header(cells for _, cells in rows(book, sheet))
        size = book.getinfo(_part(book, sheet)).file_size
    width, n = len(names), max(1, -(-size // part_bytes))
    schema = T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(x, T.StringType()) for x in names]])

    def parse(batches):
        for batch in batches:
            for content, part in zip(batch.column(0), batch.column(1).to_pylist()):
                high = (part + 1) * part_bytes if part + 1 < n else 1 << 62
                with _book(io.BytesIO(content.as_buffer()), path) as book:
                    # the header is the first row
                    found = ((i, c) for i, c in rows(book, sheet, part * part_bytes, high))
                    if not part:
                        next(found, None)
                    yield from _batches(found, width, schema.names)

    # a scan of the file for each part: nothing is shuffled
    source = spark.read.format("binaryFile").load(store.plain_path(path)).select("content")
    scans = [source.withColumn("part", F.lit(i)) for i in range(n)]
    return reduce(DataFrame.unionAll, scans).mapInArrow(parse, schema)


def _batches(found: Iterator[tuple[int, list]], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []

    def pack():
        columns = list(zip(*pending))
        arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for number, cells in found:
        pending.append((number, *(cells + [None] * width)[:width]))
        if len(pending) >= BATCH:
            yield pack()
            pending.clear()
    if pending:
        yield pack()


class Sheet:
    """Cells of a sheet: a frame, which of its columns holds styles, and a last row of text."""

    def __init__(self, frame: DataFrame, styles: str | None = None, note: str | None = None):
        self.frame, self.styles, self.note = frame, styles, note


def write_xlsx(frames: dict[str, DataFrame | Sheet], path: str, fills: dict[str, str] | None = None) -> str:
    """Frames as the sheets of a new workbook, whole: what exceeds a sheet goes on in another one.

    fills: a colour for each style. A column of styles holds (column, category) pairs, with
    * for the whole row.
    """
    named = {k: v if isinstance(v, Sheet) else Sheet(v) for k, v in frames.items()}
    spark, fills = next(iter(named.values())).frame.sparkSession, fills or {}
    if store.exists(spark, path):
        raise TableError(f"{path} exists")
    style = {None: "", "bold": ' s="1"'} | {k: f' s="{i}"' for i, k in enumerate(fills, 2)}

    def cell(v, s: str = "") -> str:
        if v is None:
            return f"<c{s}/>"
        if isinstance(v, bool):
            return f'<c{s} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c{s}><v>{v}</v></c>" if v - v == 0 else f"<c{s}/>"
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    titles: list[str] = []

    def sheet(book: zipfile.ZipFile, title: str, columns: list[str], found: Iterator[str]) -> bool:
        """Writes one sheet; whether rows are left."""
        titles.append(title)
        with book.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            f.write(("<row>" + "".join(cell(c, style["bold"]) for c in columns) + "</row>").encode())
            n = 0
            for row in found:
                f.write(row.encode())
                if (n := n + 1) == MOST_ROWS:
                    break
            f.write(b"</sheetData></worksheet>")
        return n == MOST_ROWS

    with store.writer(spark, path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for title, s in named.items():
            columns = [c for c in s.frame.columns if c != s.styles]

            def lines(s=s, columns=columns):
                for r in s.frame.toLocalIterator():
                    marks = {m["column"]: m["category"] for m in (r[s.styles] or [])} if s.styles else {}
                    whole = marks.get("*")
                    yield "<row>" + "".join(cell(r[c], style.get(marks.get(c, whole), "")) for c in columns) + "</row>"
                if s.note:
                    yield f"<row>{cell(s.note)}</row>"

            found, n = lines(), 1
            while sheet(book, title[:31] if n == 1 else f"{title[:24]} ({n})", columns, found):
                n += 1
        n = range(1, len(titles) + 1)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n)
        book.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{types}</Types>',
        )
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, titles))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{doc}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        rels += f'<Relationship Id="rId{len(titles) + 1}" Type="{doc}/styles" Target="styles.xml"/>'
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">{rels}</Relationships>')
        solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in fills.values())
        formats = "".join(f'<xf fontId="0" fillId="{i}" applyFill="1"/>' for i in range(2, len(fills) + 2))
        book.writestr(
            "xl/styles.xml",
            f'{head}<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(fills) + 2}"><fill><patternFill patternType="none"/></fill>'
            f'<fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
            f'<cellXfs count="{len(fills) + 2}"><xf/><xf fontId="1" applyFont="1"/>{formats}</cellXfs></styleSheet>',
        )
    return path
