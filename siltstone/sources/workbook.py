"""Workbooks as a Spark source: ``spark.read.format("workbook").load(path)``, a sheet in parts by ranges of rows.

The first row names the columns, all of which are text.  Options: ``sheet``, a name or a number from 1 (the first by default) or ``*``, all
sheets one after the other, which then have the same first row, as ``WorkbookSink`` writes tables too long for one; and ``rows``, how
many a part holds, if that makes no more than ``MOST_PARTS`` parts a sheet.  A part is read by its own task, as a stream: rows before its range are passed over, and of the
workbook's shared strings only those are held that the range refers to.  The path must be one that all executors see.
"""

from __future__ import annotations

import zipfile
from array import array
from collections.abc import Iterator
from xml.etree.ElementTree import Element, iterparse
from xml.parsers.expat import ParserCreate

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ROWS = 50_000
#: A sheet is read in at most so many parts, which then hold more rows than asked for.
MOST_PARTS = 128
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(element: Element) -> str:
    return element.tag.rpartition("}")[2]


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path in the file) of each sheet, in the workbook's order."""
    targets = {e.get("Id"): e.get("Target") for _, e in iterparse(book.open("xl/_rels/workbook.xml.rels")) if _local(e) == "Relationship"}
    listed = [(e.get("name"), targets[e.get(_RELATION)]) for _, e in iterparse(book.open("xl/workbook.xml")) if _local(e) == "sheet"]
    return [(name, at.lstrip("/") if at.startswith("/") else f"xl/{at}") for name, at in listed]


def column_number(reference: str) -> int:
    """From 0, of a cell's reference like ``AB12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _text_of(element: Element) -> str:
    """The text of a shared or inline string, without readings that are written above it."""
    return "".join(t.text or "" for part in element for t in ([part] if _local(part) == "t" else part if _local(part) == "r" else []) if _local(t) == "t")


def row_places(book: zipfile.ZipFile, part: str) -> tuple[bytes, array]:
    """What stands before a sheet's first row, and at which byte of the sheet each row begins."""
    places, parser = array("Q"), ParserCreate()

    def start(name: str, _attributes: dict) -> None:
        if name.rpartition(":")[2] == "row":
            places.append(parser.CurrentByteIndex)

    parser.StartElementHandler = start
    with book.open(part) as stream:
        while chunk := stream.read(1 << 20):
            parser.Parse(chunk, False)
        parser.Parse(b"", True)
    with book.open(part) as stream:
        return stream.read(places[0] if places else 0), places


class _Resumed:
    """A sheet from one of its rows on, behind what stands before its first row."""

    def __init__(self, head: bytes, stream):
        self.head, self.stream = head, stream

    def read(self, n: int = -1) -> bytes:
        head, self.head = self.head, b""
        return head or self.stream.read(n)


def rows_of(book: zipfile.ZipFile, part: str, first: int, last: int | None, start: tuple[bytes, int] | None = None) -> Iterator[dict[int, tuple[str, str]]]:
    """The rows of a range, numbered from 0 as they come, each as column to (type, value).

    With ``start``, what stands before the first row and the byte where row ``first`` begins, the rows before are unpacked but not read.
    """
    at, path = -1, []
    with book.open(part) as stream:
        if start is not None:
            at = first - 1
            stream.seek(start[1])
            stream = _Resumed(start[0], stream)
        for event, e in iterparse(stream, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if _local(e) != "row":
                continue
            at += 1
            if at >= first:
                cells: dict[int, tuple[str, str]] = {}
                for k, c in enumerate(c for c in e if _local(c) == "c"):
                    kind = c.get("t", "n")
                    column = column_number(c.get("r")) if c.get("r") else k
                    for v in c:
                        if _local(v) == "is":
                            cells[column] = ("text", _text_of(v))
                        elif _local(v) == "v" and v.text is not None:
                            cells[column] = ("shared" if kind == "s" else "bool" if kind == "b" else "text", v.text)
                yield cells
            path[-1].clear()  # the rows so far
            if last is not None and at + 1 >= last:
                return


def shared_strings(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of some numbers."""
    if not wanted or "xl/sharedStrings.xml" not in book.namelist():
        return {}
    out, at, path = {}, -1, []
    with book.open("xl/sharedStrings.xml") as stream:
        for event, e in iterparse(stream, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if _local(e) == "si":
                at += 1
                if at in wanted:
                    out[at] = _text_of(e)
                path[-1].clear()
                if len(out) == len(wanted):
                    break
    return out


def resolved(book: zipfile.ZipFile, rows: list[dict[int, tuple[str, str]]], width: int) -> list[list[str | None]]:
    """Rows as lists of texts, null where a cell is absent."""
    words = shared_strings(book, {int(v) for r in rows for k, v in r.values() if k == "shared"})
    plain = {"text": lambda v: v, "bool": lambda v: "true" if v == "1" else "false", "shared": lambda v: words.get(int(v))}
    return [[plain[r[c][0]](r[c][1]) if c in r else None for c in range(width)] for r in rows]


class _Range(InputPartition):
    def __init__(self, part: str, first: int, last: int | None, start: tuple[bytes, int] | None = None):
        self.part, self.first, self.last, self.start = part, first, last, start


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str, columns: list[str], rows: int, further: tuple[str, ...] = ()):
        self.path, self.parts, self.columns, self.rows = path, (part, *further), columns, rows

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        with zipfile.ZipFile(self.path) as book:
            for part in self.parts:
                head, places = row_places(book, part)
                total = len(places)
                rows = max(self.rows, -(-total // MOST_PARTS))  # each part unpacks what is before it
                out.extend(_Range(part, k, min(k + rows, total), (head, places[k])) for k in range(1, total, rows))
        return out or [_Range(self.parts[0], 1, 1)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        with zipfile.ZipFile(self.path) as book:
            held: list[dict] = []

            def batch() -> pa.RecordBatch:
                rows = resolved(book, held, len(self.columns))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(len(self.columns))], schema=schema)

            if partition.first < partition.last:
                held.extend(rows_of(book, partition.part, partition.first, partition.last, partition.start))
                yield batch()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheets(self) -> tuple[list[str], list[str]]:
        """The sheets to read, one at least, and their columns."""
        wanted = self.options.get("sheet", "1")
        with zipfile.ZipFile(self.options["path"]) as book:
            sheets = sheet_parts(book)
            found = [p for n, p in sheets if wanted in ("*", n)]
            if wanted != "*":
                found = found[:1] or [p for k, (_, p) in enumerate(sheets, 1) if wanted.isdigit() and int(wanted) == k]
            if not found:
                raise ValueError(f"no sheet {wanted!r} in {self.options['path']}; there are {[n for n, _ in sheets]}")
            firsts = {p: next(rows_of(book, p, 0, 1), None) for p in found}
            heads = {p: resolved(book, [f], max(f, default=-1) + 1)[0] for p, f in firsts.items() if f is not None}
        names = next(iter(heads.values()), [])
        if other := next((p for p, h in heads.items() if h != names), None):
            raise ValueError(f"{other} in {self.options['path']} has the columns {heads[other]}, a sheet before it {names}")
        found = list(heads) or found[:1]  # sheets without rows have no columns either
        seen: dict[str, int] = {}
        columns = []
        for k, n in enumerate(names):  # names that are missing or there already are numbered
            n = n if n and n.strip() else f"_c{k}"
            seen[n] = seen.get(n, 0) + 1
            columns.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
        return found, columns

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._sheets()[1]])

    def reader(self, schema: StructType) -> DataSourceReader:
        (part, *further), columns = self._sheets()
        return _Reader(self.options["path"], part, columns, int(self.options.get("rows", ROWS)), tuple(further))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(WorkbookSource)
