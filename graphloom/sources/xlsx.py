"""Sheets of .xlsx files: whole files travel as bytes, tasks parse them event by event, the first row of a file names the columns."""

from __future__ import annotations

import io
import zipfile
from collections import deque
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_SHEET, SHARED_STRINGS = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"
_CHUNK, _BATCH = 1 << 16, 2_000


def column_number(reference: str) -> int:
    """Zero-based column of a cell reference such as AB12; references without letters mean the first."""
    letters = (reference or "").rstrip("0123456789")
    return max(0, sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1)


class _Events:
    """A parser that is fed chunks and calls back with local names; text between start() and end() of the wanted tags is gathered."""

    def __init__(self, gathered: set[str]):
        self.gathered, self.depth, self.text = gathered, 0, []
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = lambda name, attrs: self._start(name.rpartition(" ")[2], attrs)
        self.parser.EndElementHandler = lambda name: self._end(name.rpartition(" ")[2])
        self.parser.CharacterDataHandler = lambda data: self.text.append(data) if self.depth else None

    def _start(self, name: str, attrs: dict) -> None:
        self.depth += name in self.gathered
        self.start(name, attrs)

    def _end(self, name: str) -> None:
        self.depth -= name in self.gathered
        self.end(name)

    def taken(self) -> str:
        out = "".join(self.text)
        self.text.clear()
        return out

    def run(self, stream) -> Iterator[None]:
        """Feeds the stream and yields after every chunk."""
        while chunk := stream.read(_CHUNK):
            self.parser.Parse(chunk)
            yield
        self.parser.Parse(b"", True)
        yield


class _Strings(_Events):
    """The texts of the shared strings, rich ones in one piece."""

    def __init__(self):
        super().__init__({"t"})
        self.found: list[str] = []

    def start(self, name, attrs):
        if name == "si":
            self.text.clear()

    def end(self, name):
        if name == "si":
            self.found.append(self.taken())


class _Rows(_Events):
    """Rows as dense lists of stripped strings, as far as they are complete."""

    def __init__(self, shared: list[str]):
        super().__init__({"v", "t"})
        self.shared, self.done, self.row, self.at, self.kind = shared, deque(), [], 0, ""

    def start(self, name, attrs):
        if name == "row":
            self.row = []
        elif name == "c":
            self.at, self.kind = column_number(attrs.get("r", "")), attrs.get("t", "")
            self.text.clear()

    def end(self, name):
        if name == "c":
            value = self.taken()
            if self.kind == "s":
                place = int(value) if value.strip().isdigit() else -1
                value = self.shared[place] if 0 <= place < len(self.shared) else ""
            self.row.extend([""] * (self.at + 1 - len(self.row)))
            self.row[self.at] = value.strip()
        elif name == "row":
            self.done.append(self.row)


def sheet_rows(data: bytes, sheet: str = FIRST_SHEET) -> Iterator[list[str]]:
    """The rows of a sheet of a file; shared and inline strings resolved.  Only the shared strings are held."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = _Strings()
        if SHARED_STRINGS in z.namelist():
            with z.open(SHARED_STRINGS) as f:
                for _ in strings.run(f):
                    pass
        rows = _Rows(strings.found)
        with z.open(sheet) as f:
            for _ in rows.run(f):
                while rows.done:
                    yield rows.done.popleft()


def _parse(sheet: str, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple[int, list[str]]] = []
                for n, row in enumerate(sheet_rows(data.as_py(), sheet)):
                    if most is not None and n >= most:
                        break
                    held.append((n, row))
                    if len(held) == _BATCH:
                        yield _batch(path, held)
                yield _batch(path, held)

    return run


def _batch(path: str, held: list) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array([n for n, _ in held], pa.int64()), pa.array([r for _, r in held], pa.list_(pa.string()))], names=["file", "row", "cells"])
    held.clear()
    return out


def sheet_cells(spark: SparkSession, path: str, sheet: str = FIRST_SHEET, most: int | None = None) -> DataFrame:
    """file, row, cells of every row of the files that path names (a file, a folder or a pattern, in any store that Spark reads)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse(sheet, most), "file string, row long, cells array<string>")


def read_sheet(spark: SparkSession, path: str, sheet: str = FIRST_SHEET) -> DataFrame:
    """One string column for each cell of the first row of the first file (col_i where it is blank); blank rows go, short ones are padded."""
    first = sheet_cells(spark, path, sheet, most=1).orderBy("file").first()
    names = [name or f"col_{i}" for i, name in enumerate(first.cells if first else [])]
    rows = sheet_cells(spark, path, sheet).where("row > 0 and exists(cells, c -> c <> '')")
    return rows.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
