"""Packing token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A document's full windows leave at once; what is left of it
goes to the open window it fills best.  If none has room, a new one is opened while there are fewer than the fixed number;
otherwise the fullest is topped up with the head of the piece (if that is no mere scrap) and emitted.
The windows open at a partition's end are merged, whole, in groups of a few thousand.

The state of a task is a number for each open window; pieces are emitted as they are placed.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import worker_tokens
from .common import Workspace, col, small_enough

WINDOW, OPEN, SCRAP, MERGED = 1024, 32, 16, 2048
#: Merged windows that may be broadcast, at some 60 bytes each.
MOST_BROADCAST = 500_000

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, ids binary, open boolean"


class Windows:
    """Open windows by the room they have left."""

    def __init__(self, first: int, window: int, most: int, scrap: int):
        self.next, self.window, self.most, self.scrap = first, window, most, scrap
        self.room: list[tuple[int, int]] = []  # (room, id), ascending

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(window, offset, length) for each part of a piece of n ids, in order."""
        while n >= self.window:
            yield self._new(), 0, self.window
            n -= self.window
        while n:
            i = bisect.bisect_left(self.room, (n, -1))
            if i < len(self.room):
                room, w = self.room.pop(i)
                yield w, self.window - room, n
                room -= n
                n = 0
            elif len(self.room) < self.most:
                room, w = self.window - n, self._new()
                yield w, 0, n
                n = 0
            else:
                room, w = self.room.pop(0)
                if room >= self.scrap:
                    yield w, self.window - room, room
                    n -= room
                continue
            if room:
                bisect.insort(self.room, (room, w))


def _pack(path: str | None, end_id: int, window: int, most: int, scrap: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = worker_tokens(path)
        windows = Windows(TaskContext.get().partitionId() << 36, window, most, scrap)
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        types = [*[pa.int64()] * 7, pa.binary(), pa.bool_()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, ids, ends in tokens.batches(batch.column(1), end_id):
                rows, data, ends = [], memoryview(ids.astype("<u4").tobytes()), ends.tolist()
                for doc, base, stop in zip(docs[first:], ends, ends[1:], strict=False):
                    start, total = 0, stop - base
                    for w, offset, n in windows.place(total):
                        part = data[4 * (base + start) : 4 * (base + start + n)]
                        rows.append((doc, start, n, zlib.crc32(part), total, w, offset, bytes(part) if keep_ids else None, False))
                        start += n
                yield packed(rows)
        yield packed([(None, None, None, None, None, w, windows.window - room, None, True) for room, w in windows.room])

    return run


def _merge(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, room = [], []  # room: (left, sequence)
        for w, used in sorted(zip(pdf["window"], pdf["used"], strict=True), key=lambda x: (-x[1], x[0])):
            i = bisect.bisect_left(room, (used, -1))
            left, seq = room.pop(i) if i < len(room) else (window, w)
            out.append((w, seq, window - left))
            if left > used:
                bisect.insort(room, (left - used, seq))
        return pd.DataFrame(out, columns=["merged", "into", "at"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN, scrap: int = SCRAP, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian 32 bits).

    A document is its text's ids and end_id behind; null is the empty text, so every row has at least one id.
    Pieces of a sequence lie without gaps from offset 0.  Equal rows and rows with equal or null ids are documents
    of their own.  An empty table gives an empty table; other columns are not read.
    """
    work = Workspace(docs.sparkSession, "packing")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    placed = work.save(rows.mapInArrow(_pack(tokenizer, end_id, window, open_windows, scrap, keep_ids), _SCHEMA), "placed")
    left = placed.where("open").select("window", F.col("offset").alias("used"))
    groups = left.count() // MERGED + 1
    merged = left.groupBy(F.pmod(F.xxhash64("window"), F.lit(groups)).alias("g")).applyInPandas(_merge(window), "merged long, into long, at long")
    merged = work.save(merged, "merged")
    if small_enough(merged, MOST_BROADCAST):
        merged = F.broadcast(merged)
    pieces = placed.where("not open").join(merged, F.col("window") == F.col("merged"), "left")
    out = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("into", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"), "ids")
    return out if keep_ids else out.drop("ids")
