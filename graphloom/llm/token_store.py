"""A content-addressed store of token ids.

Documents' id streams are cut where a rolling hash of the last ids says so, so equal passages give equal chunks wherever
they stand.  A chunk is stored once, under its digest; a document is a recipe, the list of its chunks' digests, whose Merkle root
is kept beside it.  Recipes lie in ascending order of their ids, in volumes; each volume's manifest has the Merkle root over
its documents.  Reading verifies every chunk's digest, every recipe's root and every volume's root.

Format (Parquet, in one folder): chunks (digest, ids: little-endian, 2 bytes an id, or 4 where the vocabulary needs them),
recipes (volume, place, doc_id, n_tokens, digests: 16 bytes each, root), manifests (volume, documents, n_tokens, root).
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import worker_tokens
from .common import Workspace, col, small_enough

LEAST, MEAN_BITS, MOST, SPAN = 64, 8, 1024, 16
#: Digests that a task remembers as sent; forgetting one costs a copy that is left out later.
REMEMBERED = 200_000
#: Copies of chunks, and volumes, that may be broadcast, at some 60 bytes each.
MOST_BROADCAST = 500_000
_GEAR = np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and nodes are told apart by a first byte, an odd one moves up."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"\2")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def rolling_hits(ids: np.ndarray) -> np.ndarray:
    """The places behind which the rolling hash of the last SPAN ids has MEAN_BITS zeros.  Within SPAN of an earlier text they are arbitrary."""
    n = len(ids)
    h, k = _GEAR[ids & 0xFFFF], 1
    while k < min(SPAN, n):  # sums over 2, 4, ... ids, each place shifted by its distance
        h[k:] += h[:-k] << np.uint64(k)
        k *= 2
    return np.flatnonzero((h >> np.uint64(SPAN)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1


def cut_points(ids: np.ndarray, hits: list[int] | None = None, first: int = 0, stop: int | None = None) -> list[int]:
    """Ends of the chunks of ids[first:stop]: at hits, no closer than LEAST, no farther than MOST.

    As LEAST is more than SPAN, hits of a whole batch of texts cut each text as its own hits would.
    """
    hits, stop = rolling_hits(ids).tolist() if hits is None else hits, len(ids) if stop is None else stop
    ends, at = [], first
    while stop - at > LEAST:
        i = bisect_left(hits, at + LEAST)
        end = min(hits[i], stop) if i < len(hits) else stop
        at = min(end, at + MOST)
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


_SENT = "kind byte, key binary, task int, row long, doc_id long, n_tokens long, data binary, root binary"


def _encode(path: str | None, end_id: int, wide: bool):
    """Recipes (kind 0; data: the chunks' digests) and chunks (kind 1), each chunk once a task as far as the task remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = worker_tokens(path)
        task, row, sent = TaskContext.get().partitionId(), 0, set()
        types = [pa.int8(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names, width = [f.split()[0] for f in _SENT.split(", ")], 4 if wide else 2

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, ids, ends in tokens.batches(batch.column(1), end_id):
                if not wide and len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError(f"id {ids.max()} needs 4 bytes: write the store with wide=True")
                rows, hits, ends = [], rolling_hits(ids).tolist(), ends.tolist()
                stored = memoryview(ids.astype("<u4" if wide else "<u2").tobytes())
                for doc, start, stop in zip(docs[first:], ends, ends[1:], strict=False):
                    digests, at = [], start
                    for end in cut_points(ids, hits, start, stop):
                        data = stored[width * at : width * end]
                        digests.append(key := digest(data))
                        if key not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(key)
                            rows.append((1, key, task, row, None, None, bytes(data), None))
                            row += 1
                        at = end
                    rows.append((0, None, task, row, doc, stop - start, b"".join(digests), merkle_root(digests)))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by volume and place."""
    out, roots, volume, tokens = [], [], None, 0
    for batch in batches:
        for v, n, root in zip(*(batch.column(c).to_pylist() for c in ("volume", "n_tokens", "root")), strict=True):
            if v != volume:
                if roots:
                    out.append((volume, len(roots), tokens, merkle_root(roots)))
                volume, roots, tokens = v, [], 0
            roots.append(root)
            tokens += n
    if roots:
        out.append((volume, len(roots), tokens, merkle_root(roots)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["volume", "documents", "n_tokens", "root"])


_MANIFEST = "volume int, documents long, n_tokens long, root binary"


class TokenStore:
    """A written store: its folder and what its files hold."""

    def __init__(self, spark: SparkSession, path: str, wide: bool):
        self.spark, self.path, self.wide = spark, path, wide
        self.chunks = spark.read.schema("key binary, data binary").parquet(f"{path}/chunks")
        self.recipes = spark.read.schema("volume int, place long, doc_id long, n_tokens long, digests binary, root binary").parquet(f"{path}/recipes")
        self.manifests = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")

    @classmethod
    def write(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, wide: bool | None = None) -> TokenStore:
        """Encodes every text (null: empty), with end_id behind, and writes the store.

        Ascending ids, null ones last; rows with equal ids are documents of their own, in the order of their roots.
        An empty table gives an empty store.  Other columns are not read.  wide (4 bytes an id): null takes it from the
        size of the vocabulary; an id over 65,535, as an end_id beyond the vocabulary may be, is an error unless wide.

        Tasks write what they find; of chunks that several tasks found, only keys travel to tell which copy stays, and the
        others are left out as the chunk files are written.
        """
        spark, work = docs.sparkSession, Workspace(docs.sparkSession, "token-store")
        wide = worker_tokens(tokenizer).vocabulary > 1 << 16 if wide is None else wide
        rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
        sent = work.save(rows.mapInArrow(_encode(tokenizer, end_id, wide), _SENT), "sent")
        chunks = sent.where("kind = 1")
        place = F.struct("task", "row")
        shared = work.save(chunks.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "shared")
        found = F.broadcast(shared) if small_enough(shared, MOST_BROADCAST) else shared
        others = work.save(chunks.select("key", "task", "row").join(found, "key").where(place != F.col("first")).select("task", "row"), "others")
        found = F.broadcast(others) if small_enough(others, MOST_BROADCAST) else others
        chunks.join(found, ["task", "row"], "left_anti").select("key", "data").write.option("compression", "zstd").parquet(f"{path}/chunks")
        recipes = sent.where("kind = 0").select("task", "row", "doc_id", "n_tokens", F.col("data").alias("digests"), "root")
        parts = max(1, recipes.count() // 1_000_000 + 8)
        ranged = recipes.repartitionByRange(parts, F.asc_nulls_last("doc_id"), "root", "task", "row").sortWithinPartitions(F.asc_nulls_last("doc_id"), "root", "task", "row")
        ranged = ranged.select(F.spark_partition_id().alias("volume"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("place"), "doc_id", "n_tokens", "digests", "root")
        ranged.write.option("compression", "zstd").parquet(f"{path}/recipes")
        store_recipes = spark.read.schema("volume int, place long, doc_id long, n_tokens long, digests binary, root binary").parquet(f"{path}/recipes")
        cls._roots(store_recipes).write.parquet(f"{path}/manifests")
        work.drop(sent, shared, others)
        return cls(spark, path, wide)

    @staticmethod
    def _roots(recipes: DataFrame) -> DataFrame:
        few = recipes.select("volume", "place", "n_tokens", "root")
        return few.repartition("volume").sortWithinPartitions("volume", "place").mapInArrow(_manifest, _MANIFEST)

    def verify_manifests(self) -> None:
        """Compares every volume's root with its recipes; raises where they differ."""
        now = self._roots(self.recipes)
        wrong = self.manifests.exceptAll(now).union(now.exceptAll(self.manifests)).take(1)
        if wrong:
            raise ValueError(f"volume {wrong[0].volume} doesn't match its manifest")

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

        Each chunk is read and hashed where it lies; its checksum, not its content, meets the recipes, and a document's
        checksum is combined from its chunks' ones.
        """
        sums = self.chunks.mapInArrow(_checked(self.wide), "key binary, crc long, n long")
        recipes = self.recipes.select("volume", "place", "digests", "root")
        named = recipes.select("volume", "place", F.posexplode(F.expr("transform(sequence(0, length(digests) div 16 - 1), i -> substring(digests, i * 16 + 1, 16))")).alias("i", "key"))
        parts = named.join(sums, "key", "left").groupBy("volume", "place").agg(F.array_sort(F.collect_list(F.struct("i", "key", "crc", "n"))).alias("parts"))
        whole = parts.join(self.recipes.select("volume", "place", "doc_id", "n_tokens", "root"), ["volume", "place"])
        flat = whole.select("volume", "place", "doc_id", "n_tokens", "root", F.col("parts.key").alias("keys"), F.col("parts.crc").alias("crcs"), F.col("parts.n").alias("ns"))
        checked = flat.mapInArrow(_combined, "volume int, place long, doc_id long, n_tokens long, ids_crc32 long")
        before = Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.manifests.select("volume", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("volume").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        offsets = F.broadcast(offsets) if small_enough(self.manifests, MOST_BROADCAST) else offsets
        return checked.join(offsets, "volume").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")

    def ids(self) -> DataFrame:
        """doc_id, ids (little-endian 32 bits) of every document, put together from its chunks."""
        named = self.recipes.select("volume", "place", "doc_id", F.posexplode(F.expr("transform(sequence(0, length(digests) div 16 - 1), i -> substring(digests, i * 16 + 1, 16))")).alias("i", "key"))
        parts = named.join(self.chunks, "key").groupBy("volume", "place", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("parts"))
        wide = self.wide

        def joined(batches):
            for batch in batches:
                data = [np.frombuffer(b"".join(p), "<u4" if wide else "<u2").astype("<u4").tobytes() for p in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "ids"])

        return parts.select("doc_id", F.col("parts.data").alias("data")).mapInArrow(joined, "doc_id long, ids binary")


def _checked(wide: bool):
    def run(batches):
        for batch in batches:
            keys, chunks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wide_ids = memoryview(np.frombuffer(b"".join(chunks), "<u4" if wide else "<u2").astype("<u4").tobytes())
            crcs, ns, at = [], [], 0
            for key, data in zip(keys, chunks, strict=True):
                if digest(data) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't match its digest")
                n = len(data) // (4 if wide else 2)
                crcs.append(zlib.crc32(wide_ids[at : at + 4 * n]))
                ns.append(n)
                at += 4 * n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(ns, pa.int64())], names=["key", "crc", "n"])

    return run


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
            a ^= bit
            if not a:
                break
        bit >>= 1
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return out


@lru_cache(maxsize=1 << 14)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 n_bytes."""
    out, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(square, out)
        square = _times(square, square)
        n >>= 1
    return out


@lru_cache(maxsize=1 << 11)
def _shift_tables(n_bytes: int) -> tuple[list[int], ...]:
    """What each byte of a checksum becomes when so many bytes follow."""
    bits = [_times(_shift(n_bytes), 1 << i) for i in range(32)]
    tables = []
    for at in range(0, 32, 8):
        table = [0]
        for bit in bits[at : at + 8]:
            table += [x ^ bit for x in table]
        tables.append(table)
    return tuple(tables)


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """The checksum of a whole from (checksum, bytes) of its parts."""
    out = 0
    for crc, n in parts:
        if out:
            a, b, c, d = _shift_tables(n)
            out = a[out & 255] ^ b[out >> 8 & 255] ^ c[out >> 16 & 255] ^ d[out >> 24]
        out ^= crc
    return out


def _combined(batches):
    for batch in batches:
        crcs = []
        for n, root, keys, part_crcs, ns in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "root", "keys", "crcs", "ns")), strict=True):
            if None in ns or sum(ns) != n or merkle_root(keys) != root:
                raise ValueError(f"recipe {root.hex()} can't be reconstructed")
            crcs.append(combined_crc([(c, 4 * k) for c, k in zip(part_crcs, ns, strict=True)]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("volume", "place", "doc_id", "n_tokens")), pa.array(crcs, pa.int64())], names=["volume", "place", "doc_id", "n_tokens", "ids_crc32"])


def store_and_read(docs: DataFrame, **kwargs) -> DataFrame:
    """Writes a store into the shared folder and reads it back: doc_id, start, n_tokens, ids_crc32."""
    work = Workspace(docs.sparkSession, "token-store-files")
    store = TokenStore.write(docs, work.path("store"), **kwargs)
    store.verify_manifests()
    return store.documents()
