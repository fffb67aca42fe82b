"""Exact removal of repeated substrings, by suffix sorting with a difference cover.

Documents are windows of WIDTH bytes; a window goes if it also starts in a document with a smaller id.  Equal windows hold the
same least hash of their GRAM-byte strings, so windows are dealt by that hash (runs of neighbours that share it travel as one
string) and every bucket sorts its suffixes alone: triples of words at the sampled positions (1 and 2 modulo 3) are sorted and
named, names are sorted again in triples for the depth that is asked for, the remaining suffixes are sorted by a byte and the
rank behind it and merged, and neighbours in the order are compared over the whole prefix.  Windows whose hash occurs in one
document only cannot repeat; a bitmap of fixed size, made of counts over all documents, leaves them out beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, col

WIDTH, GRAM = 50, 24
_SPAN = WIDTH - GRAM + 1
#: Bytes hashed at a time, bytes of text in a block of documents, windows in a string, and the bits of the bitmap at most (64 MB).
_PIECE, BLOCK, MOST_WINDOWS, MOST_BITS = 1 << 16, 24_000_000, 96, 1 << 29
#: Bytes of text for a part (its strings come to 4.5 times that at most), sorts that a part is cut into, bytes of strings sent on at a time.
PART, SORTS, _SENT = 4_000_000, 16, 16_000_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
FAR = np.int64(2**63 - 1)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of every GRAM bytes, put together from those of 16 and 8."""
    with np.errstate(over="ignore"):
        h, power, n, eight = data.astype(np.uint64) + np.uint64(1), _BASE, 1, None
        while n < 16:
            h, power, n = h[:-n] * power + h[n:], power * power, 2 * n
            if n == 8:
                eight, by = h, power
        h = h[: len(eight) - 16] * by + eight[16:]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """The least of every _SPAN hashes in a row."""
    n = 1
    while 2 * n <= _SPAN:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: -(_SPAN - n)], h[_SPAN - n :]) if n < _SPAN else h


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of runs of neighbouring windows with one least hash, in documents that end at `ends`.

    Runs of over MOST_WINDOWS windows are cut.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return empty.astype(np.uint64), empty, empty
    parts = [_least(_hashes(data[at : at + _PIECE + WIDTH - 1])) for at in range(0, len(data) - WIDTH + 1, _PIECE)]
    least = np.concatenate(parts)
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    first, last = np.concatenate([[0], ends[:-1]]), ends - WIDTH  # of every document; last < first where there is no window
    there = first < len(least)
    change[first[there]] = True
    # windows that cross an end are runs of their own, from last + 1 on
    begin = np.maximum(last + 1, first)
    begin = begin[begin < len(least)]
    change[begin] = True
    at = np.flatnonzero(change)
    length = np.diff(np.append(at, len(least)))
    of = np.searchsorted(ends, at, side="right")
    within = at <= last[of]
    at, length = at[within], length[within]
    if len(length) and length.max() > MOST_WINDOWS:
        pieces = -(-length // MOST_WINDOWS)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, length = np.repeat(at, pieces) + step * MOST_WINDOWS, np.minimum(np.repeat(length, pieces) - step * MOST_WINDOWS, MOST_WINDOWS)
    return least[at], at, length


class _Block:
    """Documents of a task: their ids, keys and bytes, as many as BLOCK bytes hold (one at least)."""

    def __init__(self, number: int):
        self.name = f"{TaskContext.get().partitionId()}-{number}"
        self.ids, self.keys, self.texts, self.size = [], [], [], 0

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, bytes, ends) of some 1 MB, or of one long document."""
        start = size = 0
        for i, text in enumerate(self.texts):
            size += len(text)
            if size >= 1 << 20 or i == len(self.texts) - 1:
                yield start, np.frombuffer(b"".join(self.texts[start : i + 1]), np.uint8), np.cumsum([len(t) for t in self.texts[start : i + 1]])
                start, size = i + 1, 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Rows without an id or without a window take no part."""
    number, block = 0, _Block(0)
    for batch in batches:
        for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if i is None or text is None or len(text) < WIDTH:
                continue
            block.ids.append(i)
            block.keys.append(key)
            block.texts.append(text)
            block.size += len(text)
            if block.size >= BLOCK:
                yield block
                number, block = number + 1, _Block(number + 1)
    if block.ids:
        yield block


def _split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts rows by part, and where each part starts."""
    part = part.astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _hash_lists(parts: int):
    mask = np.uint64(parts - 1)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = []
            ids = np.array(block.ids, np.int64)
            for first, data, ends in block.pieces():
                h, at, _ = runs(data, ends)
                of = ids[first + np.searchsorted(ends, at, side="right")]
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
                found.append((h[new], of[new]))
            h, of = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            if not len(start):
                continue
            several = np.maximum.reduceat(of, start) != of[start]
            h, one = h[start], of[start]
            order, bounds = _split(h & mask, parts)
            h, several, one = h[order], several[order], one[order]
            there = np.flatnonzero(np.diff(bounds))
            cut = [slice(bounds[p], bounds[p + 1]) for p in there.tolist()]
            yield pa.RecordBatch.from_pydict({"part": pa.array(there, pa.int32()), "hashes": [h[c].tobytes() for c in cut], "several": [np.packbits(several[c]).tobytes() for c in cut], "ids": [one[c].tobytes() for c in cut]})

    return lists


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows that come sorted by part."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["part"] != now:
                yield now, rows
                rows = []
            now = row["part"]
            rows.append(row)
    if rows:
        yield now, rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that two documents or more have."""
    for part, rows in _by_part(batches):
        h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        of = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(r["hashes"]) // 8) for r in rows])
        order = np.argsort(h, kind="stable")
        h, of, several = h[order], of[order], several[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        common = (np.maximum.reduceat(several, start) > 0) | (np.maximum.reduceat(of, start) != np.minimum.reduceat(of, start))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([int(common.sum())], pa.int64()), "hashes": [h[start][common].tobytes()]})


def _places(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The bit of each hash within the slice of its part."""
    shift = np.uint64(64 - (bits // parts - 1).bit_length())
    with np.errstate(over="ignore"):
        return ((h >> np.uint64(parts.bit_length() - 1)) * _BASE) >> shift


def _slices(parts: int, bits: int):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.zeros(bits // parts, bool)
                own[_places(np.frombuffer(row["hashes"], np.uint64), parts, bits)] = True
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "bits": [np.packbits(own).tobytes()]})

    return slices


def _strings(parts: int, bits: int, bitmap):
    mask, lg = np.uint64(parts - 1), np.int64(bits // parts)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint8)
        for block in _blocks(batches):
            ids = np.array(block.ids, np.int64)
            numbers: dict[bytes, int] = {}
            hashes, number, doc, start = [], [], [], []
            for first, data, ends in block.pieces():
                h, at, length = runs(data, ends)
                place = (h & mask).astype(np.int64) * lg + _places(h, parts, bits).astype(np.int64)
                hit = (known[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
                h, at, length = h[hit], at[hit], length[hit]
                of = np.searchsorted(ends, at, side="right")
                raw = data.tobytes()
                for value, a, b in zip(h.tolist(), at.tolist(), (at + length + WIDTH - 1).tolist(), strict=True):
                    k = numbers.setdefault(raw[a:b], len(numbers))
                    if k == len(hashes):
                        hashes.append(value)
                    number.append(k)
                doc.append(first + of)
                start.append(at - np.append(0, ends)[of])
            if not hashes:
                continue
            number, doc, start = np.array(number), np.concatenate(doc), np.concatenate(start)
            least, most = np.full(len(hashes), FAR), np.full(len(hashes), -FAR)
            np.minimum.at(least, number, ids[doc])
            np.maximum.at(most, number, ids[doc])
            texts = list(numbers)
            hashed = np.array(hashes, np.uint64)
            sort = _sorts(hashed, parts)
            order, bounds = _split((hashed & mask) * np.uint64(SORTS) + sort, parts * SORTS)
            bounds = bounds[::SORTS]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lengths = np.fromiter(map(len, texts), np.int32, len(texts))
            sent, size = [], 0
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                rows = order[bounds[p] : bounds[p + 1]]
                text = b"".join([texts[k] for k in rows.tolist()])
                sent.append((p, {"text": text, "lengths": lengths[rows], "sorts": sort[rows].astype(np.uint8), "least": least[rows], "most": most[rows]}))
                size += len(text)
                if size >= _SENT:
                    yield _rows(block.name, sent)
                    sent, size = [], 0
            if sent:
                yield _rows(block.name, sent)
            # where each string stands, in the order of the parts
            order = np.argsort(rank[number], kind="stable")
            yield _rows(block.name, [(-1, {"number": rank[number][order].astype(np.int32), "doc": doc[order].astype(np.int32), "start": start[order].astype(np.int64), "ids": ids, "keys": np.array(block.keys, np.int64), "bounds": bounds.astype(np.int64)})])

    return strings


_FIELDS = ("text", "lengths", "sorts", "least", "most", "number", "doc", "start", "ids", "keys", "bounds")


def _rows(block: str, rows: list[tuple[int, dict[str, bytes | np.ndarray]]]) -> pa.RecordBatch:
    cells = {f: pa.array([v if (v := values.get(f)) is None or isinstance(v, bytes) else v.tobytes() for _, values in rows], pa.binary()) for f in _FIELDS}
    return pa.RecordBatch.from_pydict({"block": [block] * len(rows), "part": pa.array([p for p, _ in rows], pa.int32()), **cells})


def _sorts(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of a part's sorts a hash belongs to: bits that neither name its part nor lead in its place in the bitmap."""
    return (h >> np.uint64(parts.bit_length() - 1)) % np.uint64(SORTS)


def _words(text: np.ndarray, width: int) -> np.ndarray:
    """The big-endian number of the `width` bytes (6 or 8) at every position, zeros behind the end."""
    one = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    out = (four[:-4] << np.uint64(32)) | four[4:]
    return (out >> np.uint64(8 * (8 - width)))[: len(text)]


def _named(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones."""
    order = np.argsort(key)
    sorted_ = key[order]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
    return names


def _triples(names: np.ndarray, at: np.ndarray, one: int, two: int) -> np.ndarray:
    """The rank of each triple of names at `at`, `one` and `two` behind it."""
    bits = int(names.max()).bit_length()
    first, second, third = names[at], names[at + one], names[at + two]
    if 3 * bits > 63:  # two at a time where three don't fit
        return _named((_named((first << bits) | second) << bits) | third)
    return _named((first << (2 * bits)) | (second << bits) | third)


def suffix_order(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The given starts in the order of their first WIDTH bytes, all of which lie in the text."""
    kind = starts % 3
    cover, rest = starts[kind != 0], starts[kind == 0]
    # only sampled positions that some start needs are named: its own, those right behind it, and what their triples are made of
    need = np.zeros(len(text), bool)
    for own in (cover, starts[kind != 1] + 2, starts[kind != 2] + 1):
        need[own] = True
    ranked = np.flatnonzero(need)
    for far in (18, 30):
        need[ranked + far] = True
    triples = np.flatnonzero(need)
    for far in (6, 12):
        need[triples + far] = True
    words = np.flatnonzero(need)
    # triples of six-byte words name 18 bytes, triples of names 48
    name, rank = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    name[words] = _named(_words(text, 6)[words])
    name[triples] = _triples(name, triples, 6, 12)
    rank[ranked] = _triples(name, ranked, 18, 30)
    # sampled suffixes by rank and the two bytes behind it; the others by a byte, the rank behind it and the last byte
    byte = text.astype(np.int64)
    cover = cover[np.argsort((rank[cover] << 16) | (byte[cover + 48] << 8) | byte[cover + 49])]
    by_one = lambda i: (byte[i] << 54) | (rank[i + 1] << 8) | byte[i + 49]
    by_two = lambda i: (((byte[i] << 8) | byte[i + 1]) << 46) | rank[i + 2]
    rest = rest[np.argsort(by_one(rest))]
    # merge: a suffix at 0 and one at 1 compare by a byte and a rank, one at 0 and one at 2 by two bytes and a rank
    place = np.empty(len(starts), np.int64)
    place_rest, place_cover = np.arange(len(rest)), np.arange(len(cover))
    for residue, key in ((1, by_one), (2, by_two)):
        own = np.flatnonzero(cover % 3 == residue)
        a, b = key(rest), key(cover[own])
        place_rest = place_rest + np.searchsorted(b, a, side="left")
        place_cover[own] += np.searchsorted(a, b, side="right")
    place[: len(rest)], place[len(rest) :] = place_rest, place_cover
    out = np.empty(len(starts), np.int64)
    out[place] = np.concatenate([rest, cover])
    return out


def first_owners(text: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each start the least owner of an equal prefix."""
    order = suffix_order(text, starts)
    owner = np.zeros(len(text), np.int64)
    owner[starts] = owners
    differs = np.zeros(len(order), bool)
    differs[0] = True
    word = _words(text, 8)
    for n in (0, 8, 16, 24, 32, 40, WIDTH - 8):
        w = word[order + n]
        differs[1:] |= w[1:] != w[:-1]
    group = np.flatnonzero(differs)
    least = np.repeat(np.minimum.reduceat(owner[order], group), np.diff(np.append(group, len(order))))
    out = np.empty(len(text), np.int64)
    out[order] = least
    return out[starts]


def _sorted_part(rows: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, string, first window, windows, owner) of runs of windows with one owner, where some document of the row's block is larger.

    Strings come by their sorts, so only one sort's strings are at hand as numbers and names at a time.
    """
    lengths = [np.frombuffer(r["lengths"], np.int32) for r in rows]
    ends = [np.cumsum(n, dtype=np.int64) for n in lengths]
    bounds = [np.searchsorted(np.frombuffer(r["sorts"], np.uint8), np.arange(SORTS + 1)) for r in rows]
    owners, most = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("least", "most"))
    for sort in range(SORTS):
        numbers: dict[bytes, int] = {}
        least, asked = [], []
        for i, row in enumerate(rows):
            low, high = bounds[i][sort], bounds[i][sort + 1]
            if low == high:
                continue
            own, text, end = [], row["text"], ends[i][low:high]
            for a, b, owner in zip((end - lengths[i][low:high]).tolist(), end.tolist(), owners[i][low:high].tolist(), strict=True):
                k = numbers.setdefault(text[a:b], len(numbers))
                if k == len(least):
                    least.append(owner)
                elif owner < least[k]:
                    least[k] = owner
                own.append(k)
            asked.append((i, low, np.array(own), most[i][low:high]))
        if not asked:
            continue
        text = np.frombuffer(b"".join(numbers), np.uint8)
        length = np.fromiter(map(len, numbers), np.int64, len(numbers))
        numbers.clear()
        first = np.cumsum(length) - length
        windows = length - WIDTH + 1
        offset = np.cumsum(windows) - windows
        starts = np.arange(windows.sum()) + np.repeat(first - offset, windows)
        owner = first_owners(text, starts, np.repeat(np.array(least, np.int64), windows))
        smallest = np.minimum.reduceat(owner, offset)
        for i, low, own, largest in asked:
            wanted = np.flatnonzero(smallest[own] < largest)
            if len(wanted):
                strings = own[wanted]
                n = windows[strings]
                take = np.arange(n.sum()) + np.repeat(offset[strings] - np.cumsum(n) + n, n)
                value, end = owner[take], np.cumsum(n)
                new = np.append(True, value[1:] != value[:-1])
                new[(end - n)] = True
                at = np.flatnonzero(new)
                string = np.searchsorted(end, at, side="right")
                yield i, (low + wanted[string]).astype(np.int32), (at - (end - n)[string]).astype(np.int16), np.diff(np.append(at, len(value))).astype(np.int16), value[at]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each string of a block the least document of every window, where some document of the block is larger."""
    for part, rows in _by_part(batches):
        said: dict[int, list] = {}
        for i, *values in _sorted_part(rows):
            said.setdefault(i, []).append(values)
        if said:
            cells = [[np.concatenate(x).tobytes() for x in zip(*said[i], strict=True)] for i in said]
            yield pa.RecordBatch.from_pydict({"block": [rows[i]["block"] for i in said], "part": pa.array([part] * len(said), pa.int32()), **dict(zip(("string", "from", "windows", "owner"), map(list, zip(*cells, strict=True)), strict=True))})


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans by document; of each block first comes what stands where, then its answers by part."""
    stands, found = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if found:
            doc, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], (start + length + WIDTH - 1)[order]
            # ends grow with starts within a document once the largest so far is taken
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            base = np.cumsum(np.append(0, np.maximum.reduceat(end, first)[:-1] + 1))
            shift = np.repeat(base, np.diff(np.append(first, len(doc))))
            reach = np.maximum.accumulate(end + shift)
            new = np.flatnonzero(np.append(True, (start + shift)[1:] > reach[:-1]))
            last = np.append(new[1:], len(doc)) - 1
            doc, start, end = doc[new], start[new], (reach - shift)[last]
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            ids, keys = (np.frombuffer(stands[c], np.int64)[doc[first]] for c in ("ids", "keys"))
            bounds = np.append(first, len(doc))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), *lists], names=["id_", "key_", "starts_", "ends_"])
            found.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] < 0:
                yield from flush()
                stands = {k: row[k] for k in ("number", "doc", "start", "ids", "keys", "bounds")}
                number, doc, start = np.frombuffer(row["number"], np.int32), np.frombuffer(row["doc"], np.int32), np.frombuffer(row["start"], np.int64)
                ids, bounds = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64)
                continue
            string = bounds[row["part"]] + np.frombuffer(row["string"], np.int32)
            at, windows, owner = np.frombuffer(row["from"], np.int16), np.frombuffer(row["windows"], np.int16), np.frombuffer(row["owner"], np.int64)
            # every place of every string
            low, high = np.searchsorted(number, string, side="left"), np.searchsorted(number, string, side="right")
            n = high - low
            take = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            again = np.repeat(owner, n) < ids[doc[take]]
            take = take[again]
            found.append((doc[take], start[take] + np.repeat(at, n)[again], np.repeat(windows, n)[again].astype(np.int64)))
    yield from flush()


def _kept(texts: bool):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, starts, ends = text or b"", starts or [], ends or []
                rest = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)) if starts else text
                out.append((len(text), len(text) - len(rest), len(starts), hashlib.sha256(rest).hexdigest(), rest if texts else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())], names=["id_", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return kept


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """id_, key_ (hash of the text), starts_, ends_: what goes of each document that loses something, in bytes."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "suffixes")
    base = docs.select(col(id_col).cast("long").alias("id_"), F.xxhash64(col(text_col).cast("string")).alias("key_"), col(text_col).cast("string").alias("text_"))
    least, size = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.agg(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    # parts and the tasks that take them grow with the text, so what a task holds doesn't
    parts = 1 << max(6, (max(4 * least, size // PART) - 1).bit_length())
    tasks, block_tasks = max(least, parts // 2), max(least, 2 * size // BLOCK)
    lists = base.mapInArrow(_hash_lists(parts), "part int, hashes binary, several binary, ids binary")
    shared = work.save(lists.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_shared, "part int, n long, hashes binary"), "shared")
    n = shared.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(parts << 6, 1 << (32 * n + 1).bit_length()))
    bitmap = bytearray(bits // 8)
    width = bits // parts // 8
    for row in shared.mapInArrow(_slices(parts, bits), "part int, bits binary").toLocalIterator():
        bitmap[row.part * width : (row.part + 1) * width] = row.bits
    sent = spark.sparkContext.broadcast(bytes(bitmap))
    fields = ", ".join(f"{f} binary" for f in _FIELDS)
    strings = work.save(base.mapInArrow(_strings(parts, bits, sent), f"block string, part int, {fields}"), "strings")
    sent.unpersist()
    asked = strings.where("part >= 0").select("block", "part", "text", "lengths", "sorts", "least", "most").repartition(tasks, "part").sortWithinPartitions("part")
    answers = work.save(asked.mapInArrow(_answers, "block string, part int, string binary, `from` binary, windows binary, owner binary"), "answers")
    stands = strings.where("part < 0").select("block", "part", *_FIELDS[5:]).join(answers.select("block").distinct(), "block", "left_semi")
    both = stands.unionByName(answers, allowMissingColumns=True).repartition(block_tasks, "block").sortWithinPartitions("block", "part")
    spans = work.save(both.mapInArrow(_spans, "id_ long, key_ long, starts_ array<long>, ends_ array<long>"), "spans")
    work.drop(shared, strings, answers)
    return spans


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """id_, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every document.

    A byte goes if a string of WIDTH bytes that covers it also starts in a document with a smaller id; ties can't be, as
    rows with one id are one document in this: none of them takes from the others, and equal rows have equal results.  Null
    texts are empty; texts of less than WIDTH bytes and rows without an id stay whole and take nothing from others.  Long
    texts are hashed in pieces; a text of over BLOCK bytes is a block of its own.  An empty table gives no rows; other columns
    don't matter.  `kept` may start or end within a character, and is null without `texts`.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    spans = removed_spans(docs, id_col, text_col, work).groupBy("id_", "key_").agg(F.first("starts_").alias("starts_"), F.first("ends_").alias("ends_"))
    base = docs.select(col(id_col).cast("long").alias("id_"), F.xxhash64(col(text_col).cast("string")).alias("key_"), col(text_col).cast("string").alias("text_"))
    joined = base.join(spans, ["id_", "key_"], "left").select("id_", "text_", "starts_", "ends_")
    return joined.mapInArrow(_kept(texts), "id_ long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
