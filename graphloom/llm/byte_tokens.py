"""Token ids of whole texts by the ``tokenizers`` library, a batch at a time, with a bounded per-worker memory of words.

A byte-level BPE file cuts texts by its pattern before merging.  Where a single space or newline stands between
characters that are not white space, that pattern always cuts, so the pieces between such places can be encoded
one by one and remembered, and so can the marks behind a word.  A batch is cut into pieces by numpy, each different piece is looked up once, and the ids are
gathered by offsets.  A text in which some white space touches other white space (or an end of the text)
goes to the library whole, in cuts of bounded length where that is safe.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most bytes of remembered pieces per worker, at some PIECE_BYTES each; beyond, the half that was met least is forgotten.
MEMORY_BYTES, PIECE_BYTES = 112 << 20, 270
#: Bytes of text that are cut into pieces at once.
BATCH_BYTES = 4 << 20
#: Longest string handed to the library at once if it can be cut; longer ones take memory many times their size.
LONGEST = 1 << 16
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:%&*$#|\"()/\-]*)")
_SAFE_CUT = re.compile(r"(?<=[A-Za-zÀ-Ö.,;:!?]) (?=[A-Za-zÀ-Ö])")
_UNSAFE = -1
#: Classes of bytes: 1 separators, 2 ASCII letters, 4 marks before which a run of letters always ends.
_SEPARATOR, _LETTER, _MARK = 1, 2, 4
_MARKS = b".,!?;:%&*$#|\"()/-"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory:
    """Pieces and their ids: a number for each piece, and the place and length of its ids; length -1 marks unsafe pieces."""

    def __init__(self, most: int):
        self.most = max(2, most)
        self.number: dict[bytes, int] = {}
        self.start, self.length, self.met = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def add(self, pieces: list[bytes], ids: list[list[int] | None]) -> None:
        n, first = len(pieces), len(self.number)
        flat = [i for x in ids if x for i in x]
        length = np.fromiter((_UNSAFE if x is None else len(x) for x in ids), np.int64, n)
        own = np.maximum(length, 0)
        while len(self.start) < first + n:
            self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = self.used + np.cumsum(own) - own
        self.length[first : first + n] = length
        self.met[first : first + n] = 0
        self.number.update(zip(pieces, range(first, first + n), strict=True))
        self.used += len(flat)

    def shrink(self) -> None:
        """Forgets the half that was met least, once there are too many."""
        n = len(self.number)
        if n <= self.most:
            return
        keep = np.sort(np.argsort(-self.met[:n], kind="stable")[: self.most // 2])
        own = np.maximum(self.length[keep], 0)
        ends = np.cumsum(own)
        ids = self.ids[np.repeat(self.start[keep] - (ends - own), own) + np.arange(own.sum())]
        pieces = list(self.number)
        self.number = dict(zip([pieces[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.start[: len(keep)], self.length[: len(keep)], self.met[: len(keep)] = ends - own, self.length[keep], self.met[keep] // 2
        self.ids[: len(ids)], self.used = ids, len(ids)


class ByteTokens:
    """Encodes texts to ids."""

    def __init__(self, path: str | None = None, memory_bytes: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self._model, self._letters = self.tokenizer.model, _byte_letters()
        self._memory = _Memory(memory_bytes // PIECE_BYTES)
        self._newline = self._library("\n")
        kinds = np.zeros(256, np.uint8)
        kinds[[32, 10]] = _SEPARATOR
        kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
        # a mark that follows a letter within an added token (as in <|x|>) may not end a piece
        within = {m for t in self.tokenizer.get_added_tokens_decoder().values() for m in re.findall(r"(?<=[A-Za-z])[^A-Za-z]", t.content)}
        kinds[[m for m in _MARKS if chr(m) not in within]] = _MARK
        self._kinds = kinds

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _run(self, run: str) -> list[int]:
        """One piece of the pattern: only merging is left to do."""
        mapped = run.replace(" ", "Ġ") if run.isascii() else run.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(mapped)]

    def _piece(self, piece: bytes) -> list[int] | None:
        """Ids of a piece: a word, with the space or newline before it, if any; None: white space that the pattern may join with its neighbours."""
        text = piece.decode("utf-8", "surrogatepass")
        before, word = (text[0], text[1:]) if text[0] in " \n" else ("", text)
        if not word or word[0].isspace() or word[-1].isspace() or word[0] in "᠎​﻿" or word[-1] in "᠎​﻿":
            return None
        ahead, before = (self._newline, "") if before == "\n" else ([], before)
        if m := _PLAIN.fullmatch(word):
            return [*ahead, *self._run(before + m[1]), *(self._run(m[2]) if m[2] else ())]
        return [*ahead, *self._library(before + word)]

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text as little-endian unsigned 32-bit numbers; null is the empty text."""
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()

    def batches(self, texts: pa.Array, end_id: int | None = None):
        """(first text, ids, offsets) for runs of texts of some BATCH_BYTES; null is the empty text."""
        sizes = np.diff(_offsets(texts)[0])
        at = 0
        while at < len(texts):
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + (1 << 16)]), BATCH_BYTES, "right")))
            yield at, *self.encode_many(texts.slice(at, stop - at), end_id)
            at = stop

    def encode_many(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (end_id behind each, if given), and where each text's begin (and the end of all)."""
        offsets, data = _offsets(texts)
        lengths = np.diff(offsets)
        whole = np.zeros(len(lengths), bool)
        inside = data[offsets[0] : offsets[-1]]
        if len(inside):
            kinds = self._kinds[inside]
            breaks = np.zeros(len(inside) + 1, bool)
            breaks[:-1] = kinds & _SEPARATOR
            breaks[1:-1] |= ((kinds[1:] & _MARK) != 0) & ((kinds[:-1] & _LETTER) != 0)
            breaks[offsets - offsets[0]] = True
            cuts = np.flatnonzero(breaks) + offsets[0]
            del breaks, kinds
            pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
            numbers = self._numbers(pieces.dictionary.to_pylist())
            indices = pieces.indices.to_numpy(zero_copy_only=False)
            which = numbers[indices]
            memory = self._memory
            memory.met[numbers] += np.bincount(indices, minlength=len(numbers))
            n_ids = memory.length[which]
            # where each text's pieces begin: empty texts have none
            first = np.searchsorted(cuts, offsets)
            filled = lengths > 0
            led = (data[offsets[:-1][filled]] == 32) | (data[offsets[:-1][filled]] == 10)
            whole[np.flatnonzero(filled)[led]] = True  # white space at a text's start, and pieces that are unsafe
            whole[np.searchsorted(first, np.flatnonzero(n_ids < 0), "right") - 1] = True
            for i in np.flatnonzero(whole).tolist():
                n_ids[first[i] : first[i + 1]] = 0
            ends = np.r_[0, np.cumsum(n_ids)]
            gather = np.repeat(memory.start[which] - ends[:-1], n_ids)
            gather += np.arange(ends[-1])
            ids = memory.ids[gather]
            del gather
            per_text = np.diff(ends[first])
            memory.shrink()
        else:
            ids, per_text = np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        if whole.any():
            parts, at = [], 0
            by = np.cumsum(per_text)
            for i in np.flatnonzero(whole).tolist():
                parts.append(ids[at : by[i]])
                at = by[i]
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")
                parts.append(np.fromiter((x for cut in self._cuts(text) for x in self._library(cut)), np.uint32))
                per_text[i] = len(parts[-1])
            ids = np.concatenate([*parts, ids[at:]])
        bounds = np.r_[0, np.cumsum(per_text)]
        if end_id is None:
            return ids, bounds
        out = np.full(len(ids) + len(per_text), end_id, np.uint32)
        own = np.ones(len(out), bool)
        bounds += np.arange(len(bounds))
        own[bounds[1:] - 1] = False
        out[own] = ids
        return out, bounds

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Their numbers in the memory; unknown ones are encoded first."""
        number = self._memory.number
        out = np.fromiter(map(number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            found, tokenize, first = [pieces[i] for i in new], self._model.tokenize, len(number)
            # a space and ASCII letters: one piece of the pattern, in letters that the byte-level alphabet keeps
            ids = [[t.id for t in tokenize("Ġ" + p[1:].decode())] if p[0] == 32 and p[1:].isalpha() else self._piece(p) for p in found]
            self._memory.add(found, ids)
            out[new] = np.arange(first, first + len(new))
        return out

    @staticmethod
    def _cuts(text: str):
        at = 0
        while len(text) - at > LONGEST:
            m = _SAFE_CUT.search(text, at + LONGEST)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts lie in the bytes of all; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    if where is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


_worker: dict[str | None, ByteTokens] = {}


def worker_tokens(path: str | None = None) -> ByteTokens:
    """One encoder per Python worker and file."""
    if path not in _worker:
        _worker[path] = ByteTokens(path)
    return _worker[path]
