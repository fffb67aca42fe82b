"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton names every vocabulary piece that ends at each character; the search carries the best score
and the number of its pieces, nothing else.  Ties are decided as the ``tokenizers`` library decides them: of equally
good paths to a place, the one whose last piece starts first.  A character that is no piece costs ten more than the least
score and counts its UTF-8 bytes if the vocabulary has all byte pieces, else one for each run of such characters.

Texts are cut before each space, as that library's Metaspace does: words are independent and remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

SPACE_SIGN, UNKNOWN_PENALTY, REMEMBERED = "▁", 10.0, 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def zipf_vocabulary(path: str | None = None) -> tuple[tuple[str, float], ...]:
    """(piece, log probability) from a sentencepiece file whose pieces are ranked: p(r) = 1 / (r H), r from 1.

    Byte and unknown pieces get the least score.  Control pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path or default_path())
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    normal.sort(key=lambda i: (-sp.get_score(i), i))
    harmonic = sum(1 / r for r in range(1, len(normal) + 1))
    rank = {i: r for r, i in enumerate(normal, 1)}
    least = -log(len(normal)) - log(harmonic)
    return tuple((sp.id_to_piece(i), -log(rank[i]) - log(harmonic) if i in rank else least) for i in range(sp.get_piece_size()) if not sp.is_control(i))


class UnigramCounter:
    def __init__(self, vocabulary: tuple[tuple[str, float], ...]):
        import ahocorasick

        self.automaton, scores = ahocorasick.Automaton(), {}
        for piece, score in vocabulary:
            scores[piece] = score
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.memory: dict[str, tuple[int, float]] = {}

    def _word(self, word: str) -> tuple[int, float]:
        n, neg = len(word), float("-inf")
        best, count, unknown = [neg] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = iter(self.automaton.iter(word)) if len(self.automaton) else iter(())
        found = next(matches, None)
        for end in range(1, n + 1):
            here = []
            while found is not None and found[0] == end - 1:
                here.append(found[1])
                found = next(matches, None)
            here.sort(reverse=True)  # longest, that is first to start, first
            for length, score in here:
                if (s := best[end - length] + score) > best[end]:
                    best[end], count[end], unknown[end] = s, count[end - length] + 1, False
            char = word[end - 1]
            if char not in self.single and (s := best[end - 1] + self.unknown) > best[end]:
                more = len(char.encode("utf-8", "surrogatepass")) if self.by_bytes else int(not unknown[end - 1])
                best[end], count[end], unknown[end] = s, count[end - 1] + more, True
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces of the text and the sum of the words' best scores."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE_SIGN)
        words = text.split(SPACE_SIGN)
        if text[0] == SPACE_SIGN:
            del words[0]
        n, total, memory = 0, 0.0, self.memory
        for w in words:
            if (found := memory.get(w)) is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                found = memory[w] = self._word(SPACE_SIGN + w)
            n += found[0]
            total += found[1]
        return n, total


_worker: dict[str | None, UnigramCounter] = {}


def _count(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _worker:
            _worker[path] = UnigramCounter(zipf_vocabulary(path))
        counter = _worker[path]
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score for each row: one pass, no shuffle.

    Null and empty texts have 0 tokens and score 0.  Ids may be null or repeat.  Other columns are not read.
    """
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(_count(vocabulary), "doc_id long, n_tokens long, score double")
