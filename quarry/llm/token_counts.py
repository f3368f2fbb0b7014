"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's pieces in a word; dynamic
programming over the places where they end carries the best score and the
number of pieces, and nothing else. Ties go as in the ``tokenizers`` unigram
model: of equal scores the earlier start stays. Spaces become marks; a text that does
not begin with a mark gets one; text is cut before each mark, one that stood in
the text included.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, textkit

MARK = "▁"
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
_MEMORY = 300_000


def read_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a SentencePiece model and their scores as the file has them.

    The unknown piece is first. Control and byte pieces are left out. Scores of
    a BPE model are negative ranks; the best split is the one with the largest
    sum all the same, and equal sums are common.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return (("<unk>", min(map(sp.get_score, own)) - UNKNOWN_PENALTY), *((sp.id_to_piece(i), sp.get_score(i)) for i in own))


class UnigramCounter:
    def __init__(self, vocabulary: tuple[tuple[str, float], ...], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if i != unknown and piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.memory: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of a word's best split; neighbouring unknown characters are one piece."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(word):
            ends[last + 1].append((size, score))
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, pieces, is_unk = None, 0, False
            single = False
            # Longer pieces start earlier and come first, so a tie leaves them.
            for size, score in sorted(ends[e], reverse=True):
                single |= size == 1
                s = best[e - size] + score
                if top is None or s > top:
                    top, pieces, is_unk = s, count[e - size] + 1, False
            if not single:
                s = best[e - 1] + self.unknown
                if top is None or s > top:
                    top, pieces, is_unk = s, count[e - 1] + (not unk[e - 1]), True
            best[e], count[e], unk[e] = top, pieces, is_unk
        return count[n]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memory) > _MEMORY:
            self.memory.clear()
        memory = self.memory
        marked = [t.replace(" ", MARK) for t in texts]
        parts = [t.removeprefix(MARK).split(MARK) if t else [] for t in marked]
        for w in set(chain.from_iterable(parts)):
            if w not in memory:
                memory[w] = self.word(MARK + w)
        out = [sum(map(memory.__getitem__, p)) for p in parts]
        if any(len(w) > 64 for w in memory):
            self.memory = {w: c for w, c in memory.items() if len(w) <= 64}
        return out


@lru_cache(maxsize=2)
def _counter(vocabulary) -> UnigramCounter:
    return UnigramCounter(vocabulary)


def count_tokens(df: DataFrame, vocabulary: tuple[tuple[str, float], ...], keep: list[str], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``keep`` of each row beside its number of pieces.

    Null and empty texts have none; rows come out one for one, repeated ones
    too, and an empty table gives an empty result. Texts are counted whole; one
    Arrow batch is in memory at a time. A ``keep`` column of the name made raises.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's size

    def run(batch: pa.RecordBatch) -> dict:
        counter = _counter(shared.value)
        out = [c for _, texts in textkit.text_slices(batch, text) for c in counter.count([t.decode() for t in texts])]
        return {name: np.array(out, np.int64)}

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, text])), run, keep, f"`{name}` long")
