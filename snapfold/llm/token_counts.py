"""Number of unigram pieces of a text, without the pieces: Aho-Corasick matches and a dynamic programme.

The automaton enumerates the vocabulary pieces that end at each character. The programme keeps, per position, the
best score and the number of pieces on the best path, nothing else. Tie rule of the unigram tokenizers: candidates for
an end come with the longest piece first and only a strictly better score replaces one; a character that is no piece
itself is an unknown one, 10 below the lowest score, and comes last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from snapfold.llm.rows import text_function

#: What stands for a space, and the penalty of an unknown character.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Chunks a task remembers.
REMEMBERED = 400_000


@dataclass(frozen=True)
class UnigramVocabulary:
    """Pieces with their scores. ``byte_pieces``: unknown characters become one piece per UTF-8 byte."""

    pieces: tuple[tuple[str, float], ...]
    byte_pieces: bool


def vocabulary_of(model: bytes) -> UnigramVocabulary:
    """The normal pieces and scores of a sentencepiece model, read as a unigram vocabulary."""
    read = sentencepiece.SentencePieceProcessor(model_proto=model)
    size, special = read.get_piece_size(), (read.is_control, read.is_unknown, read.is_byte, read.is_unused)
    normal = [i for i in range(size) if not any(is_(i) for is_ in special)]
    return UnigramVocabulary(
        tuple((read.id_to_piece(i), read.get_score(i)) for i in normal), any(read.is_byte(i) for i in range(size))
    )


class PieceCounter(dict):
    """Chunk -> (pieces, score). A chunk is a run of spaces and what follows it up to the next space.

    Where no piece goes on from another character into a space, the best path of a text is made of those of its chunks.
    Sums of whole-number scores are exact, so cutting there changes no tie. A vocabulary without these two properties
    is run over the whole text.
    """

    def __init__(self, vocabulary: UnigramVocabulary):
        self.byte_pieces = vocabulary.byte_pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary.pieces) - UNKNOWN_PENALTY
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in vocabulary.pieces)
        self.chunked = not crossing and all(score == int(score) for _, score in vocabulary.pieces)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*").findall

    def __missing__(self, chunk: str) -> tuple[int, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[chunk] = self.best(chunk)
        return found

    def best(self, chunk: str) -> tuple[int, float]:
        n, unknown = len(chunk), self.unknown
        score, count, lone = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        at, known = 1, False  # the end in hand, and whether its last character is a piece

        def close(end: int, known: bool) -> None:
            if not known:
                value = score[end - 1] + unknown
                if score[end] is None or value > score[end]:
                    score[end], lone[end] = value, True
                    if self.byte_pieces:
                        count[end] = count[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))
                    else:  # unknown characters in a row are one piece
                        count[end] = count[end - 1] + (not lone[end - 1])

        for last, (length, value) in self.automaton.iter(chunk):
            end = last + 1
            while at < end:
                close(at, known)
                at, known = at + 1, False
            known = known or length == 1
            value += score[end - length]
            if score[end] is None or value > score[end]:
                score[end], count[end], lone[end] = value, count[end - length] + 1, False
        while at <= n:
            close(at, known)
            at, known = at + 1, False
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text: one space before it, spaces as ``SPACE``; nothing for an empty text."""
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if not self.chunked:
            return self.best(text)
        found = list(map(self.__getitem__, self.cut(text)))
        return sum(f[0] for f in found), sum(f[1] for f in found)


@lru_cache(maxsize=2)
def _counter(model: bytes) -> PieceCounter:
    return PieceCounter(vocabulary_of(model))


def with_counts(docs: DataFrame, model_file: str, out: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out`` of n_tokens and score. A null or empty text has 0 pieces and score 0."""
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64())])

    def make():
        counter = _counter(model.value)

        def run(texts):
            found = [counter.count(t.decode()) if t else (0, 0.0) for t in texts]
            return pa.array([{"n_tokens": n, "score": s} for n, s in found], kind)

        return run

    return docs.withColumn(out, text_function(make, "n_tokens long, score double")(text))
