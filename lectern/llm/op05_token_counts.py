"""Token counts without tokens: Viterbi over a unigram vocabulary that carries best score and piece count.

A text is cut into words at white space; each word, led by the mark of a word's beginning, is segmented by itself. An
Aho-Corasick automaton lists the vocabulary's matches by their end; for each end the best score and the count of its
path are kept, nothing else. Ties follow the unigram tokenizer of the tokenizers library: among equal scores the longest
last piece wins; a character that is no piece itself is unknown at the worst score less ten; neighbouring unknowns
are one piece.

A worker remembers the counts of words it has seen (bounded in bytes). Rows are independent; nothing is shuffled.

Nulls: a null text has no words and no pieces. Rows of equal or null doc_id are each counted. An empty table
gives no rows. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches
from .encoding import CACHE_BYTES, Remembered

BEGIN = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file as a unigram vocabulary: a piece's score follows from its rank by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return [("<unk>", 0.0)] + [(model.id_to_piece(k), -log(rank + 10.0)) for rank, k in enumerate(ids)]


class PieceCounter:
    """pieces: (piece, score), the first one standing for unknown."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces[1:]:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p, _ in pieces[1:] if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        #: Counts of words, bounded in bytes.
        self.seen = Remembered(lambda w: self.count(BEGIN + w), CACHE_BYTES, lambda n: 28)

    def count(self, word: str) -> int:
        """Pieces of one string."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count, open_unknown = [0] * (n + 1), [False] * (n + 1)
        done = 0

        def unknowns(upto: int) -> None:
            # ends up to here have seen all their pieces; the unknown character comes last
            nonlocal done
            while done < upto:
                done += 1
                if word[done - 1] not in self.single:
                    score = best[done - 1] + self.unknown
                    if best[done] is None or score > best[done]:
                        best[done], count[done], open_unknown[done] = score, count[done - 1] + (not open_unknown[done - 1]), True

        for end, (size, score) in self.machine.iter(word):
            unknowns(end)
            end += 1
            start = end - size
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end], open_unknown[end] = score, count[start] + 1, False
        unknowns(n)
        return count[n]

    def words(self, words: list[str]) -> int:
        return sum(map(self.seen.__getitem__, words))


@cache
def counter(model: str) -> PieceCounter:
    """The counter of this worker process, with what it has seen in earlier tasks."""
    return PieceCounter(vocabulary(model))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words and n_pieces for every row; model: a sentencepiece file."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).words
        for b in batches:
            # white space is ASCII here; other spaces are characters of words
            words = [[w.decode("utf-8", "replace") for w in (t or "").encode("utf-8", "replace").split()] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, words), pa.int64()), pa.array(map(count, words), pa.int64())], names=["doc_id", "n_words", "n_pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_words long, n_pieces long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
