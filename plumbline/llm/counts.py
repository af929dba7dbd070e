"""Token counts: best unigram segmentation without building the pieces.

An Aho-Corasick automaton of the vocabulary lists every piece that occurs in a word
and where it ends; a dynamic programme over end positions carries only the best
score and the number of pieces of the path that has it. Words are maximal runs of
characters other than [\\x20\\x09-\\x0D], each with the mark U+2581 before it.

Tie rules of the published unigram tokenizers: positions are visited from left to
right and a path replaces another only if its score is higher, so of equal scores
the one with the longest last piece stays. A character that no one-character piece
covers is an unknown piece with the lowest score of the vocabulary less 10;
neighbouring unknown pieces count as one.

Words are counted per task with a bounded memo of segmented words. Null and empty
texts have 0 pieces and score 0. Repeated rows and ties as said; long words cost in
proportion to their length. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import keep_modest

MARK = "▁"
UNKNOWN_PENALTY = 10.0
NOTHING = float("-inf")
MEMO_WORDS = 200_000
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), float(model.get_score(i)))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    """Counts pieces of words; `count` gives (pieces, unknown pieces, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        # words of late and before: the older half goes when the newer one is full
        self.memo: dict[str, tuple[int, int, float]] = {}
        self.older: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) >= MEMO_WORDS:
                self.older, self.memo = self.memo, {}
            known = self.older.get(word) or self._segment(MARK + word)
            self.memo[word] = known
        return known

    def _segment(self, text: str) -> tuple[int, int, float]:
        return self._covered(text) or self._with_gaps(text)

    def _covered(self, text: str) -> tuple[int, int, float] | None:
        """Counts of a text each character of which is a piece; None for other texts.

        Matches with the same end come longest first, so the one-character piece closes a position.
        """
        size, at = len(text), 0
        score, pieces = [0.0] * (size + 1), [0] * (size + 1)
        best, number = NOTHING, 0
        for last, (length, own) in self.automaton.iter(text) if self.automaton.kind else ():
            begin = last + 1 - length
            total = score[begin] + own
            if total > best:
                best, number = total, pieces[begin] + 1
            if length == 1:
                if last != at:
                    return None
                at += 1
                score[at], pieces[at], best = best, number, NOTHING
        return (pieces[at], 0, score[at]) if at == size else None

    def _with_gaps(self, text: str) -> tuple[int, int, float]:
        size, lowest = len(text), self.unknown
        score, pieces, unknown, strange = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1), bytearray(size + 1)

        def close(end: int, best: float, reach: int, single: bool) -> None:
            """Settle a position: its best last piece has `reach` characters, 0 if no piece ends there."""
            if not single:
                total = score[end - 1] + lowest
                if not reach or total > best:
                    new = not strange[end - 1]
                    score[end], strange[end] = total, 1
                    pieces[end], unknown[end] = pieces[end - 1] + new, unknown[end - 1] + new
                    return
            score[end], pieces[end], unknown[end] = best, pieces[end - reach] + 1, unknown[end - reach]

        at, best, reach, single = 0, 0.0, 0, False
        # matches come by their last character; all places before it are settled
        for last, (length, own) in self.automaton.iter(text) if self.automaton.kind else ():
            if last + 1 != at:
                if at:
                    close(at, best, reach, single)
                for gap in range(at + 1, last + 1):
                    close(gap, 0.0, 0, False)
                at, reach, single = last + 1, 0, False
            total = score[at - length] + own
            if not reach or total > best or (total == best and length > reach):
                best, reach = total, length
            single = single or length == 1
        if at:
            close(at, best, reach, single)
        for gap in range(at + 1, size + 1):
            close(gap, 0.0, 0, False)
        return pieces[size], unknown[size], score[size]

    def count(self, text: str | None) -> tuple[int, int, float]:
        pieces = unknown = 0
        score = 0.0
        memo = self.memo
        for word in WORD.findall(text or ""):
            found = memo.get(word)
            if found is None:
                found = self.word(word)
                memo = self.memo
            pieces += found[0]
            unknown += found[1]
            score += found[2]
        return pieces, unknown, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(pieces_of(path))


def count_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens, n_unknown, score."""
    path = vocabulary or default_vocabulary()

    def count(batches):
        one = counter(path)
        for batch in batches:
            found = [one.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                names=["id", "n_tokens", "n_unknown", "score"],
            )

    keep_modest(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(count, "id bigint, n_tokens bigint, n_unknown bigint, score double")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
