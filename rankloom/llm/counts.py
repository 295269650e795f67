"""Token counts of a unigram vocabulary by a Viterbi recursion that carries only score and piece count.

An Aho-Corasick automaton lists the pieces that end at each character, longest first; that is also the order in which the
tokenizer meets them (by start), and as there a later one only wins with a strictly better score. A character
that no piece of one character covers counts as unknown, with the least score of all pieces less ten, and falls back to its bytes.

Texts are counted line by line, as the tokenizer is meant to be used; a line break counts as one piece, its byte. If no piece goes on
from one part of a line (spaces and what follows them) into the next, the parts' best paths are independent, and parts met before are
looked up. Sums are exact here. The tokenizer adds them up in single precision, which is exact too until the scores of a line sum up
to 2 ** 24 (about a thousand pieces without a line break); beyond that its own rounding may make other choices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import held, pick, share, whole_text

#: Parts that a worker remembers before it starts anew; longer ones than LONG characters are never kept.
REMEMBERED = 500_000
LONG = 64
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
UNSCORED = -1.0e8


@dataclass
class Unigram:
    """Pieces with scores; the space is SPACE, as the tokenizer writes it."""

    pieces: dict[str, float]

    def __post_init__(self):
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = None
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.part = regex.compile(f"{SPACE}+[^{SPACE}]*" if apart else "(?s).+")
        self.memory: dict[str, int] = {}

    def __getstate__(self):
        return {**self.__dict__, "automaton": None, "memory": {}}

    def walk(self, text: str) -> int:
        """Pieces of the best path; of several best ones the tokenizer's."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for piece, score in self.pieces.items():
                self.automaton.add_word(piece, (len(piece), score))
            self.automaton.make_automaton()
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        done = 0  # places up to here are final

        def offer(begin: int, end: int, score: float, pieces: int) -> None:
            new = best[begin] + score
            if best[end] is None or new > best[end]:
                best[end], count[end] = new, count[begin] + pieces

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if text[done - 1] not in self.pieces:
                    # Met after all longer pieces that end here.
                    offer(done - 1, done, self.unknown, len(text[done - 1].encode("utf-8", "surrogatepass")))

        for last, (size, score) in self.automaton.iter(text):
            close(last)
            offer(last + 1 - size, last + 1, score, 1)
        close(n)
        return count[n]

    def line(self, text: str) -> int:
        """Pieces of a line with the space that the tokenizer puts in front; none for an empty line."""
        if not text:
            return 0
        total, memory = 0, self.memory
        for part in self.part.findall(SPACE + text.replace(" ", SPACE)):
            n = memory.get(part)
            if n is None:
                n = self.walk(part)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                if len(part) <= LONG:
                    memory[part] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Pieces of a whole text: those of its lines and one for each line break."""
        lines = text.split("\n")
        return sum(map(self.line, lines)) + len(lines) - 1


def read_unigram(path: str) -> Unigram:
    """The text pieces of a vocabulary file that has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) < 256:
        raise ValueError("unknown characters are counted by their bytes, so the vocabulary needs a piece for each byte")
    text = (i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return Unigram(raised({model.id_to_piece(i): model.get_score(i) for i in text}))


def raised(scores: dict[str, float]) -> dict[str, float]:
    """Scores with UNSCORED ones put just below the least of the others.

    The vocabulary marks pieces without a rank so; left as they are, they would drown all other scores in
    single precision.
    """
    least = min((v for v in scores.values() if v > UNSCORED), default=0.0)
    return {k: v if v > UNSCORED else least - 1 for k, v in scores.items()}


def counter(docs: DataFrame, vocabulary: Unigram) -> Column:
    """Long column: pieces of the ``text`` column of ``docs``."""
    shared = share(docs.sparkSession, vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([held(shared).count(t) for t in batch], dtype="int64")

    return count(whole_text())


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_chars for every row of ``docs`` (doc_id, text); both count the whole text.

    A null or empty text has no tokens. Null ids stay null; repeated rows give repeated results, an empty table none. ``path`` names the
    vocabulary file, which only the driver reads.
    """
    plain = pick(docs, "doc_id", "text")
    return plain.select("doc_id", counter(plain, read_unigram(path)).alias("n_tokens"), F.length(whole_text()).cast("long").alias("n_chars"))
