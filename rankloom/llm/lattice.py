"""Language-model scores from a subword lattice, next to a smoothed word-unigram base.

A text is its words in lower case (A-Z only), each with a space before it, and one end. Every piece of an existing unigram
vocabulary that matches is an edge of the lattice over a word's bytes, and byte pieces make sure that there always is a path; no piece
crosses a space, so the lattice of a text is the chain of its words' lattices. The probability of a text is the sum over all
segmentations of the product of piece probabilities, computed by a forward recursion in log space.

The vocabulary's scores order its pieces and give a first distribution (by rank); expected piece counts over all segmentations of all
training words under it, smoothed with it, give the probabilities that score texts. Pieces are never added or changed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import chunks, held, pick, share, whole_text
from rankloom.session import durable

#: Most frequent words that every task knows; counts of all others come by a join. This bounds what is sent.
HEAD = 100_000
#: Weight of the first distribution in pieces when expected counts are smoothed.
PRIOR = 5_000.0
#: Words up to this many bytes are computed side by side, CHUNK at a time; longer ones one by one.
SIDE_BY_SIDE = 40
CHUNK = 10_000
#: Characters of texts whose words are held at once, words whose probability a task remembers, and words counted
#: before partial counts leave it. These bound the memory of a task.
LOOKED_AT = 3_000_000
REMEMBERED = 200_000
PARTIAL = 300_000
ADD = 0.1

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_pieces(path: str) -> list[tuple[bytes, float]]:
    """(bytes, score) of the pieces that stand for text; a byte piece has score -inf."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append((bytes([int(piece[1:-1], 16)]), -math.inf))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append((piece.replace("▁", " ").encode(), model.get_score(i)))
    return out


@dataclass
class Pieces:
    """Piece strings with log probabilities, and a hash table over them."""

    strings: list[bytes]
    log_p: np.ndarray
    end_log_p: float = math.log(0.5)

    def __post_init__(self):
        self.longest = max(map(len, self.strings))
        self.powers = np.array([pow(_BASE, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        bits = max(12, 5 + len(self.strings).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.slots, self.probes = np.zeros((1 << bits) + 64, np.uint64), np.full((1 << bits) + 64, -1), 1
        for i, s in enumerate(self.strings):
            h = 0
            for c in s:
                h = (h * _BASE + c + 1) & _MASK
            at = self._slot(np.array([h], np.uint64))[0]
            first = at
            while self.slots[at] >= 0:
                at += 1
            self.keys[at], self.slots[at] = h, i
            self.probes = max(self.probes, at - first + 1)
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def _slot(self, h: np.ndarray) -> np.ndarray:
        # A last mixing step: low bits of a polynomial hash depend on the last bytes only.
        return (((h ^ (h >> np.uint64(32))) * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 if there is none."""
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        for probe in range(1, self.probes):
            out = np.where((out < 0) & (self.keys[at + probe] == h), self.slots[at + probe], out)
        return out

    def log_probs(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each word with its space; with ``counts`` also expected piece counts."""
        out, expected = np.zeros(len(words)), np.zeros(len(self.strings))
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        n_long = int((length > SIDE_BY_SIDE).sum())
        for at in order[:n_long]:
            out[at] = self._one(words[at], expected, counts[at] if counts is not None else 0)
        for i in range(n_long, len(words), CHUNK):
            at = order[i : i + CHUNK]
            out[at] = self._many([words[k] for k in at], length[at] + 1, expected, counts[at] if counts is not None else None)
        return out, expected

    def _many(self, words: list[bytes], length: np.ndarray, expected: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        """Words come longest first, so that those with a place j are a leading part."""
        n, most = len(words), int(length[0])
        codes = np.zeros((most, n), np.uint64)
        text = np.frombuffer(b" " + b" ".join(words), np.uint8)
        owner = np.repeat(np.arange(n), length)
        place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
        codes[place, owner] = text
        hashes = np.zeros((most + 1, n), np.uint64)
        for j in range(most):
            hashes[j + 1] = hashes[j] * np.uint64(_BASE) + codes[j] + np.uint64(1)
        alpha = np.full((most + 1, n), -np.inf)
        alpha[0] = 0
        edges = []
        reach = np.searchsorted(-length, -np.arange(most + 1), "right")
        for j in range(1, most + 1):
            active = reach[j]
            for size in range(1, min(j, self.longest) + 1):
                piece = self.find(hashes[j, :active] - hashes[j - size, :active] * self.powers[size])
                own = np.flatnonzero(piece >= 0)
                if len(own):
                    piece = piece[own]
                    alpha[j, own] = np.logaddexp(alpha[j, own], alpha[j - size, own] + self.log_p[piece])
                    if counts is not None:
                        edges.append((j, size, own, piece))
        total = alpha[length, np.arange(n)]
        if counts is not None:
            beta = np.full((most + 1, n), -np.inf)
            beta[length, np.arange(n)] = 0
            for j, size, own, piece in reversed(edges):
                after = beta[j, own] + self.log_p[piece]
                beta[j - size, own] = np.logaddexp(beta[j - size, own], after)
                share = np.exp(alpha[j - size, own] + after - total[own]) * counts[own]
                expected += np.bincount(piece, share, len(expected))
        return total

    def _one(self, word: bytes, expected: np.ndarray, count: float) -> float:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i, s in enumerate(self.strings):
                self.automaton.add_word(s.decode("latin-1"), i)
            self.automaton.make_automaton()
        text = (b" " + word).decode("latin-1")
        alpha = [-math.inf] * (len(text) + 1)
        alpha[0] = 0.0
        for end, i in self.automaton.iter(text):
            alpha[end + 1] = log_add(alpha[end + 1], alpha[end + 1 - len(self.strings[i])] + float(self.log_p[i]))
        if count:
            beta = [-math.inf] * (len(text) + 1)
            beta[-1] = 0.0
            for end, i in reversed(list(self.automaton.iter(text))):
                start = end + 1 - len(self.strings[i])
                after = beta[end + 1] + float(self.log_p[i])
                beta[start] = log_add(beta[start], after)
                expected[i] += count * math.exp(alpha[start] + after - alpha[-1])
        return alpha[-1]


def log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def first_distribution(pieces: list[tuple[bytes, float]]) -> Pieces:
    """Probabilities that fall with the rank of a piece's score (1 / (rank + 10)); equal strings are added up.

    Byte pieces rank last. Pieces with a space after another byte, or of spaces only but for the single one, cannot occur
    in a word and are left out. The end takes the place of one middling piece until it is learned.
    """
    usable = [(s, score) for s, score in pieces if s and b" " not in s[1:]]
    scores = sorted({score for _, score in usable}, reverse=True)
    rank = {score: i for i, score in enumerate(scores)}
    mass: Counter = Counter()
    for s, score in usable:
        mass[s] += 1 / (rank[score] + 10)
    for c in range(256):
        mass.setdefault(bytes([c]), 1 / (len(scores) + 10))
    strings = sorted(mass)
    p = np.array([mass[s] for s in strings])
    return Pieces(strings, np.log(p / p.sum()))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), c over the column ``text``; the end is the word of one space and counts the rows."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text))
                seen[b" "] += 1
                if len(seen) >= PARTIAL:
                    yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})

    partial = docs.select(whole_text().alias("text")).mapInPandas(count, "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    counts: DataFrame
    n: int
    v: int
    ends: int
    pieces: Pieces
    head: dict[bytes, int]


def train(docs: DataFrame, path: str, head: int = HEAD) -> Model:
    """Word counts and piece probabilities from all rows of ``docs`` (text); a null text is empty."""
    spark = docs.sparkSession
    counts = durable(count_words(pick(docs, "text")), "word_counts")
    end = F.col("word") == F.lit(b" ")
    n, v, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(end, F.col("c")))).first()
    first = first_distribution(read_pieces(path))
    start = share(spark, first)

    def expect(batches):
        pieces = held(start)
        total = np.zeros(len(pieces.strings))
        for batch in batches:
            total += pieces.log_probs(batch["word"].tolist(), batch["c"].to_numpy(np.float64))[1]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"piece": at, "e": total[at]})

    # At most one row for each piece of the vocabulary.
    found = counts.where(~end).mapInPandas(expect, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
    expected = np.zeros(len(first.strings))
    expected[found["piece"]] = found["e"]
    mass = expected + PRIOR * np.exp(first.log_p)
    total = mass.sum() + (ends or 0) + 1
    pieces = Pieces(first.strings, np.log(mass / total), math.log(((ends or 0) + 1) / total))
    # Eight bins to each doubling of the count; the head is all bins that fit together into ``head`` words.
    bins = dict(counts.where(~end).groupBy(F.floor(F.log2("c") * 8).alias("b")).count().collect())
    least, room = None, head
    for b in sorted(bins, reverse=True):
        room -= bins[b]
        if room < 0:
            break
        least = b
    words = counts.where(~end & (F.floor(F.log2("c") * 8) >= least)).collect() if least is not None else []
    return Model(counts, n or 0, v or 0, ends or 0, pieces, {bytes(w): c for w, c in words})


def scored(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, doc_id) and n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    shared = share(spark, (model.pieces, {w: math.log10(c + ADD) for w, c in model.head.items()}))
    kind = "n_words long, known long, base double, lattice double, rare array<struct<word:binary,tf:int>>"

    @F.pandas_udf(kind)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, head = held(shared)
        memory: dict[bytes, float] = {}
        for batch in batches:
            rows = []
            for _, part in chunks(batch.tolist(), LOOKED_AT):
                texts = [words_of(t) for t in part]
                if len(memory) >= REMEMBERED:
                    memory.clear()
                fresh = list({w for words in texts for w in words if w not in memory})
                memory.update(zip(fresh, pieces.log_probs(fresh)[0].tolist()))
                for words in texts:
                    common = [head[w] for w in words if w in head]
                    rare = Counter([w for w in words if w not in head])
                    lattice = math.fsum(map(memory.__getitem__, words)) if words else 0.0
                    rows.append((len(words), len(common), math.fsum(common), lattice, list(rare.items())))
            yield pd.DataFrame(rows, columns=["n_words", "known", "base", "lattice", "rare"])

    # Numbers are given once, when the table is written.
    looked = docs.withColumn("look", look(whole_text())).select(*keep, "look.*")
    rows = durable(looked.withColumn("row", F.monotonically_increasing_id()), "looked_up")
    rare = rows.select("row", F.inline("rare"))
    hit = rare.join(model.counts, "word").groupBy("row").agg(
        F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + ADD)).alias("rest")
    )
    bottom = math.log10(model.n + ADD * (model.v + 1))
    known = F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(model.ends > 0))
    n_tokens = F.col("n_words") + 1
    top = F.col("base") + F.coalesce("rest", F.lit(0.0)) + F.lit(math.log10(model.ends + ADD)) + (n_tokens - known - int(model.ends == 0)) * math.log10(ADD)
    score = (F.col("lattice") + F.lit(model.pieces.end_log_p)) / math.log(10)
    names = [c for c in rows.columns if c not in ("n_words", "known", "base", "lattice", "rare", "row")]
    return rows.drop("rare").join(hit, "row", "left").select(
        *names, n_tokens.alias("n_tokens"), known.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (top - n_tokens * bottom).alias("base_score"), score.alias("score"),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Scores are log10 probabilities of the whole text. A null text is empty: its only token is the end. Without training rows every base term is
    log10(0.1 / 0.1) = 0 and pieces keep their first distribution. Null ids stay null; repeated rows give repeated results, an empty table none.
    """
    return scored(pick(docs, "doc_id", "text"), model, [F.col("doc_id")])
