"""Periodic runs of words by online dyadic square catching.

Level e cuts the words into blocks of w = 2^e, numbered from the front. Once a block is complete it becomes a catcher: the hash of
its words is compared with the hash of the last w words after each appended word, as long as that suffix starts w to 2w - 1 places
behind the block's start. Each word thus advances one comparison at each level. If two neighbouring catchers are met at the same
distance d, the 2w > d words from the first one's start repeat d places later: a square of period d is caught. Squares of one
period in a row are one run; its ends are found by comparing words.

A run of period q and at least 4q words holds two neighbouring blocks of 2^e <= q < 2^(e+1) words together with what lies q places behind
them, so every such run is caught at that level, whatever its place. Multiples of q are caught at higher levels inside the same run and
left out. Hashes only propose; words decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import chunks, pick, whole_text

#: Least length of a run, in periods (which the catchers rest on) and in words.
EXPONENT = 4
LEAST = 6
#: Characters of short texts whose words are searched as one sequence; words appended at once.
TOGETHER = 1 << 19
STEP = 1 << 17
FOUND = "start array<long>, length array<long>, period array<long>, n_words long, collapsed string"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, so that sums of hashes do not cancel out."""
    x = (x ^ (x >> _HALF)) * _A
    return (x ^ (x >> _HALF)) * _B


class Level:
    """Catchers of one block size: what is still needed of the hashes of the words seen so far."""

    def __init__(self, width: int):
        self.width, self.row = width, 0
        #: Hashes of the row that is being filled, and those that wait for a partner at the next level.
        self.tail = self.held = np.zeros(0, np.uint64)
        self.catcher: np.uint64 | None = None
        self.met = np.zeros(width, bool)

    def append(self, new: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Take the next hashes; returns those of twice the width and the caught stretches (period, first, stop).

        Words first to stop - 1 equal those ``period`` places later, if hashes do not lie.
        """
        w = self.width
        pairs = np.concatenate([self.held, new])
        self.held = pairs[-w:]
        double = mixed(pairs[:-w] * _B + pairs[w:]) if len(pairs) > w else np.zeros(0, np.uint64)
        self.tail = np.concatenate([self.tail, new])
        whole, rest = divmod(len(self.tail), w)
        rows = whole + (rest > 0)
        met = np.zeros((rows + 1, w), bool)
        met[0] = self.met
        flat, table = met[1:].reshape(-1), self.tail[: whole * w].reshape(whole, w)
        firsts = np.append(table[:, 0], self.tail[whole * w : whole * w + 1])
        if whole > 1:
            met[2 : whole + 1] = table[1:] == firsts[: whole - 1, None]
        if self.catcher is not None:
            met[1, : min(w, len(self.tail))] = self.tail[:w] == self.catcher
        if rest and whole:
            flat[whole * w : whole * w + rest] = self.tail[whole * w :] == firsts[whole - 1]
        found = self.stretches(met)
        if whole:
            self.met, self.catcher = met[whole].copy(), firsts[whole - 1]
            self.tail = self.tail[whole * w :]
            self.row += whole
        return double, found

    def stretches(self, met: np.ndarray) -> list[np.ndarray]:
        """Columns met in at least two rows running; row i of ``met`` is row ``self.row`` - 1 + i of the level."""
        w = self.width
        columns = np.flatnonzero((met[1:] & met[:-1]).any(0))
        if not len(columns):
            return []
        column, row = np.nonzero(met[:, columns].T)
        opens = np.append(True, (column[1:] != column[:-1]) | (row[1:] != row[:-1] + 1))
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(row)) - 1
        long = last > first
        first, last = first[long], last[long]
        above = self.row - 1
        return [np.column_stack([w + columns[column[first]], (above + row[first] - 1) * w, (above + row[last]) * w])]


class Catchers:
    """Catches squares while words are appended; ``longest`` bounds the runs of interest (None: no bound)."""

    def __init__(self, longest: int | None = None):
        self.longest, self.levels, self.caught = longest, [], []

    def append(self, codes: np.ndarray) -> int:
        """Append words, given as numbers; returns how many stretches of squares were caught or grew."""
        new, width, caught = mixed(codes.astype(np.uint64) + _A), 1, 0
        at = 0
        while len(new) and (self.longest is None or EXPONENT * width <= self.longest):
            if at == len(self.levels):
                self.levels.append(Level(width))
            new, found = self.levels[at].append(new)
            self.caught += found
            caught += sum(map(len, found))
            at, width = at + 1, width * 2
        return caught

    def squares(self) -> np.ndarray:
        """Stretches (period, first, stop) in order of period, those that touch joined."""
        if not self.caught:
            return np.zeros((0, 3), np.int64)
        rows = np.concatenate(self.caught)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        # Within a period stops only count once a later start lies beyond all of them.
        lift = rows[:, 0] * (rows[:, 2].max() + 1)
        reach = np.maximum.accumulate(rows[:, 2] + lift)
        opens = np.append(True, rows[1:, 1] + lift[1:] > reach[:-1])
        return np.column_stack([rows[opens, 0], rows[opens, 1], (reach - lift)[np.append(opens[1:], True)]])


def same_before(codes: np.ndarray, i: int, d: int, step: int) -> int:
    """First place from which words up to ``i`` equal those ``d`` later."""
    while i > 0:
        low = max(0, i - step)
        other = np.flatnonzero(codes[low:i] != codes[low + d : i + d])
        if len(other):
            return low + int(other[-1]) + 1
        i = low
    return i


def same_after(codes: np.ndarray, i: int, d: int, step: int) -> int:
    """First place from ``i`` where a word differs from the one ``d`` later."""
    end = len(codes) - d
    while i < end:
        high = min(end, i + step)
        other = np.flatnonzero(codes[i:high] != codes[i + d : high + d])
        if len(other):
            return i + int(other[0])
        i = high
    return i


def runs_of(codes: np.ndarray, squares: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs (start, length, period) by start, then period, of at least EXPONENT periods and ``least`` words."""
    starts, ends, found = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    level = np.frexp(squares[:, 0].astype(float))[1]
    for e in np.unique(level):
        rows = squares[level == e]
        # A stretch inside a run of smaller period is a multiple of that period.
        reach = np.append(0, np.maximum.accumulate(ends))
        rows = rows[reach[np.searchsorted(starts, rows[:, 1], "right")] < rows[:, 2] + rows[:, 0]]
        fresh = []
        for d, first, stop in rows.tolist():
            differ = np.flatnonzero(codes[first:stop] != codes[first + d : stop + d])
            edges = [first - 1, *(first + differ).tolist(), stop]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    low = same_before(codes, a + 1, d, d) if a < first else a + 1
                    high = same_after(codes, b, d, d) if b == stop else b
                    if high - low > d:
                        fresh.append((low, high + d, d))
        if fresh:
            both = np.array(fresh, np.int64)
            # So is a run that words showed to be shorter than hashes said.
            both = both[reach[np.searchsorted(starts, both[:, 0], "right")] < both[:, 1]]
            found += map(tuple, both.tolist())
            starts, ends = np.append(starts, both[:, 0]), np.append(ends, both[:, 1])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
    out = sorted((a, b - a, d) for a, b, d in found if b - a >= max(least, EXPONENT * d))
    return np.array(out, np.int64).reshape(-1, 3)


def catch(codes: np.ndarray, longest: int | None = None, step: int = STEP) -> np.ndarray:
    """All runs of a sequence, appended ``step`` words at a time."""
    catchers = Catchers(longest)
    for i in range(0, len(codes), step):
        catchers.append(codes[i : i + step])
    return runs_of(codes, catchers.squares())


class Codes(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words. They are searched in a row with a word of its own after each list, which no run can cross."""
    codes, sizes = Codes(), [len(words) for words in texts]
    row = np.zeros(sum(sizes) + len(sizes), np.int64)
    place = np.cumsum([0, *(n + 1 for n in sizes)])
    for k, words in enumerate(texts):
        row[place[k] : place[k] + sizes[k]] = np.fromiter(map(codes.__getitem__, words), np.int64, sizes[k])
        row[place[k] + sizes[k]] = -1 - k
    runs = catch(row, max(sizes, default=0))
    bounds = np.searchsorted(runs[:, 0], place)
    return [runs[i:j] - (p, 0, 0) for i, j, p in zip(bounds, bounds[1:], place)]


def without_repeats(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, one space between, but for those that lie behind the first period of a run."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


Order = Callable[[int, int], "np.ndarray | None"]


def run_column(seed: Column, order: Order | None = None) -> Column:
    """Struct column FOUND of the column ``text``; ``order`` is given the number of words and the seed of the row."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, seeds in batches:
            rows = []
            for first, part in chunks(texts.tolist(), TOGETHER):
                split = [t.encode("utf-8", "surrogatepass").split() for t in part]
                if order is not None:
                    for k, words in enumerate(split):
                        new = order(len(words), int(seeds.iat[first + k]))
                        if new is not None:
                            split[k] = [words[i] for i in new]
                for words, runs in zip(split, runs_of_texts(split)):
                    text = without_repeats(words, runs).decode("utf-8", "surrogatepass")
                    rows.append((runs[:, 0], runs[:, 1], runs[:, 2], len(words), text))
            yield pd.DataFrame(rows, columns=["start", "length", "period", "n_words", "collapsed"])

    return run(whole_text(), seed)


def periodic_runs(docs: DataFrame, seed: Column | None = None, order: Order | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text for every row of ``docs`` (doc_id, text).

    Words are what white space of ASCII parts, numbered from 0. A run is a longest stretch with smallest period q of at least 4q and
    6 words. ``collapsed`` drops words that lie behind the first q words of any run and joins the others by one space.
    ``order`` (n, seed) may give the word numbers to read instead of 0 … n - 1. Null and empty texts have no words and no runs; null ids stay null; repeated rows
    give repeated results; an empty table none. Texts of any length take n log n steps and memory in proportion to n.
    """
    plain = pick(docs, "doc_id", "text")
    found = plain.select("doc_id", run_column(F.lit(0) if seed is None else seed, order).alias("found"))
    return found.select("doc_id", "found.n_words", F.arrays_zip("found.start", "found.length", "found.period").alias("runs"), "found.collapsed")
