"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be changed by e = floor(m * rate) edits. Cut into e + 1 pieces, at least one
piece survives unchanged, so an Aho-Corasick automaton over all pieces finds every place where an occurrence
can be. Myers' bit-parallel distance then decides on the text around each hit. Items and texts are compared in lower
case with runs of white space as one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import held, pick, share, whole_text

#: Edits allowed as a share of the item's characters.
RATE = 0.05
#: Characters of benchmark items that are searched for in one pass over the documents. This bounds what is sent
#: to each task; a larger benchmark takes several passes.
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of normal(text) its place in ``text``, and one more entry for the end."""
    at: list[int] = []
    gap = True
    last = 0
    for i, c in enumerate(text):
        if c.isspace():
            gap = True
            continue
        if gap and at:
            at.append(last)
        gap = False
        at.extend([i] * len(c.lower()))
        last = i + 1
    return [*at, last]


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their offsets."""
    n, m = errors + 1, len(item)
    cuts = [i * m // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str) -> Iterator[int]:
    """Least edit distance of the pattern to any part of ``text`` that ends at each place."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        equal = masks.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        right, left = down | (~(diagonal | up) & full), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1
        column = equal | down
        up, down = (left | ~(column | right)) & full, right & column & full
        yield score


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def best_in(item: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``text`` nearest to ``item``: the first end, then the longest part."""
    m = len(item)
    best, end = m, 0
    for j, d in enumerate(myers(masks_of(item), m, text)):
        if d < best:
            best, end = d, j + 1
    start = end
    head = text[max(0, end - m - best) : end]
    for j, d in enumerate(myers(masks_of(item[::-1]), m, head[::-1])):
        if d == best:
            start = end - j - 1
    return best, start, end


class Items:
    """Benchmark items with the automaton over their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        by_text: dict[str, list] = defaultdict(list)
        for item_id, text in items:
            if text := normal(text):
                by_text[text].append(item_id)
        self.texts = sorted(by_text)
        self.ids = [sorted(by_text[t], key=lambda i: (i is not None, i)) for t in self.texts]
        self.errors = [int(len(t) * rate) for t in self.texts]
        self.pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.texts):
            for offset, piece in pieces(t, self.errors[k]):
                self.pieces[piece].append((k, offset))
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def find(self, text: str) -> list[tuple]:
        """(item_id, distance, start, end) of the best occurrence of each item within its errors."""
        if not self.texts:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for piece, where in self.pieces.items():
                self.automaton.add_word(piece, (len(piece), where))
            self.automaton.make_automaton()
        plain = normal(text)
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (length, where) in self.automaton.iter(plain):
            for k, offset in where:
                starts[k].append(last + 1 - length - offset)
        out, back = [], None
        for k, found in sorted(starts.items()):
            item, e = self.texts[k], self.errors[k]
            best = None
            for a, b in windows(sorted(set(found)), len(item), e, len(plain)):
                d, s, t = best_in(item, plain[a:b])
                if d <= e and (best is None or d < best[0]):
                    best = (d, a + s, a + t)
            if best:
                back = back or places(text)
                span = (back[best[1]], back[best[2] - 1] + 1) if best[2] > best[1] else (back[best[1]],) * 2
                out.extend((i, best[0], *span) for i in self.ids[k])
        return out


def windows(starts: list[int], m: int, e: int, size: int) -> list[tuple[int, int]]:
    """Text ranges that hold every occurrence suggested by the starts; overlapping ones are one."""
    out: list[tuple[int, int]] = []
    for s in starts:
        a, b = max(0, s - e), min(size, s + m + e)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters."""
    items = pick(benchmark, "item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield Items([tuple(r) for r in items.where(block == i).collect()], rate)


def matcher(docs: DataFrame, items: Items) -> Column:
    """Array of matches for the ``text`` column of ``docs``."""
    shared = share(docs.sparkSession, items)

    @F.pandas_udf("array<struct<item_id:long,distance:int,start:long,end:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([held(shared).find(t) for t in batch], dtype=object)

    return run(whole_text())


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: one row for each document and item that occurs in it.

    An item occurs if some part of the text is within floor(rate * length) edits; the part with the least distance
    is returned (first end, then longest), as code points of the original text. Null and empty texts and items
    match nothing; null ids stay null. Repeated documents or items give repeated rows. Empty tables give no rows.
    """
    plain = pick(docs, "doc_id", "text")
    out = None
    for items in item_blocks(benchmark, rate, block_chars):
        found = plain.select("doc_id", matcher(plain, items).alias("found")).select("doc_id", F.inline("found"))
        out = found if out is None else out.unionByName(found)
    return out
