"""Byte-level BPE by prefix dynamic programming.

Each prefix of a byte string has exactly one encoding, so it has one last token. That token is the only one that ends
there and may follow the last token of the prefix before it, where two tokens may stand side by side if
merging their bytes gives back these two tokens. ``Prefixes`` keeps the last token of every prefix: the encoding is read off
backwards, appended bytes never touch what is stored, and after an edit only entries up to the place where old and new
agree again are computed anew. Time is linear in the length, also for one very long word.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import held, pick, share, whole_text

#: Encodings of pieces that a worker remembers in each of two generations, and pairs of tokens that it remembers before it starts anew.
REMEMBERED = 300_000
PAIRS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pieces(dict):
    """What is needed of each match of the pattern met lately: its ids as text with a comma behind each, and the bytes they decode to.

    When REMEMBERED matches are held they become the old generation; what is asked for again moves to the new one, so
    common matches are never lost. Long matches are not held.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        found = self.old.get(piece)
        if found is None:
            v = self.vocabulary
            if len(v.pairs) >= PAIRS:
                v.pairs.clear()
            ids = v.piece_ids(piece.encode("utf-8", "surrogatepass"))
            found = "".join([v.digits[i] for i in ids]), v.decode(ids)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Vocabulary:
    """Merge ranks with what the recursion needs: the halves of each token and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)
        self.split = regex.compile(pattern)
        # Bytes are searched as characters of the same number. Only tokens that merging can make end a prefix.
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.made(rank):
                self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.digits = [f"{i}," for i in range(len(self.tokens))]

    def __reduce__(self):
        return Vocabulary, (self.ranks, self.pattern)

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """Plain merging, lowest rank and leftmost pair first, with ranks under ``below``. Only for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token that no merge makes."""
        if token not in self.halves:
            parts = self.merged(self.tokens[token], token)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def made(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves_of(token) is not None

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between the two tokens.

        The merges are undone from the last to the first. As long as the parts on both sides of the border
        stood next to each other, their own merge must not have come before the one that used up either.
        """
        key = left << 32 | right
        ranks, tokens = self.ranks, self.tokens
        limit, answer = len(tokens), True
        while True:
            if ranks.get(tokens[left] + tokens[right], limit) < limit:
                answer = False
                break
            a = self.halves_of(left) if len(tokens[left]) > 1 else None
            b = self.halves_of(right) if len(tokens[right]) > 1 else None
            if a is None and b is None:
                break
            # Of two merges with one rank the left one comes first, so the right one is undone first.
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                # A merge across the border lies to the left of the right part's own and wins a tie.
                limit, right = right + 1, b[0]
        self.pairs[key] = answer
        return answer

    def piece_ids(self, data: bytes) -> list[int]:
        """Bytes that are a token as a whole are that token."""
        rank = self.ranks.get(data)
        return Prefixes(self, data).ids() if rank is None else [rank]

    def encode(self, text: str) -> tuple[str, bytes]:
        """The ids, joined by commas, and the bytes they decode to; each match of the pattern for itself."""
        pieces = self.split.findall(text)
        if not pieces:
            return "", b""
        ids, data = zip(*map(self.pieces.__getitem__, pieces))
        return "".join(ids)[:-1], b"".join(data)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; nothing stored changes."""
        vocabulary, last, old = self.vocabulary, self.last, len(self.data)
        self.data += more
        last.extend([-1] * len(more))
        # No token that ends in the new part begins before this place.
        base = max(0, old - vocabulary.longest)
        fits, known = vocabulary.side_by_side, vocabulary.pairs
        for end, (token, size) in vocabulary.ends.iter(self.data[base:].decode("latin-1")):
            i = base + end + 1
            if i > old and last[i] < 0:
                if size < i:
                    before = last[i - size]
                    good = known.get(before << 32 | token)
                    if not (fits(before, token) if good is None else good):
                        continue
                last[i] = token

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; returns how many entries were computed.

        An entry depends on the token-length window of entries and bytes before it, so once a whole window after
        the edit equals the old one, all later entries do.
        """
        tail, rest = self.last[stop + 1 :], bytes(self.data[stop:])
        del self.data[start:]
        del self.last[start + 1 :]
        self.append(new)
        equal, done = 0, 0
        while done < len(rest) and equal < self.vocabulary.longest:
            self.append(rest[done : done + 1])
            equal = equal + 1 if self.last[-1] == tail[done] else 0
            done += 1
        self.data += rest[done:]
        self.last += tail[done:]
        return len(new) + done

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.tokens[self.last[i]])
        return out[::-1]


def coder(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = False) -> Column:
    """Struct column n_tokens, ids_sha256, decoded_sha256 (and ids) for the ``text`` column of ``docs``."""
    shared = share(docs.sparkSession, vocabulary)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(kind)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = held(shared)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for batch in batches:
            rows = []
            for text in batch:
                ids, data = v.encode(text)
                row = (ids.count(",") + (ids != ""), sha(ids.encode()), sha(data))
                rows.append((*row, [int(i) for i in ids.split(",") if i]) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)

    return code(whole_text())


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids for every row of ``docs`` (doc_id, text).

    Texts are encoded whole, each match of ``pattern`` for itself, without special tokens; the ids are then decoded.
    A null text counts as empty: no tokens, digests of nothing. Null ids stay null; repeated rows give repeated results, an empty table
    none. ``path`` names the vocabulary file, which only the driver reads.
    """
    plain = pick(docs, "doc_id", "text")
    return plain.select("doc_id", coder(plain, Vocabulary(read_ranks(path), pattern), with_ids).alias("code")).select("doc_id", "code.*")
