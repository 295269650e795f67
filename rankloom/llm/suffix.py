"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else. To bring equal strings together without
sorting the whole corpus, every WIDTH-byte window is named after the least hash of the GRAM-byte strings in it; equal windows have equal
names. Windows that follow each other under one name form a segment. Only names that occur more than once go on, and equal segments
are folded into one with a count.

Each shard holds whole names (a name with very many different segments is spread over several shards). It builds the suffix array of its
segments by Larsson-Sadakane refinement, common prefixes by Kasai's theorem, and finds the runs of windows that agree on WIDTH bytes. For names
that are spread, the shards' sorted window hashes are dealt by range and merged by binary search, so that windows that are single in
each of two shards find each other. All steps are linear in the windows, no pair of texts is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pick, whole_text
from rankloom.session import durable

WIDTH = 400
GRAM = 32
#: Bytes of segments of a shard, about; a name with more is spread.
SHARD_BYTES = 2_000_000
#: Window hashes of a merge task, about.
MERGE_WINDOWS = 1_000_000
SEED = 42


def byte_codes() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def string_hashes(data: np.ndarray, size: int, codes: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` bytes from each place, mixed; by doubling, and one step for what is left."""
    hashes, length, factor = codes[data], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = factor
        parts = []  # pieces of the binary form of size, from the left
        left = size
        offset = 0
        while left:
            if left & 1:
                parts.append((offset, hashes, power))
                offset += length
            left >>= 1
            if left:
                hashes = hashes[:-length] * power + hashes[length:]
                power, length = power * power, length * 2
        n = max(len(data) - size + 1, 0)
        total = np.zeros(n, np.uint64)
        for at, part, p in parts:
            total = total * p + part[at : at + n]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    length, low = 1, values
    while length * 2 <= width:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    rest = width - length
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def segments(data: bytes, codes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and name of each segment of one text."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = string_hashes(np.frombuffer(data, np.uint8), gram, codes)
    names = sliding_min(grams, width - gram + 1)
    # A new segment begins where the name changes or its (first) place falls out of the window.
    begin = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (grams[: len(names) - 1] == names[:-1])))
    return begin, np.diff(np.append(begin, len(names))), names[begin]


def places(n: int) -> type:
    """Whole numbers that hold ``n``; the memory of a task is that of its arrays of places."""
    return np.int32 if n < 1 << 31 else np.int64


def starts(fresh: np.ndarray, kind: type) -> np.ndarray:
    """For each place the last one up to it that is ``fresh`` (0 before the first)."""
    at = np.arange(len(fresh), dtype=kind)
    at[~fresh] = 0
    return np.maximum.accumulate(at, out=at)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least (Larsson-Sadakane refinement).

    Suffixes are first ranked by 8 bytes. A step ranks those that still tie by the rank of the suffix ``known`` bytes
    further on, which doubles the known bytes; suffixes that are alone in their rank are never touched again.
    """
    n = len(data)
    kind = places(n + 2 * depth)
    padded = np.append(data, np.zeros(8, np.uint8))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i : i + n]
    order = np.argsort(key, kind="stable").astype(kind)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    del key, padded
    rank = np.empty(n + 1, kind)
    rank[n] = -1
    rank[order] = starts(fresh, kind)
    known = 8
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(kind)
    while known < depth and len(tied):
        own = order[tied]
        after = rank[np.minimum(own + known, n)]
        place = np.argsort(rank[own].astype(np.int64) * (n + 1) + after + 1, kind="stable")
        own, after = own[place], after[place]
        del place
        group = rank[own]
        order[tied] = own
        fresh = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        rank[own] = tied[starts(fresh, kind)]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order`` (0 for the first), after Kasai.

    From one place of the text to the next the value falls by one at most, and by exactly one where the bytes before both
    suffixes agree. So only the other places are compared, eight bytes at a time.
    """
    n = len(data)
    kind = order.dtype
    before = np.full(n, -1, kind)
    before[order[1:]] = order[:-1]
    left = np.append(np.uint8(0), data[:-1])
    has = before >= 0
    same = before > 0
    same[:1] = False
    same[same] = left[same.nonzero()[0]] == left[before[same]]
    del left
    # The neighbour of the next suffix is the next of the neighbour only if that is stated so.
    chained = np.zeros(n, bool)
    chained[1:] = same[1:] & (before[1:] == before[:-1] + 1) & has[:-1]
    heads = np.flatnonzero(has & ~chained)
    shared = np.zeros(n, kind)
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    active, length = heads, np.zeros(len(heads), np.int64)
    live = np.arange(len(heads))
    del same
    while len(live):
        a, b = active[live] + length[live], before[active[live]] + length[live]
        inside = np.minimum(n - a, n - b)
        x = np.ascontiguousarray(words[np.minimum(a, n)]).view("<u8").ravel() ^ np.ascontiguousarray(words[np.minimum(b, n)]).view("<u8").ravel()
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        equal = np.minimum(equal, inside)
        length[live] += equal
        live = live[(equal == 8)]
    shared[heads] = length
    del heads, active, length, live, before
    last = starts(~chained, kind)
    value = shared[last]
    del shared
    value += last
    value -= np.arange(n, dtype=kind)
    value[(value < 0) | ~has] = 0
    return value[order]


def shard_windows(pieces: list[bytes], windows: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, where each piece begins, and for each window: its place, whether it is repeated, and its run."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    # 0xFF is in no UTF-8 text, so no window runs over a border.
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    begin = np.cumsum(length + 1) - length - 1
    kind = places(len(data) + 2 * width)
    place = np.repeat((begin - (np.cumsum(windows) - windows)).astype(kind), windows)
    place += np.arange(len(place), dtype=kind)
    order = suffix_array(data, width)
    run = np.cumsum(common_prefixes(data, order) < width, dtype=kind)
    run -= 1
    run_of = np.empty(len(data), kind)
    run_of[order] = run
    del order, run
    run_of = run_of[place]
    total = np.bincount(run_of, np.repeat(counts.astype(np.float64), windows))
    return data, begin, place, total[run_of] > 1, run_of


def ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (first, one past the last)."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


KEY = ["id", "digest"]
FOUND = "name long, print long, found array<struct<a:int,b:int>>"


def repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, digest, cut: the first bytes of repeated windows of each text as ranges; ``docs`` has id, digest, text."""
    seed = SEED

    def cut(batches):
        codes = byte_codes()
        for batch in batches:
            out = []
            for i, digest, text in zip(batch["id"], batch["digest"], batch["text"]):
                data = text.encode("utf-8", "surrogatepass")
                begin, n, name = segments(data, codes, width, gram)
                view = memoryview(data)
                prints = [xxhash.xxh3_64_intdigest(view[a : a + c + width - 1], seed) for a, c in zip(begin.tolist(), n.tolist())]
                if len(begin):
                    out.append((np.full(len(begin), i), np.full(len(begin), digest), name.view(np.int64), np.array(prints, np.uint64).view(np.int64), begin, n))
            if out:
                yield pd.DataFrame(dict(zip(("id", "digest", "name", "print", "first", "n"), map(np.concatenate, zip(*out)))))

    every = durable(docs.mapInPandas(cut, "id long, digest long, name long, print long, first int, n int"), "segments")
    # Written, so that both sides of the join are dealt anew and a very frequent name can be split.
    names = durable(every.groupBy("name").count().where("count > 1").select("name"), "shared_names")
    every = durable(every.join(names, "name"), "shared_segments")
    folded = every.groupBy("name", "print").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "first", "n")).alias("one"))
    folded = durable(folded.select("name", "print", "copies", "one.*"), "folded_segments")
    size = F.col("n") + F.lit(width - 1)
    sums = folded.groupBy("name").agg(F.sum(size).alias("bytes"))
    shards = max(1, -(-(folded.agg(F.sum(size)).first()[0] or 0) // shard_bytes))
    # A large name is a shard family of its own, and each of its shards takes the segments of some prints.
    wide = sums.where(F.col("bytes") > shard_bytes).select("name", F.ceil(F.col("bytes") / shard_bytes).alias("parts"))
    held = folded.join(wide, "name", "left").select(
        "*",
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("name"), F.lit(shards))).otherwise(F.col("name")).alias("family"),
        F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("print"), F.coalesce("parts", F.lit(1)))).alias("part"),
    )
    text = docs.select(*KEY, F.col("text").cast("binary").alias("bytes"))
    piece = F.substring("bytes", F.col("first") + 1, size)
    filled = held.join(text, KEY).select("family", "part", "name", "print", "copies", "n", piece.alias("piece"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["name", "print"]).sort_values(["name", "print"])
        windows = rows["n"].to_numpy(np.int64)
        data, _, place, again, run = shard_windows(rows["piece"].tolist(), windows, rows["copies"].to_numpy(np.int64), width)
        ends = np.cumsum(windows)
        found = [ranges(again[b - c : b]) for b, c in zip(ends, windows)]
        out = pd.DataFrame({"name": rows["name"], "print": rows["print"], "found": found})
        if rows["part"].iloc[0] < 0:
            return out.assign(hashes=None, refs=None)
        # Of each run one window, with its owner if it is single here.
        first = np.unique(run, return_index=True)[1]
        hashes = string_hashes(data, width, byte_codes())[place[first]]
        owner = np.searchsorted(ends, first, "right")
        single = ~again[first]
        refs = np.where(single, first - (ends - windows)[owner], -1)
        order = np.lexsort((hashes, owner))
        lists = np.split(order, np.searchsorted(owner[order], np.arange(1, len(out))))
        return out.assign(hashes=[hashes[at].view(np.int64).tolist() for at in lists], refs=[refs[at].tolist() for at in lists])

    kind = f"{FOUND}, hashes array<long>, refs array<int>"
    searched = durable(filled.groupBy("family", "part").applyInPandas(search, kind), "searched_segments")
    found = searched.where("size(found) > 0").select("name", "print", "found")
    spread = searched.where("hashes is not null")
    many = spread.agg(F.sum(F.size("hashes"))).first()[0]
    if many:
        buckets = -(-many // MERGE_WINDOWS)
        windows = spread.select("name", "print", F.explode(F.arrays_zip("hashes", "refs")).alias("w")).select("name", "print", F.col("w.hashes").alias("hash"), F.col("w.refs").alias("ref"))
        bucket = F.floor((F.col("hash").cast("double") + 2.0**63) / 2.0**64 * buckets)

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            sorted_hashes = np.sort(rows["hash"].to_numpy())
            own = rows[rows["ref"] >= 0]
            values = own["hash"].to_numpy()
            # Each shard lists a window once, so a second entry is another shard's.
            other = np.searchsorted(sorted_hashes, values, "right") - np.searchsorted(sorted_hashes, values, "left") > 1
            own = own[other]
            return pd.DataFrame({"name": own["name"], "print": own["print"], "found": [[(int(r), int(r) + 1)] for r in own["ref"]]})

        found = found.unionByName(windows.groupBy(bucket.alias("bucket")).applyInPandas(merge, FOUND))
    at = F.transform("found", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    return every.join(found, ["name", "print"]).select(*KEY, at.alias("cut")).groupBy(*KEY).agg(F.flatten(F.collect_list("cut")).alias("cut"))


def kept(data: bytes, cut: list | None, width: int) -> tuple[bytes, int]:
    """What stays of a text, and the number of removed runs, given the first bytes of repeated windows as ranges."""
    if cut is None or not len(cut):
        return data, 0
    parts, at, runs = [], 0, 0
    end = -1
    for a, b in sorted((r["a"], r["b"] + width - 1) for r in cut):
        if a > end:
            runs += 1
            parts.append(data[at:a])
        end = at = max(end, b)
    parts.append(data[at:])
    return b"".join(parts), runs


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes; a null text is empty. Rows that repeat a text, even with its id, are documents of their own, so all their windows
    are repeated. Matches never run over the end of a document. Null ids stay null; an empty table gives no rows.
    """
    plain = pick(docs, "doc_id", "text").withColumn("text", whole_text())
    keyed = plain.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "digest": F.xxhash64("text")})
    cuts = repeated(keyed.select(*KEY, "text"), width, gram, shard_bytes)
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    @F.pandas_udf(kind)
    def finish(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, cut in batches:
            rows = []
            for text, own in zip(texts, cut):
                data = text.encode("utf-8", "surrogatepass")
                left, runs = kept(data, own, width)
                row = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
                rows.append((*row, left) if with_bytes else row)
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes])

    return keyed.join(cuts, KEY, "left").select("doc_id", finish("text", "cut").alias("out")).select("doc_id", "out.*")
