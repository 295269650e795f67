"""Importance resampling towards a target corpus by hashed n-gram features.

Separators of a text collapse to single spaces; one regular expression, searched with overlaps, then yields at each word
the spans of the one, two and three words that begin there, and CRC32 deals them to buckets. Bucket
counts of the corpus and of the target give each feature a gain; a document's weight is the sum of its gains, Gumbel noise
from its id makes the score, and the highest scores are a sample without replacement. The scan runs once: the buckets of each document are written, two bytes a feature,
and both the counts and the weights read them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pick, whole_text
from rankloom.operators.ordering import with_positions
from rankloom.session import durable

BUCKETS = 10_000
#: Documents with fewer words are never drawn; share of the others that is, in hundredths.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Letters A-Z fall to a-z; all other ASCII but a-z and 0-9 separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: At each word that a space precedes: up to three, two and one words, each up to a space.
GRAMS = regex.compile(rb" (?=((([^ ]+)(?: [^ ]+)?)(?: [^ ]+)?) )")


def collapsed(text: str) -> bytes:
    """The words of the text in lower case with one space before, between and after them; empty without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return b" ".join([b"", *words, b""]) if words else b""


def spans(data: bytes) -> Iterator[tuple[int, int]]:
    """Spans of all runs of one to three words of a collapsed text, by start, shorter ones first."""
    for m in GRAMS.finditer(data, overlapped=True):
        yield from sorted({m.span(3), m.span(2), m.span(1)})


def buckets(text: str, n: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature, repeats included."""
    three, two, one = zip(*found) if (found := GRAMS.findall(collapsed(text), overlapped=True)) else ((), (), ())
    # The last word begins no pair and the last two no triple; there the longer groups repeat the shorter.
    parts = [one, two[:-1], three[:-2]]
    codes = [np.fromiter(map(crc32, p), np.uint32, len(p)) for p in parts]
    return len(one), (np.concatenate(codes) % np.uint32(n)).astype("<u2")


def scanned(texts: DataFrame, n: int = BUCKETS) -> DataFrame:
    """``texts`` with n_words and the buckets of the features (two bytes each) in place of ``text``."""

    @F.pandas_udf("n_words long, buckets binary")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(words, own.tobytes()) for words, own in (buckets(t, n) for t in batch)]
            yield pd.DataFrame(rows, columns=["n_words", "buckets"])

    others = [c for c in texts.columns if c != "text"]
    return texts.select(*others, scan(whole_text()).alias("scan")).select(*others, "scan.*")


def counted(scans: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; at most ``n`` sums of the tasks' counts reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for own in batch["buckets"]:
                total += np.bincount(np.frombuffer(own, "<u2"), minlength=n)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "features": total[held]})

    sums = scans.select("buckets").mapInPandas(count, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features"))
    out = np.zeros(n, np.int64)
    for row in sums.collect():
        out[row.bucket] = row.features
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weight_column(gain: np.ndarray) -> Column:
    """Sum of the gains of the features in ``buckets``."""

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([int(gain[np.frombuffer(own, "<u2")].sum()) for own in batch], dtype="int64")

    return weigh("buckets")


def noise(seed: int = SEED, column: str = "doc_id") -> Column:
    """Gumbel noise in thousandths, drawn from the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, n: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) for every row of ``docs`` (doc_id, text).

    Features are runs of one to three words, repeats counted, in ``n`` buckets; the gains compare all of ``docs`` with the texts of ``target``. Of the N
    documents with at least ``least`` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id (null
    last). Null and empty texts have no features and weight 0. Repeated rows are documents of their own with equal scores; an empty table gives no
    rows, an empty target gives gains all the same.
    """
    rows = durable(scanned(pick(docs, "doc_id", "text"), n), "buckets")
    gain = gains(counted(rows, n), counted(scanned(pick(target, "text"), n), n))
    size = F.octet_length("buckets").cast("long") / 2
    scored = rows.select("doc_id", "n_words", size.cast("long").alias("n_features"), weight_column(gain).alias("weight"))
    scored = durable(scored.withColumn("score", F.col("weight") + noise(seed)), "scores")
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    ranked = with_positions(scored.where(able), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
