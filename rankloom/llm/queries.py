"""The named queries of the operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    bpe, counts, decontaminate, language, lattice, periods, quality, resample, secret_scan, simhash, suffix, tag_paths, topk,
)
from rankloom.llm.common import fold_of, pick

#: Where the vocabulary files lie.
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches by kind, their digest, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secret_scan.KINDS),
        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold_of(5) != 0)
    model = quality.train(docs, labels)
    return quality.rate(docs, model).select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold_of(5) != 0))
    plain = pick(docs, "doc_id", "text")
    label = language.labeller(plain, model)
    rows = plain.withColumn("label", label)
    return rows.select("doc_id", (fold_of(5) == 0).alias("held_out"), "label.lang_pred", "label.score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its place and distance."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without the bytes of repeated 400-byte strings."""
    return suffix.deduplicated(table(spark, sf_dir, "documents"), 400)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of all documents, learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    model = lattice.train(docs.where(fold_of(10) != 0), public_tokenizers.path(PIECES))
    return lattice.scored(pick(docs, "doc_id", "text"), model, [F.col("doc_id"), (fold_of(10) == 0).alias("held_out")])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the unigram reading of the piece vocabulary."""
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and their components at three differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's text of every page."""
    return tag_paths.extracted(table(spark, sf_dir, "pages"))


def repeated_tail(n: int, h: int) -> np.ndarray | None:
    """Word numbers of a text of ``n`` words with id hash ``h``: a tenth of the texts end in a stretch said again and again."""
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return np.concatenate([np.arange(first), first + np.arange(n - first) % period])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the runs, the longest one, and the digest of the text without repeats."""
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), seed, repeated_tail)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # The greatest of these is the longest run; of equally long ones the first, then the one of smallest period.
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(order)
    length, period = best["length"], -best["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        ((length * 1000 - F.pmod(length * 1000, period)) / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and scores of all documents towards the benchmark texts, and the rank of those that are drawn."""
    drawn = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_top_k,
        op3_quality,
        op4_language,
        op5_decontaminate,
        op6_suffix_dedup,
        op7_byte_bpe,
        op8_lattice,
        op9_token_counts,
        op10_simhash,
        op11_html_extraction,
        op12_periodic_runs,
        op13_resampling,
    )
}
