"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints link when at most RADIUS bits differ. Each bit position has a class, a non-zero vector of
RADIUS + 1 bits; table v keeps the positions whose class has an odd inner product with v. RADIUS
classes cannot span RADIUS + 1 dimensions, so for any RADIUS differing positions some v is orthogonal to
all of their classes: that table keeps none of them and the pair collides. No pair within the radius is
missed, and every collision is checked on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import pick, whole_text
from rankloom.session import durable

RADIUS = 3
SHINGLE = 3
SEED = 42
#: A bucket with more fingerprints is compared block by block, in tasks of at most two blocks.
BLOCK = 2048


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, as unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(width: int = SHINGLE) -> Column:
    """Fingerprint of ``text`` as a signed long with the same 64 bits."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, width) for t in batch), np.uint64, len(batch))
            yield pd.Series(values.view(np.int64))

    return run(whole_text())


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as signed 64-bit masks."""
    classes = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, classes + 1):
        kept = sum(1 << i for i in range(64) if bin((i % classes + 1) & v).count("1") % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def distance_links(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the first value of its component under links within ``radius``."""
    link = distance_links(values.view(np.uint64), values.view(np.uint64), radius)
    label = np.arange(len(values))
    while True:
        least = np.where(link, label[None, :], len(values)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def runs_forest(table: pd.DataFrame, keys: list[str], radius: int) -> pd.DataFrame:
    """Star edges (a, b) of the components inside each group of equal keys."""
    table = table.sort_values([*keys, "fp"], kind="stable")
    values = table["fp"].to_numpy(np.int64)
    change = np.zeros(len(table), bool)
    for k in keys:
        column = table[k].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    start = np.append(0, np.flatnonzero(change)) if len(table) else np.zeros(0, np.int64)
    stop = np.append(start[1:], len(table)) if len(table) else start
    size = stop - start
    two = start[size == 2]
    near = np.bitwise_count(values[two].view(np.uint64) ^ values[two + 1].view(np.uint64)) <= radius if len(two) else np.zeros(0, bool)
    a, b = [values[two + 1][near]], [values[two][near]]
    for i, j in zip(start[size > 2], stop[size > 2]):
        own = values[i:j]
        label = forest(own, radius)
        moved = np.flatnonzero(label != np.arange(len(own)))
        a.append(own[moved])
        b.append(own[label[moved]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}, dtype=np.int64)


def links(fingerprints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), b < a, that connect exactly the pairs within ``radius`` (not all pairs).

    ``fingerprints`` has distinct longs in ``fp``. Within a bucket only a star for each component leaves the
    task. A bucket of more than ``block`` values is split into blocks by hash and each pair of blocks is a task of
    its own, so that no task holds more than about two blocks of one bucket and no pair is lost.
    """
    spark = fingerprints.sparkSession
    tables = F.array(*(F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))))
    placed = fingerprints.select("fp", F.explode(tables).alias("t")).select("fp", "t.v", "t.key")
    # Written, so that both sides of the join are dealt anew and a large bucket can be split.
    sizes = durable(placed.groupBy("v", "key").agg(F.count("*").alias("size")).where("size > 1"), "bucket_sizes")
    shared = placed.join(sizes, ["v", "key"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A bounded number of whole buckets is dealt to each group of a task.
    groups = F.pmod(F.xxhash64("v", "key"), F.lit(parts * 8))
    small = (
        shared.where(F.col("size") <= block)
        .groupBy(groups.alias("g"))
        .applyInPandas(lambda t: runs_forest(t, ["v", "key"], radius), "a long, b long")
    )
    n = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp")), n).cast("int")
    large = (
        shared.where(F.col("size") > block)
        .select("v", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
        .select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .groupBy("v", "key", "i", "j")
        .applyInPandas(lambda t: runs_forest(t, ["v", "key"], radius), "a long, b long")
    )
    return small.unionByName(large).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the connected component, for every node of an edge.

    Alternating star contraction: each step hangs the larger (then the smaller) neighbours of a node on its
    least neighbour, which keeps connectivity, never adds edges, and ends with stars after a number of steps that
    grows with the logarithm of the nodes. Each step is one written table; a hot node is only met in
    pre-aggregated minima and in joins that adaptive execution can split.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least.select(F.col("u").alias("w"), F.least("u", "m").alias("m")), F.col("u") == F.col("w"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(first.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(first.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = durable(small, "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").distinct().toDF("node", "root"))


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root, component_id for the distinct fingerprints of ``rows`` (doc_id, fp).

    All work between fingerprints is on distinct ones, so copies of one text cost one row.
    """
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(links(distinct.select("fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.select("fp", "root").join(named, "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of at most ``radius`` bits reach; rows with a null id are linked
    too but name no component unless it has no other id (then it is null). A null or empty text
    has fingerprint zero and is linked like any other. Repeated rows give repeated results, an empty table none.
    """
    rows = durable(pick(docs, "doc_id", "text").select("doc_id", fingerprint_column(width).alias("fp")), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(grouped(rows, radius), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """All columns of one row of each component: the smallest id (null last), then the least hash of its text.

    Rows that repeat both are copies of each other; one of them stays. The texts move once, to meet the rows that stay.
    """
    hashed = F.xxhash64("text")
    rows = durable(
        pick(docs, "doc_id", "text").select("doc_id", hashed.alias("digest"), fingerprint_column(width).alias("fp")), "fingerprints"
    )
    return kept_rows(docs, rows.join(grouped(rows, radius), "fp"))


def kept_rows(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for a root of ``placed`` (doc_id, digest of the text, root)."""
    columns = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest"))
    stay = placed.groupBy("root").agg(first.alias("first")).select("first.*")
    numbered = docs.toDF(*(f"column_{i}" for i in range(len(columns))))
    doc_id, text = (F.col(f"column_{columns.index(c)}") for c in ("doc_id", "text"))
    keys = ["nameless", "id", "digest"]
    keyed = numbered.withColumns({"nameless": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)), "digest": F.xxhash64(text)})
    copies = Window.partitionBy(*keys).orderBy("digest")
    kept = keyed.join(stay, keys, "left_semi").withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    return kept.select(*(f"column_{i}" for i in range(len(columns)))).toDF(*columns)
