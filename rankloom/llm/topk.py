"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, one term for each non-zero component. Vectors are dealt to tasks as they are; a
task packs them into blocks of postings (by term: rows and weights). The queries of a part come first and stay; each block of
candidates is packed once, scattered block by block of queries into one dense array of scores, and merged with the k best of every
query so far, so a task holds a bounded chunk of queries, one block of candidates and one array of scores, however many vectors
it reads. A ranked window merges the parts. Every chunk of queries is dealt to every group of candidates, so each query meets
every candidate once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import pick
from rankloom.session import durable

SCALE = 1024
#: Vectors of a packed block; scores of a pair of blocks fit the cache.
CANDIDATES = 256
QUERIES = 256
#: Non-zero components of a packed block at most, for very long vectors.
COMPONENTS = 1 << 17
#: Queries that a task holds while candidates pass, and their components.
HELD = 1 << 15
HELD_COMPONENTS = 1 << 22


def weights(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and weights floor(SCALE * x) of the vectors that are whole: no null id, vector or component, all finite."""
    plain = pick(vectors, id_column, vector_column).toDF("id", "vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & finite
    return plain.where(whole).select("id", F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE)).alias("w"))


def blocks(ids: list[int], vectors: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, dict]]:
    """Ids and postings of runs of at most ``size`` vectors (and about COMPONENTS weights), by ascending id."""
    order = np.argsort(np.asarray(ids, np.int64), kind="stable")
    first, held = 0, 0
    for i, at in enumerate(order):
        if i > first and (i - first == size or held + len(vectors[at]) > COMPONENTS):
            yield packed(ids, vectors, order[first:i])
            first, held = i, 0
        held += len(vectors[at])
    if len(order):
        yield packed(ids, vectors, order[first:])


def packed(ids: list[int], vectors: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, dict]:
    own = [np.asarray(vectors[at], np.int64) for at in order]
    length = np.array([len(v) for v in own], np.int64)
    weight = np.concatenate(own)
    row = np.repeat(np.arange(len(own), dtype=np.int32), length)
    term = (np.arange(len(weight)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
    some = weight != 0
    return np.asarray(ids, np.int64)[order], postings(row[some], term[some], weight[some])


def postings(rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By term the rows that hold it and their weights."""
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    start = np.flatnonzero(np.diff(terms, prepend=-1))
    return {int(terms[a]): (rows[a:b], values[a:b]) for a, b in zip(start, np.append(start[1:], len(terms)))}


def accumulate(queries: dict, n_queries: int, candidates: dict, n_candidates: int) -> np.ndarray:
    """Scores of all queries and candidates, one term after the other."""
    scores = np.zeros((n_queries, n_candidates), np.int64)
    products = np.empty_like(scores)
    for term, (own, weight) in queries.items():
        if term in candidates:
            rows, values = candidates[term]
            if len(own) == n_queries and len(rows) == n_candidates:
                np.multiply(weight[:, None], values[None, :], out=products)
                scores += products
            elif len(rows) == n_candidates:
                scores[own] += weight[:, None] * values[None, :]
            else:
                scores[np.ix_(own, rows)] += weight[:, None] * values[None, :]
    return scores


class Matches:
    """The k best candidates so far of one block of queries; an id counts once, with its best row, and never for itself."""

    def __init__(self, ids: np.ndarray, terms: dict, k: int):
        self.ids, self.terms, self.k = ids, terms, k
        self.found = np.zeros(len(ids), np.int64)
        self.best = np.zeros((len(ids), k), np.int64)
        self.names = np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, terms: dict) -> None:
        """Merge the scores of a block of candidates of ascending ids."""
        scores = accumulate(self.terms, len(self.ids), terms, len(ids))
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        if len(first) < len(ids):
            scores, ids = np.maximum.reduceat(scores, first, axis=1), ids[first]
        at = np.minimum(np.searchsorted(ids, self.ids), len(ids) - 1)
        own = np.flatnonzero(ids[at] == self.ids)
        scores[own, at[own]] = np.iinfo(np.int64).min
        rows, columns = np.nonzero(scores >= self.least(scores)[:, None])
        score, name = scores[rows, columns], ids[columns]
        full = self.found[rows] == self.k
        new = (name != self.ids[rows]) & (~full | (score > self.best[rows, -1]) | (name < self.names[rows, -1]))
        if new.any():
            self.merge(rows[new], name[new], score[new])

    def least(self, scores: np.ndarray) -> np.ndarray:
        """By query a score that its k best cells reach."""
        out = np.full(len(scores), np.iinfo(np.int64).min)
        full = self.found == self.k
        out[full] = self.best[full, -1]
        if scores.shape[1] > self.k and not full.all():
            out[~full] = np.partition(scores[~full], scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        return out

    def merge(self, rows: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(rows)
        old, place = np.nonzero(np.arange(self.k) < self.found[touched][:, None])
        old = touched[old]
        rows = np.concatenate([old, rows])
        name, score = np.concatenate([self.names[old, place], name]), np.concatenate([self.best[old, place], score])
        order = np.lexsort((~score, name, rows))
        rows, name, score = rows[order], name[order], score[order]
        once = np.append(True, (rows[1:] != rows[:-1]) | (name[1:] != name[:-1]))
        rows, name, score = rows[once], name[once], score[once]
        # The complement of an integer is its order turned round, also for the least one.
        order = np.lexsort((name, ~score, rows))
        rows, name, score = rows[order], name[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        rows, place = rows[kept], place[kept]
        self.names[rows, place], self.best[rows, place] = name[kept], score[kept]
        self.found[touched] = np.minimum(np.bincount(rows, minlength=len(self.ids)), self.k)[touched]

    def rows(self) -> pd.DataFrame:
        row, place = np.nonzero(np.arange(self.k) < self.found[:, None])
        return pd.DataFrame({"query_id": self.ids[row], "vec_id": self.names[row, place], "score": self.best[row, place]})


def matched(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best candidates of the queries of each part, from rows (part, candidate, id, w) sorted by part, queries first."""
    part, held, ids, vectors, asked = None, [], [], [], True

    def pack(whole: bool) -> None:
        """Blocks of what waits: of queries all, of candidates no less than a block unless nothing follows."""
        if asked:
            held.extend(Matches(*block, k) for block in blocks(ids, vectors, QUERIES))
        elif whole or len(ids) >= CANDIDATES:
            for block in blocks(ids, vectors, CANDIDATES):
                for queries in held:
                    queries.meet(*block)
        else:
            return
        ids.clear()
        vectors.clear()

    for batch in batches:
        parts, kinds = batch["part"].to_numpy(), batch["candidate"].to_numpy()
        change = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
        for i, j in zip([0, *change], [*change, len(parts)]):
            if i == j:
                continue
            if (parts[i], not kinds[i]) != (part, asked):
                pack(True)
                if parts[i] != part:
                    yield from (queries.rows() for queries in held)
                    held.clear()
                part, asked = parts[i], not kinds[i]
            if asked or held:
                # Of candidates no more than a block waits, whatever the size of a batch.
                for at in range(i, j, CANDIDATES):
                    to = min(j, at + CANDIDATES)
                    ids.extend(batch["id"].iloc[at:to])
                    vectors.extend(batch["w"].iloc[at:to])
                    if not asked:
                        pack(False)
    pack(True)
    yield from (queries.rows() for queries in held)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest integer inner product for each query.

    ``is_query`` chooses the queries by the column ``id``. Every vector is a candidate, but not for queries with its own id, so rows
    that repeat an id are no match of it; a repeated query id is answered once, by its first vector in order of
    components. Vectors of unequal length are compared as if filled with zeros; an empty vector scores 0. Ties go to the smaller
    id, and a candidate id that repeats counts with its best row. Sums must fit 64 bits. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = weights(vectors, id_column, vector_column)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = durable(rows.where(is_query).groupBy("id").agg(F.min("w").alias("w")), "top-k-queries")
    n, components = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w").cast("long")), F.lit(0))).first()
    chunks = max(1, -(-n // HELD), -(-components // HELD_COMPONENTS))
    # Part p has the queries of chunk p / groups and the candidates of group p % groups.
    chunk, group = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"), F.pmod(F.xxhash64("id", "w"), F.lit(groups)).cast("int")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    queries = own.select("*", every_group.alias("g")).select((chunk * groups + F.col("g")).alias("part"), F.lit(False).alias("candidate"), "id", "w")
    candidates = rows.select("*", every_chunk.alias("c")).select((F.col("c") * groups + group).alias("part"), F.lit(True).alias("candidate"), "id", "w")
    dealt = queries.unionByName(candidates).repartitionById(chunks * groups, F.col("part")).sortWithinPartitions("part", "candidate")
    partial = dealt.mapInPandas(lambda batches: matched(batches, k), "query_id long, vec_id long, score long")
    merged = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
