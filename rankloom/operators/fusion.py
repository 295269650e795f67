"""Combine several vectors of one entity into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.columns import ITEM
from rankloom.functions import vectors as V


def sum_fusion(sources: list[Column]) -> Column:
    return V.weighted_columns([(s, F.lit(1.0)) for s in sources])


def masked_fusion(sources: list[Column], available: list[Column], weights: list[float] | None = None, dim: int = 0) -> Column:
    """Weighted mean of the available sources, each normalized first.

    Weights are a softmax over the available sources (equal by default). Without
    any available source the result is the zero vector. An unavailable source may
    be null.
    """
    weights = weights or [0.0] * len(sources)
    exps = [F.when(a, F.exp(F.lit(float(w)))).otherwise(F.lit(0.0)) for a, w in zip(available, weights)]
    total = sum(exps[1:], exps[0])
    filled = [F.when(a, V.layer_norm(s)).otherwise(V.zeros(dim)) for a, s in zip(available, sources)]
    parts = V.weighted_columns([(s, e / F.nullif(total, F.lit(0.0))) for s, e in zip(filled, exps)])
    return F.when(total > 0, V.layer_norm(parts)).otherwise(V.zeros(dim))


def history_vectors(histories: DataFrame, items: DataFrame, dim: int, decay: float = 1.0, key: str = "query_id") -> DataFrame:
    """Recency-weighted mean of the history item vectors per query.

    The newest entry weighs 1, each older one ``decay`` times the next. An empty
    history gives the zero vector and ``available`` false.
    """
    entries = histories.select(key, F.size("history").alias("_n"), F.posexplode("history").alias("_at", ITEM))
    age = F.col("_n") - 1 - F.col("_at")
    weighted = entries.withColumn("_w", F.pow(F.lit(float(decay)), age))
    joined = weighted.join(items.select(F.col("id").alias(ITEM), "vector"), ITEM)
    summed = joined.groupBy(key).agg(*V.sum_columns("vector", dim, F.col("_w")), F.sum("_w").alias("_all"))
    means = summed.select(key, V.scale(V.gather_columns(dim), 1.0 / F.col("_all")).alias("_mean"))
    full = histories.select(key).join(means, key, "left")
    return full.select(
        key, F.coalesce("_mean", V.zeros(dim)).alias("vector"), F.col("_mean").isNotNull().alias("available")
    )
