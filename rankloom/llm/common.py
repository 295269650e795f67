"""Small helpers that all text operators share."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Send a model of bounded size to all workers, its class by value: they need not have this package."""
    return spark.sparkContext.broadcast({"sent": cloudpickle.dumps(value)})


def held(shared: Broadcast) -> Any:
    """The shared value; a worker builds it once and keeps it beside the broadcast for all its tasks."""
    box = shared.value
    if "value" not in box:
        box["value"] = pickle.loads(box["sent"])
    return box["value"]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table holds.

    A name in exact letter case wins over one that differs in case only, and the first of
    repeated columns is taken, so extra columns with clashing names are no matter.
    """
    columns = df.columns
    folded = [c.lower() for c in columns]
    at = [columns.index(n) if n in columns else folded.index(n.lower()) for n in names]
    plain = df.toDF(*(f"column_{i}" for i in range(len(columns))))
    return plain.select(*(F.col(f"column_{i}").alias(n) for i, n in zip(at, names)))


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def chunks(texts: list[str], size: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters, with the number of the first; a longer text is a run of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]
