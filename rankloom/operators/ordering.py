"""Positions and running sums inside ordered groups, safe for very large groups.

A plain window sends a whole group to one task. That is fine until one user owns
a large share of all rows. Groups above ``HOT_ROWS`` rows are therefore sorted
globally by range, numbered per range chunk, and shifted by the chunk offsets, so
no task ever holds more than one chunk. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.session import durable, shuffles_removed

HOT_ROWS = 2_000_000
# Values for ``hot``: find hot keys with a count; every key is hot. None means that
# no key is hot, and a DataFrame lists the hot keys.
DETECT = "detect"
ALL = "all"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys whose group exceeds ``hot_rows``, or None when there is none.

    Costs one pre-aggregated count over the key columns. The result can be handed
    to every later operator on the same keys, also after rows were removed.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    with shuffles_removed(df.sparkSession):
        largest = counts.agg(F.max("_n")).first()[0]
    if largest is None or largest <= hot_rows:
        return None
    return durable(counts.where(F.col("_n") > hot_rows).select(*keys), "hot-keys")


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups and rows of hot groups."""
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def resolve_hot(df: DataFrame, keys: Sequence[str], hot, hot_rows: int):
    """None, ``ALL``, or the table of hot keys."""
    return hot_keys(df, keys, hot_rows) if isinstance(hot, str) and hot == DETECT else hot


def by_heat(df: DataFrame, keys: Sequence[str], hot, ordinary, heavy) -> DataFrame:
    """Apply ``ordinary`` to rows of ordinary groups and ``heavy`` to those of hot ones."""
    if hot is None:
        return ordinary(df)
    if isinstance(hot, str):
        return heavy(df)
    few, many = split_hot(df, keys, hot)
    return ordinary(few).unionByName(heavy(many))


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort by range and tag each row with its chunk and its place in the chunk."""
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return durable(tagged, "ranged").withColumn("_chunk", F.shiftright("_place", 33))


def _ranged_running(df, keys, order, sums: dict[str, Column], totals: dict[str, str]) -> DataFrame:
    keys = list(keys)
    ranged = _ranged(df, [*(F.col(k) for k in keys), *order])
    chunk = [*keys, "_chunk"]
    parts = ranged.groupBy(*chunk).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    # One row per chunk of a key: bounded by the number of range partitions.
    over_key = W.partitionBy(*(keys or [F.lit(0)]))
    before = over_key.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *chunk,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(over_key).alias(t) for n, t in totals.items()],
    )
    local = W.partitionBy(*chunk).orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    counted = ranged.select("*", *[F.sum(v).over(local).alias(f"_l_{n}") for n, v in sums.items()])
    joined = counted.join(offsets, chunk)
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *totals.values(),
    )


def _window_running(df, keys, order, sums: dict[str, Column], totals: dict[str, str]) -> DataFrame:
    whole = W.partitionBy(*(list(keys) or [F.lit(0)]))
    upto = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.select(
        "*",
        *[F.sum(v).over(upto).alias(n) for n, v in sums.items()],
        *[F.sum(sums[n]).over(whole).alias(t) for n, t in totals.items()],
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    hot=DETECT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add inclusive running sums per key in the given total order.

    ``sums`` maps a new column to the summed expression; ``totals`` maps one of
    those columns to the name of its per-key total. Without keys the whole table
    is one group: it is numbered by range unless its size is checked to be small.
    """
    totals = totals or {}
    if not keys:
        with shuffles_removed(df.sparkSession):
            small = df.count() <= hot_rows
        build = _window_running if small else _ranged_running
        return build(df, keys, order, sums, totals)
    return by_heat(
        df,
        keys,
        resolve_hot(df, keys, hot, hot_rows),
        lambda part: _window_running(part, keys, order, sums, totals),
        lambda part: _ranged_running(part, keys, order, sums, totals),
    )


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str = "pos",
    total: str | None = None,
    hot=DETECT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size."""
    return running_sums(
        df,
        keys,
        order,
        {position: F.lit(1).cast("long")},
        {position: total} if total else None,
        hot,
        hot_rows,
    )
