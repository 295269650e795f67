"""Dense integer ids and lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordering import HOT_ROWS, with_positions


def catalog_index(items: DataFrame, column: str, name: str = "idx", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number distinct values ``0..n-1`` in ascending order."""
    values = items.select(column).dropna().distinct()
    placed = with_positions(values, [], [F.col(column).asc()], "_pos", hot_rows=hot_rows)
    return placed.select(column, (F.col("_pos") - 1).alias(name))


def first_seen_ids(
    entities: DataFrame,
    entity_order: Column,
    interactions: DataFrame,
    interaction_order: Column,
    column: str,
    name: str = "idx",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Dense ids by first appearance: entity table first, then the interactions."""
    known = entities.groupBy(column).agg(F.min(entity_order).alias("_first")).dropna(subset=[column])
    later = (
        interactions.groupBy(column)
        .agg(F.min(interaction_order).alias("_first"))
        .dropna(subset=[column])
        .join(known.select(column), column, "left_anti")
    )
    order = [F.col("_first").asc(), F.col(column).asc()]
    head = with_positions(known, [], order, "_pos", hot_rows=hot_rows)
    tail = with_positions(later, [], order, "_pos", hot_rows=hot_rows)
    offset = known.agg(F.count(F.lit(1))).scalar()
    return head.select(column, (F.col("_pos") - 1).alias(name)).unionByName(
        tail.select(column, (F.col("_pos") - 1 + offset).alias(name))
    )


def map_ids(df: DataFrame, ids: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Replace ``column`` by its dense id; unknown values become -1."""
    joined = df.join(ids.select(column, F.col(name).alias("_id")), column, "left")
    mapped = F.coalesce(F.col("_id"), F.lit(-1).cast("long"))
    return joined.withColumn(column, mapped).select(*df.columns)


def translate_ids(df: DataFrame, left: DataFrame, right: DataFrame, token: str = "token") -> DataFrame:
    """Rewrite ids of one vocabulary as ids of another one that shares tokens.

    ``left`` and ``right`` hold ``(id, token)``. An id without a counterpart is an
    error, raised by the job that reads the result.
    """
    bridge = left.join(right.withColumnRenamed("id", "_to"), token, "left").select("id", "_to", token)
    joined = df.join(bridge, "id", "left")
    missing = F.raise_error(F.concat(F.lit("no counterpart for id "), F.col("id").cast("string")))
    return joined.withColumn("id", F.coalesce(F.col("_to"), missing.cast("long"))).select(*df.columns)
