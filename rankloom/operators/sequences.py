"""Bounded user histories, model rows and sequence exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql import Window as W

from rankloom.columns import (
    HISTORY_LENGTH,
    ITEM,
    ROW,
    SPLIT,
    USER,
    context_columns,
    is_temporal,
)
from rankloom.operators.cleaning import oldest_first, positives
from rankloom.operators.ordering import (
    ALL,
    DETECT,
    HOT_ROWS,
    by_heat,
    resolve_hot,
    with_positions,
)

CHUNK_ROWS = 100_000


def user_history(
    df: DataFrame,
    length: int = HISTORY_LENGTH,
    value: Column | None = None,
    name: str = "history",
    hot=DETECT,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the last ``length`` values of the user strictly before each row.

    Oldest first. Give it the positive rows of all splits: earlier splits, and
    earlier rows of the same split, are visible to later rows because the splits
    follow time. Without times the history is empty.
    """
    value = F.col(ITEM) if value is None else value
    if length == 0 or not is_temporal(df):
        empty = df.limit(0).select(F.array(value)).schema[0].dataType.simpleString()
        return df.withColumn(name, F.array().cast(empty))
    hot = resolve_hot(df, [USER], hot, hot_rows)
    order = oldest_first(df)

    def by_window(part: DataFrame) -> DataFrame:
        before = W.partitionBy(USER).orderBy(*order).rowsBetween(-length, -1)
        return part.withColumn(name, F.collect_list(value).over(before))

    def by_chunk(part: DataFrame) -> DataFrame:
        return _chunked_history(part, length, value, name, order, chunk_rows)

    return by_heat(df, [USER], hot, by_window, by_chunk)


def _chunked_history(df, length, value, name, order, chunk_rows) -> DataFrame:
    """Histories of hot users: cut each timeline into chunks that share ``length`` rows.

    The last ``length`` rows of a chunk are repeated at the head of the next one,
    so every window stays within ``chunk_rows + length`` rows.
    """
    chunk_rows = max(chunk_rows, length)
    placed = with_positions(df, [USER], order, "_pos", hot=ALL)
    own = F.floor((F.col("_pos") - 1) / chunk_rows)
    to_end = chunk_rows - F.pmod(F.col("_pos") - 1, F.lit(chunk_rows))
    homes = F.when(to_end <= length, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_part", F.explode(homes))
    before = W.partitionBy(USER, "_part").orderBy("_pos").rowsBetween(-length, -1)
    return (
        spread.withColumn(name, F.collect_list(value).over(before))
        .where(F.col("_part") == F.col("_own"))
        .select(*df.columns, name)
    )


def padded(history: Column, length: int = HISTORY_LENGTH) -> tuple[Column, Column]:
    """Fixed-width form: ids shifted by one with zero padding, and the valid mask."""
    shifted = F.transform(history, lambda i: i + 1)
    gap = F.lit(length) - F.size(history)
    return (
        F.concat(shifted, F.array_repeat(F.lit(0).cast("long"), gap)),
        F.concat(F.transform(history, lambda i: F.lit(True)), F.array_repeat(F.lit(False), gap)),
    )


def model_rows(df: DataFrame) -> DataFrame:
    """One row per positive event: query, user, history, context, target, negatives.

    The context is one array: numbers, and the entries of array columns, in order of the columns. A null array adds none.
    """
    none = F.array().cast("array<float>")
    context = none
    for c in context_columns(df):
        if c in ("history", "negatives"):
            continue
        if isinstance(df.schema[c].dataType, ArrayType):
            values = F.coalesce(F.transform(c, lambda x: x.try_cast("float")), none)
        else:
            values = F.array(F.col(c).try_cast("float"))
        context = F.concat(context, values)
    negatives = F.col("negatives") if "negatives" in df.columns else F.array().cast("array<bigint>")
    return df.select(
        F.col(ROW).alias("query_id"),
        USER,
        "history",
        context.alias("context"),
        F.col(ITEM).alias("target_item_id"),
        negatives.alias("negatives"),
    )


def sequence_rows(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split for a sequence model: text ids and a space-joined history.

    Training rows without history are dropped; the other splits keep them.
    """
    rows = df.where(F.col(SPLIT) == split)
    if split == "train":
        rows = rows.where(F.size("history") > 0)
    return rows.select(
        F.col(USER).cast("string").alias("user_id:token"),
        F.col(ITEM).cast("string").alias("item_id:token"),
        F.array_join(F.transform("history", lambda i: i.cast("string")), " ").alias("item_id_list:token_seq"),
    )


def batch_entities(df: DataFrame) -> DataFrame:
    """Distinct entities touched by model rows: users, and targets plus history items."""
    users = df.select(F.lit("user").alias("kind"), F.col(USER).alias("id"))
    items = df.select(
        F.lit("item").alias("kind"),
        F.explode(F.array_union("history", F.array(ITEM))).alias("id"),
    )
    return users.unionByName(items).distinct()


def history_entries(df: DataFrame, key: str = ROW) -> DataFrame:
    """Long form of histories: one row per entry with its position, and the last flag."""
    entries = df.select(key, F.size("history").alias("_size"), F.posexplode("history").alias("position", ITEM))
    return entries.select(key, "position", ITEM, (F.col("position") == F.col("_size") - 1).alias("is_last"))


def positive_history(labelled: DataFrame, length: int = HISTORY_LENGTH, **options) -> DataFrame:
    return user_history(positives(labelled), length, **options)
