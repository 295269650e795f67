"""Negative sampling without building a user x catalog table.

A user's unseen items are never listed. With the catalog numbered ``0..n-1``, the
r-th unseen item is ``r`` plus the number of seen items whose index, less the
number of seen items before it, is at most ``r``. Draws are therefore numbers
below the unseen count, and one ordered running count per user turns them into
items. It is exact for any density of seen items and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.columns import ITEM, NEGATIVES_PER_POSITIVE, RELEVANT, ROW, USER, require
from rankloom.functions.hashing import digest, digest_number
from rankloom.operators.ids import catalog_index
from rankloom.operators.ordering import (
    DETECT,
    HOT_ROWS,
    resolve_hot,
    running_sums,
    with_positions,
)
from rankloom.session import durable


def _numbers(seed: int, row: Column, k: int) -> Column:
    """``k`` hash numbers of a row; one digest serves four of them."""
    hexes = [digest(seed, row, block) for block in range((k + 3) // 4)]
    return F.array(*[digest_number(hexes[j // 4], j % 4) for j in range(k)])


def _distinct_draws(numbers: Column, unseen: Column, k: int) -> Column:
    """``k`` different places below ``unseen``, every subset equally likely.

    Place ``j`` is drawn from the first ``unseen - k + j + 1`` places; a place that
    was taken already is replaced by the last one of that range.
    """

    def step(taken: Column, slot: Column) -> Column:
        last = unseen - k + slot
        place = F.pmod(F.get(numbers, slot), last + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, place), last).otherwise(place))

    slots = F.array(*[F.lit(j) for j in range(k)])
    return F.aggregate(slots, F.array().cast("array<bigint>"), step)


def negative_draws(
    interactions: DataFrame,
    catalog: DataFrame,
    k: int = NEGATIVES_PER_POSITIVE,
    seed: int = 0,
    observed: DataFrame | None = None,
    hot=DETECT,
    hot_rows: int = HOT_ROWS,
    row_text: Column | None = None,
) -> DataFrame:
    """Long form ``(row_id, user_id, slot, item_id)`` of ``k`` negatives per row.

    Items of one row differ, and none was observed for the user. A user with
    fewer than ``k`` unseen items gets them with repetition; one without any is
    an error. ``catalog`` lists the candidate items.
    """
    require(interactions, USER, ITEM, ROW)
    if k < 0:
        raise ValueError("the number of negatives must not be negative")
    observed = interactions if observed is None else observed
    index = durable(catalog_index(catalog, ITEM, hot_rows=hot_rows), "catalog")
    n_items = index.count()
    if n_items < k:
        raise ValueError(f"sampling needs at least {k} candidate items, got {n_items}")
    if isinstance(hot, str):
        hot = resolve_hot(observed, [USER], hot, max(1, hot_rows // (k + 1)))

    seen = observed.select(USER, ITEM).distinct().join(index, ITEM).select(USER, "idx")
    seen = with_positions(seen, [USER], [F.col("idx").asc()], "_pos", "_seen", hot=hot)
    gaps = seen.select(
        USER, (F.col("idx") - F.col("_pos") + 1).alias("_key"), F.lit(0).alias("_kind"), F.lit(1).alias("_one")
    )
    seen_count = seen.where("_pos = 1").select(USER, "_seen")

    rows = interactions
    if RELEVANT in rows.columns:
        bad = F.raise_error(F.lit("negative sampling expects positive interactions"))
        rows = rows.where(F.when(F.col(RELEVANT) > 0, F.lit(True)).otherwise(bad.cast("boolean")))
    text = F.col(ROW).cast("string") if row_text is None else row_text
    rows = rows.select(USER, ROW, _numbers(seed, text, k).alias("_h")).join(seen_count, USER, "left")
    none_left = F.raise_error(F.concat(F.lit("no unseen items for user "), F.col(USER).cast("string")))
    unseen = F.lit(n_items) - F.coalesce("_seen", F.lit(0))
    rows = rows.withColumn("_unseen", F.when(unseen > 0, unseen).otherwise(none_left.cast("long")))
    repeated = F.transform("_h", lambda h: F.pmod(h, F.col("_unseen")))
    places = F.when(F.col("_unseen") >= k, _distinct_draws(F.col("_h"), F.col("_unseen"), k)).otherwise(repeated)
    draws = rows.select(USER, ROW, F.posexplode(places).alias("slot", "_key")).select(
        "*", F.lit(1).alias("_kind"), F.lit(0).alias("_one")
    )

    both = draws.unionByName(gaps, allowMissingColumns=True)
    counted = running_sums(
        both, [USER], [F.col("_key").asc(), F.col("_kind").asc()], {"_before": F.col("_one")}, hot=hot
    )
    found = counted.where("_kind = 1").select(USER, ROW, "slot", (F.col("_key") + F.col("_before")).alias("idx"))
    return found.join(index, "idx").select(ROW, USER, "slot", ITEM)


def with_negatives(
    interactions: DataFrame, catalog: DataFrame, k: int = NEGATIVES_PER_POSITIVE, **options
) -> DataFrame:
    """Add the ``negatives`` array, ``k`` items per row."""
    if k == 0:
        kind = interactions.schema[ITEM].dataType.simpleString()
        return interactions.withColumn("negatives", F.array().cast(f"array<{kind}>"))
    draws = negative_draws(interactions, catalog, k, **options)
    ordered = F.array_sort(F.collect_list(F.struct("slot", ITEM)))
    lists = draws.groupBy(ROW).agg(F.transform(ordered, lambda s: s[ITEM]).alias("negatives"))
    return interactions.join(lists, ROW).select(*interactions.columns, "negatives")


def candidate_rows(df: DataFrame) -> DataFrame:
    """Target at position 0, negatives after it, with the label of each. Text ids stay text."""
    kind = "string" if df.schema[ITEM].dataType.simpleString() == "string" else "bigint"
    candidates = F.concat(F.array(F.col(ITEM).cast(kind)), F.col("negatives").cast(f"array<{kind}>"))
    rows = df.select(ROW, USER, F.posexplode(candidates).alias("position", ITEM))
    return rows.withColumn("label", (F.col("position") == 0).cast("int"))
