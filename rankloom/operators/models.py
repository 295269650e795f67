"""Baselines that train as Spark jobs: popularity, item-kNN, transitions, factors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.columns import HISTORY_LENGTH, ITEM, ROW, SPLIT, USER, is_temporal
from rankloom.operators.cleaning import positives
from rankloom.operators.ids import catalog_index
from rankloom.operators.ordering import DETECT, HOT_ROWS, resolve_hot, with_positions
from rankloom.operators.sequences import user_history
from rankloom.session import durable, shuffles_removed

# Row items whose cells a task adds up at once: from the least to the most, about PAIRS_PER_BLOCK pairs of a user's items.
KNN_BLOCK = 256
MOST_BLOCK = 2048
PAIRS_PER_BLOCK = 1 << 22
# A hot user's items are gathered by runs of the catalog; pieces of hot users that meet in one task.
RUN_ITEMS = 1 << 16
STRIPE_PIECES = 16
# What the rows of a slice of row items may take, in times of the pairs, and in bytes at least.
SLICE_TIMES = 4
SLICE_BYTES = 1 << 29
# Cells up to which a block is a dense table; pairs that are added at once.
DENSE_CELLS = 1 << 22
PAIRS_AT_ONCE = 1 << 22
USERS_PER_SALT = 1_000_000
STRIPE_BLOCKS = 64


# --- popularity -----------------------------------------------------------------


def item_counts(train: DataFrame) -> DataFrame:
    """Positive training interactions per item."""
    return positives(train).groupBy(ITEM).agg(F.count(F.lit(1)).alias("n"))


def popularity_places(train: DataFrame, catalog: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Place of every catalog item by count; ties go to the smaller id."""
    counted = catalog.select(ITEM).distinct().join(item_counts(train), ITEM, "left").fillna(0, ["n"])
    order = [F.col("n").desc(), F.col(ITEM).asc()]
    return with_positions(counted, [], order, "place", hot_rows=hot_rows)


def static_target_ranks(
    labelled: DataFrame, places: DataFrame, split: str = "test", length: int = HISTORY_LENGTH, hot=DETECT
) -> DataFrame:
    """Target ranks under one fixed item order for all users.

    Histories are built over places instead of ids. A target's rank is its place
    less the seen items in front of it, so nothing is scored per query. Items outside
    the catalog have no place: as targets they come last, in histories they count as events but mask nothing.
    """
    hot = resolve_hot(positives(labelled), [USER], hot, HOT_ROWS)
    outside = F.lit(0).cast("long")
    placed = positives(labelled).join(places.select(ITEM, F.col("place").cast("long").alias("place")), ITEM, "left")
    rows = user_history(placed, length, F.coalesce("place", outside), "seen_places", hot=hot)
    last = places.agg(F.count(F.lit(1)) + 1).scalar()
    rows = rows.withColumn("place", F.coalesce("place", last))
    ahead = F.size(F.filter(F.array_distinct("seen_places"), lambda p: (p > outside) & (p < F.col("place"))))
    return rows.where(F.col(SPLIT) == split).select(
        F.col(ROW).alias("query_id"), (F.col("place") - ahead).alias("rank")
    )


# --- item-kNN -------------------------------------------------------------------


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with equal keys."""
    change = np.zeros(len(keys[0]), bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    at = [0, *np.flatnonzero(change).tolist(), len(change)]
    return list(zip(at, at[1:])) if len(change) else []


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All entries in a row, and the length of each list."""
    sizes = lists.map(len).to_numpy()
    return np.concatenate(lists.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64), sizes


class _Cells:
    """Sums over the cells (row item, item) of one block of row items: a dense table if it is small, else sorted codes."""

    def __init__(self, first: int, rows: int, n_items: int):
        self.first, self.n_items = first, n_items
        self.dense = np.zeros(rows * n_items, np.int64) if rows * n_items <= DENSE_CELLS else None
        self.codes, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> None:
        """One for each pair of a left and a right entry of the same row."""
        bounds = np.searchsorted(np.cumsum(left_sizes * right_sizes), np.arange(PAIRS_AT_ONCE, (left_sizes * right_sizes).sum(), PAIRS_AT_ONCE)) + 1
        starts = np.unique([0, *bounds, len(left_sizes)])
        left_at, right_at = np.append(0, np.cumsum(left_sizes)), np.append(0, np.cumsum(right_sizes))
        for i, j in zip(starts, starts[1:]):
            times = np.repeat(right_sizes[i:j], left_sizes[i:j])
            total = int(times.sum())
            rows = np.repeat(left[left_at[i] : left_at[j]] - self.first, times)
            # The left entry's row gives the place of its right list; the pair's number in the entry is added.
            from_place = np.repeat(right_at[i:j], left_sizes[i:j]) - (np.cumsum(times) - times)
            columns = right[np.repeat(from_place, times) + np.arange(total)]
            codes = rows * self.n_items + columns
            if self.dense is not None:
                self.dense += np.bincount(codes, minlength=len(self.dense))
            else:
                self.waiting.append(codes)
                self.held += total
                if self.held >= PAIRS_AT_ONCE:
                    self._squeeze()

    def _squeeze(self) -> None:
        codes, sums = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.zeros(0, np.int64),) * 2
        self.waiting, self.held = [], 0
        both, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        self.sums = np.bincount(at, np.concatenate([self.sums, sums]), len(both)).astype(np.int64)
        self.codes = both

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row item, item and sum of all cells but those of an item with itself, in order."""
        if self.dense is not None:
            codes = np.flatnonzero(self.dense)
            sums = self.dense[codes]
        else:
            self._squeeze()
            codes, sums = self.codes, self.sums
        i, j = codes // self.n_items + self.first, codes % self.n_items
        return i[i != j], j[i != j], sums[i != j]


def _row_blocks(batches: Iterator[pd.DataFrame], block: int, n_items: int, finish) -> Iterator[pd.DataFrame]:
    """``finish`` of the cells of each (block, salt) from rows sorted by them."""
    current, cells, counts = None, None, np.zeros(n_items, np.int64)
    for pdf in batches:
        for i, j in _runs(pdf["block"].to_numpy(), pdf["salt"].to_numpy()):
            part = pdf.iloc[i:j]
            key = (int(part["block"].iat[0]), int(part["salt"].iat[0]))
            if key != current:
                if current is not None:
                    yield finish(*cells.cells(), counts)
                current, cells = key, _Cells(key[0] * block, block, n_items)
            left, left_sizes = _flat(part["places"])
            right, right_sizes = _flat(part["other_places"])
            if "other_counts" in part:
                counts[right] = _flat(part["other_counts"])[0]
            cells.add(left, left_sizes, right, right_sizes)
    if current is not None:
        yield finish(*cells.cells(), counts)


def _loads(pairs: DataFrame) -> tuple[float, int, int]:
    """Sum of the squares of the users' numbers of items, the largest of the numbers, and their sum."""
    counts = pairs.groupBy(USER).agg(F.count(F.lit(1)).alias("_n"))
    square = F.col("_n").cast("double") * F.col("_n")
    with shuffles_removed(pairs.sparkSession):
        load, most, total = counts.agg(F.sum(square), F.max("_n"), F.sum("_n")).first()
    return load or 1.0, most or 0, total or 0


def _block_of(load: float, n_items: int) -> int:
    """Row items of a block: the more of them, the fewer times a user's items travel."""
    return int(min(max(KNN_BLOCK, n_items * PAIRS_PER_BLOCK / load), MOST_BLOCK))


def _baskets(pairs: DataFrame, index: DataFrame, piece: int, most: int, n_items: int, counted: bool) -> DataFrame:
    """Written rows (user, places, counts, hot): the items of a user in ascending order, of hot users (over ``piece`` items) in pieces of at most as many.

    ``index``: ``(item_id, idx, c)``. The pieces of a hot user are made of runs of the catalog, so no row grows with the busiest user.
    """
    place = F.col("idx").cast("int" if n_items < 1 << 31 else "long").alias("idx")
    pairs = pairs.select(USER, ITEM).where(F.col(USER).isNotNull())
    placed = pairs.join(index.select(ITEM, place, "c"), ITEM)
    run = F.lit(0)
    if most > piece:
        hot = pairs.groupBy(USER).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > piece).select(USER, F.lit(True).alias("_hot"))
        placed = placed.join(durable(hot, "hot-users"), USER, "left")
        run = F.when(F.col("_hot"), F.floor(F.col("idx") / RUN_ITEMS)).otherwise(0)
    else:
        placed = placed.withColumn("_hot", F.lit(None).cast("boolean"))
    entry = F.struct("idx", "c") if counted else F.struct("idx")
    packed = placed.groupBy(USER, run.alias("_run")).agg(F.sort_array(F.collect_set(entry)).alias("_all"), F.first("_hot").alias("hot"))
    cuts = F.sequence(F.lit(1), F.size("_all"), F.lit(piece))
    packed = packed.select(USER, "hot", F.explode(F.transform(cuts, lambda at: F.slice("_all", at, F.lit(piece)))).alias("_all"))
    counts = [F.col("_all.c").alias("counts")] if counted else []
    return durable(packed.select(USER, F.col("_all.idx").alias("places"), *counts, F.coalesce("hot", F.lit(False)).alias("hot")), "baskets")


def _rows_of(baskets: DataFrame, block: int, most: int, piece: int, counted: bool, slices: int = 1, at: int = 0) -> DataFrame:
    """Rows (user, block, places, other_places, other_counts): a user's items of one block, next to a piece of the user's items."""
    columns = ["other_places", "other_counts"][: 1 + counted]
    own = baskets.select(USER, "hot", F.col("places").alias("_left"), "places", *["counts"][:counted]).toDF(USER, "hot", "_left", *columns)
    if most > piece:
        # Pieces of hot users meet each other in stripes; tables of users are merged, since sent whole they would fill the driver.
        stripes = -(-most // (piece * STRIPE_PIECES))
        left = baskets.where("hot").select(USER, F.col("places").alias("_left"), F.pmod(F.xxhash64("places"), F.lit(stripes)).alias("_stripe"))
        right = own.where("hot").select(USER, *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("_stripe"))
        met = left.join(right.hint("merge"), [USER, "_stripe"]).select(USER, "_left", *columns)
        own = own.where("not hot").select(USER, "_left", *columns).unionByName(met)
    number = lambda x: F.floor(x / block).cast("int")
    if slices > 1:
        own = own.withColumn("_left", F.filter("_left", lambda x: F.pmod(number(x), F.lit(slices)) == at))
    own = own.withColumn("block", F.explode(F.array_distinct(F.transform("_left", number))))
    return own.select(USER, "block", F.filter("_left", lambda x: number(x) == F.col("block")).alias("places"), *columns)


def _salting(rows: DataFrame, loads: DataFrame | None) -> DataFrame:
    """Rows with the ``salt`` of their user and the ``salts`` of their block."""
    if loads is None:
        return rows.withColumns({"salts": F.lit(1), "salt": F.lit(0)})
    rows = rows.join(loads, "block", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64(USER), F.col("salts")).cast("int"))


def _slices(load: float, total: int, n_items: int, block: int) -> int:
    """Slices of row items whose shuffles lie on disk one after the other: each takes a few times the room of the pairs."""
    blocks = -(-n_items // block)
    room = 4 * total * min(load / max(total, 1), blocks)
    return int(min(max(1, -(-room // max(SLICE_TIMES * 4 * total, SLICE_BYTES))), max(blocks, 1)))


def _met_slices(
    pairs: DataFrame, index: DataFrame, block: int | None, users_per_salt: int, stripe_blocks: int, n_items: int, counted: bool = True,
    sliced: bool = False,
) -> tuple[list[DataFrame], int, bool]:
    """Slices of rows (block, salt, salts, places, other_places, other_counts), the size of a block, and whether any block is salted.

    Blocks with many users are salted by user, and the items of a user are cut into pieces, so no row and no task grows with the most
    popular item or the busiest user. Counts travel only if ``counted``. A user's items are gathered once; all slices read them.
    """
    load, most, total = _loads(pairs)
    block = block or _block_of(load, n_items)
    piece = stripe_blocks * min(block, KNN_BLOCK)
    baskets = _baskets(pairs, index, piece, most, n_items, counted)
    loads = None
    if _salted(index, block, users_per_salt):
        users = baskets.select(F.explode(F.array_distinct(F.transform("places", lambda x: F.floor(x / block).cast("int")))).alias("block"))
        loads = users.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / users_per_salt).cast("int").alias("salts")).where("salts > 1")
        loads = durable(loads, "salts")
        loads = None if loads.isEmpty() else loads
    slices = _slices(load, total, n_items, block) if sliced else 1
    rows = [_salting(_rows_of(baskets, block, most, piece, counted, slices, at), loads).drop(USER) for at in range(slices)]
    return rows, block, loads is not None


def _met(pairs: DataFrame, index: DataFrame, block: int, users_per_salt: int, stripe_blocks: int, n_items: int, counted: bool = True) -> DataFrame:
    return _met_slices(pairs, index, block, users_per_salt, stripe_blocks, n_items, counted)[0][0]


def _per_block(met: DataFrame, block: int, n_items: int, finish, schema: str) -> DataFrame:
    rows = met.drop("salts").repartition("block", "salt").sortWithinPartitions("block", "salt")
    return rows.mapInPandas(
        lambda batches: _row_blocks(batches, block, n_items, finish), schema
    )


def _all_cells(i, j, n, _counts) -> pd.DataFrame:
    return pd.DataFrame({"i": i, "j": j, "n": n})


def counted_index(pairs: DataFrame) -> DataFrame:
    """``(item_id, idx, c)``: dense index in id order and users of each item."""
    index = catalog_index(pairs, ITEM)
    return durable(index.join(pairs.groupBy(ITEM).agg(F.count(F.lit(1)).alias("c")), ITEM), "item-index")


def cooccurrence(
    pairs: DataFrame,
    index: DataFrame | None = None,
    block: int | None = None,
    users_per_salt: int = USERS_PER_SALT,
    stripe_blocks: int = STRIPE_BLOCKS,
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Users shared by two items, as ``(i, j, n)`` over catalog indexes, both directions.

    Item pairs of a user are never written out: a user's items of one block of row items travel next to the user's items, and a task adds up
    the cells of a block. ``index`` as ``counted_index`` gives it. With ``each`` the cells are taken in slices that hold all cells of
    their ``i``; what ``each`` makes of a slice is written before the next one begins, so only one slice's shuffle lies on disk.
    """
    index = counted_index(pairs.select(USER, ITEM)) if index is None else index
    n_items = index.count()
    slices, block, salted = _met_slices(pairs, index, block, users_per_salt, stripe_blocks, n_items, False, each is not None)
    schema, out = "i bigint, j bigint, n bigint", []
    for met in slices:
        cells = _per_block(met.where("salts = 1") if salted else met, block, n_items, _all_cells, schema)
        if salted:
            # The cells of a salted block come in several pieces; one more sum completes them.
            parts = _per_block(met.where("salts > 1"), block, n_items, _all_cells, schema)
            cells = cells.unionByName(parts.groupBy("i", "j").agg(F.sum("n").alias("n")))
        out.append(cells if each is None else durable(each(cells), "cells"))
    return reduce(DataFrame.unionByName, out)


def item_neighbors(
    train: DataFrame,
    n_neighbors: int,
    block: int | None = None,
    users_per_salt: int = USERS_PER_SALT,
    stripe_blocks: int = STRIPE_BLOCKS,
) -> DataFrame:
    """Top cosine neighbours ``(item_id, neighbor_id, similarity, rank)`` of every item; ties go to the smaller id.

    A task that holds all users of a block of row items keeps only the best neighbours of each, so no table of
    pairs leaves it. Only for blocks with more than ``users_per_salt`` users, whose tasks hold parts of the sums, are cells shuffled.
    """
    pairs = durable(positives(train).select(USER, ITEM).distinct(), "pairs")
    index = counted_index(pairs)
    n_items = index.count()

    def best(i, j, n, counts) -> pd.DataFrame:
        similarity = n / np.sqrt(counts[i].astype(np.float64) * counts[j].astype(np.float64))
        order = np.lexsort((j, -similarity, i))
        i, j, similarity = i[order], j[order], similarity[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        keep = rank <= n_neighbors
        return pd.DataFrame({"i": i[keep], "j": j[keep], "similarity": similarity[keep], "rank": rank[keep].astype(np.int32)})

    (met,), block, salted = _met_slices(pairs, index, block, users_per_salt, stripe_blocks, n_items)
    whole = _per_block(met.where("salts = 1") if salted else met, block, n_items, best, "i bigint, j bigint, similarity double, rank int")
    left = index.select(F.col("idx").alias("i"), F.col("c").alias("_ci"), F.col(ITEM))
    right = index.select(F.col("idx").alias("j"), F.col("c").alias("_cj"), F.col(ITEM).alias("neighbor_id"))
    out = whole
    if salted:
        parts = _per_block(met.where("salts > 1"), block, n_items, _all_cells, "i bigint, j bigint, n bigint")
        sums = parts.groupBy("i", "j").agg(F.sum("n").alias("n")).join(left, "i").join(right, "j")
        root = F.sqrt(F.col("_ci").cast("double") * F.col("_cj").cast("double"))
        order = W.partitionBy("i").orderBy(F.col("similarity").desc(), F.col("j").asc())
        ranked = sums.select("i", "j", (F.col("n") / root).alias("similarity")).withColumn("rank", F.row_number().over(order))
        out = out.unionByName(ranked.where(F.col("rank") <= n_neighbors))
    return out.join(left, "i").join(right, "j").select(ITEM, "neighbor_id", "similarity", "rank")


def _salted(index: DataFrame, block: int, users_per_salt: int) -> bool:
    """Whether any block of row items may have more than ``users_per_salt`` users: a bound from the counts of its items."""
    load = index.groupBy(F.floor(F.col("idx") / block)).agg(F.sum("c").alias("_users"))
    return not load.where(F.col("_users") > users_per_salt).isEmpty()


def neighbor_scores(queries: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Sum of similarities from the history of each query, for items it reaches.

    Rounded, so that equal sums tie whatever order the parts were added in.
    """
    packed = neighbors.groupBy(ITEM).agg(
        F.collect_list(F.struct(F.col("neighbor_id").alias("to"), "similarity")).alias("_near")
    )
    entries = queries.select("query_id", F.explode(F.array_distinct("history")).alias(ITEM))
    reached = entries.join(packed, ITEM).select("query_id", F.inline("_near"))
    return reached.groupBy("query_id", F.col("to").alias(ITEM)).agg(F.round(F.sum("similarity"), 9).alias("score"))


# --- next-item transitions --------------------------------------------------------


def transition_counts(train: DataFrame, hot=DETECT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """How often an item directly follows another one in a user's positive events."""
    if not is_temporal(train):
        raise ValueError("transitions need a time order")
    rows = user_history(positives(train), 1, hot=hot, hot_rows=hot_rows)
    steps = rows.where(F.size("history") > 0).select(F.element_at("history", 1).alias("from_item"), ITEM)
    return steps.groupBy("from_item", ITEM).agg(F.count(F.lit(1)).alias("n"))


def transition_probabilities(train: DataFrame, **options) -> DataFrame:
    """All next items of each item, ``(from_item, item_id, probability)``."""
    counts = durable(transition_counts(train, **options), "transition-counts")
    totals = counts.groupBy("from_item").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "from_item").select("from_item", ITEM, (F.col("n") / F.col("_all")).alias("probability"))


def transition_top(train: DataFrame, k: int | None = None, **options) -> DataFrame:
    """Next items per item from the most likely on, with their probability; the first ``k`` if given, else all."""
    counts = transition_counts(train, **options)
    totals = counts.groupBy("from_item").agg(F.sum("n").alias("_all"))
    # Only the rank is windowed, so Spark limits each group before the shuffle.
    best = W.partitionBy("from_item").orderBy(F.col("n").desc(), F.col(ITEM).asc())
    ranked = counts.withColumn("rank", F.row_number().over(best))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.join(totals, "from_item").select(
        "from_item", ITEM, (F.col("n") / F.col("_all")).alias("probability"), "rank"
    )


def transition_scores(queries: DataFrame, transitions: DataFrame) -> DataFrame:
    """Probability of each next item after the last history item of a query."""
    last = queries.where(F.size("history") > 0).select(
        "query_id", F.element_at("history", -1).alias("from_item")
    )
    return last.join(transitions, "from_item").select("query_id", ITEM, F.col("probability").alias("score"))


# --- factors --------------------------------------------------------------------


def factor_vectors(train: DataFrame, rank: int = 16, iterations: int = 10, seed: int = 42, **params):
    """Implicit alternating least squares; returns user and item ``(id, vector)``.

    Ids of any type that can be ordered: the model sees their dense numbers in ascending order. Rows without a user or item are left out.
    """
    from pyspark.ml.recommendation import ALS

    known = positives(train).select(USER, ITEM).dropna()
    counted = durable(known.groupBy(USER, ITEM).agg(F.count(F.lit(1)).cast("float").alias("weight")), "pairs")
    user_ids = durable(catalog_index(counted, USER, "_user"), "user-ids")
    item_ids = durable(catalog_index(counted, ITEM, "_item"), "item-ids")
    pairs = counted.join(user_ids, USER).join(item_ids, ITEM)
    # Numbers beyond 2^31 fail the cast under ANSI rules, and the model refuses them otherwise.
    pairs = pairs.select(F.col("_user").cast("int"), F.col("_item").cast("int"), "weight")
    als = ALS(
        rank=rank,
        maxIter=iterations,
        seed=seed,
        implicitPrefs=True,
        userCol="_user",
        itemCol="_item",
        ratingCol="weight",
        **params,
    )
    model = als.fit(pairs)

    def vectors(df: DataFrame, ids: DataFrame) -> DataFrame:
        name, number = ids.columns
        own = ids.select(F.col(name).alias("_name"), F.col(number).cast("int").alias("id"))
        return df.join(own, "id").select(F.col("_name").alias("id"), F.col("features").cast("array<double>").alias("vector"))

    return vectors(model.userFactors, user_ids), vectors(model.itemFactors, item_ids)


def queries_of(labelled: DataFrame, split: str = "test", length: int = HISTORY_LENGTH, hot=DETECT, index: DataFrame | None = None) -> DataFrame:
    """Evaluation queries ``(query_id, user_id, target_item_id, history)`` of a split.

    With the ``index`` of a catalog also ``target_idx`` (null outside the catalog) and ``seen``, the distinct indexes of history items that are in it. Rows
    meet the catalog before histories are made, so history entries never travel one by one.
    """
    rows, asked = positives(labelled), [F.col(ROW).alias("query_id"), USER, F.col(ITEM).alias("target_item_id")]
    if index is None:
        return user_history(rows, length, hot=hot).where(F.col(SPLIT) == split).select(*asked, "history")
    hot = resolve_hot(rows, [USER], hot, HOT_ROWS)
    placed = rows.join(index.select(ITEM, F.col("idx").alias("target_idx")), ITEM, "left")
    entry = F.when(F.col(ITEM).isNotNull(), F.struct(F.col(ITEM).alias("item"), F.col("target_idx").alias("idx")))
    found = user_history(placed, length, entry, "_past", hot=hot).where(F.col(SPLIT) == split)
    seen = F.filter(F.array_distinct("_past.idx"), lambda x: x.isNotNull())
    return found.select(*asked, F.col("_past.item").alias("history"), "target_idx", seen.alias("seen"))
