"""From raw interactions to clean, labelled, split interactions."""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.columns import (
    ITEM,
    MIN_INTERACTIONS,
    RATING,
    RELEVANT,
    ROW,
    SPLIT,
    TEST_RATIO,
    TIME,
    USER,
    VAL_RATIO,
    context_columns,
    is_explicit,
    is_temporal,
    require,
)
from rankloom.functions.hashing import digest
from rankloom.operators.ordering import (
    DETECT,
    HOT_ROWS,
    by_heat,
    resolve_hot,
    with_positions,
)
from rankloom.session import durable

# Rounds after which the pairs of a k-core are rewritten without what went.
COMPACT_EVERY = 4


def clean_columns(df: DataFrame) -> DataFrame:
    """Lower-case headers, trim them, join words by ``_``, drop other signs."""
    return df.toDF(*[re.sub(r"[^\w]", "", c.lower().strip().replace(" ", "_")) for c in df.columns])


NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def number(c: Column) -> Column:
    """Number or null; text that is no number, and NaN, become null.

    A cast alone would also read type suffixes, as in ``12D``.
    """
    value = c.try_cast("double")
    return F.when(c.cast("string").rlike(NUMBER) & ~F.isnan(value), value)


def oldest_first(df: DataFrame) -> list[Column]:
    """Total order of the events of one user; unknown times count as newest."""
    return [F.col(TIME).asc_nulls_last(), F.col(ROW).asc()] if is_temporal(df) else [F.col(ROW).asc()]


def newest_first(df: DataFrame) -> list[Column]:
    return [F.col(TIME).desc_nulls_first(), F.col(ROW).desc()] if is_temporal(df) else [F.col(ROW).desc()]


def positives(df: DataFrame) -> DataFrame:
    return df.where(F.col(RELEVANT) > 0) if RELEVANT in df.columns else df


def dedup_latest(df: DataFrame, cluster_by_user: bool = False) -> DataFrame:
    """Keep the latest event per (user, item); ties go to the later row.

    With ``cluster_by_user`` the rows are shuffled by user first, so that the
    per-user operators that follow reuse that partitioning. Use it only when no
    user is hot; otherwise each pair is reduced before the shuffle.
    """
    if USER not in df.columns or ITEM not in df.columns:
        return df
    df = df.where(F.col(USER).isNotNull())
    if cluster_by_user:
        df = df.repartition(USER)
    pair = W.partitionBy(USER, ITEM).orderBy(*newest_first(df))
    return df.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")


def kcore(
    interactions: DataFrame,
    min_interactions: int = MIN_INTERACTIONS,
    users: DataFrame | None = None,
    items: DataFrame | None = None,
    compact_every: int = COMPACT_EVERY,
):
    """Drop rare users and items until every one left has enough interactions.

    Both filters of a round use the counts of that round. Counts are kept as a table of users and items and only
    lowered by the pairs that a round removes, so a round reads the distinct id pairs once, next to its (few) rare ids, and
    writes counts, not pairs; pairs are rewritten once in ``compact_every`` rounds. All tables lie in the
    shared folder, so a lost executor costs one round. The full rows are made once, with one row a pair, and read once more at
    the end, next to the fewer of the ids that stay and those that went.
    Returns the interactions, or ``(users, items, interactions)`` if tables are given.
    """
    rows = durable(dedup_latest(interactions.where(F.col(ITEM).isNotNull())), "kcore-rows")
    pairs = rows.select(USER, ITEM)
    counts = durable(_ends(pairs).groupBy(USER, ITEM).agg(F.count(F.lit(1)).alias("n")), "kcore-counts")
    removed: DataFrame | None = None
    rares: list[DataFrame] = []
    for step in itertools.count(1):
        rare = counts.where(F.col("n") < min_interactions)
        if rare.isEmpty():
            break
        rares.append(rare)
        gone = _pairs_of(pairs, rare, removed)
        lost = _ends(gone).select(USER, ITEM, F.lit(-1).alias("n"), F.lit(False).alias("kept"))
        left = counts.where(F.col("n") >= min_interactions).select(USER, ITEM, "n", F.lit(True).alias("kept"))
        # An id that was rare too has no row of its own any more; what it lost is of no interest.
        lowered = left.unionByName(lost).groupBy(USER, ITEM).agg(F.sum("n").alias("n"), F.bool_or("kept").alias("kept"))
        counts = durable(lowered.where("kept").select(USER, ITEM, "n"), f"kcore-counts-{step}")
        removed = rare if removed is None else removed.unionByName(rare)
        if step % compact_every == 0:
            pairs, removed = durable(_without(pairs, removed), f"kcore-pairs-{step}"), None
    valid_users = counts.select(USER).where(F.col(USER).isNotNull())
    valid_items = counts.select(ITEM).where(F.col(ITEM).isNotNull())
    kept = rows
    if rares:
        went = reduce(DataFrame.unionByName, rares)
        sizes = [ends.agg(F.count(USER), F.count(ITEM)).first() for ends in (counts, went)]
        for key, stay, out in zip((USER, ITEM), *sizes):
            kept = kept.join(_ids(went, key), key, "left_anti") if out < stay else kept.join(_ids(counts, key), key, "left_semi")
    kept = kept.select(*interactions.columns)
    if users is None or items is None:
        return kept
    return (
        users.join(valid_users, USER, "left_semi").select(*users.columns),
        items.join(valid_items, ITEM, "left_semi").select(*items.columns),
        kept,
    )


def _ends(pairs: DataFrame) -> DataFrame:
    """Two rows a pair: its user with no item, and its item with no user."""
    empty = {c: F.lit(None).cast(pairs.schema[c].dataType) for c in (USER, ITEM)}
    user = F.struct(F.col(USER).alias(USER), empty[ITEM].alias(ITEM))
    item = F.struct(empty[USER].alias(USER), F.col(ITEM).alias(ITEM))
    return pairs.select(F.inline(F.array(user, item)))


def _ids(ends: DataFrame, key: str) -> DataFrame:
    return ends.select(key).where(F.col(key).isNotNull())


def _without(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    return pairs.join(_ids(ends, USER), USER, "left_anti").join(_ids(ends, ITEM), ITEM, "left_anti").select(USER, ITEM)


def _pairs_of(pairs: DataFrame, rare: DataFrame, removed: DataFrame | None) -> DataFrame:
    """Pairs that a rare user or item takes along, each once, but for those that went before."""
    marked = pairs.join(_ids(rare, USER).withColumn("_u", F.lit(True)), USER, "left")
    marked = marked.join(_ids(rare, ITEM).withColumn("_i", F.lit(True)), ITEM, "left")
    found = marked.where("_u or _i").select(USER, ITEM)
    return found if removed is None else _without(found, removed)


def _sizes(n: Column, test_ratio: float, val_ratio: float) -> tuple[Column, Column]:
    n_test = F.greatest(F.lit(1), F.floor(n * F.lit(float(test_ratio))))
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(float(val_ratio))))
    crowded = n_test + n_val >= n
    return F.when(crowded, F.lit(1)).otherwise(n_test), F.when(crowded, F.lit(1)).otherwise(n_val)


def _split(df, order, min_interactions, test_ratio, val_ratio, hot, hot_rows) -> DataFrame:
    """Tag rows by their rank in ``order``: first test, then val, then train."""
    ranked = with_positions(df, [USER], order, "_pos", "_n", hot, hot_rows)
    n_test, n_val = _sizes(F.col("_n"), test_ratio, val_ratio)
    tag = (
        F.when(F.col("_n") < min_interactions, "train")
        .when(F.col("_pos") <= n_test, "test")
        .when(F.col("_pos") <= n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.withColumn(SPLIT, tag).drop("_pos", "_n")


def split_temporal(
    df: DataFrame,
    test_ratio: float = TEST_RATIO,
    val_ratio: float = VAL_RATIO,
    min_interactions: int = MIN_INTERACTIONS,
    hot=DETECT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Newest events of each user go to test, the ones before to val."""
    return _split(df, newest_first(df), min_interactions, test_ratio, val_ratio, hot, hot_rows)


def split_random(
    df: DataFrame,
    seed: int,
    test_ratio: float = TEST_RATIO,
    val_ratio: float = VAL_RATIO,
    min_interactions: int = MIN_INTERACTIONS,
    hot=DETECT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Same sizes over a seeded shuffle of each user's events."""
    keyed = df.withColumn("_key", digest(seed, F.col(USER), F.col(ITEM)))
    order = [F.col("_key").asc(), F.col(ROW).asc()]
    out = _split(keyed, order, min_interactions, test_ratio, val_ratio, hot, hot_rows)
    return out.drop("_key")


def split_interactions(df: DataFrame, seed: int = 0, **options) -> DataFrame:
    """Temporal split when events carry a time, seeded random split otherwise."""
    return split_temporal(df, **options) if is_temporal(df) else split_random(df, seed, **options)


def relevance_thresholds(train: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Mean rating per user and overall, from training rows only."""
    if not is_explicit(train):
        return None
    rating = number(F.col(RATING))
    return (
        train.groupBy(USER).agg(F.avg(rating).alias("_user_mean")),
        train.agg(F.avg(rating).alias("_mean")),
    )


def _label(threshold: Column) -> Column:
    rating = number(F.col(RATING))
    return F.coalesce((rating >= threshold).cast("int"), F.lit(0))


def add_relevance(df: DataFrame, thresholds: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Label rows 1 or 0 against fitted thresholds; implicit events are all 1."""
    if not is_explicit(df):
        return df.withColumn(RELEVANT, F.lit(1))
    if thresholds is None:
        raise RuntimeError("explicit ratings need fitted relevance thresholds")
    by_user, overall = thresholds
    threshold = F.coalesce(F.col("_user_mean"), overall.scalar())
    joined = df.join(by_user, USER, "left")
    return joined.withColumn(RELEVANT, _label(threshold)).select(*df.columns, RELEVANT)


def with_user_means(df: DataFrame, hot=DETECT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the mean training rating of the user as ``_user_mean`` to split rows.

    Ordinary users take a window on the partitioning that the split left behind;
    hot users go through a pre-aggregated mean instead.
    """
    hot = resolve_hot(df, [USER], hot, hot_rows)
    rating = train_rating()

    def by_window(part: DataFrame) -> DataFrame:
        return part.withColumn("_user_mean", F.avg(rating).over(W.partitionBy(USER)))

    def by_join(part: DataFrame) -> DataFrame:
        means = part.groupBy(USER).agg(F.avg(rating).alias("_user_mean"))
        return part.join(means, USER, "left").select(*df.columns, "_user_mean")

    return by_heat(df, [USER], hot, by_window, by_join)


def train_rating() -> Column:
    return F.when(F.col(SPLIT) == "train", number(F.col(RATING)))


def label_with_means(df: DataFrame, overall: Column) -> DataFrame:
    """Label rows that carry ``_user_mean``; ``overall`` serves users without one."""
    threshold = F.coalesce(F.col("_user_mean"), overall)
    return df.withColumn(RELEVANT, _label(threshold)).drop("_user_mean")


def label_split(df: DataFrame, hot=DETECT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Label a split table against the means of its own training rows.

    The overall mean is a second pass over ``df``: hand in a written table, or use
    the preparation plan, which writes the split once.
    """
    require(df, USER, SPLIT)
    if not is_explicit(df):
        return df.withColumn(RELEVANT, F.lit(1))
    overall = df.agg(F.avg(train_rating())).scalar()
    return label_with_means(with_user_means(df, hot, hot_rows), overall)


def profile(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """One row that describes a dataset: feedback, split rule, sizes, sparsity."""
    def features(df: DataFrame) -> Column:
        return F.lit(len([c for c in df.columns if c not in (USER, ITEM, ROW)]))

    n_users = users.agg(F.count(F.lit(1))).scalar()
    n_items = items.agg(F.count(F.lit(1))).scalar()
    counted = interactions.agg(F.count(F.lit(1)).alias("num_interactions")).select(
        F.lit("explicit" if is_explicit(interactions) else "implicit").alias("feedback_type"),
        F.lit("temporal" if is_temporal(interactions) else "random").alias("split_strategy"),
        n_users.alias("num_users"),
        n_items.alias("num_items"),
        "num_interactions",
        features(users).alias("num_user_feats"),
        features(items).alias("num_item_feats"),
        F.lit(len(context_columns(interactions))).alias("num_ctx_feats"),
    )
    cells = F.col("num_users").cast("double") * F.col("num_items").cast("double")
    return counted.withColumn(
        "sparsity",
        F.when(cells == 0, F.lit(0.0)).otherwise(1.0 - F.col("num_interactions") / cells),
    )


def processed_profile(interactions: DataFrame, user_ids: DataFrame, item_ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """The profile of prepared tables: sizes count encoded ids, feature numbers are widths of the encoded vectors.

    ``num_user_text`` and ``num_item_text`` say how many of the entries hold text.
    """
    sized = F.when(F.col("kind") == "text", F.col("cardinality")).otherwise(F.lit(1))
    wide = lambda group, name: F.coalesce(F.sum(F.when(F.col("grp") == group, sized)), F.lit(0)).alias(name)
    text = F.when(F.col("kind") == "text", F.col("cardinality"))
    of_text = lambda group, name: F.coalesce(F.sum(F.when(F.col("grp") == group, text)), F.lit(0)).alias(name)
    widths = metadata.agg(F.struct(
        wide("users", "num_user_feats"), wide("items", "num_item_feats"), wide("inter", "num_ctx_feats"),
        of_text("users", "num_user_text"), of_text("items", "num_item_text"),
    ).alias("widths")).scalar()
    base = profile(interactions, user_ids, item_ids).drop("num_user_feats", "num_item_feats", "num_ctx_feats")
    return base.withColumn("_w", widths).select(*base.columns, "_w.*")
