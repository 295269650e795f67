"""From a raw bundle to prepared tables in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.columns import (
    HISTORY_LENGTH,
    ITEM,
    MIN_INTERACTIONS,
    NEGATIVES_PER_POSITIVE,
    ROW,
    SPLIT,
    TEST_RATIO,
    TEXT_DIM,
    USER,
    VAL_RATIO,
    is_explicit,
)
from rankloom.operators.cleaning import (
    add_relevance,
    clean_columns,
    dedup_latest,
    kcore,
    label_with_means,
    positives,
    split_interactions,
    train_rating,
    with_user_means,
)
from rankloom.operators.encoding import FEATURE_TYPES, FeatureEncoder
from rankloom.operators.ids import first_seen_ids
from rankloom.operators.negatives import with_negatives
from rankloom.operators.ordering import ALL, HOT_ROWS, by_heat, hot_keys
from rankloom.operators.sequences import user_history
from rankloom.session import durable
from rankloom.sources.artifacts import save_prepared
from rankloom.sources.datasets import Bundle


def labelled_splits(
    interactions: DataFrame,
    seed: int = 0,
    test_ratio: float = TEST_RATIO,
    val_ratio: float = VAL_RATIO,
    min_interactions: int = MIN_INTERACTIONS,
    hot_rows: int = HOT_ROWS,
    slices: int = 1,
) -> DataFrame:
    """Deduplicate, split per user, and label relevance, as a written table.

    Without hot users this is one shuffle by user for all steps. The split is
    written together with the user means, so the overall mean is a scan of two
    columns and every later plan starts from the table. With ``slices`` users are taken in so many
    slices, written one after the other, each of which reads the interactions anew and shuffles its own rows only.
    """
    explicit = is_explicit(interactions)

    def run(part: DataFrame, hot) -> DataFrame:
        unique = dedup_latest(part, cluster_by_user=hot is None)
        split = split_interactions(
            unique,
            seed,
            test_ratio=test_ratio,
            val_ratio=val_ratio,
            min_interactions=min_interactions,
            hot=hot,
        )
        return with_user_means(split, hot) if explicit else split

    hot = hot_keys(interactions, [USER], hot_rows)
    stored = None
    for at in range(slices):
        own = interactions if slices == 1 else interactions.where(F.pmod(F.xxhash64(USER), F.lit(slices)) == at)
        part = durable(by_heat(own, [USER], hot, lambda part: run(part, None), lambda part: run(part, ALL)), "split")
        stored = part if stored is None else stored.unionByName(part)
    if not explicit:
        return add_relevance(stored, None)
    overall = stored.agg(F.avg(train_rating())).first()[0]
    return label_with_means(stored, F.lit(overall).cast("double"))


@dataclass
class Prepared:
    """Prepared tables; ``rows`` are the model rows per positive interaction."""

    interactions: DataFrame
    user_ids: DataFrame
    item_ids: DataFrame
    user_features: DataFrame
    item_features: DataFrame
    metadata: DataFrame
    rows: DataFrame
    parameters: dict = field(default_factory=dict)
    context: DataFrame | None = None

    def save(self, folder: str) -> None:
        tables = {
            "interactions": self.interactions,
            "user_ids": self.user_ids,
            "item_ids": self.item_ids,
            "user_features": self.user_features,
            "item_features": self.item_features,
            "metadata": self.metadata,
        }
        save_prepared(folder, tables, self.parameters)


def _ids(entities: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Ids by first appearance; entities without a source order go by their key."""
    order = F.col(ROW if ROW in entities.columns else key)
    return first_seen_ids(entities, order, train, F.col(ROW), key)


def prepare(
    bundle: Bundle,
    seed: int = 42,
    test_ratio: float = TEST_RATIO,
    val_ratio: float = VAL_RATIO,
    min_interactions: int = MIN_INTERACTIONS,
    remove_sparse: bool = True,
    feature_types: tuple[str, ...] = FEATURE_TYPES,
    history_length: int = HISTORY_LENGTH,
    negatives: int = NEGATIVES_PER_POSITIVE,
    text_dim: int = TEXT_DIM,
    max_tokens: int | None = None,
) -> Prepared:
    """Clean, filter, split, label, encode, and build histories and negatives."""
    spark = bundle.interactions.sparkSession
    events, users, items = (clean_columns(t) for t in (bundle.interactions, bundle.users, bundle.items))
    if remove_sparse:
        # Row ids from files are fixed here, before several jobs read them.
        users, items, events = kcore(durable(events, "events"), min_interactions, users, items)
    users, items = durable(users, "users"), durable(items, "items")
    labelled = labelled_splits(events, seed, test_ratio, val_ratio, min_interactions)
    train = labelled.where(F.col(SPLIT) == "train")
    user_ids = durable(_ids(users, train, USER), "user-ids")
    item_ids = durable(_ids(items, train, ITEM), "item-ids")

    features, metadata = {}, None
    for group, table, key in (("users", users, USER), ("items", items, ITEM)):
        encoder = FeatureEncoder(bundle.roles[group], key, feature_types, text_dim, max_tokens).fit(table)
        encoded = encoder.vector(encoder.transform(table))
        ids = user_ids if key == USER else item_ids
        features[group] = encoded.join(ids, key).select("idx", "features")
        described = encoder.metadata(group, spark)
        metadata = described if metadata is None else metadata.unionByName(described)

    context_roles = bundle.roles["inter"]
    context = FeatureEncoder(context_roles, ROW, feature_types, text_dim, max_tokens).fit(train)
    metadata = metadata.unionByName(context.metadata("inter", spark))
    canonical = [c for c in labelled.columns if c not in sum(context_roles.values(), [])]
    encoded = context.transform(labelled, keep=canonical)
    mapped = (
        encoded.join(user_ids.withColumnRenamed("idx", "_u"), USER, "left")
        .join(item_ids.withColumnRenamed("idx", "_i"), ITEM, "left")
        .withColumns({USER: F.coalesce("_u", F.lit(-1)).cast("long"), ITEM: F.coalesce("_i", F.lit(-1)).cast("long")})
        .select(*encoded.columns)
    )
    interactions = durable(mapped, "interactions")

    # An item known from val or test only has no id; it can be neither seen nor ranked.
    known = positives(interactions).where(F.col(ITEM) >= 0)
    rows = user_history(known, history_length)
    if not is_explicit(labelled) and negatives:
        catalog = item_ids.select(F.col("idx").alias(ITEM))
        sampled = with_negatives(rows.where(F.col(SPLIT) == "train"), catalog, negatives, seed=seed, observed=known)
        rows = sampled.unionByName(
            rows.where(F.col(SPLIT) != "train").withColumn("negatives", F.array().cast("array<bigint>")),
        )
    parameters = {
        "min_interactions": min_interactions,
        "test_ratio": test_ratio,
        "val_ratio": val_ratio,
        "random_state": seed,
        "remove_sparse": remove_sparse,
        "feature_types": list(feature_types),
        "text_embedding_dim": text_dim,
        "text_max_tokens": max_tokens,
        "max_history_len": history_length,
    }
    return Prepared(
        interactions, user_ids, item_ids, features["users"], features["items"], metadata,
        rows, parameters, context.vector(interactions),
    )

