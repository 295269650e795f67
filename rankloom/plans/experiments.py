"""One evaluator for all models, component variants, and parameter search."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.columns import EVALUATION_PROTOCOL, GRAPH_LAYERS, ITEM, ROW, SPLIT, TOP_KS, USER, is_temporal
from rankloom.functions import vectors as V
from rankloom.operators.fusion import history_vectors, masked_fusion, sum_fusion
from rankloom.operators.encoding import Layout, layouts, project, seeded_signs
from rankloom.operators.graph import interaction_graph, smooth
from rankloom.operators.ids import catalog_index, map_ids
from rankloom.operators.models import (
    factor_vectors,
    item_counts,
    item_neighbors,
    neighbor_scores,
    popularity_places,
    queries_of,
    static_target_ranks,
    transition_probabilities,
    transition_scores,
    transition_top,
)
from rankloom.operators.ranking import Account, check_queries, ranking_metrics, target_ranks
from rankloom.operators.scoring import catalog_target_ranks, popularity_prior
from rankloom.session import durable


def _train(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col(SPLIT) == "train")


def popularity_ranks(labelled: DataFrame, catalog: DataFrame, split: str = "test") -> DataFrame:
    return static_target_ranks(labelled, popularity_places(_train(labelled), catalog), split)


def neighbor_ranks(
    labelled: DataFrame, catalog: DataFrame, split: str = "test", n_neighbors: int = 100, history: int | None = None
) -> DataFrame:
    """Target ranks under item-kNN; ``history`` bounds the last items of a history that score (all mask)."""
    if history is not None:
        ranks = neighbor_trials(labelled, catalog, [{"n_neighbors": n_neighbors, "history": history}], split)
        return ranks.drop("trial")
    queries = durable(queries_of(labelled, split), "queries")
    index = durable(catalog_index(catalog, ITEM), "catalog")
    near = item_neighbors(_train(labelled), n_neighbors)
    # Only items of the catalog are scored; history items outside it still point to them.
    near = durable(near.join(index.select(F.col(ITEM).alias("neighbor_id")), "neighbor_id", "left_semi"), "neighbors")
    return target_ranks(neighbor_scores(queries, near), queries, index)


def transition_ranks(labelled: DataFrame, catalog: DataFrame, split: str = "test", k: int | None = None) -> DataFrame:
    index = durable(catalog_index(catalog, ITEM), "catalog")
    queries = durable(queries_of(labelled, split, index=index), "queries")
    # Ranks of next items are only needed for a cut.
    steps = transition_probabilities(_train(labelled)) if k is None else transition_top(_train(labelled), k)
    steps = durable(steps.join(index.select(ITEM), ITEM, "left_semi"), "transitions")
    return target_ranks(transition_scores(queries, steps), queries, index)


def factor_ranks(
    labelled: DataFrame, catalog: DataFrame, split: str = "test", rank: int = 16, iterations: int = 10, seed: int = 42, **params
) -> DataFrame:
    """Target ranks under factors; items and users without factors get zero vectors. Ids may be of any type.

    The catalog is scored by its index, whose order is that of the ids, so ties fall alike; items outside it are -1.
    """
    users, items = factor_vectors(_train(labelled), rank, iterations, seed, **params)
    zero = V.zeros(rank)
    index = durable(catalog_index(catalog, ITEM), "catalog")
    items = index.join(items.withColumnRenamed("id", ITEM), ITEM, "left").select(F.col("idx").alias("id"), "vector")
    items = items.withColumn("vector", F.coalesce("vector", zero))
    coded = map_ids(labelled, index, ITEM)
    queries = queries_of(coded, split).join(users.withColumnRenamed("id", USER), USER, "left")
    queries = queries.withColumn("vector", F.coalesce("vector", zero))
    return catalog_target_ranks(queries, items, rank)


# Every model sees the same queries, masks and catalog.
MODELS = {
    "popularity": popularity_ranks,
    "item-knn": neighbor_ranks,
    "transition": transition_ranks,
    "factors": factor_ranks,
}
SEQUENTIAL = {"transition"}


def evaluate(
    labelled: DataFrame, catalog: DataFrame, models=tuple(MODELS), split: str = "test", top_ks=TOP_KS,
    account: Account | None = None, **params
) -> DataFrame:
    """One metric row per model. Sequence models are skipped without a time order.

    The loop is over model names; each model is one distributed plan. Each ranks every positive row of the split;
    ``account`` counts the ranks of each model.
    """
    out = None
    for name in dict.fromkeys(models):
        if name in SEQUENTIAL and not is_temporal(labelled):
            continue
        ranks = MODELS[name](labelled, catalog, split, **params.get(name, {}))
        ranks = ranks if account is None else account.watch(ranks, name)
        row = ranking_metrics(ranks, top_ks).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("evaluation_protocol", F.lit(EVALUATION_PROTOCOL))


# --- hybrid scorer and its variants -----------------------------------------------------


@dataclass(frozen=True)
class HybridConfig:
    """Switches of the hybrid scorer. Unlisted sources are simply left out."""

    graph_mode: str = "lightgcn"
    use_user_features: bool = True
    use_item_features: bool = True
    use_text_features: bool = True
    use_seq_encoder: bool = True
    use_context: bool = True
    use_gcl: bool = True
    use_item_bias: bool = True
    scorer_type: str = "mlp"
    fusion_type: str = "masked_gated"


# Component variants by name, as changes to the full setting.
VARIANTS: dict[str, dict[str, object]] = {
    "base": {
        "graph_mode": "id",
        "use_user_features": False,
        "use_item_features": False,
        "use_text_features": False,
        "use_seq_encoder": False,
        "use_context": False,
        "use_gcl": False,
        "use_item_bias": False,
        "scorer_type": "dot",
        "fusion_type": "sum",
    },
    "full": {},
    "no_graph": {"graph_mode": "none", "use_gcl": False},
    "no_features": {"use_user_features": False, "use_item_features": False, "use_text_features": False},
    "no_user_features": {"use_user_features": False},
    "no_item_features": {"use_item_features": False},
    "no_text": {"use_text_features": False},
    "no_sequence": {"use_seq_encoder": False},
    "no_context": {"use_context": False},
    "sum_fusion": {"fusion_type": "sum"},
    "no_gcl": {"use_gcl": False},
    "no_item_bias": {"use_item_bias": False},
    "dot_product": {"scorer_type": "dot"},
}


def variant(name: str, base: HybridConfig = HybridConfig()) -> HybridConfig:
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name!r}; available: {', '.join(VARIANTS)}")
    return replace(base, **VARIANTS[name])


@dataclass(frozen=True)
class Availability:
    """What a dataset offers, independent of switches."""

    user_features: int = 0
    item_features: int = 0
    user_text: int = 0
    item_text: int = 0
    context: int = 0
    history: bool = False


def has_history(histories: DataFrame) -> bool:
    """Whether any training row has a usable history."""
    return bool(histories.agg(F.max(F.size("history") > 0)).first()[0])


# What each source of the scorer needs: the switch that turns it on, and what the data must hold.
SOURCES = {
    "graph": (lambda c: c.graph_mode != "none", lambda c, d: True),
    "user_features": (lambda c: c.use_user_features, lambda c, d: d.user_features > (0 if c.use_text_features else d.user_text)),
    "item_features": (lambda c: c.use_item_features, lambda c, d: d.item_features > (0 if c.use_text_features else d.item_text)),
    "sequence": (lambda c: c.use_seq_encoder, lambda c, d: d.history),
    "context": (lambda c: c.use_context, lambda c, d: d.context > 0),
}
def modules(config: HybridConfig, data: Availability) -> dict[str, bool]:
    """Sources that are both switched on and provided by the data."""
    return {source: bool(on(config) and held(config, data)) for source, (on, held) in SOURCES.items()}


def effects(config: HybridConfig, data: Availability) -> tuple:
    """All that the scores of a setting depend on here, so settings with equal effects give equal results.

    Loss terms and the kind of scorer do not count, because nothing is learned.
    """
    active = modules(config, data)
    text = config.use_text_features and (
        active["user_features"] and data.user_text > 0 or active["item_features"] and data.item_text > 0
    )
    mode = config.graph_mode if active["graph"] else None
    fused = any(active[source] for source in SOURCES if source != "context")
    return tuple(active.values()), text, mode, config.fusion_type if fused else None, config.use_item_bias


def applicable(name: str, data: Availability) -> bool:
    """Whether a variant changes any score for this data; the full setting is what others are held against."""
    config = variant(name)
    return name == "full" or effects(config, data) != effects(variant("full"), data)


def seeded_vectors(ids: DataFrame, dim: int, seeds) -> DataFrame:
    """Signs drawn per id and dimension, scaled to unit length: start of the smoothing. Seeds follow one another in a vector."""
    out, parts = ids.select("id"), []
    for k, seed in enumerate(seeds):
        hexes, signs = seeded_signs(dim, F.lit(seed), F.col("id"))
        out = out.withColumn("_h", hexes).withColumn(f"_v{k}", F.array(*[s / F.lit(dim**0.5) for s in signs])).drop("_h")
        parts.append(F.col(f"_v{k}"))
    return out.select("id", F.concat(*parts).alias("vector"))


def _by_seed(wide: DataFrame, dim: int, seeds, name: str) -> DataFrame:
    each = [F.struct(F.lit(s).alias("seed"), F.slice("vector", k * dim + 1, dim).alias(name)) for k, s in enumerate(seeds)]
    return wide.select("id", F.inline(F.array(*each)))


# Sums per node that one round of smoothing makes at once; seeds beyond it take another pass.
SMOOTHED_AT_ONCE = 64


def graph_vectors(train: DataFrame, num_users: int, num_items: int, dim: int, seeds, layers: int, modes) -> DataFrame:
    """Node vectors ``(seed, id, _id, _graph)``: the start of each seed, and its smoothing if a mode asks for it."""
    spark, step, out = train.sparkSession, max(1, SMOOTHED_AT_ONCE // dim), None
    edges = durable(interaction_graph(train, F.lit(num_users)), "edges") if "lightgcn" in modes else None
    for at in range(0, len(seeds), step):
        some = seeds[at : at + step]
        start = seeded_vectors(spark.range(num_users + num_items), dim, some)
        part = _by_seed(start, dim, some, "_id")
        if edges is None:
            part = part.withColumn("_graph", F.col("_id"))
        else:
            smoothed = durable(smooth(edges, start, dim * len(some), layers), "nodes")
            part = part.join(_by_seed(smoothed, dim, some, "_graph"), ["id", "seed"], "left")
        out = part if out is None else out.unionByName(part)
    return durable(out, "graph-vectors")


@dataclass(frozen=True)
class Features:
    """Feature vectors of any width: a table ``(id, features)`` and what their places hold."""

    table: DataFrame
    layout: Layout


def _width(features: Features | None) -> Layout:
    return Layout() if features is None else features.layout


def grid_ranks(
    labelled: DataFrame,
    configs: list[HybridConfig],
    seeds,
    num_users: int,
    num_items: int,
    dim: int = 16,
    layers: int = GRAPH_LAYERS,
    user_features: Features | None = None,
    item_features: Features | None = None,
    context: Features | None = None,
    split: str = "test",
    queries: DataFrame | None = None,
) -> DataFrame:
    """Target ranks ``(run, query_id, rank)`` of all settings and seeds from one plan; run = place of seed × settings + place of setting.

    Ids are dense, those of ``context`` are row ids. Features are projected to ``dim`` by signs of the seed, with or without their text.
    Sources are fused per entity, context is added to the user's vector, users and items meet in a dot product, and the
    popularity prior is added when switched on. Queries, smoothing and projections are made once for all settings. Repeated query ids and
    targets outside ``num_items`` raise an error; a user outside ``num_users`` has no graph vector.
    """
    seeds, train = list(seeds), _train(labelled)
    if queries is None:
        queries = durable(queries_of(labelled, split), "queries")
    check_queries(queries, num_items)
    nodes = graph_vectors(train, num_users, num_items, dim, seeds, layers, {c.graph_mode for c in configs})
    of_seed = F.explode(F.array(*[F.lit(s) for s in seeds]))
    place = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("seed")).cast("int") - 1
    setting = F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1)))

    def projected(features: Features, name: str) -> DataFrame:
        found = durable(project(features.table, features.layout, dim, seeds), name)
        return found.select("seed", "id", F.col("vector").alias("_feat"), F.col("plain").alias("_plain"))

    def sources(config: HybridConfig, features: Features | None, on: bool) -> list[Column]:
        graph = {"none": [], "id": [F.col("_id")], "lightgcn": [F.col("_graph")]}[config.graph_mode]
        width = _width(features)
        held = width.width - (0 if config.use_text_features else width.text)
        return graph + ([F.col("_feat" if config.use_text_features else "_plain")] if on and held else [])

    def fuse(config: HybridConfig, vectors: list[Column]) -> Column:
        if not vectors:
            return V.zeros(dim)
        if config.fusion_type == "sum":
            return sum_fusion([F.coalesce(v, V.zeros(dim)) for v in vectors])
        return masked_fusion(vectors, [v.isNotNull() for v in vectors], dim=dim)

    def item_kind(config: HybridConfig) -> tuple:
        """All that the item vectors of a setting depend on."""
        found = sources(config, item_features, config.use_item_features)
        featured = len(found) > int(config.graph_mode != "none")
        return config.graph_mode, featured, featured and config.use_text_features, config.fusion_type

    def by_setting(of) -> Column:
        """One expression that takes the branch of the row's setting."""
        out = F.when(F.col("setting") == 0, of(configs[0]))
        for k, config in enumerate(configs[1:], 1):
            out = out.when(F.col("setting") == k, of(config))
        return out

    run = (place * len(configs) + F.col("setting")).alias("run")
    inside = F.col("id").between(num_users, num_users + num_items - 1)
    items = nodes.where(inside).withColumn("id", F.col("id") - num_users)
    if item_features is not None:
        items = items.join(projected(item_features, "item-features"), ["seed", "id"], "left")
    items = items.withColumn("setting", setting)
    vector = by_setting(lambda c: fuse(c, sources(c, item_features, c.use_item_features)))
    items = items.select(run, "setting", "id", vector.alias("vector"))
    if any(c.use_item_bias for c in configs):
        prior = popularity_prior(item_counts(train)).select(F.col(ITEM).alias("id"), F.col("bias").alias("_prior"))
        biased = by_setting(lambda c: F.lit(c.use_item_bias))
        items = items.join(prior, "id", "left").withColumn("bias", F.when(biased, F.coalesce("_prior", F.lit(0.0))).otherwise(0.0))
        items = items.drop("_prior")
    items = durable(items, "item-vectors")

    users = nodes.where(F.col("id") < num_users).withColumnRenamed("id", USER)
    rows = queries.withColumn("seed", of_seed).join(users, ["seed", USER], "left")
    if user_features is not None:
        own = projected(user_features, "user-features").withColumnRenamed("id", USER)
        rows = rows.join(own, ["seed", USER], "left")
    around = V.zeros(dim)
    if context is not None:
        near = projected(context, "context").select("seed", F.col("id").alias("query_id"), F.col("_feat").alias("_ctx"), F.col("_plain").alias("_ctx_plain"))
        rows = rows.join(near, ["seed", "query_id"], "left")
    rows = rows.withColumn("setting", setting).select("*", run)
    sequential = [k for k, c in enumerate(configs) if c.use_seq_encoder] if is_temporal(labelled) else []
    if sequential:
        # Settings with equal item vectors share the vectors of histories; the first of them stands for all.
        kinds = {k: item_kind(configs[k]) for k in sequential}
        shown = {k: next(j for j in sequential if kinds[j] == kinds[k]) for k in sequential}
        wanted = F.col("setting").isin(sorted(set(shown.values())))
        first = F.get(F.array(*[F.lit(shown.get(k)).cast("int") for k in range(len(configs))]), F.col("setting"))
        rows = rows.withColumn("_shown", place * len(configs) + first)
        # Histories and items of one run meet by (run, item).
        asked = queries.select("query_id", "history").withColumn("seed", of_seed).withColumn("setting", setting).where(wanted)
        asked = asked.select(run, "query_id", "history")
        keyed = F.transform("history", lambda i: F.struct(F.col("run").alias("run"), i.cast("long").alias("id")))
        asked = asked.select(F.struct("run", "query_id").alias("key"), keyed.alias("history"))
        known = items.where(wanted).select(F.struct("run", "id").alias("id"), "vector")
        seen = history_vectors(asked, known, dim, key="key")
        seen = seen.select(F.col("key.run").alias("_shown"), "key.query_id", F.when(F.col("available"), F.col("vector")).alias("_seq"))
        rows = rows.join(seen, ["_shown", "query_id"], "left")

    def query_vector(config: HybridConfig) -> Column:
        found = sources(config, user_features, config.use_user_features)
        if sequential and config.use_seq_encoder:
            found = [*found, F.col("_seq")]
        fused = fuse(config, found)
        if context is None or not config.use_context:
            return fused
        return V.add(fused, F.coalesce("_ctx" if config.use_text_features else "_ctx_plain", around))

    rows = rows.select("run", "query_id", "target_item_id", "history", by_setting(query_vector).alias("vector"))
    return catalog_target_ranks(rows, items.drop("setting"), dim)


def hybrid_ranks(labelled: DataFrame, config: HybridConfig, num_users: int, num_items: int, dim: int = 16, seed: int = 42, **options) -> DataFrame:
    """Target ranks of one setting of the hybrid scorer; options are those of ``grid_ranks``."""
    return grid_ranks(labelled, [config], [seed], num_users, num_items, dim, **options).drop("run")


def available(
    user_features: Features | None = None, item_features: Features | None = None, context: Features | None = None, history: bool = False
) -> Availability:
    """What given features offer."""
    user, item = _width(user_features), _width(item_features)
    return Availability(user.width, item.width, user.text, item.text, _width(context).width, history)


def availability(profile: DataFrame, rows: DataFrame) -> Availability:
    """What a processed profile and the model rows offer."""
    p = profile.first()
    return Availability(
        p["num_user_feats"], p["num_item_feats"], p["num_user_text"], p["num_item_text"], p["num_ctx_feats"],
        p["split_strategy"] == "temporal" and has_history(rows.where(F.col(SPLIT) == "train")),
    )


def hybrid_inputs(prepared) -> dict:
    """Arguments of ``run_variants`` and ``grid_ranks`` from prepared tables: encoded ids, features of any width, context."""
    layout = layouts(prepared.metadata)
    named = lambda df, key: df.select(F.col(key).alias("id"), "features")
    tables = {
        "user_features": ("users", named(prepared.user_features, "idx")),
        "item_features": ("items", named(prepared.item_features, "idx")),
        "context": ("inter", None if prepared.context is None else named(prepared.context, ROW)),
    }
    found = {n: Features(t, layout[g]) if t is not None and g in layout and layout[g].width else None for n, (g, t) in tables.items()}
    return {
        "labelled": prepared.interactions.where((F.col(ITEM) >= 0) & (F.col(USER) >= 0)),
        "num_users": prepared.user_ids.count(),
        "num_items": prepared.item_ids.count(),
        **found,
    }


def run_variants(
    labelled: DataFrame, num_users: int, num_items: int, names=tuple(VARIANTS), seeds=(13, 42, 77), top_ks=TOP_KS,
    split: str = "test", user_features: Features | None = None, item_features: Features | None = None, context: Features | None = None, **params,
) -> DataFrame:
    """One metric row per (variant, seed) with its switches and active sources, all from one plan.

    Variants of equal effect share one run; those that change nothing for this data are marked as not applicable.
    """
    spark = labelled.sparkSession
    queries = durable(queries_of(labelled, split), "queries")
    data = available(user_features, item_features, context, is_temporal(labelled) and has_history(queries))
    configs = {name: variant(name) for name in dict.fromkeys(names)}
    kinds = list(dict.fromkeys(effects(c, data) for c in configs.values()))
    chosen = [next(c for c in configs.values() if effects(c, data) == kind) for kind in kinds]
    ranks = grid_ranks(
        labelled, chosen, seeds, num_users, num_items, user_features=user_features, item_features=item_features,
        context=context, split=split, queries=queries, **params,
    )
    metrics = ranking_metrics(ranks, top_ks, ("run",))
    labels = []
    for (name, config), (at, seed) in product(configs.items(), enumerate(seeds)):
        active = {f"module_{m}": int(on) for m, on in modules(config, data).items()}
        switches = {k: v if isinstance(v, str) else int(v) for k, v in asdict(config).items()}
        run = at * len(chosen) + kinds.index(effects(config, data))
        labels.append({"_place": len(labels), "run": run, "variant": name, "seed": seed, "applicable": int(applicable(name, data)), **active, **switches})
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in labels[0].items())
    table = spark.createDataFrame([tuple(r.values()) for r in labels], schema)
    return table.join(metrics, "run", "left").orderBy("_place").drop("_place", "run")


def neighbor_trials(labelled: DataFrame, catalog: DataFrame, trials: list[dict[str, int]], split: str = "val") -> DataFrame:
    """Target ranks ``(trial, query_id, rank)`` of all item-kNN trials in one plan.

    A trial has ``n_neighbors`` and, if wanted, ``history``. Neighbours are found once, as many as the largest trial needs: those of the
    others come first in the same lists. An entry of a history and its neighbour then count for each trial that reaches both.
    """
    most = max(t["n_neighbors"] for t in trials)
    index = durable(catalog_index(catalog, ITEM), "catalog")
    near = item_neighbors(_train(labelled), most)
    near = durable(near.join(index.select(F.col(ITEM).alias("neighbor_id")), "neighbor_id", "left_semi"), "neighbors")
    queries = durable(queries_of(labelled, split), "queries")
    settings = F.array(
        *[F.struct(F.lit(i).alias("trial"), F.lit(t["n_neighbors"]).alias("n"), F.lit(t.get("history")).cast("int").alias("h")) for i, t in enumerate(trials)]
    )
    entries = queries.select("query_id", F.size("history").alias("_size"), F.posexplode("history").alias("_at", ITEM))
    # Of an item's places in a history the last one reaches farthest.
    entries = entries.groupBy("query_id", ITEM).agg(F.min(F.col("_size") - F.col("_at")).alias("_age"))
    packed = near.groupBy(ITEM).agg(F.collect_list(F.struct(F.col("neighbor_id").alias("to"), "similarity", "rank")).alias("_near"))
    reached = entries.join(packed, ITEM).select("query_id", "_age", F.inline("_near"))
    counts = F.filter(settings, lambda t: (t["n"] >= F.col("rank")) & (t["h"].isNull() | (t["h"] >= F.col("_age"))))
    each = reached.select("query_id", F.col("to").alias(ITEM), "similarity", F.explode(F.transform(counts, lambda t: t["trial"])).alias("trial"))
    scores = each.groupBy(F.struct("trial", "query_id").alias("query_id"), ITEM).agg(F.round(F.sum("similarity"), 9).alias("score"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(trials) - 1))).alias("trial")
    asked = queries.select("*", numbers).withColumn("query_id", F.struct("trial", "query_id")).drop("trial")
    ranks = target_ranks(scores, asked, index)
    return ranks.select("query_id.trial", "query_id.query_id", "rank")


# Models whose trials share their work, and the parameters that may differ.
SHARED = {"item-knn": (neighbor_trials, {"n_neighbors", "history"})}


def search(
    labelled: DataFrame, catalog: DataFrame, model: str, grid: dict[str, list], metric: str = "ndcg@20", top_ks=TOP_KS
) -> DataFrame:
    """Validation metric of every parameter combination, one row per trial, best first.

    Trials of a model that can share its work are one plan, whose jobs do not depend on their number.
    """
    trials = [dict(zip(grid, values)) for values in product(*grid.values())]
    shared, parameters = SHARED.get(model, (None, set()))
    if shared is not None and "n_neighbors" in grid and set(grid) <= parameters:
        ranks = shared(labelled, catalog, trials, "val")
        rows = ranking_metrics(ranks, top_ks, ("trial",)).select("trial", F.col(f"`{metric}`").alias("value"))
        texts = F.array(*[F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in t.items()])) for t in trials])
        out = rows.select("trial", F.get(texts, F.col("trial")).alias("params"), "value")
        return out.orderBy(F.col("value").desc(), "trial")
    out = None
    for number, params in enumerate(trials):
        ranks = MODELS[model](labelled, catalog, "val", **params)
        row = ranking_metrics(ranks, top_ks).select(
            F.lit(number).alias("trial"),
            F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in params.items()])).alias("params"),
            F.col(f"`{metric}`").alias("value"),
        )
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.col("value").desc(), "trial")


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the best value; ties go to the earlier one."""
    return trials.agg(F.max_by(F.struct("trial", "params", "value"), F.struct("value", -F.col("trial"))).alias("t")).select("t.*")


