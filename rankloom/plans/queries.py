"""Named queries: every operator applied to whole test tables.

Two interaction views feed most of them. ``ev`` reads the events table (item from
the ``k`` property); ``orders_view`` joins orders and line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.columns import ITEM, RATING, RELEVANT, ROW, SPLIT, TIME, USER
from rankloom.functions import names as N
from rankloom.functions import vectors as V
from rankloom.functions.text import clean_text, flatten_list_text, list_tokens, text_document
from rankloom.functions.times import academic_year, epoch_seconds
from rankloom.operators import cleaning, encoding, fusion, graph, ids, models, negatives, ranking, scoring, sequences
from rankloom.operators import statistics as S
from rankloom.operators.ordering import hot_keys
from rankloom.plans import experiments
from rankloom.plans.preparation import labelled_splits, prepare
from rankloom.session import durable, durable_path, spread
from rankloom.sources import artifacts, datasets
from rankloom.streaming import histories as stream_histories
from rankloom.streaming import ingest

DIGITS = 6
EMBEDDING_DIM = 64
# Slices of users whose shuffles lie on disk one after the other, at most, and lines from which another one is taken.
USER_SLICES = 4
SLICE_LINES = 1 << 20


# --- inputs -------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt out to all cores if it lies in few files."""
    return spread(table(spark, sf_dir, name))


def seconds(column: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("int").alias(ITEM),
        F.col("value").alias(RATING),
        seconds("ts").alias(TIME),
        F.col("event_id").alias(ROW),
        "event_type",
    )


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias(USER),
        F.col("l_partkey").alias(ITEM),
        F.col("l_quantity").alias(RATING),
        seconds("o_orderdate").alias(TIME),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias(ROW),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_splits(ev(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select(ITEM).distinct()


def train_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(SPLIT) == "train")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def line_key():
    return [F.col(f"{ROW}.{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey")]


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


def rounded(column: str, digits: int = DIGITS):
    return F.round(F.col(f"`{column}`"), digits).alias(column)


def metric_rows(wide: DataFrame, ids: tuple[str, ...] = ()) -> DataFrame:
    long = ranking.metrics_long(wide, ids)
    return long.withColumn("value", F.round("value", DIGITS))


# --- cleaning, splits, labels -----------------------------------------------------------


def dedup_latest(spark, d):
    return cleaning.dedup_latest(orders_view(spark, d)).select(USER, ITEM, RATING, *line_key())


def dedup_last_in_file(spark, d):
    return cleaning.dedup_latest(ev(spark, d).drop(TIME)).select(USER, ITEM, ROW, RATING)


def kcore(spark, d):
    return cleaning.kcore(orders_view(spark, d), 20).select(USER, ITEM, RATING, *line_key())


def kcore_entities(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", USER)
    parts = table(spark, d, "part").withColumnRenamed("p_partkey", ITEM)
    users, items, kept = cleaning.kcore(orders_view(spark, d), 20, customers, parts)
    left = users.agg(F.count(F.lit(1)).alias("n_users"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    right = items.agg(F.count(F.lit(1)).alias("n_items"), F.sum("p_size").alias("sizes"))
    whole = kept.agg(F.count(F.lit(1)).alias("n_interactions"))
    return whole.select("n_interactions", *[left.select(c).scalar().alias(c) for c in left.columns], *[
        right.select(c).scalar().alias(c) for c in right.columns
    ])


def split_temporal(spark, d):
    events = orders_view(spark, d)
    hot = hot_keys(events, [USER])
    rows = cleaning.dedup_latest(events, cluster_by_user=hot is None)
    return cleaning.split_temporal(rows, hot=hot).select(USER, ITEM, *line_key(), SPLIT)


def split_random(spark, d):
    events = orders_view(spark, d)
    hot = hot_keys(events, [USER])
    rows = cleaning.dedup_latest(events, cluster_by_user=hot is None)
    return cleaning.split_random(rows, seed=42, hot=hot).select(USER, ITEM, *line_key(), SPLIT)


def relevance_labels(spark, d):
    return labelled_splits(orders_view(spark, d)).select(USER, ITEM, RATING, SPLIT, RELEVANT)


def relevance_implicit(spark, d):
    rows = cleaning.add_relevance(ev(spark, d).drop(RATING), None)
    return rows.groupBy("event_type").agg(F.sum(RELEVANT).alias("n_relevant"))


def relevance_thresholds(spark, d):
    by_user, overall = cleaning.relevance_thresholds(train_of(labelled(spark, d)))
    return by_user.select(
        USER, F.round("_user_mean", DIGITS).alias("user_mean"), F.round(overall.scalar(), DIGITS).alias("global_mean")
    )


def dataset_profile(spark, d):
    events = ev(spark, d)
    items = events.select(ITEM).distinct()
    users = table(spark, d, "customer").withColumnRenamed("c_custkey", USER)
    return cleaning.profile(events, users, items).withColumn("sparsity", F.round("sparsity", DIGITS))


# --- sequences and graph ------------------------------------------------------------------


def user_history(spark, d):
    return sequences.positive_history(labelled(spark, d)).select(ROW, USER, ITEM, SPLIT, joined("history"))


def history_entries(spark, d):
    return sequences.history_entries(sequences.positive_history(labelled(spark, d)))


def padded_history(spark, d):
    rows = sequences.positive_history(labelled(spark, d))
    history = F.col("history").cast("array<bigint>")
    items, mask = sequences.padded(history)
    wide = rows.select(ROW, items.alias("items"), mask.alias("mask"))
    return wide.select(
        ROW, joined("items"), F.size(F.filter("mask", lambda m: m)).alias("valid"), F.size("items").alias("width")
    )


def sequence_export(spark, d):
    rows = durable(sequences.positive_history(labelled(spark, d)), "histories")
    written = artifacts.save_sequences(durable_path(spark, "sequences"), "ev", rows)
    parts = []
    for kind, path in written.items():
        back = artifacts.read_tsv(spark, path).toDF(USER, ITEM, "item_id_list")
        parts.append(back.select(F.lit(kind).alias("file"), USER, ITEM, F.coalesce("item_id_list", F.lit("")).alias("item_id_list")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def model_rows(spark, d):
    events = ev(spark, d).withColumn("is_purchase", (F.col("event_type") == "purchase").cast("int"))
    rows = sequences.positive_history(labelled_splits(events.drop("event_type")))
    shaped = sequences.model_rows(rows)
    return shaped.select("query_id", USER, "target_item_id", joined("history"), joined("context"))


def batch_entities(spark, d):
    return sequences.batch_entities(sequences.positive_history(labelled(spark, d)))


def interaction_graph(spark, d):
    rows = labelled(spark, d)
    n_users = ev(spark, d).agg(F.max(USER) + 1).scalar()
    return graph.interaction_graph(train_of(rows), n_users)


def edge_dropout_view(spark, d):
    return graph.drop_edges(interaction_graph(spark, d), 0.2, seed=13)


def graph_smooth(spark, d):
    edges = durable(interaction_graph(spark, d), "edges")
    smoothed = graph.smooth(edges, vectors(spark, d), EMBEDDING_DIM, layers=2)
    long = smoothed.select("id", F.posexplode("vector").alias("dim", "value"))
    return long.withColumn("value", F.round("value", DIGITS))


def graph_nodes(spark, d):
    events = ev(spark, d)
    row = events.agg(F.max(USER) + 1, F.max(ITEM) + 1).first()
    return graph.graph_nodes(row[0], row[1], spark)


# --- negatives ------------------------------------------------------------------------


def negative_samples(spark, d):
    rows = cleaning.positives(labelled(spark, d))
    return negatives.negative_draws(train_of(rows), catalog(spark, d), 4, seed=42, observed=rows)


def negative_lists(spark, d):
    rows = cleaning.positives(labelled(spark, d))
    out = negatives.with_negatives(train_of(rows), catalog(spark, d), 4, seed=42, observed=rows)
    return out.select(ROW, USER, ITEM, joined("negatives"))


def candidate_rows(spark, d):
    rows = cleaning.positives(labelled(spark, d))
    out = negatives.with_negatives(train_of(rows), catalog(spark, d), 4, seed=42, observed=rows)
    return negatives.candidate_rows(out)


def candidate_metrics(spark, d):
    """Rank of the target among itself and its negatives by item popularity."""
    rows = cleaning.positives(labelled(spark, d))
    counts = models.item_counts(train_of(rows))
    test = rows.where(F.col(SPLIT) == "test")
    sampled = durable(negatives.with_negatives(test, catalog(spark, d), 4, seed=42, observed=rows), "sampled")
    scored = negatives.candidate_rows(sampled).join(counts, ITEM, "left").select(
        F.col(ROW).alias("query_id"), ITEM, F.coalesce("n", F.lit(0)).cast("double").alias("score")
    )
    queries = test.select(
        F.col(ROW).alias("query_id"), F.col(ITEM).alias("target_item_id"), F.array().cast("array<int>").alias("history")
    )
    return metric_rows(ranking.ranking_metrics(ranking.target_ranks(scored, queries), (1, 3)))


# --- ranking and models -------------------------------------------------------------------


def popularity_metrics(spark, d):
    """Flagship: deduplicate, split, label, rank by popularity, mask, and evaluate."""
    rows = labelled(spark, d)
    ranks = experiments.popularity_ranks(rows, catalog(spark, d))
    return metric_rows(ranking.ranking_metrics(ranks))


def popularity_ranks(spark, d):
    return experiments.popularity_ranks(labelled(spark, d), catalog(spark, d))


def popularity_prior(spark, d):
    prior = scoring.popularity_prior(models.item_counts(train_of(labelled(spark, d))))
    return prior.select(ITEM, rounded("bias"))


def top_items_per_user(spark, d):
    scores = ev(spark, d).groupBy(F.col(USER).alias("query_id"), ITEM).agg(F.round(F.sum(RATING), 4).alias("score"))
    top = ranking.top_k(scores, 10)
    return top.withColumn("rank_score", ranking.rank_score(F.col("rank"), 10))


def masked_top_items(spark, d):
    rows = labelled(spark, d)
    queries = durable(models.queries_of(rows), "queries")
    near = durable(models.item_neighbors(train_of(rows), 20), "neighbors")
    scores = ranking.mask_seen(models.neighbor_scores(queries, near), queries)
    scores = scores.withColumn("score", F.round("score", 9))
    return ranking.top_k(scores, 5).select("query_id", ITEM, "rank", rounded("score"))


def item_neighbors(spark, d):
    near = models.item_neighbors(train_of(labelled(spark, d)), 10)
    return near.select(ITEM, "neighbor_id", "rank", rounded("similarity"))


def item_cooccurrence(spark, d):
    pairs = durable(orders_view(spark, d).select(USER, ITEM).distinct(), "pairs")
    totals = [F.count(F.lit(1)).alias("n_neighbors"), F.sum("n").alias("n_shared"), F.max("n").alias("max_shared")]
    return models.cooccurrence(pairs, each=lambda cells: cells.groupBy(F.col("i").alias("idx")).agg(*totals))


def neighbor_metrics(spark, d):
    ranks = experiments.neighbor_ranks(labelled(spark, d), catalog(spark, d), n_neighbors=20)
    return metric_rows(ranking.ranking_metrics(ranks))


def transition_top(spark, d):
    top = models.transition_top(train_of(labelled(spark, d)), 10)
    return top.select("from_item", ITEM, "rank", rounded("probability"))


def transition_metrics(spark, d):
    ranks = experiments.transition_ranks(labelled(spark, d), catalog(spark, d))
    return metric_rows(ranking.ranking_metrics(ranks))


def model_comparison(spark, d):
    rows, items = labelled(spark, d), catalog(spark, d)
    out = experiments.evaluate(
        rows, items, ("popularity", "item-knn", "transition"),
        **{"item-knn": {"n_neighbors": 20}},
    )
    return metric_rows(out.drop("evaluation_protocol"), ("model",))


def _searched(spark, d):
    grid = {"n_neighbors": [5, 20], "history": [3, 50]}
    return experiments.search(labelled(spark, d), catalog(spark, d), "item-knn", grid, "ndcg@10")


def search_trials(spark, d):
    trials = _searched(spark, d)
    return trials.select("trial", "params", rounded("value"))


def best_trial(spark, d):
    return experiments.best_trial(_searched(spark, d)).select("trial", "params", rounded("value"))


def factor_metrics(spark, d):
    ranks = experiments.factor_ranks(labelled(spark, d), catalog(spark, d))
    return metric_rows(ranking.ranking_metrics(ranks))


def factor_ids(spark, d):
    """Factors over text ids: one vector of full width for each user and item with a positive training row."""
    rows = labelled(spark, d).withColumns({USER: F.concat(F.lit("U_"), USER), ITEM: F.concat(F.lit("C_"), ITEM)})
    users, items = models.factor_vectors(train_of(rows))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.size("vector").alias("width"))
    return named(users, "user").unionByName(named(items, "item"))


def vector_catalog_ranks(spark, d):
    """Target ranks of three models over the items that have a vector; orders also name other items, and users without one."""
    slices = min(USER_SLICES, max(1, table(spark, d, "lineitem").count() // SLICE_LINES))
    rows = labelled_splits(orders_view(spark, d), slices=slices)
    # Now that a user has an item once, order, line and part tell rows apart and order them as all fields do; the rest need not travel.
    rows = rows.withColumn(ROW, F.struct(*(F.col(f"{ROW}.{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey"))))
    items = vectors(spark, d)
    known = items.select(F.col("id").alias(ITEM))
    asked = models.queries_of(rows).join(items.withColumnRenamed("id", USER), USER, "left")
    asked = asked.withColumn("vector", F.coalesce("vector", V.zeros(EMBEDDING_DIM)))
    ranks = {
        "popularity": experiments.popularity_ranks(rows, known),
        "transition": experiments.transition_ranks(rows, known),
        "dot": scoring.catalog_target_ranks(asked, items, EMBEDDING_DIM),
    }
    # One model after the other is written, so only one model's shuffles lie on disk.
    out = [
        durable(r.select(F.lit(m).alias("model"), "query_id.l_orderkey", "query_id.l_linenumber", "query_id.l_partkey", F.col("rank").cast("long").alias("rank")), "ranks")
        for m, r in ranks.items()
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _encoded(df, roles, key, text_dim=32):
    """Feature vectors of a table by ``key`` and what they hold."""
    encoder = encoding.FeatureEncoder(roles, key, text_dim=text_dim).fit(df)
    found = encoder.vector(encoder.transform(df)).withColumnRenamed(key, "id")
    return experiments.Features(found, encoder.layout())


def variant_metrics(spark, d):
    """All variants and seeds of the hybrid scorer, with features of customers and parts and the kind of event as context."""
    rows = durable(labelled(spark, d), "labelled")
    n_users, n_items = ev(spark, d).agg(F.max(USER) + 1, F.max(ITEM) + 1).first()
    users = table(spark, d, "customer").withColumn("c_custkey", F.col("c_custkey").cast("long"))
    things = parts(spark, d).withColumn("p_partkey", F.col("p_partkey").cast("long"))
    return experiments.run_variants(
        rows, n_users, n_items,
        user_features=_encoded(users, {"num": ["c_acctbal"], "cat": ["c_mktsegment"]}, "c_custkey"),
        item_features=_encoded(things, PART_ROLES, "p_partkey"),
        context=_encoded(rows, {"cat": ["event_type"]}, ROW),
    )


def dot_top_k(spark, d):
    items = vectors(spark, d)
    queries = items.select(F.col("id").alias("query_id"), "vector", F.array("id").alias("history"))
    top = scoring.catalog_top_k(queries, items, EMBEDDING_DIM, 10)
    return top.select("query_id", ITEM, "rank", rounded("score"))


def dot_target_ranks(spark, d):
    """Rank of the vector with the next id, in the order of similarity."""
    items = vectors(spark, d)
    last = items.agg(F.max("id")).scalar()
    queries = items.select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") == last, F.lit(0)).otherwise(F.col("id") + 1).alias("target_item_id"),
        "vector",
        F.array("id").alias("history"),
    )
    return scoring.catalog_target_ranks(queries, items, EMBEDDING_DIM)


def candidate_scores(spark, d):
    pairs = ev(spark, d).select(USER, F.col(ITEM).cast("long").alias(ITEM)).distinct()
    items = vectors(spark, d)
    prior = scoring.popularity_prior(pairs.groupBy(ITEM).agg(F.count(F.lit(1)).alias("n")))
    scored = scoring.score_candidates(pairs, items, items, EMBEDDING_DIM, bias=prior)
    return scored.select(USER, ITEM, rounded("score"))


def history_vectors(spark, d):
    queries = models.queries_of(labelled(spark, d))
    means = fusion.history_vectors(durable(queries, "queries"), vectors(spark, d), EMBEDDING_DIM, decay=0.9)
    return means.select("query_id", "available", F.round(V.total(F.col("vector")), DIGITS).alias("total"),
                        F.round(V.norm(F.col("vector")), DIGITS).alias("length"))


def _two_sources(spark, d):
    left = vectors(spark, d).withColumnRenamed("vector", "a")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return left.join(labels, "id").withColumn("b", F.reverse("a"))


def masked_fusion(spark, d):
    rows = _two_sources(spark, d)
    fused = fusion.masked_fusion(
        [F.col("a"), F.col("b")], [F.col("label") % 3 != 0, F.col("label") % 2 == 0], [0.0, 1.0], EMBEDDING_DIM
    )
    long = rows.select("id", F.posexplode(fused).alias("dim", "value"))
    return long.withColumn("value", F.round("value", DIGITS))


def sum_fusion(spark, d):
    rows = _two_sources(spark, d)
    long = rows.select("id", F.posexplode(fusion.sum_fusion([F.col("a"), F.col("b")])).alias("dim", "value"))
    return long.withColumn("value", F.round("value", DIGITS))


def unit_vectors(spark, d):
    long = vectors(spark, d).select("id", F.posexplode(V.l2_normalize(F.col("vector"))).alias("dim", "value"))
    return long.withColumn("value", F.round("value", DIGITS))


# --- features --------------------------------------------------------------------------


PART_ROLES = {"num": ["p_size", "p_retailprice"], "cat": ["p_brand", "p_type"], "list": ["words"], "text": ["p_name"]}


def parts(spark, d):
    return table(spark, d, "part").withColumn("words", F.replace("p_type", F.lit(" "), F.lit("|")))


def encode_numeric(spark, d):
    df, columns = parts(spark, d), PART_ROLES["num"]
    stats = encoding.fit_numeric(df, columns).collect()
    return df.select("p_partkey", *encoding.encode_numeric(columns, stats)).select(
        "p_partkey", rounded("num__p_size"), rounded("num__p_retailprice")
    )


def encode_categories(spark, d):
    df, columns = parts(spark, d), PART_ROLES["cat"]
    # Codes are fitted on the parts above the mean size; the others may hold new values.
    fitted = encoding.fit_categories(df.where(F.col("p_size") >= df.agg(F.avg("p_size")).scalar()), columns)
    return encoding.encode_categories(df, columns, fitted).select("p_partkey", "cat__p_brand", "cat__p_type")


def category_cardinalities(spark, d):
    return encoding.cardinalities(encoding.fit_categories(parts(spark, d), PART_ROLES["cat"]))


def encode_lists(spark, d):
    df = parts(spark, d)
    words = durable(encoding.fit_vocabulary(df, ["words"]), "words")
    coded = encoding.encode_lists(df, ["words"], words)
    flags = encoding.dense_list(F.col("list__words"), encoding.vocabulary_sizes(words).get("words", 0))
    bits = F.array_join(F.transform(flags, lambda x: x.cast("int").cast("string")), "")
    return coded.select("p_partkey", bits.alias("bits"))


def feature_vectors(spark, d):
    roles = {k: v for k, v in PART_ROLES.items() if k != "text"}
    encoder = encoding.FeatureEncoder(roles, "p_partkey").fit(parts(spark, d))
    rows = encoder.vector(encoder.transform(parts(spark, d)))
    return rows.select("p_partkey", F.posexplode("features").alias("place", "value")).select(
        "p_partkey", "place", F.round(F.col("value").cast("double"), 4).alias("value")
    )


def feature_metadata(spark, d):
    encoder = encoding.FeatureEncoder({k: v for k, v in PART_ROLES.items() if k != "text"}, "p_partkey").fit(parts(spark, d))
    return encoder.metadata("items", spark)


def text_vectors(spark, d):
    docs = texts(spark, d, "documents").withColumn("document", text_document(["text"]))
    encoder = encoding.HashedTextEncoder(64)
    docs = durable(encoder.counted(docs).select("doc_id", encoding.COUNTS), "text-counts")
    rows = encoder.fit(docs).transform(docs).select("doc_id", F.posexplode("text").alias("dim", "value"))
    return rows.where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), DIGITS))


def passthrough(spark, d):
    """Dense ids fitted on customers and training rows; unknown items become -1."""
    rows = labelled(spark, d)
    train = train_of(rows)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias(USER))
    users = ids.first_seen_ids(customers, F.col(USER), train, F.col(ROW), USER)
    some = train.where(F.col(ITEM) % 2 == 0)
    items = ids.first_seen_ids(some.select(ITEM), F.col(ITEM), some, F.col(ROW), ITEM)
    out = encoding.encode_passthrough(rows.drop("event_type", SPLIT), users, items)
    return out.select(ROW, USER, ITEM, F.col(RATING).alias(RATING), RELEVANT, TIME)


def first_seen_ids(spark, d):
    """Ids of an entity table that lacks some users (here by nation), then of the users that only events name."""
    events = ev(spark, d)
    customers = table(spark, d, "customer").where("c_nationkey < 13").select(F.col("c_custkey").alias(USER))
    return ids.first_seen_ids(customers, F.col(USER), events, F.col(ROW), USER)


def translated_ids(spark, d):
    events = ev(spark, d).select(F.col(ITEM).alias("id"), ROW)
    tokens = events.select("id").distinct().withColumn("token", F.concat(F.lit("C_"), F.col("id").cast("string")))
    numbered = ids.catalog_index(tokens, "token").select(F.col("idx").alias("id"), "token")
    left = tokens.select(F.col("id").cast("long").alias("id"), "token")
    return ids.translate_ids(events.withColumn("id", F.col("id").cast("long")), left, numbered)


# --- text and scalar functions ------------------------------------------------------------


def clean_pages(spark, d):
    return texts(spark, d, "pages").select("page_id", clean_text(F.col("html")).alias("text"))


def clean_documents(spark, d):
    return texts(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def text_documents(spark, d):
    df = table(spark, d, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    return df.select("p_partkey", text_document(["p_name", "p_brand", "p_type"]).alias("document"))


def list_forms(spark, d):
    """Part words written as a list literal, with three separators, and plain."""
    words = F.split("p_name", " ")
    literal = F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']"))
    form = F.pmod(F.length("p_name"), F.lit(5))
    listed = F.when(form == 0, literal)
    for i, sign in enumerate((", ", ";", " | ")):
        listed = listed.when(form == i + 1, F.array_join(words, sign))
    return table(spark, d, "part").select("p_partkey", listed.otherwise(F.col("p_name")).alias("written"))


def list_values(spark, d):
    tokens = list_tokens(F.col("written"))
    return list_forms(spark, d).select("p_partkey", F.array_join(tokens, "/").alias("tokens"))


def flattened_lists(spark, d):
    return list_forms(spark, d).select("p_partkey", flatten_list_text(F.col("written")).alias("plain"))


def categories(spark, d):
    from rankloom.functions.text import category

    padded = F.concat(F.lit("  "), F.nullif("p_brand", F.lit("Brand#11")), F.lit("\t"))
    blank = F.when(F.col("p_size") < 5, F.lit(" \n ")).otherwise(padded)
    return table(spark, d, "part").select("p_partkey", category(blank).alias("value"))


def academic_years(spark, d):
    orders = table(spark, d, "orders")
    year = F.year("o_orderdate")
    text = F.concat(F.substring(year.cast("string"), 3, 2), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2))
    written = F.when(F.col("o_orderstatus") == "P", F.lit("unknown")).otherwise(text)
    counted = orders.select(academic_year(written).alias("year"))
    return counted.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def valid_times(spark, d):
    """Times as text, with one event type made invalid and one negative."""
    events = table(spark, d, "events")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(text)
    text = F.when(F.col("event_type") == "signup", F.lit("1960-05-01 00:00:00")).otherwise(text)
    rows = events.select("event_id", text.alias(TIME))
    return datasets.valid_times(rows, non_negative=True)


def numbers(spark, d):
    """Text coerced to numbers; text that is none becomes null."""
    written = F.when(F.col("p_size") < 10, F.col("p_brand")).otherwise(F.col("p_retailprice").cast("string"))
    rows = table(spark, d, "part").select(cleaning.number(written).alias("value"))
    return rows.groupBy((F.col("value").isNull()).alias("is_null")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


def display_names(spark, d):
    df = table(spark, d, "part").select("p_type", "p_brand").distinct()
    return df.select(
        "p_type", "p_brand", N.safe_name(F.concat_ws("##", "p_brand", "p_type")).alias("safe"),
        N.dataset_label(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("label"),
    )


def ordered_places(spark, d):
    order = ["purchase", "signup", "click"]
    counted = ev(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("event_type", "n", N.place_in(F.col("event_type"), order).cast("int").alias("place"))


# --- source operators ----------------------------------------------------------------------


def class_counts(spark, d):
    classes = {"click": "num_clicks", "view": "num_views", "purchase": "num_purchases", "refund": "num_refunds"}
    return datasets.class_counts(ev(spark, d), ITEM, "event_type", classes)


def entity_stats(spark, d):
    teach = table(spark, d, "lineitem").select(F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("instructor_id"))
    people = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("instructor_id"), F.col("s_acctbal").alias("total_enrollments"),
        F.col("s_nationkey").alias("total_reviews"),
    )
    stats = datasets.instructor_stats(teach, people)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("course_id"), "p_name")
    wide = parts.join(stats, "course_id", "left").fillna(0, ["num_instructors", "instructor_enrollments", "instructor_reviews"])
    return wide.select(
        "course_id", "p_name", "num_instructors", F.round("instructor_enrollments", 2).alias("instructor_enrollments"),
        F.round("instructor_reviews", 2).alias("instructor_reviews"),
    )


def _students(spark, d):
    """Documents as student records: word lengths as courses, derived dates as times."""
    docs = texts(spark, d, "documents")
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    date = lambda n: F.when(n % 7 == 0, F.lit("none")).otherwise(
        F.concat(F.lit("20"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("-01-01 00:00:00"))
    )
    times = F.transform("course_order", date)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), lengths.alias("course_order"), "n_chars", "lang")
    short = F.slice(times, 1, F.size("course_order") - 1)
    return rows.select(
        "id", F.col("lang").alias("gender"), F.lit(None).cast("string").alias("school"),
        F.lit(None).cast("string").alias("year_of_birth"), "course_order",
        F.when((F.col("n_chars") % 10 == 3) & (F.size("course_order") > 1), short).otherwise(times).alias("enroll_time"),
    )


def _enrollment_counts(events):
    return events.groupBy(ITEM).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(USER).alias("n_users"), F.min(TIME).alias("time")
    )


def enrollment_events(spark, d):
    students = durable(_students(spark, d), "students")
    return _enrollment_counts(datasets.enrollments(students, F.col("id")))


def stream_enrollments(spark, d):
    """The same events, read as a stream from JSON Lines files."""
    folder = durable_path(spark, "students")
    _students(spark, d).write.json(folder)
    stream = ingest.stream_enrollments(spark, folder).select(USER, ITEM, TIME)
    return _enrollment_counts(ingest.run_available(stream, label="enrollments"))


def csv_scan(spark, d):
    """Two CSV files per logical table, read back by name and united."""
    customers = table(spark, d, "customer")
    folder = durable_path(spark, "csv")
    paths = []
    for name, rule in (("low", "c_nationkey < 12"), ("high", "c_nationkey >= 12")):
        paths.append(f"{folder}/{name}")
        customers.where(rule).write.option("header", True).csv(paths[-1])
    back = datasets.read_csv(spark, paths, "c_custkey, c_mktsegment, c_acctbal")
    back = back.select("c_custkey", "c_mktsegment", cleaning.number(F.col("c_acctbal")).alias("c_acctbal"))
    return cleaning.clean_columns(back.withColumnRenamed("c_mktsegment", " Market Segment! ")).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "market_segment", "c_acctbal"
    )


def capped_rows(spark, d):
    """The row-capped scan: the first 500 events in source order, which is the feature."""
    return datasets.capped(ev(spark, d), 500).select(ROW, USER, ITEM)


def first_per_id(spark, d):
    return datasets.first_per_id(ev(spark, d).select(USER, ITEM, "event_type", ROW), USER)


# --- exports ---------------------------------------------------------------------------


def atomic_frame(spark, d):
    df = table(spark, d, "part").select(
        F.col("p_partkey").alias(ITEM),
        F.nullif("p_brand", F.lit("Brand#11")).alias("Brand Name"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("2 price"),
        F.substring("p_brand", 7, 2).alias("brand-name"),
    )
    return artifacts.atomic_frame(df, {"Brand Name", "brand-name", "size"}, "item")


def atomic_export(spark, d):
    """Positive interactions written as typed TSV per split and read back."""
    rows = labelled(spark, d)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias(USER), "c_acctbal", "c_mktsegment")
    items = table(spark, d, "part").select(F.col("p_partkey").alias(ITEM), "p_size")
    written = artifacts.save_atomic(
        durable_path(spark, "atomic"), "ev", rows, people, items, {"inter": {"event_type"}, "user": {"c_mktsegment"}}
    )
    out = None
    for kind in ("train.inter", "valid.inter", "test.inter"):
        part = artifacts.read_tsv(spark, written[kind]).select(F.lit(kind).alias("file"), "*")
        out = part if out is None else out.unionByName(part)
    return out.select(
        "file", F.col("`user_id:token`").alias("user_token"), F.col("`item_id:token`").alias("item_token"),
        F.col("`inter_event_type:token`").alias("event_token"), F.col("`relevant:float`").cast("double").alias("relevant"),
    )


def prepared_tables(spark, d):
    """Split table saved with its manifest and read back by split."""
    rows = labelled(spark, d)
    folder = durable_path(spark, "prepared")
    features = rows.select(USER).distinct()
    tables = {"interactions": rows, "user_features": features, "item_features": rows.select(ITEM).distinct()}
    artifacts.save_prepared(folder, tables, {"random_state": 42})
    if not artifacts.prepared_exists(spark, folder, {"random_state": 42}):
        raise RuntimeError("prepared folder is incomplete")
    back = artifacts.load_prepared(spark, folder)["interactions"]
    return back.groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("n"), F.sum(RELEVANT).alias("n_relevant"), F.countDistinct(USER).alias("n_users")
    )


def latest_artifacts(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("lang").alias("dataset"), F.col("source").alias("name"), F.col("n_chars").alias("modified"),
        F.col("doc_id").alias("path"), (F.col("n_chars") > 100).alias("has_model"), F.lit(True).alias("has_metadata"),
    )
    newest = artifacts.latest_artifact(docs.withColumn("modified", F.struct("modified", "path")))
    return newest


def stored_results(spark, d):
    """Metric rows stored per dataset, model and seed, then read back under the protocol."""
    folder = durable_path(spark, "results")
    artifacts.save_results(wide_results(spark, d), folder)
    back = artifacts.load_results(spark, folder)
    return back.select("dataset", F.col("model").cast("string").alias("model"), F.col("seed").cast("int").alias("seed"),
                       rounded("hit@10"), rounded("mrr@10"))


def metric_files(spark, d):
    """CSV results, one folder per dataset, read back with the folder as the dataset."""
    folder = durable_path(spark, "metric-files")
    wide_results(spark, d).write.partitionBy("dataset").option("header", True).csv(folder)
    back = artifacts.load_metric_files(spark, f"{folder}/*/*.csv")
    back = back.withColumn("dataset", F.regexp_replace("dataset", "^dataset=", ""))
    long = S.long_results(back, 10)
    return long.select("dataset", F.col("seed").cast("int").alias("seed"), "model", "metric", rounded("value"))


def prepared_interactions(spark, d):
    """The whole preparation of a bundle: k-core, split, labels, ids, histories."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias(USER), "c_mktsegment", "c_acctbal")
    items = table(spark, d, "part").select(F.col("p_partkey").alias(ITEM), "p_brand", "p_size")
    kinds = datasets.roles({"cat": ["c_mktsegment"], "num": ["c_acctbal"]}, {"cat": ["p_brand"], "num": ["p_size"]}, {"cat": ["event_type"]})
    done = prepare(datasets.Bundle(ev(spark, d), items, customers, kinds), seed=42)
    return done.rows.select(ROW, USER, ITEM, SPLIT, F.col("cat__event_type").alias("event_code"), joined("history"))


def prepared_features(spark, d):
    """Feature vectors of the same preparation, by dense user id."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias(USER), "c_mktsegment", "c_acctbal")
    items = table(spark, d, "part").select(F.col("p_partkey").alias(ITEM), "p_brand", "p_size")
    kinds = datasets.roles({"cat": ["c_mktsegment"], "num": ["c_acctbal"]}, {"cat": ["p_brand"], "num": ["p_size"]})
    done = prepare(datasets.Bundle(ev(spark, d), items, customers, kinds), seed=42)
    wide = artifacts.feature_columns(done.user_features, "idx", ["balance", "segment"])
    return wide.select("idx", F.round(F.col("balance").cast("double"), 4).alias("balance"), F.col("segment").cast("int").alias("segment"))


# --- experiment tables ----------------------------------------------------------------------


def wide_results(spark, d):
    """Event values as results: type as dataset, item group as model, user group as seed."""
    return ev(spark, d).groupBy(
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("m"), F.pmod(ITEM, F.lit(5)).cast("string")).alias("model"),
        F.pmod(USER, F.lit(4)).cast("int").alias("seed"),
    ).agg(
        F.round(F.avg(RATING) / 100, 3).alias("hit@10"),
        F.round(F.avg(F.sqrt(RATING)) / 10, 2).alias("mrr@10"),
        F.round(F.max(RATING) / 1000, 3).alias("ndcg@5"),
    )


def long_results(spark, d):
    """Long results as a small written table, as stored results would be."""
    return durable(S.long_results(wide_results(spark, d), 10), "results")


def unpivoted_results(spark, d):
    return long_results(spark, d).select("dataset", "seed", "model", "metric", rounded("value"))


def seed_summary(spark, d):
    out = S.seed_summary(long_results(spark, d))
    return out.select("dataset", "model", "metric", rounded("mean"), rounded("std"), "n_seeds")


def summary_text(spark, d):
    out = S.summary_text(wide_results(spark, d), by=("dataset", "model"))
    return out.select("dataset", "model", *[F.col(f"`{m}@{k}`").alias(f"{m}_{k}") for m, k in (("hit", 10), ("mrr", 10), ("ndcg", 5))])


def summary_order(spark, d):
    ordered = S.sorted_summary(S.seed_summary(long_results(spark, d)), ["m3", "m1"])
    return ordered.select("dataset", "model", "metric", "n_seeds")


def pending_pairs(spark, d):
    wide = wide_results(spark, d)
    stored = wide.where("dataset = 'click' and `hit@10` > 0.49").withColumn(
        "evaluation_protocol", F.when(F.col("model") == "m0", "old").otherwise("one-target-per-interaction-v1")
    )
    return S.pending(wide, wide, stored).select("model", "seed")


def collected_results(spark, d):
    wide = wide_results(spark, d)
    stored = wide.withColumn("evaluation_protocol", F.when(F.col("model") == "m0", "old").otherwise("one-target-per-interaction-v1"))
    asked = wide.where("dataset = 'click' and `hit@10` > 0.49")
    return S.collected(stored, asked).select("dataset", "model", "seed", rounded("hit@10"))


def model_ranks(spark, d):
    block = ("metric", "dataset", "seed")
    ranks = S.model_ranks(S.complete_blocks(long_results(spark, d), block, ("metric",)), block)
    return ranks.select(*block, "model", rounded("value"), "rank")


def pivoted_results(spark, d):
    blocks = S.complete_blocks(long_results(spark, d), ("metric", "dataset", "seed"), ("metric",))
    wide = S.wide_blocks(blocks, ("metric", "dataset", "seed"), ["m0", "m1", "m2", "m3", "m4"])
    return wide.select("metric", "dataset", "seed", *[rounded(f"m{i}") for i in range(5)])


def mean_ranks(spark, d):
    return S.mean_ranks(model_ranks(spark, d)).select("dataset", "metric", "model", rounded("rank"))


def friedman(spark, d):
    by_metric = S.friedman(long_results(spark, d), ("dataset", "seed"), ("metric",))
    overall = S.friedman(long_results(spark, d), ("dataset", "seed", "metric"))
    out = by_metric.unionByName(overall.withColumn("metric", F.lit("all_metrics")))
    return out.select(
        "metric", "n_blocks", "n_models", rounded("friedman_statistic"), "best_model", rounded("best_rank")
    )


def friedman_report(spark, d):
    table_ = S.friedman(long_results(spark, d), ("dataset", "seed"), ("metric",))
    out = S.friedman_report(table_)
    return out.select(
        "metric", "n_blocks", "n_models", rounded("friedman_statistic"), "best_model", rounded("best_rank"),
        F.round("friedman_pvalue", 9).alias("friedman_pvalue"),
    )


def nemenyi(spark, d):
    out = S.nemenyi(long_results(spark, d), ("dataset", "seed"), ("metric",))
    return out.select("metric", "model", "other_model", rounded("rank_difference"), F.round("p_value", 9).alias("p_value"),
                      rounded("critical_distance"), "significant")


def relative_improvement(spark, d):
    out = S.relative_improvement(S.seed_summary(long_results(spark, d)), "m1")
    return out.select("dataset", "metric", "proposed_model", "baseline", rounded("proposed_value"), rounded("baseline_value"),
                      rounded("relative_improvement_percent"))


def improvement_named(spark, d):
    out = S.relative_improvement(S.seed_summary(long_results(spark, d)), "m1", "m3")
    return out.select("dataset", "metric", "baseline", rounded("relative_improvement_percent"))


def _runs(spark, d):
    names_ = F.lit(["full", "base", "no_graph", "no_sequence", "sum_fusion"])
    return ev(spark, d).groupBy(
        F.col("event_type").alias("dataset"),
        F.element_at(names_, F.pmod(ITEM, F.lit(5)) + 1).alias("variant"),
        F.pmod(USER, F.lit(4)).cast("int").alias("seed"),
    ).agg(F.round(F.avg(RATING) / 100, 4).alias("ndcg@10"), (F.max(F.pmod(ITEM, F.lit(5))) != 4).cast("int").alias("applicable"))


def importance(spark, d):
    out = S.importance(_runs(spark, d), "ndcg@10")
    return out.select("dataset", "variant", "component", rounded("importance_mean"), rounded("importance_std"), "n_seeds")


def importance_matrix(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    out = S.importance_matrix(S.importance(_runs(spark, d), "ndcg@10"), kinds)
    return out.select("component", *map(rounded, kinds))


# --- streams ---------------------------------------------------------------------------


def stream_history(spark, d):
    """Histories over all events as a stream with bounded state per user."""
    schema = table(spark, d, "events").schema
    source = ingest.stream_files(spark, d, schema, "parquet", "events.parquet")
    events = source.select(
        USER, F.get_json_object("props", "$.k").cast("bigint").alias(ITEM), seconds("ts").alias(TIME), F.col("event_id").alias(ROW)
    )
    done = ingest.run_available(stream_histories.stream_history(events, 10), label="history")
    return done.select(ROW, USER, ITEM, joined("history"))


def epoch(spark, d):
    text = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max(epoch_seconds(text)).alias("latest"))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dedup_latest, dedup_last_in_file, kcore, kcore_entities, split_temporal, split_random, relevance_labels,
        relevance_implicit, relevance_thresholds, dataset_profile, user_history, history_entries, padded_history,
        sequence_export, model_rows, batch_entities, interaction_graph, edge_dropout_view, graph_smooth, graph_nodes,
        negative_samples, negative_lists, candidate_rows, candidate_metrics, popularity_metrics, popularity_ranks,
        popularity_prior, top_items_per_user, masked_top_items, item_neighbors, item_cooccurrence, neighbor_metrics,
        transition_top, transition_metrics, model_comparison, search_trials, best_trial, factor_metrics,
        factor_ids, vector_catalog_ranks, variant_metrics, dot_top_k, dot_target_ranks, candidate_scores, history_vectors, masked_fusion, sum_fusion,
        unit_vectors, encode_numeric, encode_categories, category_cardinalities, encode_lists, feature_vectors,
        feature_metadata, text_vectors, passthrough, first_seen_ids, translated_ids, clean_pages, clean_documents,
        text_documents, list_values, flattened_lists, categories, academic_years, valid_times, numbers, display_names,
        ordered_places, class_counts, entity_stats, enrollment_events, stream_enrollments, csv_scan, capped_rows,
        first_per_id, atomic_frame, atomic_export, prepared_tables, latest_artifacts, stored_results, metric_files,
        prepared_interactions, prepared_features, unpivoted_results, pivoted_results, seed_summary, summary_text, summary_order, pending_pairs, collected_results, model_ranks,
        mean_ranks, friedman, friedman_report, nemenyi, relative_improvement, improvement_named, importance,
        importance_matrix, stream_history, epoch,
    )
}
