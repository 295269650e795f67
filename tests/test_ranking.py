import collections
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.columns import METRICS
from rankloom.functions import vectors as V
from rankloom.operators import encoding, fusion, models, ranking, scoring
from rankloom.operators.ids import catalog_index
from rankloom.plans import experiments
from rankloom.plans.preparation import labelled_splits
from rankloom.session import durable

N_USERS, N_ITEMS, DIM = 40, 37, 4


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    items = np.round(rng.normal(size=(N_ITEMS, DIM)), 1)
    items[5] = items[9]  # a tie
    users = np.round(rng.normal(size=(N_USERS, DIM)), 1)
    histories = [sorted(rng.choice(N_ITEMS, size=rng.integers(0, 8), replace=False).tolist()) for _ in range(N_USERS)]
    targets = rng.integers(0, N_ITEMS, size=N_USERS).tolist()
    return users, items, histories, targets


@pytest.fixture(scope="module")
def tables(spark, data):
    users, items, histories, targets = data
    q = [(i, [float(v) for v in users[i]], histories[i], targets[i]) for i in range(N_USERS)]
    queries = spark.createDataFrame(
        q, "query_id bigint, vector array<double>, history array<bigint>, target_item_id bigint"
    )
    catalog = spark.createDataFrame(
        [(i, [float(v) for v in items[i]]) for i in range(N_ITEMS)], "id bigint, vector array<double>"
    )
    return queries, catalog


def eligible(data, q):
    users, items, histories, targets = data
    scores = items @ users[q] / math.sqrt(DIM)
    rows = [(s, i) for i, s in enumerate(scores) if i == targets[q] or i not in histories[q]]
    return sorted(rows, key=lambda r: (-round(r[0], 9), r[1]))


SETTINGS = [{}, {"broadcast_bytes": 0, "block_items": 5, "chunk_queries": 7}]


@pytest.mark.parametrize("options", SETTINGS)
def test_catalog_top_k(tables, data, options):
    queries, catalog = tables
    got = {}
    for r in scoring.catalog_top_k(queries, catalog, DIM, 6, **options).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["item_id"], r["score"])
    for q in range(N_USERS):
        expected = eligible(data, q)[:6]
        assert [got[q][k + 1][0] for k in range(6)] == [i for _, i in expected]
        assert np.allclose([got[q][k + 1][1] for k in range(6)], [s for s, _ in expected])


@pytest.mark.parametrize("options", SETTINGS)
def test_catalog_target_ranks(tables, data, options):
    queries, catalog = tables
    got = {r["query_id"]: r["rank"] for r in scoring.catalog_target_ranks(queries, catalog, DIM, **options).collect()}
    for q in range(N_USERS):
        place = [i for _, i in eligible(data, q)].index(data[3][q]) + 1
        assert got[q] == place


def test_bias_moves_scores(tables, spark):
    queries, catalog = tables
    bias = spark.createDataFrame([(7, 100.0)], "item_id bigint, bias double")
    top = scoring.catalog_top_k(queries.drop("history", "target_item_id"), catalog, DIM, 1, bias=bias)
    assert {r["item_id"] for r in top.collect()} == {7}


def test_dense_and_sparse_target_ranks(spark, data):
    _, _, histories, targets = data
    rng = np.random.default_rng(2)
    scores = {(q, i): float(rng.integers(0, 4)) for q in range(N_USERS) for i in range(N_ITEMS)}
    rows = [(q, i, s) for (q, i), s in scores.items()]
    schema = "query_id bigint, item_id bigint, score double"
    queries = spark.createDataFrame(
        [(q, targets[q], histories[q]) for q in range(N_USERS)],
        "query_id bigint, target_item_id bigint, history array<bigint>",
    )
    expected = {}
    for q in range(N_USERS):
        open_items = [i for i in range(N_ITEMS) if i == targets[q] or i not in histories[q]]
        order = sorted(open_items, key=lambda i: (-scores[q, i], i))
        expected[q] = order.index(targets[q]) + 1
    dense = ranking.target_ranks(spark.createDataFrame(rows, schema), queries)
    assert {r["query_id"]: r["rank"] for r in dense.collect()} == expected
    index = catalog_index(spark.range(N_ITEMS).withColumnRenamed("id", "item_id"), "item_id")
    sparse = spark.createDataFrame([r for r in rows if r[2] > 0], schema)
    assert {r["query_id"]: r["rank"] for r in ranking.target_ranks(sparse, queries, index).collect()} == expected


def test_queries_with_only_seen_or_no_scored_items_keep_a_rank(spark):
    queries = spark.createDataFrame(
        [(1, 4, [2, 3]), (2, 4, []), (3, 0, [2]), (4, 2, [2])],
        "query_id int, target_item_id int, history array<int>",
    )
    schema = "query_id int, item_id int, score double"
    scores = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (3, 2, 1.0), (4, 2, 1.0), (4, 0, 3.0)], schema)
    index = catalog_index(spark.range(6).withColumnRenamed("id", "item_id"), "item_id")
    got = {r["query_id"]: r["rank"] for r in ranking.target_ranks(scores, queries, index).collect()}
    assert got == {1: 3, 2: 5, 3: 1, 4: 2}
    assert sorted(map(tuple, ranking.mask_seen(scores, queries).collect())) == [(4, 0, 3.0), (4, 2, 1.0)]


def test_unknown_targets_come_after_all_eligible_items(spark):
    """Target 9 is no item; item 7 of a history is none either. Queries in are ranks out."""
    queries = spark.createDataFrame([(1, 9, [2, 3, 2, 7]), (2, 9, []), (3, 4, [7])], "query_id int, target_item_id int, history array<int>")
    schema = "query_id int, item_id int, score double"
    scores = spark.createDataFrame([(1, 2, 1.0), (1, 0, 2.0), (3, 2, 1.0), (3, 4, 0.5)], schema)
    index = catalog_index(spark.range(6).withColumnRenamed("id", "item_id"), "item_id")
    ranks = lambda df: {r["query_id"]: r["rank"] for r in df.collect()}
    assert ranks(ranking.target_ranks(scores, queries, index)) == {1: 5, 2: 7, 3: 2}
    # Without a catalog only scored items count.
    assert ranks(ranking.target_ranks(scores, queries)) == {1: 2, 2: 1, 3: 2}


def test_pairs_without_vectors_keep_a_score(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (3, 1), (3, 2)], "user_id bigint, item_id bigint")
    vectors = spark.createDataFrame([(1, [2.0, 0.0])], "id bigint, vector array<double>")
    bias = spark.createDataFrame([(2, 0.5)], "item_id bigint, bias double")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in scoring.score_candidates(pairs, vectors, vectors, 2, 1.0, bias=bias).collect()}
    assert got == {(1, 1): 4.0, (1, 2): 0.5, (3, 1): 0.0, (3, 2): 0.5}


def test_every_evaluator_ranks_every_query(spark, labelled, items):
    """A catalog without most items: each model ranks all positive test rows, and unknown targets come last."""
    few = items.where("item_id < 6")
    queries = {r["query_id"]: r for r in models.queries_of(labelled).collect()}
    unknown = {q: 7 - len({i for i in r["history"] if i < 6}) for q, r in queries.items() if r["target_item_id"] >= 6}
    assert unknown and len(unknown) < len(queries)
    account = ranking.Account()
    table = experiments.evaluate(labelled, few, account=account, factors={"rank": 3, "iterations": 2}, **{"item-knn": {"n_neighbors": 5}})
    assert len(table.collect()) == 4
    assert account.rows() == dict.fromkeys(experiments.MODELS, len(queries))
    for name, options in (("popularity", {}), ("item-knn", {"n_neighbors": 5}), ("transition", {}), ("factors", {"rank": 3, "iterations": 2})):
        got = {r["query_id"]: r["rank"] for r in experiments.MODELS[name](labelled, few, **options).collect()}
        assert got.keys() == queries.keys() and {q: got[q] for q in unknown} == unknown
        assert all(1 <= got[q] <= 6 for q in queries if q not in unknown)
    with pytest.raises(ValueError):
        account.watch(labelled, "popularity")
    with pytest.raises(ValueError):
        experiments.hybrid_ranks(labelled, experiments.HybridConfig(), 12, 6, dim=4)
    # Users without a node keep their queries.
    assert experiments.hybrid_ranks(labelled, experiments.HybridConfig(), 0, 23, dim=4).count() == len(queries)


def test_factors_over_text_ids(labelled, items):
    """Text ids in the same order as the numbers give the same factors and ranks."""
    named = labelled.withColumns({"user_id": F.format_string("U_%03d", "user_id"), "item_id": F.format_string("C_%03d", "item_id")})
    users, things = models.factor_vectors(named.where("split = 'train'"), 3, 2, seed=1)
    plain_users, plain_things = models.factor_vectors(labelled.where("split = 'train'"), 3, 2, seed=1)
    for text, plain, sign in ((users, plain_users, "U"), (things, plain_things, "C")):
        expected = {f"{sign}_{r['id']:03d}": r["vector"] for r in plain.collect()}
        assert {r["id"]: r["vector"] for r in text.collect()} == expected
    ranks = lambda rows, known: {r["query_id"]: r["rank"] for r in experiments.factor_ranks(rows, known, rank=3, iterations=2).collect()}
    assert ranks(named, items.select(F.format_string("C_%03d", "item_id").alias("item_id"))) == ranks(labelled, items)


def test_scores_must_be_finite(spark):
    queries = spark.createDataFrame([(1, 1, [2])], "query_id int, target_item_id int, history array<int>")
    for bad in (float("nan"), float("inf"), None):
        scores = spark.createDataFrame([(1, 1, bad)], "query_id int, item_id int, score double")
        with pytest.raises(Exception, match="finite"):
            ranking.target_ranks(scores, queries).collect()


def test_query_checks(spark):
    good = spark.createDataFrame([(1, 0), (2, 4)], "query_id int, target_item_id int")
    ranking.check_queries(good, 5, 5)
    ranking.check_queries(good.limit(0), 5)
    for queries, items, k in ((good, 5, 6), (good, 5, 0), (good, 4, None), (good.union(good), 5, None)):
        with pytest.raises(ValueError):
            ranking.check_queries(queries, items, k)


def test_metrics_closed_forms(spark):
    ranks = spark.createDataFrame([(1,), (3,), (11,)], "rank int")
    row = ranking.ranking_metrics(ranks, (5, 20)).first().asDict()
    assert row["hit@5"] == row["recall@5"] == pytest.approx(2 / 3)
    assert row["precision@5"] == pytest.approx(2 / 3 / 5)
    assert row["ndcg@5"] == pytest.approx((1 + 1 / 2) / 3)
    assert row["map@20"] == row["mrr@20"] == pytest.approx((1 + 1 / 3 + 1 / 11) / 3)
    assert all(row[f"{m}@5"] <= row[f"{m}@20"] for m in METRICS if m != "precision")
    assert ranking.metrics_long(ranking.ranking_metrics(ranks, (5,))).count() == len(METRICS)


def test_top_k_ties_and_rank_scores(spark):
    scores = spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 9, 1.0)], "query_id int, item_id int, score double")
    top = ranking.top_k(scores, 2).select("item_id", "rank", ranking.rank_score(F.col("rank"), 2).alias("s"))
    assert sorted(map(tuple, top.collect())) == [(3, 1, 2), (5, 2, 1)]


# --- models ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(events):
    return durable(labelled_splits(events), "ranking-labelled")


@pytest.fixture(scope="module")
def items(labelled):
    return labelled.select("item_id").distinct()


def brute_ranks(labelled, items, score, split="test"):
    """Ranks from a full scan of the catalog; ``score(history, item)``."""
    rows = sorted(
        (r.asDict() for r in labelled.where("relevant > 0").collect()),
        key=lambda r: (math.inf if r["timestamp"] is None else r["timestamp"], r["row_id"]),
    )
    catalog, past, out = sorted(r[0] for r in items.collect()), {}, {}
    for r in rows:
        history = past.setdefault(r["user_id"], [])
        if r["split"] == split:
            last = history[-50:]
            order = sorted(
                (i for i in catalog if i == r["item_id"] or i not in last), key=lambda i: (-score(last, i), i)
            )
            out[r["row_id"]] = order.index(r["item_id"]) + 1
        history.append(r["item_id"])
    return out


def train_rows(labelled):
    return [r.asDict() for r in labelled.where("relevant > 0 and split = 'train'").collect()]


def test_popularity(labelled, items):
    counts = {}
    for r in train_rows(labelled):
        counts[r["item_id"]] = counts.get(r["item_id"], 0) + 1
    got = {r["query_id"]: r["rank"] for r in experiments.popularity_ranks(labelled, items).collect()}
    assert got == brute_ranks(labelled, items, lambda h, i: counts.get(i, 0)) and got


@pytest.mark.parametrize("options", [{}, {"block": 4, "users_per_salt": 3, "stripe_blocks": 2}, {"block": 4, "users_per_salt": 9}, {"block": 1}])
@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_neighbors(labelled, options, dense, monkeypatch):
    # Driver globals travel with the functions that read them.
    monkeypatch.setattr(models, "DENSE_CELLS", dense)
    monkeypatch.setattr(models, "PAIRS_AT_ONCE", 50 if not dense else 1 << 22)
    users = {}
    for r in train_rows(labelled):
        users.setdefault(r["item_id"], set()).add(r["user_id"])
    expected = {}
    for i in users:
        near = [(len(users[i] & users[j]) / math.sqrt(len(users[i]) * len(users[j])), j) for j in users if j != i]
        near = sorted([(s, j) for s, j in near if s > 0], key=lambda t: (-t[0], t[1]))[:3]
        expected.update({(i, k + 1): (j, s) for k, (s, j) in enumerate(near)})
    rows = models.item_neighbors(labelled.where("split = 'train'"), 3, **options).collect()
    got = {(r["item_id"], r["rank"]): (r["neighbor_id"], r["similarity"]) for r in rows}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k][0] == expected[k][0] and got[k][1] == pytest.approx(expected[k][1])


def test_neighbor_model_end_to_end(labelled, items):
    near = {}
    for r in models.item_neighbors(labelled.where("split = 'train'"), 5).collect():
        near.setdefault(r["item_id"], {})[r["neighbor_id"]] = r["similarity"]
    score = lambda h, i: round(sum(near.get(x, {}).get(i, 0.0) for x in set(h)), 9)
    got = {r["query_id"]: r["rank"] for r in experiments.neighbor_ranks(labelled, items, n_neighbors=5).collect()}
    assert got == brute_ranks(labelled, items, score)


@pytest.mark.parametrize("hot_rows", [10_000, 4])
def test_transitions(labelled, hot_rows):
    counts, last = {}, {}
    for r in sorted(train_rows(labelled), key=lambda r: (math.inf if r["timestamp"] is None else r["timestamp"], r["row_id"])):
        if r["user_id"] in last:
            step = (last[r["user_id"]], r["item_id"])
            counts[step] = counts.get(step, 0) + 1
        last[r["user_id"]] = r["item_id"]
    got = models.transition_counts(labelled.where("split = 'train'"), hot_rows=hot_rows).collect()
    assert {(r["from_item"], r["item_id"]): r["n"] for r in got} == counts
    with pytest.raises(ValueError):
        models.transition_counts(labelled.drop("timestamp"))


def test_evaluate_runs_all_models_on_the_same_queries(labelled, items):
    rows = experiments.evaluate(labelled, items, factors={"rank": 3, "iterations": 2}).collect()
    assert [r["model"] for r in rows] == list(experiments.MODELS)
    assert all(0 <= r["hit@5"] <= r["hit@20"] <= 1 for r in rows)
    no_time = experiments.evaluate(labelled.drop("timestamp"), items, ("popularity", "transition")).collect()
    assert [r["model"] for r in no_time] == ["popularity"]


def test_shared_trials_equal_trials_on_their_own(labelled, items):
    trials = [{"n_neighbors": n, "history": h} for n in (1, 4) for h in (1, 3, 50)]
    got = {}
    for r in experiments.neighbor_trials(labelled, items, trials, "val").collect():
        got.setdefault(r["trial"], {})[r["query_id"]] = r["rank"]
    for number, t in enumerate(trials):
        near = {}
        for r in models.item_neighbors(labelled.where("split = 'train'"), t["n_neighbors"]).collect():
            near.setdefault(r["item_id"], {})[r["neighbor_id"]] = r["similarity"]
        score = lambda h, i: round(sum(near.get(x, {}).get(i, 0.0) for x in set(h[-t["history"] :])), 9)  # noqa: B023,E731
        assert got[number] == brute_ranks(labelled, items, score, "val")
    assert got[2] == {r["query_id"]: r["rank"] for r in experiments.neighbor_ranks(labelled, items, "val", 1).collect()}
    rows = experiments.search(labelled, items, "item-knn", {"n_neighbors": [1, 4], "history": [1, 50]}, "ndcg@5").collect()
    assert sorted(r["trial"] for r in rows) == [0, 1, 2, 3] and rows[0]["params"].startswith('{"n_neighbors":')


def test_blocks_of_short_vectors_are_passed_over():
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(3000, 8)) * rng.exponential(size=(3000, 1)) ** 2
    ids, bias = np.arange(3000) * 3, np.zeros(3000)
    part = pd.DataFrame({"query_id": range(40), "vector": list(rng.normal(size=(40, 8)))})
    blocks = scoring._pruned_blocks(ids, matrix, bias, 100)
    vectors = np.stack(part["vector"])
    kth, found, computed = scoring.pruned_top_k(part, blocks, 10, 1.0, np.full(40, 1e-9))
    scores = vectors @ matrix.T
    assert computed < 0.5 * scores.size
    assert np.allclose(kth, np.sort(scores, 1)[:, -10])
    rows, names = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    for q in range(40):
        assert set(ids[np.argsort(-scores[q])[:10]]) <= set(names[rows == q])


def test_zero_vectors_are_ranked_by_bias_without_scores(monkeypatch):
    rng = np.random.default_rng(9)
    ids, bias = np.arange(300) * 2, rng.integers(0, 5, 300).astype(float)
    matrix = rng.normal(size=(300, 8))
    targets = rng.choice([*ids, 601], 50)
    histories = [rng.choice([*ids, 7], 12).tolist() for _ in range(50)]
    score = dict(zip(ids.tolist(), bias))
    part = pd.DataFrame({"query_id": range(50), "vector": list(np.zeros((50, 8))), "target_item_id": targets, "history": histories})
    part["target_score"] = [score.get(t, -np.inf) for t in targets.tolist()]
    blocks = scoring._pruned_blocks(ids, matrix, bias, 64)
    expected = [
        sum((-b, i) < (-own, t) for i, b in score.items() if i != t and i not in h)
        for t, own, h in zip(targets.tolist(), part["target_score"], histories)
    ]
    monkeypatch.setattr(scoring, "_products", lambda *a: pytest.fail("a score was computed"))
    got = pd.concat(scoring._count_step(part, blocks, 0, 1.0))
    assert got["above"].tolist() == expected


def test_ties_leave_k_cells_a_query():
    rng = np.random.default_rng(10)
    matrix = np.repeat(rng.normal(size=(3, 8)), 400, axis=0)
    ids, asked = rng.permutation(1200), rng.normal(size=(20, 8))
    order = np.argsort(ids)
    blocks = scoring._pruned_blocks(ids[order], matrix[order], np.zeros(1200), 100)
    part = pd.DataFrame({"query_id": range(20), "vector": list(asked)})
    kth, found, _ = scoring.pruned_top_k(part, blocks, 10, 1.0, np.full(20, 1e-9))
    rows, names = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    assert len(rows) == 200
    kind = (asked @ matrix[::400].T).argmax(1)
    for q in range(20):
        assert sorted(names[rows == q]) == sorted(ids[kind[q] * 400 : kind[q] * 400 + 400])[:10]


def test_search_keeps_the_best_trial(labelled, items):
    trials = experiments.search(labelled, items, "item-knn", {"n_neighbors": [1, 4]}, "ndcg@5")
    rows = trials.collect()
    best = experiments.best_trial(trials).first()
    assert len(rows) == 2 and best["value"] == max(r["value"] for r in rows) and best["trial"] == rows[0]["trial"]


# --- vectors and fusion ---------------------------------------------------------------------


def one(spark, column, **cols):
    df = spark.range(1)
    for name, value in cols.items():
        df = df.withColumn(name, F.lit(value).cast("array<double>") if value is not None else F.lit(None).cast("array<double>"))
    return df.select(column).first()[0]


def layer_norm(x):
    x = np.asarray(x)
    return (x - x.mean()) / np.sqrt(x.var() + 1e-5)


def test_vector_functions(spark):
    v = [3.0, 4.0, 0.0]
    assert np.allclose(one(spark, V.l2_normalize(F.col("v")), v=v), [0.6, 0.8, 0])
    assert one(spark, V.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert np.allclose(one(spark, V.layer_norm(F.col("v")), v=v), layer_norm(v))
    assert one(spark, V.dot(F.col("v"), F.col("w")), v=v, w=[1.0, 2.0, 5.0]) == 11.0


def test_masked_fusion(spark):
    a, b = [1.0, 2.0, 4.0], [5.0, -1.0, 0.0]
    both = fusion.masked_fusion([F.col("a"), F.col("b")], [F.lit(True), F.lit(True)], [0.0, 1.0], 3)
    w = np.exp([0.0, 1.0]) / np.exp([0.0, 1.0]).sum()
    assert np.allclose(one(spark, both, a=a, b=b), layer_norm(w[0] * layer_norm(a) + w[1] * layer_norm(b)))
    only = fusion.masked_fusion([F.col("a"), F.col("b")], [F.lit(True), F.col("b").isNotNull()], dim=3)
    assert np.allclose(one(spark, only, a=a, b=None), layer_norm(layer_norm(a)))
    none = fusion.masked_fusion([F.col("a")], [F.lit(False)], dim=3)
    assert one(spark, none, a=a) == [0.0, 0.0, 0.0]
    assert one(spark, fusion.sum_fusion([F.col("a"), F.col("b")]), a=a, b=b) == [6.0, 1.0, 4.0]


def test_history_vectors(spark):
    queries = spark.createDataFrame([(1, [0, 1]), (2, [])], "query_id int, history array<bigint>")
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id bigint, vector array<double>")
    got = {r["query_id"]: r for r in fusion.history_vectors(queries, table, 2, decay=0.5).collect()}
    assert np.allclose(got[1]["vector"], [1 / 3, 2 / 3]) and got[1]["available"]
    assert got[2]["vector"] == [0.0, 0.0] and not got[2]["available"]


# --- variants -------------------------------------------------------------------------------


def test_has_history(spark):
    rows = spark.createDataFrame([([],), ([1],)], "history array<int>")
    assert experiments.has_history(rows) and not experiments.has_history(rows.limit(0))
    assert not experiments.has_history(spark.createDataFrame([([],)], "history array<int>"))


def test_variants_and_availability():
    rich = experiments.Availability(3, 3, 1, 1, 1, True)
    bare = experiments.Availability()
    assert len(experiments.VARIANTS) == 13
    # Nothing is learned here: loss terms and the scorer's kind change no score.
    never = {"no_gcl", "dot_product"}
    off = lambda data: {v for v in experiments.VARIANTS if not experiments.applicable(v, data)}
    assert off(rich) == never
    assert off(experiments.Availability(1, 3, 0, 0, 1, True)) == never | {"no_text"}
    assert off(experiments.Availability(1, 3, 1, 1, 0, True)) == never | {"no_context"}
    assert off(bare) == never | {"no_features", "no_user_features", "no_item_features", "no_text", "no_sequence", "no_context"}
    assert experiments.modules(experiments.variant("no_graph"), rich)["graph"] is False
    assert experiments.variant("base").fusion_type == "sum"
    with pytest.raises(ValueError):
        experiments.variant("nothing")


def test_factor_ranks_follow_the_factors(labelled, items):
    train = labelled.where("split = 'train'")
    users, things = models.factor_vectors(train, 3, 2, seed=1)
    u = {r["id"]: np.array(r["vector"]) for r in users.collect()}
    v = {r["id"]: np.array(r["vector"]) for r in things.collect()}
    owner = {r["row_id"]: r["user_id"] for r in labelled.collect()}
    got = {r["query_id"]: r["rank"] for r in experiments.factor_ranks(labelled, items, rank=3, iterations=2, seed=1).collect()}
    zero = np.zeros(3)
    assert got
    for query, rank in got.items():
        score = lambda h, i: float(u.get(owner[query], zero) @ v.get(i, zero))  # noqa: B023,E731
        assert brute_ranks(labelled, items, score)[query] == rank


def brute_hybrid(labelled, config, dim, seed, n_users=12, n_items=23):
    import hashlib

    def start(i):
        hexes = [hashlib.md5(f"{seed}|{i}|{b}".encode()).hexdigest() for b in range((dim + 3) // 4)]
        bits = [int(hexes[j // 4][j % 4 * 8 : j % 4 * 8 + 8], 16) % 2 for j in range(dim)]
        return [(1 if b == 0 else -1) / math.sqrt(dim) for b in bits]

    x = np.array([start(i) for i in range(n_users + n_items)])
    a = np.zeros((len(x), len(x)))
    for r in train_rows(labelled):
        a[r["user_id"], n_users + r["item_id"]] = a[n_users + r["item_id"], r["user_id"]] = 1
    d = a.sum(axis=0)
    inv = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
    w = inv[:, None] * a * inv[None, :]
    x = (x + w @ x + w @ w @ x) / 3
    things = np.array([layer_norm(layer_norm(v)) for v in x[n_users:]])
    prior = {}
    for r in train_rows(labelled):
        prior[r["item_id"]] = prior.get(r["item_id"], 0) + 1

    def vector(user, history):
        graph = layer_norm(x[user])
        if not history or not config.use_seq_encoder:
            return layer_norm(graph)
        return layer_norm((graph + layer_norm(things[history].mean(axis=0))) / 2)

    return lambda user: lambda h, i: round(
        float(vector(user, h) @ things[i]) / math.sqrt(dim) + (math.log1p(prior.get(i, 0)) if config.use_item_bias else 0), 9
    )


@pytest.mark.parametrize("name", ["full", "no_sequence", "no_item_bias"])
def test_hybrid_matches_dense_algebra(spark, labelled, name):
    config = experiments.variant(name)
    got = {r["query_id"]: r["rank"] for r in experiments.hybrid_ranks(labelled, config, 12, 23, dim=4, seed=3).collect()}
    scorer = brute_hybrid(labelled, config, 4, 3)
    catalog = spark.range(23).withColumnRenamed("id", "item_id")
    owner = {r["row_id"]: r["user_id"] for r in labelled.collect()}
    assert got
    for user in set(owner[q] for q in got):
        expected = brute_ranks(labelled.where(F.col("user_id") == user), catalog, scorer(user))
        for q, rank in expected.items():
            assert got[q] == rank


def test_hybrid_variants_run(labelled):
    rows = experiments.run_variants(labelled, 12, 23, ("full", "no_sequence", "no_gcl"), (13, 5), (5,), dim=4).collect()
    assert [(r["variant"], r["seed"]) for r in rows] == [(v, s) for v in ("full", "no_sequence", "no_gcl") for s in (13, 5)]
    assert rows[0]["module_sequence"] == 1 and rows[2]["module_sequence"] == 0
    assert [r["applicable"] for r in rows] == [1, 1, 1, 1, 0, 0]
    assert rows[0]["ndcg@5"] == rows[4]["ndcg@5"] and rows[1]["ndcg@5"] == rows[5]["ndcg@5"]
    assert all(0 <= r["ndcg@5"] <= 1 for r in rows)
    for r in rows[:4]:
        alone = experiments.hybrid_ranks(labelled, experiments.variant(r["variant"]), 12, 23, dim=4, seed=r["seed"])
        assert ranking.ranking_metrics(alone, (5,)).first()["ndcg@5"] == pytest.approx(r["ndcg@5"], abs=1e-12)


def md5_signs(dim, *parts):
    import hashlib

    hexes = [hashlib.md5("|".join(map(str, (*parts, b))).encode()).hexdigest() for b in range((dim + 3) // 4)]
    return np.array([1 if int(hexes[j // 4][j % 4 * 8 : j % 4 * 8 + 8], 16) % 2 == 0 else -1 for j in range(dim)])


def test_projection_matches_plain_sums(spark):
    layout = encoding.Layout(2, 1, 1)
    rows = [(1, [0.5, 0.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0, -1.0]), (3, None), (4, [1.0, 1.0, 1.0, 0.0])]
    table = spark.createDataFrame(rows, "id bigint, features array<float>")
    got = {(r["seed"], r["id"]): (r["vector"], r["plain"]) for r in encoding.project(table, layout, 6, (7, 8)).collect()}
    assert got.keys() == {(s, i) for s in (7, 8) for i in (1, 2, 4)}
    for (seed, i), (whole, plain) in got.items():
        f = rows[i - 1][1]
        sign = lambda token: md5_signs(6, seed, "feature", token) / math.sqrt(6)  # noqa: B023,E731
        expected = f[0] * sign("0") + f[1] * sign("1") + sign(f"3:{int(f[3])}")
        assert np.allclose(plain, expected) and np.allclose(whole, expected + f[2] * sign("2"))
    with pytest.raises(Exception, match="must have 5 entries"):
        encoding.project(table, encoding.Layout(3, 1, 1), 6, (7,)).collect()
    assert encoding.project(table.limit(0), layout, 6, (7,)).count() == 0


@pytest.mark.parametrize("name", ["no_sequence", "no_text", "no_context", "no_graph"])
def test_features_and_context_reach_the_scores(spark, labelled, name):
    """Ranks with projected features and context against plain sums, without a graph."""
    config = experiments.variant(name, experiments.HybridConfig(graph_mode="none", use_seq_encoder=False, fusion_type="sum"))
    dim, seed = 4, 9
    layout = encoding.Layout(1, 1, 0)
    feature = lambda i, k: [float((i * k) % 5 - 2), float((i + k) % 3)]
    rows = {r["row_id"]: r for r in labelled.collect()}
    make = lambda ids, k: experiments.Features(
        spark.createDataFrame([(i, feature(i, k)) for i in ids], "id bigint, features array<double>"), layout
    )
    got = experiments.hybrid_ranks(
        labelled, config, 12, 23, dim, seed, user_features=make(range(12), 3), item_features=make(range(23), 4), context=make(rows, 5)
    )
    got = {r["query_id"]: r["rank"] for r in got.collect()}
    prior = {}
    for r in train_rows(labelled):
        prior[r["item_id"]] = prior.get(r["item_id"], 0) + 1

    def vector(i, k):
        f = feature(i, k)
        text = md5_signs(dim, seed, "feature", 1) * f[1] if config.use_text_features else 0
        return (md5_signs(dim, seed, "feature", 0) * f[0] + text) / math.sqrt(dim)

    assert got
    catalog = spark.range(23).withColumnRenamed("id", "item_id")
    for query, rank in got.items():
        near = vector(query, 5) if config.use_context else 0
        asked = vector(rows[query]["user_id"], 3) + near
        score = lambda h, i: round(float(asked @ vector(i, 4)) / math.sqrt(dim) + math.log1p(prior.get(i, 0)), 9)  # noqa: B023,E731
        mine = labelled.where((F.col("user_id") == rows[query]["user_id"]))
        if query in sorted(got)[:6]:
            assert brute_ranks(mine, catalog, score)[query] == rank


def plan_of(df) -> str:
    """The physical plan before any adaptive step."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_cells_of_whole_blocks_are_not_shuffled_again(spark):
    pairs = spark.createDataFrame([(u, (u * 3 + k) % 11) for u in range(20) for k in range(4)], "user_id bigint, item_id bigint")
    whole = models.cooccurrence(pairs)
    assert "HashAggregate" not in plan_of(whole).split("MapInPandas")[0]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, models.cooccurrence(pairs, block=2, users_per_salt=3).collect()))


def test_items_far_apart_travel_once_a_block(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(3) for i in range(0, 200, 1 + 60 * (u > 0))], "user_id bigint, item_id bigint")
    # Rows were the blocks of a user times the wide blocks of the user.
    assert models._met(pairs, models.counted_index(pairs), 1, 1000, 64, 200).groupBy().count().first()[0] == 4 + 4 + 200 * 4


@pytest.mark.parametrize("options", [{}, {"stripe_blocks": 1}, {"stripe_blocks": 1, "users_per_salt": 3}])
def test_slices_of_cells_are_whole(spark, options, monkeypatch):
    for name, size in (("SLICE_TIMES", 0), ("SLICE_BYTES", 1), ("RUN_ITEMS", 4), ("STRIPE_PIECES", 1)):
        monkeypatch.setattr(models, name, size)
    rows = [(u, (u * 3 + k * k) % 17) for u in range(20) for k in range(15 if u == 4 else 4)] + [(None, 1), (3, None)]
    pairs = spark.createDataFrame(rows, "user_id bigint, item_id bigint")
    totals = lambda cells: cells.groupBy("i").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n"))
    sums = []

    def each(cells):
        sums.append(cells)
        return totals(cells)

    got = models.cooccurrence(pairs, block=2, each=each, **options).collect()
    assert len(sums) == 9
    known = {(u, i) for u, i in rows if u is not None and i is not None}
    places = {i: at for at, i in enumerate(sorted({i for _, i in rows if i is not None}))}
    cells = collections.Counter((places[i], places[j]) for u, i in known for v, j in known if u == v and i != j)
    expected = collections.defaultdict(lambda: [0, 0])
    for (i, _), n in cells.items():
        expected[i][0] += 1
        expected[i][1] += n
    assert {r.i: [r.n_cells, r.n] for r in got} == dict(expected) and len(got) == len(expected)
    whole = models.cooccurrence(pairs, block=2, **options).collect()
    assert {(r.i, r.j): r.n for r in whole} == dict(cells) and len(whole) == len(cells)


def test_queries_are_not_written_once_a_block_of_items(tables, labelled, items):
    queries, catalog = tables
    for make in (scoring.catalog_target_ranks, lambda *a, **o: scoring.catalog_top_k(*a, 3, **o)):
        plan = plan_of(make(queries, catalog, DIM, broadcast_bytes=0, block_items=5, chunk_queries=7))
        assert "Generate" not in plan and "CoGroup" not in plan
    assert "Generate" not in plan_of(experiments.transition_ranks(labelled, items))


def test_catalog_ranks_without_items(spark, tables):
    queries, catalog = tables
    for options in SETTINGS:
        ranks = scoring.catalog_target_ranks(queries, catalog.limit(0), DIM, **options).collect()
        assert {r["rank"] for r in ranks} == {1} and len(ranks) == N_USERS
    uneven = spark.createDataFrame([(0, [1.0] * DIM), (1, [1.0])], "id bigint, vector array<double>")
    with pytest.raises(ValueError):
        scoring.catalog_top_k(queries, uneven, DIM, 3)


def test_queries_that_met_the_catalog_rank_alike(labelled, items):
    known = catalog_index(items.where("item_id % 3 <> 1"), "item_id")
    plain, met = models.queries_of(labelled), models.queries_of(labelled, index=known)
    assert sorted(map(str, plain.collect())) == sorted(map(str, met.select(plain.columns).collect()))
    twice = lambda queries: queries.unionByName(queries.where("query_id % 4 = 0"))
    near = models.item_neighbors(labelled.where("split = 'train'"), 4).join(known.withColumnRenamed("item_id", "neighbor_id"), "neighbor_id", "left_semi")
    ranks = [sorted(map(tuple, ranking.target_ranks(models.neighbor_scores(plain, near), twice(q), known).collect())) for q in (plain, met)]
    assert ranks[0] == ranks[1] and ranks[0]


def test_slices_of_users_are_split_alike(events):
    for rows in (events, events.unionByName(events.where("user_id < 3").selectExpr("cast(null as bigint) user_id", "item_id", "rating", "timestamp", "row_id"))):
        whole, sliced = labelled_splits(rows), labelled_splits(rows, hot_rows=50, slices=3)
        assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.select(whole.columns).collect())) and whole.count()


def test_written_tables_leave_no_shuffle(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().keySet().size()
    durable(spark.range(100).repartition(7, "id"))
    assert tracker.shuffleStatuses().keySet().size() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tables_of_users_and_queries_are_not_sent_whole(spark, labelled, items):
    pairs = labelled.select("user_id", "item_id").distinct()
    met = models._met(pairs, models.counted_index(pairs), 4, 1000, 64, 23)
    assert "BroadcastHashJoin [user_id" not in plan_of(met)
    queries = models.queries_of(labelled)
    scores = queries.select("query_id", F.lit(1).cast("long").alias("item_id"), F.lit(1.0).alias("score"))
    ranks = ranking.target_ranks(scores, queries, catalog_index(items, "item_id"))
    assert "BroadcastHashJoin [query_id" not in plan_of(ranks)


def test_settings_with_equal_items_share_history_vectors(labelled, monkeypatch):
    runs, whole = [], experiments.history_vectors

    def watched(histories, *args, **options):
        runs.append(histories.select("key.run").distinct().count())
        return whole(histories, *args, **options)

    monkeypatch.setattr(experiments, "history_vectors", watched)
    configs = [experiments.variant(v) for v in ("full", "no_item_bias", "no_sequence", "sum_fusion")]
    ranks = experiments.grid_ranks(labelled, configs, [13, 5], 12, 23, dim=4).collect()
    assert runs == [4]
    alone = experiments.hybrid_ranks(labelled, configs[1], 12, 23, dim=4, seed=5).collect()
    assert {r["query_id"]: r["rank"] for r in ranks if r["run"] == 5} == {r["query_id"]: r["rank"] for r in alone}
