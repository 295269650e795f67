import pytest
from pyspark.sql import functions as F

from rankloom.operators import graph, negatives, ordering, sequences
from rankloom.operators.cleaning import positives
from rankloom.plans.preparation import labelled_splits
from rankloom.session import durable
from tests.test_cleaning import key


@pytest.fixture(scope="module")
def labelled(events):
    return durable(labelled_splits(events), "test-labelled")


def brute_history(rows, length):
    out, past = {}, {}
    for r in sorted(rows, key=key):
        mine = past.setdefault(r["user_id"], [])
        out[r["row_id"]] = mine[-length:] if length else []
        mine.append(r["item_id"])
    return out


@pytest.mark.parametrize("hot_rows,chunk", [(10_000, 100), (8, 5)])
def test_history(events, hot_rows, chunk):
    rows = sequences.user_history(events, 5, hot_rows=hot_rows, chunk_rows=chunk)
    got = {r["row_id"]: r["history"] for r in rows.collect()}
    assert got == brute_history([r.asDict() for r in events.collect()], 5)


def test_history_without_time_is_empty(events):
    rows = sequences.user_history(events.drop("timestamp"))
    assert all(r["history"] == [] for r in rows.collect())


def test_partitioning_does_not_matter(events):
    one = {r["row_id"]: r["history"] for r in sequences.user_history(events.coalesce(1)).collect()}
    many = {r["row_id"]: r["history"] for r in sequences.user_history(events.repartition(7)).collect()}
    assert one == many


def test_padding(events):
    rows = sequences.user_history(events, 5)
    items, mask = sequences.padded(F.col("history"), 5)
    for r in rows.select("history", items.alias("i"), mask.alias("m")).collect():
        assert len(r["i"]) == len(r["m"]) == 5
        assert [x - 1 for x, ok in zip(r["i"], r["m"]) if ok] == r["history"]
        assert all(x == 0 for x, ok in zip(r["i"], r["m"]) if not ok)


def test_sequence_rows_drop_empty_training_histories(labelled):
    rows = sequences.positive_history(labelled)
    train = sequences.sequence_rows(rows, "train").collect()
    assert train and all(r["item_id_list:token_seq"] for r in train)
    assert sequences.sequence_rows(rows, "test").count() == rows.where("split = 'test'").count()


def brute_running(rows):
    total, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["row_id"])):
        total[r["user_id"]] = total.get(r["user_id"], 0) + r["item_id"]
        out[r["row_id"]] = total[r["user_id"]]
    return out, total


@pytest.mark.parametrize("hot_rows", [10_000, 6])
def test_running_sums(events, hot_rows):
    rows = ordering.running_sums(
        events, ["user_id"], [F.col("row_id").asc()], {"run": F.col("item_id")}, {"run": "all"}, hot_rows=hot_rows
    )
    running, totals = brute_running([r.asDict() for r in events.collect()])
    for r in rows.collect():
        assert (r["run"], r["all"]) == (running[r["row_id"]], totals[r["user_id"]])


@pytest.mark.parametrize("hot_rows", [10_000, 10])
def test_global_positions(events, hot_rows):
    rows = ordering.with_positions(events, [], [F.col("item_id").desc(), F.col("row_id").asc()], hot_rows=hot_rows)
    ordered = [r["row_id"] for r in rows.orderBy("pos").collect()]
    expected = sorted(events.collect(), key=lambda r: (-r["item_id"], r["row_id"]))
    assert ordered == [r["row_id"] for r in expected]


# --- negatives -------------------------------------------------------------------------


def catalog(spark, n=40):
    return spark.range(n).select(F.col("id").alias("item_id"))


@pytest.mark.parametrize("hot_rows", [10_000, 10])
def test_negatives_are_unseen_and_distinct(spark, labelled, hot_rows):
    rows = positives(labelled)
    seen = {}
    for r in rows.collect():
        seen.setdefault(r["user_id"], set()).add(r["item_id"])
    out = negatives.with_negatives(rows, catalog(spark), 4, seed=3, hot_rows=hot_rows).collect()
    assert len(out) == rows.count()
    for r in out:
        assert len(set(r["negatives"])) == 4
        assert not set(r["negatives"]) & seen[r["user_id"]]
        assert all(0 <= i < 40 for i in r["negatives"])


def test_negatives_cover_all_unseen_items_evenly(spark):
    rows = spark.range(4000).select(
        F.lit(1).alias("user_id"), (F.col("id") % 3 * 4).alias("item_id"), F.col("id").alias("row_id")
    )
    draws = negatives.negative_draws(rows, catalog(spark, 12), 4, seed=1)
    counts = {r["item_id"]: r["count"] for r in draws.groupBy("item_id").count().collect()}
    assert set(counts) == set(range(12)) - {0, 4, 8}
    assert max(counts.values()) < 1.12 * min(counts.values())


def test_few_unseen_items_repeat_and_none_is_an_error(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(3)], "user_id int, item_id bigint, row_id int")
    out = negatives.with_negatives(rows, catalog(spark, 4), 3).collect()
    assert all(r["negatives"] == [3, 3, 3] for r in out)
    with pytest.raises(Exception, match="no unseen items"):
        negatives.with_negatives(rows, catalog(spark, 3), 3).collect()


def test_negative_sampling_guards(spark, labelled):
    rows = positives(labelled)
    with pytest.raises(ValueError):
        negatives.with_negatives(rows, catalog(spark), -1)
    with pytest.raises(ValueError):
        negatives.with_negatives(rows, catalog(spark, 2), 4)
    with pytest.raises(ValueError, match="item_id"):
        negatives.with_negatives(rows.drop("item_id"), catalog(spark), 4)
    with pytest.raises(Exception, match="positive"):
        negatives.with_negatives(labelled, catalog(spark), 4).collect()
    assert {tuple(r["negatives"]) for r in negatives.with_negatives(rows, catalog(spark), 0).collect()} == {()}


def test_candidates_start_with_the_target(spark, labelled):
    rows = negatives.candidate_rows(negatives.with_negatives(positives(labelled), catalog(spark), 2))
    counts = rows.groupBy("position").agg(F.count("*").alias("n"), F.sum("label").alias("labels")).collect()
    assert {r["position"]: r["labels"] == (r["n"] if r["position"] == 0 else 0) for r in counts} == {0: True, 1: True, 2: True}


# --- graph ----------------------------------------------------------------------------


def test_graph_has_both_directions_and_dropout_keeps_pairs(labelled):
    train = labelled.where("split = 'train'")
    edges = graph.interaction_graph(train, 12)
    found = {(r["src"], r["dst"]) for r in edges.collect()}
    assert found == {(b, a) for a, b in found} and len(found) == 2 * positives(train).count()
    kept = {(r["src"], r["dst"]) for r in graph.drop_edges(edges, 0.4, 1).collect()}
    assert kept == {(b, a) for a, b in kept} and 0 < len(kept) < len(found)
    assert kept != {(r["src"], r["dst"]) for r in graph.drop_edges(edges, 0.4, 2).collect()}
    assert graph.drop_edges(edges, 0.0, 1).count() == len(found)


def test_smoothing_matches_dense_algebra(spark, labelled):
    import numpy as np

    edges = graph.interaction_graph(labelled.where("split = 'train'"), 12)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(36, 3))
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(36)], "id bigint, vector array<double>")
    a = np.zeros((36, 36))
    for r in edges.collect():
        a[r["dst"], r["src"]] += 1
    degree = a.sum(axis=1)
    inverse = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1)), 0)
    norm = inverse[:, None] * a * inverse[None, :]
    expected = (x + norm @ x + norm @ norm @ x) / 3
    got = {r["id"]: r["vector"] for r in graph.smooth(edges, nodes, 3, 2).collect()}
    assert np.allclose([got[i] for i in range(36)], expected)
    same = {r["id"]: r["vector"] for r in graph.smooth(edges, nodes, 3, 0).collect()}
    assert np.allclose([same[i] for i in range(36)], x)
