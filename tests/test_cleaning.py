import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import cleaning
from rankloom.plans.preparation import labelled_splits


def key(row):
    return (math.inf if row["timestamp"] is None else row["timestamp"], row["row_id"])


def brute_dedup(rows):
    best = {}
    for r in rows:
        pair = (r["user_id"], r["item_id"])
        if pair not in best or key(r) > key(best[pair]):
            best[pair] = r
    return list(best.values())


def brute_split(rows, minimum=3):
    out, users = {}, {}
    for r in rows:
        users.setdefault(r["user_id"], []).append(r)
    for mine in users.values():
        mine.sort(key=key)
        n = len(mine)
        a, b = max(1, int(n * 0.2)), max(1, int(n * 0.1))
        if a + b >= n:
            a = b = 1
        for i, r in enumerate(mine):
            left = n - i
            out[r["row_id"]] = "train" if n < minimum else "test" if left <= a else "val" if left <= a + b else "train"
    return out


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_clean_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" User ID ", "Año (x)", "a-b"])
    assert cleaning.clean_columns(df).columns == ["user_id", "año_x", "ab"]


@pytest.mark.parametrize("cluster", [True, False])
def test_dedup_keeps_latest(events, cluster):
    got = {r["row_id"] for r in as_dicts(cleaning.dedup_latest(events, cluster))}
    assert got == {r["row_id"] for r in brute_dedup(as_dicts(events))}


def test_dedup_without_time_keeps_last_row(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 5), (1, 2, 3)], "user_id int, item_id int, row_id int")
    assert sorted(r["row_id"] for r in cleaning.dedup_latest(df).collect()) == [3, 5]


def test_dedup_without_ids_is_a_no_op(spark):
    df = spark.createDataFrame([(1,), (1,)], "x int")
    assert cleaning.dedup_latest(df).count() == 2


@pytest.mark.parametrize("hot_rows", [10_000, 15])
def test_split_matches_brute_force_with_and_without_hot_users(events, hot_rows):
    unique = cleaning.dedup_latest(events)
    got = {r["row_id"]: r["split"] for r in as_dicts(cleaning.split_temporal(unique, hot_rows=hot_rows))}
    assert got == brute_split(brute_dedup(as_dicts(events)))


def test_random_split_sizes_and_seed(events):
    unique = cleaning.dedup_latest(events.drop("timestamp"))
    first = {r["row_id"]: r["split"] for r in as_dicts(cleaning.split_random(unique, 1))}
    again = {r["row_id"]: r["split"] for r in as_dicts(cleaning.split_random(unique.repartition(3), 1, hot_rows=10))}
    other = {r["row_id"]: r["split"] for r in as_dicts(cleaning.split_random(unique, 2))}
    assert first == again and first != other
    temporal = cleaning.split_temporal(cleaning.dedup_latest(events))
    sizes = lambda df: sorted(map(tuple, df.groupBy("user_id", "split").count().collect()))
    assert sizes(cleaning.split_random(unique, 1)) == sizes(temporal)


def test_all_users_below_minimum_stay_in_train(events):
    rows = cleaning.split_temporal(cleaning.dedup_latest(events), min_interactions=1000)
    assert {r["split"] for r in rows.collect()} == {"train"}


@pytest.mark.parametrize("hot_rows", [10_000, 15])
def test_labels(events, hot_rows):
    rows = as_dicts(labelled_splits(events, hot_rows=hot_rows))
    train = [r for r in rows if r["split"] == "train" and r["rating"] is not None]
    overall = sum(r["rating"] for r in train) / len(train)
    for r in rows:
        mine = [t["rating"] for t in train if t["user_id"] == r["user_id"]]
        bar = sum(mine) / len(mine) if mine else overall
        assert r["relevant"] == int(r["rating"] is not None and r["rating"] >= bar)
    assert len(rows) == len(brute_dedup(as_dicts(events)))


def test_label_ways_agree(events):
    split = cleaning.split_temporal(cleaning.dedup_latest(events))
    by_join = cleaning.add_relevance(split, cleaning.relevance_thresholds(split.where("split = 'train'")))
    by_window = cleaning.label_split(split)
    pick = lambda df: sorted(map(tuple, df.select("row_id", "relevant").collect()))
    assert pick(by_join) == pick(by_window)


def test_implicit_events_are_all_relevant(events):
    rows = labelled_splits(events.drop("rating"))
    assert {r["relevant"] for r in rows.collect()} == {1}
    with pytest.raises(RuntimeError):
        cleaning.add_relevance(events, None)


def test_nan_rating_is_not_relevant(spark):
    df = spark.createDataFrame(
        [(1, 1, float("nan"), 0, "train"), (1, 2, 2.0, 1, "train")],
        "user_id int, item_id int, rating double, row_id int, split string",
    )
    assert sorted(map(tuple, cleaning.label_split(df).select("item_id", "relevant").collect())) == [(1, 0), (2, 1)]


def test_kcore_is_the_largest_fixpoint(spark, events):
    pairs = {(r["user_id"], r["item_id"]) for r in as_dicts(events)}
    while True:
        users, items = {}, {}
        for u, i in pairs:
            users[u], items[i] = users.get(u, 0) + 1, items.get(i, 0) + 1
        kept = {(u, i) for u, i in pairs if users[u] >= 4 and items[i] >= 4}
        if kept == pairs:
            break
        pairs = kept
    people = spark.createDataFrame([(u,) for u in range(12)], "user_id bigint")
    things = spark.createDataFrame([(i,) for i in range(23)], "item_id bigint")
    u, i, kept = cleaning.kcore(events, 4, people, things)
    assert {(r["user_id"], r["item_id"]) for r in as_dicts(kept)} == pairs and pairs
    assert kept.count() == len(pairs)
    assert {r[0] for r in u.collect()} == {a for a, _ in pairs}
    assert {r[0] for r in i.collect()} == {b for _, b in pairs}
    assert cleaning.kcore(events, 500).count() == 0
    assert cleaning.kcore(events.limit(0), 4).count() == 0


@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_kcore_peels_a_long_chain(spark, compact_every):
    """A chain loses its two ends a round, many rounds long; a block of three by three beside it stays, tied to the chain by one pair."""
    chain = [(k // 2, (k + 1) // 2) for k in range(16)]
    block = [(100 + u, 100 + i) for u in range(3) for i in range(3)]
    rows = [*chain, *block, (100, 8), (None, 101), (101, None)]
    table = spark.createDataFrame([(u, i, k) for k, (u, i) in enumerate(rows)], "user_id bigint, item_id int, row_id int")
    kept = cleaning.kcore(table, 2, compact_every=compact_every)
    assert sorted((r["user_id"], r["item_id"]) for r in kept.collect()) == block


def test_kcore_makes_the_rows_once(spark, events):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def watched(item):
        seen.add(1)
        return item

    rows = events.withColumn("item_id", watched.asNondeterministic()("item_id"))
    kept = cleaning.kcore(rows, 4)
    assert kept.count() == cleaning.kcore(events, 4).count() > 0
    assert seen.value == events.count()


def test_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "a string")
    assert [r[0] for r in df.select(cleaning.number(F.col("a"))).collect()] == [1.5, None, None, None]


def test_profile(events, spark):
    users = spark.createDataFrame([(1, "a")], "user_id int, x string")
    row = cleaning.profile(events, users, users.limit(0)).first()
    assert (row["feedback_type"], row["split_strategy"], row["sparsity"], row["num_user_feats"]) == (
        "explicit", "temporal", 0.0, 1)
