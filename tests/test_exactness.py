"""Results that must not depend on batches, blocks, keys or id types."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import encoding, negatives, scoring, sequences


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_ties_do_not_depend_on_batches(spark, broadcast_bytes):
    draw = np.random.default_rng(3)
    some = draw.normal(size=(20, 16))
    vectors = some[draw.integers(0, 20, 120)]
    asked = draw.normal(size=(60, 16))
    targets = draw.integers(0, 120, 60)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    queries = spark.createDataFrame(
        [(q, v.tolist(), int(t)) for q, (v, t) in enumerate(zip(asked, targets))], "query_id long, vector array<double>, target_item_id long"
    )
    # Equal vectors tie exactly, so the rank follows from the scores of the distinct ones.
    scores = np.round(asked @ vectors.T, 9)
    own = scores[np.arange(60), targets][:, None]
    expected = 1 + ((scores > own) | ((scores == own) & (np.arange(120) < targets[:, None]))).sum(1)
    best = {q: np.lexsort((np.arange(120), -scores[q]))[:7].tolist() for q in range(60)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, block in ((7, 16), (1000, 50)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            options = dict(broadcast_bytes=broadcast_bytes, block_items=block, chunk_queries=25)
            ranks = {r["query_id"]: r["rank"] for r in scoring.catalog_target_ranks(queries, items, 16, **options).collect()}
            assert ranks == dict(enumerate(expected.tolist()))
            top = scoring.catalog_top_k(queries.drop("target_item_id"), items, 16, 7, **options).collect()
            found = {q: [r["item_id"] for r in sorted((r for r in top if r["query_id"] == q), key=lambda r: r["rank"])] for q in range(60)}
            assert found == best
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_unknown_target_ranks_last(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    queries = spark.createDataFrame(
        [(1, [1.0, 1.0], 99, [0, 3]), (2, [1.0, 1.0], 4, [])],
        "query_id long, vector array<double>, target_item_id long, history array<long>",
    )
    ranks = {r["query_id"]: r["rank"] for r in scoring.catalog_target_ranks(queries, items, 2).collect()}
    assert ranks == {1: 4, 2: 1}


def test_array_context(spark):
    df = spark.createDataFrame(
        [(1, 2, 3, [5], 0.5, [1.0, 2.0]), (1, 2, 4, [5], None, None)],
        "user_id long, item_id long, row_id long, history array<long>, place double, text array<double>",
    )
    rows = {r["query_id"]: r["context"] for r in sequences.model_rows(df).collect()}
    assert rows == {3: [0.5, 1.0, 2.0], 4: [None]}


def test_lists_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a, b", "x"), (1, "c", None), (None, "b", "y; x"), (2, None, "z")], "id long, tags string, more string")
    vocabulary = encoding.fit_vocabulary(df.where("more is null or more <> 'z'"), ["tags", "more"])
    coded = encoding.encode_lists(df, ["tags", "more"], vocabulary)
    assert coded.columns == [*df.columns, "list__tags", "list__more"]
    got = sorted((r["tags"] or "", r["list__tags"], r["list__more"]) for r in coded.collect())
    assert got == [("", [], []), ("a, b", [0, 1], [0]), ("b", [1], [0, 1]), ("c", [2], [])]
    dense = coded.select("tags", encoding.dense_list(F.col("list__tags"), 3).alias("d")).collect()
    assert {r["tags"]: r["d"] for r in dense} == {"a, b": [1, 1, 0], "c": [0, 0, 1], "b": [0, 1, 0], None: [0, 0, 0]}
    assert encoding.encode_lists(df.limit(0), ["tags"], vocabulary).count() == 0
    assert encoding.vocabulary_sizes(vocabulary) == {"tags": 3, "more": 2}


def test_text_ids_of_candidates(spark):
    df = spark.createDataFrame([(1, "u", "C_1", ["C_2"])], "row_id long, user_id string, item_id string, negatives array<string>")
    rows = negatives.candidate_rows(df).orderBy("position").collect()
    assert [(r["item_id"], r["label"]) for r in rows] == [("C_1", 1), ("C_2", 0)]
