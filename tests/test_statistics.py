import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import statistics as S

SCHEMA = "dataset string, seed int, model string, metric string, value double"


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    values = {"A": [3.0, 3.0, 2.0, 5.0], "B": [2.0, 3.0, 1.0, 4.0], "C": [1.0, 1.0, 3.0, 0.0]}
    for m, vs in values.items():
        rows += [("d", s, m, "hit@10", v) for s, v in enumerate(vs)]
    rows += [("d", 9, "A", "hit@10", 1.0), ("e", 0, "A", "mrr@10", 0.0), ("e", 0, "B", "mrr@10", 2.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_summary(results):
    rows = {(r["dataset"], r["model"], r["metric"]): r for r in S.seed_summary(results).collect()}
    a = rows["d", "A", "hit@10"]
    assert a["mean"] == pytest.approx(2.8) and a["n_seeds"] == 5
    assert a["std"] == pytest.approx(math.sqrt(sum((x - 2.8) ** 2 for x in (3, 3, 2, 5, 1)) / 4))
    assert rows["e", "A", "mrr@10"]["std"] == 0.0


def test_summary_text(spark):
    wide = spark.createDataFrame([("A", 1, "0.5"), ("A", 2, "bad"), ("B", 1, None)], "model string, seed int, `hit@5` string")
    got = {r["model"]: r["hit@5"] for r in S.summary_text(wide).collect()}
    assert got == {"A": "0.5000 ± 0.0000", "B": None}


def test_ranks_share_ties_and_drop_incomplete_blocks(results):
    block = ("metric", "dataset", "seed")
    rows = S.model_ranks(S.complete_blocks(results.where("metric = 'hit@10'"), block, ("metric",)), block).collect()
    ranks = {(r["seed"], r["model"]): r["rank"] for r in rows}
    assert set(s for s, _ in ranks) == {0, 1, 2, 3}
    assert (ranks[1, "A"], ranks[1, "B"], ranks[1, "C"]) == (1.5, 1.5, 3.0)
    assert (ranks[2, "C"], ranks[2, "A"], ranks[2, "B"]) == (1.0, 2.0, 3.0)


def test_friedman_and_nemenyi(results):
    row = S.friedman(results, ("dataset", "seed"), ("metric",)).first()
    ranks = [[1, 2, 3], [1.5, 1.5, 3], [2, 3, 1], [1, 2, 3]]
    n, k = 4, 3
    sums = [sum(c) for c in zip(*ranks)]
    statistic = 12 / (n * k * (k + 1)) * sum(s * s for s in sums) - 3 * n * (k + 1)
    statistic /= 1 - (2**3 - 2) / (n * k * (k * k - 1))
    assert row["friedman_statistic"] == pytest.approx(statistic)
    assert (row["n_blocks"], row["n_models"], row["best_model"]) == (4, 3, "A")
    assert row["best_rank"] == pytest.approx(sums[0] / 4)
    report = S.friedman_report(S.friedman(results, ("dataset", "seed"), ("metric",))).first()
    assert report["friedman_pvalue"] == pytest.approx(math.exp(-statistic / 2))
    pairs = {(r["model"], r["other_model"]): r for r in S.nemenyi(results, ("dataset", "seed"), ("metric",)).where("metric = 'hit@10'").collect()}
    assert pairs["A", "C"]["rank_difference"] == pytest.approx(abs(sums[0] - sums[2]) / 4)
    assert pairs["A", "C"]["critical_distance"] == pytest.approx(2.3437 * math.sqrt(12 / 24), abs=1e-4)
    for r in pairs.values():
        assert r["p_value"] == pytest.approx(plain_tail(r["rank_difference"] / math.sqrt(12 / 48), 3), abs=1e-9)
        assert r["significant"] == (r["p_value"] < 0.05)


def test_chi_square_tail():
    assert S.chi_square_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert S.chi_square_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert S.chi_square_tail(18.307038053, 10) == pytest.approx(0.05, abs=1e-8)
    assert S.chi_square_tail(0.0, 3) == 1.0
    for statistic in (0.5, 3.0, 100.0, 300.0, 1400.0):
        closed = math.exp(-statistic / 2) * (1 + statistic / 2)
        assert S.chi_square_tail(statistic, 4) == pytest.approx(closed, rel=1e-10)
    assert S.chi_square_tail(1600.0, 4) == 0.0 or S.chi_square_tail(1600.0, 4) < 1e-300
    assert S.chi_square_tail(3000.0, 4) < 1e-300


def plain_tail(q, models):
    """Chance that the range of normal values exceeds ``q``, by Simpson's rule over the smallest one."""
    below = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    n, low = 4000, -9.0
    step = 18.0 / n
    total = sum(
        (1 if i in (0, n) else 4 if i % 2 else 2) * math.exp(-((low + i * step) ** 2) / 2) * (below(low + i * step + q) - below(low + i * step)) ** (models - 1)
        for i in range(n + 1)
    )
    return 1 - models * total * step / 3 / math.sqrt(2 * math.pi)


def test_range_tail(spark):
    cases = [(q, k) for k in (2, 5, 12, 40) for q in (0.0, 0.3, 1.0, 2.5, 3.9, 5.0, 7.0)]
    table = spark.createDataFrame(cases, "q double, k int")
    for r in table.select("*", S.range_tail(F.col("q"), F.col("k")).alias("p")).collect():
        assert r["p"] == pytest.approx(plain_tail(r["q"], r["k"]), abs=1e-10)
    # Two models: the difference of two normal values; far out the small chance keeps its digits.
    far = spark.range(1).select(S.range_tail(F.lit(14.0), F.lit(2)).alias("p"), S.normal_below(F.lit(-8.0)).alias("n")).first()
    assert far["p"] == pytest.approx(math.erfc(14 / 2), rel=1e-6)
    assert far["n"] == pytest.approx(0.5 * math.erfc(8 / math.sqrt(2)), rel=1e-6)


def test_nemenyi_critical_values(spark):
    published = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164, 12: 3.268, 20: 3.544}
    table = spark.createDataFrame([(k,) for k in published], "k int")
    got = table.select("k", S.critical_range(F.col("k"), 0.05).alias("q"), S.critical_range(F.col("k"), 0.1).alias("q10")).collect()
    for r in got:
        assert r["q"] / math.sqrt(2) == pytest.approx(published[r["k"]], abs=1.1e-3)
    assert {r["k"]: r["q10"] for r in got}[3] / math.sqrt(2) == pytest.approx(2.052, abs=1.1e-3)


def test_improvement(results):
    best = {r["metric"]: r for r in S.relative_improvement(S.seed_summary(results), "A").collect()}
    assert best["hit@10"]["baseline"] == "B" and best["hit@10"]["relative_improvement_percent"] == pytest.approx(100 * (2.8 - 2.5) / 2.5)
    named = S.relative_improvement(S.seed_summary(results), "B", "A").where("metric = 'mrr@10'").first()
    assert named["relative_improvement_percent"] is None


def test_pending_and_collected(spark):
    protocol = "one-target-per-interaction-v1"
    stored = spark.createDataFrame([("A", 1, protocol, 0.5), ("B", 1, "old", 0.4)], "model string, seed int, evaluation_protocol string, v double")
    models = spark.createDataFrame([("A",), ("B",), ("A",)], "model string")
    seeds = spark.createDataFrame([(1,), (2,)], "seed int")
    assert sorted(map(tuple, S.pending(models, seeds, stored).select("model", "seed").collect())) == [("A", 2), ("B", 1), ("B", 2)]
    asked = spark.createDataFrame([("A", 1), ("B", 1)], "model string, seed int")
    assert [r["model"] for r in S.collected(stored, asked).collect()] == ["A"]


def test_long_results(spark):
    wide = spark.createDataFrame([("d", 1, "A", "0.5", "x", "1", "1")], "dataset string, seed int, model string, `HIT@10` string, `mrr@10` string, `hit@5` string, `odd@10` string")
    assert [(r["metric"], r["value"]) for r in S.long_results(wide, 10).collect()] == [("hit@10", 0.5)]


def test_importance(spark):
    rows = [("d", "full", 1, 1, 0.5), ("d", "full", 2, 1, 0.7), ("d", "no_graph", 1, 1, 0.4), ("d", "no_graph", 2, 1, 0.4),
            ("d", "no_graph", 3, 1, 0.1), ("d", "base", 1, 1, 0.1), ("d", "no_gcl", 1, 0, 0.1), ("e", "no_graph", 1, 1, 0.3)]
    runs = spark.createDataFrame(rows, "dataset string, variant string, seed int, applicable int, `ndcg@10` double")
    table = S.importance(runs, "ndcg@10")
    row = table.first()
    assert table.count() == 1 and (row["component"], row["n_seeds"]) == ("Grafo", 2)
    assert row["importance_mean"] == pytest.approx(0.2) and row["importance_std"] == pytest.approx(math.sqrt(0.02))
    assert S.importance_table(table).first()["importance"] == "0.2000 ± 0.1414"
    wide = S.importance_matrix(table, ["d", "e"]).first()
    assert wide["d"] == pytest.approx(0.2) and wide["e"] is None


def test_sorted_summary(results):
    rows = S.sorted_summary(S.seed_summary(results), ["C", "A"]).collect()
    assert [(r["metric"], r["model"]) for r in rows] == [("hit@10", "C"), ("hit@10", "A"), ("hit@10", "B"), ("mrr@10", "A"), ("mrr@10", "B")]
