"""Summaries, ranks and tests over results of several models and seeds.

Input is the long form ``(dataset, seed, model, metric, value)`` unless noted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.columns import EVALUATION_PROTOCOL
from rankloom.functions.names import COMPONENT_ORDER, METRIC_ORDER, component_label, mean_and_deviation, place_in
from rankloom.operators.cleaning import number

def _deviation(c):
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


# --- collecting ---------------------------------------------------------------------


def pending(models: DataFrame, seeds: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested (model, seed) pairs without a stored result of the current protocol.

    ``models`` and ``seeds`` are the short lists of a request.
    """
    asked = seeds.agg(F.collect_set("seed")).scalar()
    grid = models.select("model").distinct().select("model", F.explode(asked).alias("seed"))
    done = stored.where(F.col("evaluation_protocol") == EVALUATION_PROTOCOL)
    return grid.join(done, ["model", "seed"], "left_anti")


def collected(stored: DataFrame, requested: DataFrame) -> DataFrame:
    """Stored results of the requested (model, seed) pairs."""
    valid = stored.where(F.col("evaluation_protocol") == EVALUATION_PROTOCOL)
    return valid.join(requested.select("model", "seed"), ["model", "seed"], "left_semi")


def metric_columns(columns: list[str], k: int) -> list[str]:
    """Columns ``metric@k`` of known metrics at one cutoff."""
    named = {column: column.lower().rpartition("@") for column in columns}
    return [column for column, (metric, _, cutoff) in named.items() if (metric, cutoff) in {(m, str(k)) for m in METRIC_ORDER}]


def long_results(wide: DataFrame, k: int, ids=("dataset", "seed", "model")) -> DataFrame:
    """Long form of wide results at one cutoff; values that are no numbers drop out."""
    columns = metric_columns(wide.columns, k)
    values = wide.select(*ids, *[number(F.col(f"`{c}`")).alias(c) for c in columns])
    long = values.unpivot(list(ids), [F.col(f"`{c}`") for c in columns], "metric", "value")
    return long.withColumn("metric", F.lower("metric")).where(F.col("value").isNotNull())


# --- summaries ----------------------------------------------------------------------


def seed_summary(results: DataFrame, by=("dataset", "model", "metric")) -> DataFrame:
    """Mean, sample deviation (0 for one seed) and number of seeds."""
    valued = results.withColumn("value", number(F.col("value")))
    return valued.groupBy(*by).agg(
        F.avg("value").alias("mean"), _deviation("value").alias("std"), F.count("value").alias("n_seeds")
    )


def summary_text(wide: DataFrame, order_by: str | None = None, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """One row per model (or per ``by``) with ``mean ± deviation`` text per metric column."""
    columns = [c for c in wide.columns if c not in (*by, "seed", "evaluation_protocol", order_by)]
    texts = []
    for c in columns:
        value = number(F.col(f"`{c}`"))
        texts.append(mean_and_deviation(F.avg(value), _deviation(value)).alias(c))
    if order_by is None:
        return wide.groupBy(*by).agg(*texts)
    first = F.min(order_by).alias("_first")
    return wide.groupBy(*by).agg(*texts, first).orderBy("_first").drop("_first")


def sorted_summary(summary: DataFrame, models: list[str], metrics: list[str] = METRIC_ORDER) -> DataFrame:
    """Rows in display order: metric, dataset, then the given model order."""
    base = F.substring_index("metric", "@", 1)
    return summary.orderBy(place_in(base, metrics), "metric", "dataset", place_in(F.col("model"), models), "model")


def relative_improvement(summary: DataFrame, proposed: str, baseline: str | None = None) -> DataFrame:
    """Percent change of one model's mean against the best or a named other model."""
    by = ["dataset", "metric"]
    own = summary.where(F.col("model") == proposed).select(*by, F.col("mean").alias("proposed_value"))
    if baseline is None:
        others = summary.where(F.col("model") != proposed)
        # Ties go to the name that comes first, as in a table with sorted columns.
        best = W.partitionBy(*by).orderBy(F.col("mean").desc(), F.col("model").asc())
        others = others.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    else:
        others = summary.where(F.col("model") == baseline)
    others = others.select(*by, F.col("model").alias("baseline"), F.col("mean").alias("baseline_value"))
    joined = own.join(others, by).withColumn("proposed_model", F.lit(proposed))
    change = 100.0 * (F.col("proposed_value") - F.col("baseline_value")) / F.abs("baseline_value")
    return joined.select(
        *by, "proposed_model", "baseline", "proposed_value", "baseline_value",
        F.when(F.col("baseline_value") != 0, change).alias("relative_improvement_percent"),
    )


# --- ranks and tests ------------------------------------------------------------------


def complete_blocks(results: DataFrame, block: tuple[str, ...], group: tuple[str, ...] = ()) -> DataFrame:
    """Mean value per (block, model), for blocks where every model of the group has one."""
    keys = list(dict.fromkeys([*group, *block]))
    cells = results.groupBy(*keys, "model").agg(F.avg("value").alias("value")).where(F.col("value").isNotNull())
    wanted = cells.groupBy(*group).agg(F.countDistinct("model").alias("_k")) if group else cells.agg(
        F.countDistinct("model").alias("_k")
    )
    have = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    if group:
        have = have.join(wanted, list(group))
    else:
        have = have.withColumn("_k", wanted.scalar())
    full = have.where("_have = _k").select(*keys)
    return cells.join(full, keys, "left_semi").select(*keys, "model", "value")


def wide_blocks(blocks: DataFrame, block: tuple[str, ...], models: list[str]) -> DataFrame:
    """Complete blocks as rows with one column per model."""
    return blocks.groupBy(*block).pivot("model", models).agg(F.first("value"))


def model_ranks(blocks: DataFrame, block: tuple[str, ...]) -> DataFrame:
    """Rank of each model in its block, best first; ties share their mean rank."""
    order = W.partitionBy(*block).orderBy(F.col("value").desc())
    peers = W.partitionBy(*block, "value")
    shared = (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
    return blocks.withColumn("rank", F.rank().over(order) + shared)


def mean_ranks(ranks: DataFrame, by=("dataset", "metric", "model")) -> DataFrame:
    return ranks.groupBy(*by).agg(F.avg("rank").alias("rank"))


def chi_square_tail(statistic: float, degrees: int) -> float:
    """Probability that a chi-square value exceeds ``statistic``.

    Small statistics use the series of the lower tail, larger ones the continued fraction of the upper tail
    (both times exp(log of the common factor)), so that tiny probabilities keep their digits.
    """
    if statistic <= 0 or degrees < 1:
        return 1.0
    a, x = degrees / 2.0, statistic / 2.0
    factor = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - math.exp(factor) * total)
    # Convergents of 1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ...)) by their ratios.
    b = x + 1.0 - a
    below, above = 1.0 / b, math.inf
    value = below
    for i in range(1, 10_000):
        b += 2.0
        step = -i * (i - a)
        below = 1.0 / (b + step * below)
        above = b + step / above
        value *= below * above
        if abs(below * above - 1.0) < 1e-15:
            break
    return math.exp(factor + math.log(value))


# Coefficients of the rational form of the normal tail (Hart 1968, algorithm 5666, as given by West 2005).
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
)
#: Nodes of the quadrature over a standard normal value. The integrand is smooth and vanishes at both ends, so equal steps are exact to rounding.
NODES = [i / 8.0 for i in range(-72, 73)]
#: Halvings that locate a critical value to about 1e-12.
HALVINGS = 45


def normal_below(x: Column) -> Column:
    """Chance that a standard normal value lies below ``x``, to about 1e-15."""
    size = F.abs(x)

    def horner(coefficients) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * size + F.lit(c)
        return out

    far = F.lit(0.65) + size
    for c in (4.0, 3.0, 2.0, 1.0):
        far = size + F.lit(c) / far
    bell = F.exp(-size * size / 2.0)
    tail = F.when(size < 7.07106781186547, bell * horner(TAIL_ABOVE) / horner(TAIL_BELOW)).otherwise(bell / far / F.lit(math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def _node_table() -> Column:
    below = lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0))
    step = NODES[1] - NODES[0]
    rows = [F.struct(F.lit(z).alias("z"), F.lit(math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * step).alias("w"), F.lit(below(z)).alias("p")) for z in NODES]
    return F.array(*rows)


def range_tail(q: Column, models: Column) -> Column:
    """Chance that the range of ``models`` standard normal values exceeds ``q`` (infinite degrees of freedom).

    The largest value z has the density k phi(z) Phi(z)^(k-1); the others miss the range below it with the chance
    that is summed here, written so that small chances keep their digits.
    """
    power = models.cast("double") - 1.0

    def part(total: Column, node: Column) -> Column:
        share = F.least(normal_below(node["z"] - q) / node["p"], F.lit(1.0))
        # 1 - (1 - share)^power, and 1 where nothing lies inside the range.
        outside = F.when(share < 1.0, -F.expm1(power * F.log1p(-F.least(share, F.lit(1.0 - 1e-16))))).otherwise(F.lit(1.0))
        return total + node["w"] * F.pow(node["p"], power) * outside

    chance = models * F.aggregate(_node_table(), F.lit(0.0), part)
    return F.when(q <= 0, F.lit(1.0)).otherwise(F.least(chance, F.lit(1.0)))


def critical_range(models: Column, alpha: float) -> Column:
    """The range of ``models`` standard normal values that is exceeded with chance ``alpha``, by halving."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(40.0).alias("high"))

    def halve(state: Column, _step: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2.0
        above = range_tail(middle, models) > F.lit(alpha)
        return F.struct(F.when(above, middle).otherwise(state["low"]).alias("low"), F.when(above, state["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["low"] + s["high"]) / 2.0)


def friedman(results: DataFrame, block: tuple[str, ...], group: tuple[str, ...] = ()) -> DataFrame:
    """Friedman statistic with tie correction per group of complete blocks.

    Groups need two blocks and three models. ``chi_square_tail`` of the statistic
    with ``n_models - 1`` degrees gives the p-value.
    """
    keys = tuple(dict.fromkeys([*group, *block]))
    ranks = model_ranks(complete_blocks(results, block, group), keys)
    by_model = ranks.groupBy(*group, "model").agg(F.sum("rank").alias("_r"), F.count(F.lit(1)).alias("_n"))
    sums = by_model.groupBy(*group).agg(
        F.max("_n").alias("n_blocks"),
        F.count(F.lit(1)).alias("n_models"),
        F.sum(F.col("_r") * F.col("_r")).alias("_squares"),
        F.min_by("model", F.struct("_r", "model")).alias("best_model"),
        F.min(F.col("_r") / F.col("_n")).alias("best_rank"),
    )
    tied = ranks.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("_t"))
    ties = tied.groupBy(*group).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    joined = sums.join(ties, list(group)) if group else sums.withColumn("_ties", ties.scalar())
    n, k = F.col("n_blocks").cast("double"), F.col("n_models").cast("double")
    raw = 12.0 / (n * k * (k + 1.0)) * F.col("_squares") - 3.0 * n * (k + 1.0)
    correction = 1.0 - F.col("_ties") / (n * k * (k * k - 1.0))
    scored = joined.where("n_blocks >= 2 and n_models >= 3").withColumn(
        "friedman_statistic", raw / F.nullif(correction, F.lit(0.0))
    )
    return scored.select(*group, "n_blocks", "n_models", "friedman_statistic", "best_model", "best_rank")


def friedman_report(table: DataFrame) -> DataFrame:
    """Add p-values to a Friedman table, which holds one row per metric."""
    spark = table.sparkSession
    rows = [
        (*r, None if r["friedman_statistic"] is None else chi_square_tail(r["friedman_statistic"], r["n_models"] - 1))
        for r in table.collect()
    ]
    schema = table.schema.add("friedman_pvalue", "double")
    return spark.createDataFrame(rows, schema)


def nemenyi(results: DataFrame, block: tuple[str, ...], group: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """Pairwise mean-rank differences with their p-values and the critical distance at ``alpha``, for any number of models.

    Everything is a column expression: no job runs before the result is read. The critical value is found once for each number of models.
    """
    keys = tuple(dict.fromkeys([*group, *block]))
    ranks = model_ranks(complete_blocks(results, block, group), keys)
    means = ranks.groupBy(*group, "model").agg(F.avg("rank").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*(group or [F.lit(0)]))
    means = means.withColumn("_k", F.count(F.lit(1)).over(whole)).withColumn("_g", F.lit(0))
    sizes = means.where("_k > 1").select("_k").distinct().withColumn("_q", critical_range(F.col("_k"), alpha))
    other = means.select(*group, "_g", F.col("model").alias("other_model"), F.col("_mean").alias("_other"))
    pairs = means.join(sizes, "_k").join(other, ["_g", *group]).where(F.col("model") < F.col("other_model"))
    k = F.col("_k").cast("double")
    unit = F.sqrt(k * (k + 1.0) / (12.0 * F.col("_n")))
    gap = F.abs(F.col("_mean") - F.col("_other"))
    distance = F.col("_q") * unit
    return pairs.select(
        *group, "model", "other_model", gap.alias("rank_difference"), range_tail(gap / unit, F.col("_k")).alias("p_value"),
        distance.alias("critical_distance"), (gap > distance).alias("significant"),
    )


# --- component importance -------------------------------------------------------------


def importance(runs: DataFrame, metric: str) -> DataFrame:
    """Mean loss of each variant against the full model over the seeds both have.

    ``runs``: ``(dataset, variant, seed, applicable, <metric>)``.
    """
    value = number(F.col(f"`{metric}`"))
    used = runs.where(F.coalesce(F.col("applicable") != 0, F.lit(True))) if "applicable" in runs.columns else runs
    full = used.where("variant = 'full'").select("dataset", "seed", value.alias("_full"))
    other = used.where("variant not in ('full', 'base')").select("dataset", "seed", "variant", value.alias("_value"))
    drops = other.join(full, ["dataset", "seed"]).withColumn("_drop", F.col("_full") - F.col("_value"))
    return drops.groupBy("dataset", "variant").agg(
        F.avg("_drop").alias("importance_mean"),
        _deviation("_drop").alias("importance_std"),
        F.count(F.lit(1)).alias("n_seeds"),
    ).withColumn("component", component_label(F.col("variant")))


def importance_table(table: DataFrame) -> DataFrame:
    """Importance rows in display order with a ``mean ± deviation`` text."""
    text = mean_and_deviation(F.col("importance_mean"), F.col("importance_std"))
    return table.withColumn("importance", text).orderBy("dataset", place_in(F.col("component"), COMPONENT_ORDER), "variant")


def importance_matrix(table: DataFrame, datasets: list[str], values: str = "importance_mean") -> DataFrame:
    """Components as rows, datasets as columns; components without any value drop out."""
    wide = table.groupBy("component").pivot("dataset", datasets).agg(F.first(values))
    return wide.dropna("all", subset=datasets).orderBy(place_in(F.col("component"), COMPONENT_ORDER))
