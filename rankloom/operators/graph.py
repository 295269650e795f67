"""The user-item graph, edge-dropout views and neighbour smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.columns import EDGE_DROP, GRAPH_LAYERS, ITEM, USER
from rankloom.functions import vectors as V
from rankloom.functions.hashing import unit_draw
from rankloom.operators.cleaning import positives
from rankloom.session import durable


def interaction_graph(train: DataFrame, num_users) -> DataFrame:
    """Edges ``(src, dst)`` of positive training rows in both directions.

    Ids are dense; item nodes follow the user nodes.
    """
    user = F.col(USER).cast("long")
    item = (F.col(ITEM) + num_users).cast("long")
    both = F.array(
        F.struct(user.alias("src"), item.alias("dst")),
        F.struct(item.alias("src"), user.alias("dst")),
    )
    return positives(train).select(F.inline(both))


def graph_nodes(num_users: int, num_items: int, spark) -> DataFrame:
    """Node ids with their type: 0 for users, 1 for items."""
    nodes = spark.range(num_users + num_items)
    return nodes.withColumn("node_type", (F.col("id") >= num_users).cast("int"))


def drop_edges(edges: DataFrame, p: float = EDGE_DROP, seed: int = 0) -> DataFrame:
    """Drop each undirected pair with probability ``p``; both directions share the draw."""
    pair = (F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.where(unit_draw(seed, *pair) >= F.lit(float(p)))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Symmetric weights: one over the root of the product of both in-degrees."""
    degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_deg"))
    src = degree.select(F.col("dst").alias("src"), F.col("_deg").alias("_src_deg"))
    weighted = edges.join(degree, "dst").join(src, "src", "left")
    root = F.sqrt(F.col("_deg").cast("double") * F.col("_src_deg").cast("double"))
    return weighted.select("src", "dst", F.coalesce(1.0 / root, F.lit(0.0)).alias("weight"))


def propagate(weighted: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """One round: every node takes the weighted sum of its neighbours' vectors.

    Each dimension is its own sum, so a node with very many neighbours is reduced
    on the map side and only one row per task and node is shuffled.
    """
    carried = weighted.join(vectors.withColumnRenamed("id", "src"), "src")
    summed = carried.groupBy("dst").agg(*V.sum_columns("vector", dim, F.col("weight")))
    sums = summed.select(F.col("dst").alias("id"), V.gather_columns(dim).alias("_sum"))
    joined = vectors.select("id").join(sums, "id", "left")
    return joined.select("id", F.coalesce("_sum", V.zeros(dim)).alias("vector"))


def smooth(
    edges: DataFrame,
    vectors: DataFrame,
    dim: int,
    layers: int = GRAPH_LAYERS,
    normalize_input: bool = False,
) -> DataFrame:
    """Mean of the input vectors and of ``layers`` rounds of neighbour sums.

    Nodes are those of ``vectors`` and of ``edges``; a node without a vector starts from zero and still takes part.
    Rounds after the first start from a written table, which keeps the plan flat
    and survives lost executors.
    """
    given = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    current = given.join(ends, "id", "full").select("id", F.coalesce("vector", V.zeros(dim)).alias("vector"))
    if normalize_input:
        current = current.withColumn("vector", V.layer_norm(F.col("vector")))
    if layers == 0:
        return current
    weighted = edge_weights(edges)
    if layers > 1:
        weighted, current = durable(weighted, "edges"), durable(current, "layer-0")
    total = current
    for layer in range(1, layers + 1):
        current = propagate(weighted, current, dim)
        if layer < layers:
            current = durable(current, f"layer-{layer}")
        step = current.withColumnRenamed("vector", "_next")
        total = total.join(step, "id").select("id", V.add(F.col("vector"), F.col("_next")).alias("vector"))
    return total.select("id", V.scale(F.col("vector"), 1.0 / (layers + 1)).alias("vector"))
