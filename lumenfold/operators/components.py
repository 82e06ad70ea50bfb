"""Connectivity: component labels, members, subgraphs, partition equality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.lineage import cut
from lumenfold.operators.numbering import ONE_WINDOW, number_rows


#: Up to so many stored edges, counted, the components of a graph are found within one task.
LOCAL_EDGES = 500_000


def _settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and smallest node of their component, for edges that fit in memory."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _local_labels(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(pdf["a"].to_numpy(), pdf["b"].to_numpy()) for pdf in batches if len(pdf)]
        if parts:
            nodes, labels = _settle(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pd.DataFrame({"id": nodes, "label": labels})

    return edges.coalesce(1).mapInPandas(run, "id long, label long")


def min_labels(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, local_edges: int = 0) -> DataFrame:
    """(id, label) of every node that has an edge; label is the smallest id of its component.

    Edges count in both directions.  Each round takes the smallest label around a node and then
    the label of that label (pointer jumping), so that long paths take a logarithmic number of
    rounds.  Minima are combined before the shuffle, and every round is cut from its lineage.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if local_edges and both.limit(local_edges + 1).count() <= local_edges:
        return _local_labels(both)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"))
        up = lower.select(F.col("id").alias("up"), F.col("label").alias("up_label"))
        new = cut(lower.join(up, lower["label"] == up["up"]).select("id", F.least("label", "up_label").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "id").where(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(edges: DataFrame, vertices: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(i, label): components numbered from 0 by their smallest node; isolated nodes included.

    Stored edges count whatever their weight.  Small graphs, by a count of their edges, are settled
    within a task; others by rounds of joins.
    """
    found = min_labels(edges, "i", "j", local_edges=local_edges)
    least = vertices.select("i").join(found, vertices["i"] == found["id"], "left").select("i", F.coalesce("label", "i").alias("least"))
    order = number_rows(least.where(F.col("least") == F.col("i")).select("least"), "least", name="label")
    return least.join(order, "least").select("i", F.col("label").cast("int"))


#: The most members that one row lists.
MOST_MEMBERS = 10_000_000


def component_members(labels: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(label, members): ascending node ids of each component.  A row holds a whole component, so
    larger ones than ``most``, counted, are refused: take (i, label) as it is, or ``local_numbers``."""
    largest = labels.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a component of {largest} members does not go into one row")
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("i")).alias("members"))


def local_numbers(labels: DataFrame, one_window: int = ONE_WINDOW) -> DataFrame:
    """(i, label, li): nodes numbered from 0 by id within their component.

    All nodes are numbered by (label, id), and a component's first number is taken off, so that a
    component that holds most nodes is no task of its own.
    """
    numbered = number_rows(labels.select("i", "label"), "label", "i", one_window=one_window)
    first = numbered.groupBy("label").agg(F.min("number").alias("first"))
    return numbered.join(first, "label").select("i", "label", (F.col("number") - F.col("first")).alias("li"))


def subgraphs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, li, lj, w): edges within components, nodes numbered from 0 by id in each."""
    local = local_numbers(labels)
    a = edges.join(local, "i")
    b = local.select(F.col("i").alias("j"), F.col("label").alias("other"), F.col("li").alias("lj"))
    return a.join(b, "j").where(F.col("label") == F.col("other")).select("label", "li", "lj", "w")


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``same``: whether two labellings group the nodes alike, whatever the names."""
    both = a.select("i", F.col("label").alias("x")).join(b.select("i", F.col("label").alias("y")), "i", "full")
    pairs = both.groupBy("x", "y").count()
    return pairs.agg(
        ((F.count(F.lit(1)) == F.countDistinct("x")) & (F.count(F.lit(1)) == F.countDistinct("y")) & (F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0)).alias("same")
    )
