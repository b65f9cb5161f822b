"""Connected components by alternating large-star and small-star rounds over staged tables.

The label of a component is its smallest node. Edges stay in DataFrames; the driver learns only whether all of them make
stars. A node with very many edges is salted: its edges are dealt by a hash of their other ends, and only one row for each
salt in use meets at the node itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stage

#: Parts that the edges of a node are dealt into.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, salt, m): for each u of edges (u, v, salt) and each of its salts, the smallest v of u."""
    some = edges.groupBy("u", "salt").agg(F.min("v").alias("m"))
    return some.withColumn("m", F.min("m").over(Window.partitionBy("u")))


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = _salted(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    low = _with_least(both).select("u", "salt", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    edges = _salted(edges)
    low = _with_least(edges)
    moved = edges.join(low, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u of another: then each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    odd = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1")
    return odd.isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (u long, v long). Returns (node, component_id) for each node that has an edge to another.

    Null ends and self loops are ignored; repeated edges count once. An empty input gives an empty result.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _all_stars(edges):
            leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
            return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
        edges = stage(_small_star(_large_star(edges)), "stars", instead_of=edges)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] in place; labels[i] is the smallest index of i's class."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
