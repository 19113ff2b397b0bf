"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hot_rows, lookup

#: Edges per task of a round: small edge tables run in few tasks, whatever the number of shuffle partitions.
TASK_EDGES = 100_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = _least(both).select("a", F.least("a", "m").alias("m"), "c")
    return lookup(both.where("b > a"), m, "a", "c", hot_rows(2 * n)).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    m = _least(e)
    moved = lookup(e, m, "a", "c", hot_rows(n)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(m.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the least node of its component.

    `edges` has two long columns a, b; loops, nulls and repeats are ignored. Every round is cut off by a checkpoint; rounds grow with
    the logarithm of the number of nodes. No group of edges is gathered: rounds are minima and equi joins, and nodes with very many
    edges take their minimum from a broadcast table (see `common.lookup`).
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = checkpoint(e), None
    n = e.count()
    for _ in range(most_rounds):
        if n == 0:
            break
        tasks = 1 + n // TASK_EDGES
        e = checkpoint(_small_star(_large_star(e.coalesce(tasks), n).coalesce(tasks), 2 * n).coalesce(tasks))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        n = now["n"]
        if (n, now["h"]) == seen:
            break
        seen = (n, now["h"])
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
