"""Positions of samples, and groups of consecutive samples for lagged passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint

SID = "__sid"


def indexed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `__sid`, the position (from 0) in the order of `keys`, nulls first.

    Rows are range-partitioned and sorted; a row's number within its partition and the sizes of the partitions
    before give its rank, so no task ever holds more than its own range. The ranges are checkpointed between the two steps.
    """
    ranged = checkpoint(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("__m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("__m", 33).alias("p")).count().collect()  # one row a partition
    starts, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        starts[r["p"]] = at
        at += r["count"]
    if not starts:
        return ranged.withColumn(SID, F.lit(0).cast("long")).drop("__m")
    table = F.broadcast(df.sparkSession.createDataFrame(list(starts.items()), "__p long, __start long"))
    placed = ranged.withColumn("__p", F.shiftright("__m", 33)).join(table, "__p")
    return placed.withColumn(SID, F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__start")


def with_halo(df: DataFrame, ahead: int, least: int = 4096) -> DataFrame:
    """Deal rows to groups `__g` of consecutive positions, each group with the `ahead` rows that follow it.

    `__own` marks a group's own rows. Groups hold at least four times as many rows of their own as borrowed ones, so at most
    a quarter of the rows is sent twice; both are bounded by the lag, not by the data.
    """
    size = max(least, 4 * ahead)
    group = F.floor(F.col(SID) / size)
    homes = F.when((group > 0) & (F.pmod(F.col(SID), F.lit(size)) < ahead), F.array(group, group - 1)).otherwise(F.array(group))
    return df.withColumn("__g", F.explode(homes)).withColumn("__own", F.col("__g") == group)
