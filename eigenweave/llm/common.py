"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A maximal run of characters outside ASCII white space: the word of most contracts here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the one the cluster names, else, in local mode only (tests), one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="eigenweave-ckpt-"))
    return named or sc.getCheckpointDir()


#: Rows of a task where their number is known: small tables are written by few tasks, in few files.
TASK_ROWS = 100_000


def checkpoint(df: DataFrame, rows: int | None = None, per_task: int = TASK_ROWS) -> DataFrame:
    """Materialise df in the shared checkpoint folder; survives the loss of any executor. `rows`: how many there are at most."""
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(1 + rows // per_task)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key with more rows than `hot_rows` is hot; the second number bounds how many such keys there can be.
LEAST_HOT, MOST_HOT = 1_000, 50_000


def hot_rows(n: int) -> int:
    """Rows from which a key counts as hot in a table of at most n rows: fewer than MOST_HOT keys can have more."""
    return max(LEAST_HOT, -(-n // MOST_HOT))


def lookup(rows: DataFrame, table: DataFrame, by: str | list[str], count: str, hot: int) -> DataFrame:
    """Inner join of `rows` with `table`, which has one row a key and how many rows there are of it in `count`.

    Hot keys are looked up in a broadcast of their own, of fewer than MOST_HOT rows (a table of n rows has no more keys of n / MOST_HOT
    rows), and their rows are dealt out by a salt; only rows of other keys meet by key.
    """
    by = [by] if isinstance(by, str) else list(by)
    values = [c for c in table.columns if c not in (*by, count)]
    found = F.struct(F.lit(1).alias("_one"), *values)
    marked = rows.join(F.broadcast(table.where(F.col(count) > hot).select(*by, found.alias("_hot"))), by, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(1 << 30))).cast("int"))
    both = marked.join(table.where(F.col(count) <= hot).select(*by, F.lit(0).alias("_salt"), found.alias("_cold")), [*by, "_salt"], "left")
    both = both.where("_hot is not null or _cold is not null")
    return both.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values])


def salted(n_rows: Column, hot: int) -> Column:
    """Number of parts a key of n rows is split into."""
    return F.ceil(F.coalesce(n_rows, F.lit(1)) / F.lit(hot)).cast("int")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
