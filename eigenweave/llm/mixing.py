"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected number of copies is its source's
target over its source's size. Inside a source the expected copies are prefix-summed in a fixed order,
one random offset is added, and a document is emitted once for every integer boundary that its stretch
of the prefix sum crosses. Expected copies are fixed-point integers, so the sums are exact and a rerun
gives the same mix on any partitioning.

The prefix sum is distributed: documents fall into cells (source, size class, salt); cells are summed
before any shuffle of rows, offsets are summed over cells and size classes, and only rows of a single cell
meet in one sort. Ordering by size class first makes the sample a stratified one, so the words
taken come close to the target although documents differ in length by orders of magnitude.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, word_count

SCALE_BITS = 26
#: A source's rows of one size class are dealt into so many cells at least, and into so many that a cell has about CELL_ROWS of them.
LEAST_SALTS, CELL_ROWS = 64, 65_536


def water_fill(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Split sum(sizes) by weight; no share above cap times its size, the excess reshared by weight."""
    caps = [cap * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    left, weight, level = float(sum(sizes)), float(sum(weights)), 0.0
    for i in order:
        level = left / weight
        if level <= caps[i] / weights[i]:
            break
        left, weight = left - caps[i], weight - weights[i]
    return [min(c, level * w) for c, w in zip(caps, weights, strict=True)]


def _offset(seed: str, key: str) -> int:
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:6], 16) << (SCALE_BITS - 24)


def _size_class(size: Column) -> Column:
    """Length in bits and the two bits after the leading one: classes about 20 % wide."""
    bits = F.length(F.bin(size))
    lead = F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 3, F.lit(0)))) % 4
    return (bits * 4 + lead).cast("int")


def salts(rows: int) -> int:
    """The least power of two, from LEAST_SALTS, with CELL_ROWS rows or fewer for each."""
    return max(LEAST_SALTS, 1 << max(0, -(-rows // CELL_ROWS) - 1).bit_length())


def _salt(doc_id: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 7), 16, 10).cast("int") % n


def systematic_copies(rows: DataFrame, group: str, units: str, cell: Sequence[str], order: Sequence[str], offset: str) -> DataFrame:
    """Add ``copies``: integer boundaries crossed by the prefix sum of `units` within `group`.

    `units` and `offset` are fixed-point longs with SCALE_BITS fraction bits. `cell` names a coarse and a
    fine key; the order inside a group is (coarse, fine, *order). Rows equal in all of these are
    interchangeable. An empty table gives an empty result.
    """
    coarse, fine = cell
    cells = rows.groupBy(group, coarse, fine).agg(F.sum(units).alias("_u"))
    in_class = Window.partitionBy(group, coarse).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_in", F.coalesce(F.sum("_u").over(in_class), F.lit(0)))
    classes = cells.groupBy(group, coarse).agg(F.sum("_u").alias("_cu"))
    before = Window.partitionBy(group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(group, coarse, F.coalesce(F.sum("_cu").over(before), F.lit(0)).alias("_before"))
    starts = cells.join(classes, [group, coarse]).select(group, coarse, fine, (F.col("_in") + F.col("_before")).alias("_start"))
    run = Window.partitionBy(group, coarse, fine).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_run", F.sum(units).over(run)).join(starts, [group, coarse, fine])
    end = F.col("_start") + F.col("_run") + F.col(offset)
    copies = F.shiftright(end, SCALE_BITS) - F.shiftright(end - F.col(units), SCALE_BITS)
    return out.withColumn("copies", copies).drop("_run", "_start")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, seed: str = "mix-1", max_sources: int = 100_000) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken.

    Sources are ordered by code point with null last and take `weights` in turn, repeating. A null or empty
    text has size 0 and takes no words; a source without words has target 0 and its documents no copies. Tied
    and repeated rows are sampled like any others. Other columns are ignored. The table of sources is the
    only thing brought to the driver and broadcast; more than `max_sources` of them is an error.
    """
    spark = docs.sparkSession
    base = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("_skey"), word_count(F.col(text_col)).alias("size")))
    found = base.groupBy("_skey").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["_skey"] == "n", r["_skey"]))
    sizes, given = [r["words"] for r in found], [float(weights[i % len(weights)]) for i in range(len(found))]
    targets = water_fill(sizes, given, max_repeat)
    units = [int(t / s * (1 << SCALE_BITS) + 0.5) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    plan = [(r["_skey"], s, t, u, _offset(seed, r["_skey"])) for r, s, t, u in zip(found, sizes, targets, units, strict=True)]
    plan = spark.createDataFrame(plan, "_skey string, source_size long, target double, _units long, _offset long")
    rows = base.join(F.broadcast(plan), "_skey").withColumn("_class", _size_class(F.col("size"))).withColumn("_salt", _salt(F.col("doc_id"), salts(sum(r["rows"] for r in found))))
    out = systematic_copies(rows, "_skey", "_units", ("_class", "_salt"), ("size", "doc_id"), "_offset")
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` repeated by its number of copies, same columns.

    Rows are matched by id and size; where several rows have both, they get copies in a fixed order of all columns' hash.
    """
    id_col = options.get("id_col", "doc_id")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), word_count(F.col(options.get("text_col", "text"))).alias("n"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("h"))
    found = checkpoint(mix(docs, **options).select(F.col("doc_id").alias("id2"), F.col("size").alias("n2"), "copies"))
    each = found.groupBy("id2", "n2").agg(F.count("*").alias("alike"), F.max("copies").alias("copies")).where("copies > 0")
    same = rows["id"].eqNullSafe(each["id2"]) & (rows["n"] == each["n2"])
    met = rows.join(each, same)
    once = met.where("alike = 1").select("row", "copies")
    place = lambda *by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    many = met.where("alike > 1").select("row", "id", "n", "h").withColumn("k", place("id", "n", order="h"))
    theirs = found.join(each.where("alike > 1").select(F.col("id2").alias("id3"), F.col("n2").alias("n3")), F.col("id2").eqNullSafe(F.col("id3")) & (F.col("n2") == F.col("n3"))).select("id2", "n2", "copies").withColumn("k2", place("id2", "n2", order="copies")).where("copies > 0")
    often = many.join(theirs, many["id"].eqNullSafe(theirs["id2"]) & (many["n"] == theirs["n2"]) & (many["k"] == theirs["k2"])).select("row", "copies")
    return once.union(often).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_mix_sources(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = rf"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
ord AS (SELECT *, row_number() OVER (ORDER BY skey = 'n', encode(skey)) - 1 AS k FROM src),
wts AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM ord),
lvl AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM wts WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pick AS (SELECT coalesce(first(level ORDER BY cap / w, k) FILTER (WHERE level <= cap / w), 0) AS lo FROM lvl),
tgt AS (SELECT skey, source_size, least(cap, lo * w) AS target FROM lvl, pick),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size * {1 << SCALE_BITS} + 0.5)::BIGINT END AS units,
         ('0x' || substr(md5('mix-1|' || skey), 1, 6))::BIGINT * {1 << (SCALE_BITS - 24)} AS off FROM tgt),
docs AS (
  SELECT b.*, p.* EXCLUDE (skey), length(bin(size)) * 4 + (size // (2 ** greatest(length(bin(size)) - 3, 0))::BIGINT) % 4 AS cls,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % (SELECT greatest({LEAST_SALTS}, 2 ** ceil(log2(greatest(1, ceil(count(*) / {CELL_ROWS}.0)))))::BIGINT FROM base) AS salt FROM base b JOIN plan p USING (skey)),
run AS (SELECT *, sum(units) OVER (PARTITION BY skey ORDER BY cls, salt, size, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT + off AS e FROM docs)
SELECT doc_id, size, source_size, target, ((e >> {SCALE_BITS}) - ((e - units) >> {SCALE_BITS}))::BIGINT * size AS taken,
       ((e >> {SCALE_BITS}) - ((e - units) >> {SCALE_BITS}))::BIGINT AS copies FROM run
"""
