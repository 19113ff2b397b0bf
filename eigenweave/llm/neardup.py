"""MinHash near-duplicate components with sequential Bayesian verification.

1. Every document's set of word shingles is hashed and sketched in one pass; documents with equal sets fall
   into one class, represented by its least id, before anything else.
2. Representatives are banded. Members of a bucket become candidates of the bucket's least member: a star, never all pairs.
   The pairs of a large star are split into parts, to each of which the centre's text is sent once.
3. A candidate's signature is compared batch by batch; it is dropped once the posterior probability of
   reaching the threshold falls under `miss`; survivors are verified on their full shingle sets.
4. Stars alone could miss a link between two members neither of which is linked to the star's centre. So in each
   candidate component, documents outside its largest linked group meet all others of the component,
   in blocks of `block` rows; pairs that a union-find already joins are skipped.
5. Verified links are closed to components.

With the default 44 bands of 6 rows a pair at similarity 0.8 shares no band with probability 1.6e-6, pairs
above it with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import TASK_ROWS, checkpoint, hot_rows, lookup, release, salted
from .components import components

BANDS, ROWS = 44, 6
BATCH = 33
_RNG = np.random.Generator(np.random.PCG64(77))
_A = (_RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_MULT = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minhash(unique: np.ndarray) -> np.ndarray:
    """16-bit signature (one value per hash function) of a set of 64-bit hashes.

    A minimum of a large set is a small number, so that it is multiplied by an odd constant before its top bits are kept: equal minima give
    equal values, and unequal ones differ whatever the size of the sets.
    """
    x = (unique >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for c in range(0, len(x), 2048):
        np.minimum(least, (_A * x[None, c : c + 2048] + _B).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


@lru_cache(maxsize=16)
def posterior_floor(threshold: float, miss: float, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, least matches among the first n hashes) for which P(similarity >= threshold | matches) >= miss.

    Under a uniform prior the posterior is Beta(matches + 1, n - matches + 1), whose upper tail is a
    finite binomial sum.
    """
    out = []
    for n in range(batch, BANDS * ROWS + 1, batch):
        tail, least = 0.0, n + 1
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append((n, least))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `left` and `right` paired one to one: indices that outlive every batch, and their matches."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in posterior_floor(threshold, miss):
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1, dtype=np.int32)
        alive, done = alive[matches[alive] >= least], n
        if not len(alive):
            break
    return alive, matches[alive]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text, sorted; ASCII upper case counts as lower case."""
    buf, offsets = K.utf8(column)
    for i, j in K.slices(offsets):
        starts, ends, first = K.words(buf, offsets[i : j + 1])
        hashes, at = K.shingles(K.word_hashes(buf, starts, ends), first, width)
        for d in range(j - i):
            yield np.unique(hashes[at[d] : at[d + 1]])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_KEY_1, _KEY_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def set_key(unique: np.ndarray) -> np.uint64:
    return K.mix64(unique ^ _KEY_1).sum(dtype=np.uint64)


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for u in shingle_sets(b.column(1), width):
                n.append(len(u))
                k1.append(set_key(u))
                k2.append(K.mix64(u * _KEY_2).sum(dtype=np.uint64))
                sig.append(minhash(u).tobytes() if len(u) else None)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), as_long(k1), as_long(k2), pa.array(sig, pa.binary())], schema=schema)

    return run


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return K.mix64((parts * _BAND_MULT[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))


def _bands(batches):
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            keys = band_keys(_sig_matrix(part.column(1)))
            reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], names=["key", "rep"])


def _own(sets: Iterator[np.ndarray], keys: pa.Array) -> Iterator[np.ndarray | None]:
    """The sets that have the keys; None where an id is shared by rows of other texts and the set is not the one that was sketched."""
    for u, key in zip(sets, keys.to_numpy(), strict=True):
        yield u if np.uint64(key.view(np.uint64)) == set_key(u) else None


def _verify_pairs(width: int, percent: int, miss: float):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = {n: b.column(i).slice(at, 512) for i, n in enumerate(b.schema.names)}
                alive, _ = survivors(_sig_matrix(c["sig_a"]), _sig_matrix(c["sig_b"]), percent / 100, miss)
                keep = pa.array(alive)
                left, right = (_own(shingle_sets(c[f"text_{s}"].take(keep), width), c[f"key_{s}"].take(keep)) for s in "ab")
                good = alive[[x is not None and y is not None and linked(x, y, percent) for x, y in zip(left, right, strict=True)]] if len(alive) else alive
                yield pa.RecordBatch.from_arrays([c["a"].take(pa.array(good)), c["b"].take(pa.array(good))], names=["a", "b"])

    return run


def _verify_block(width: int, percent: int, miss: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t):
        t = t.combine_chunks()
        reps, roots, own = (t.column(n).to_numpy() for n in ("rep", "root", "own"))
        sig, sets, found = _sig_matrix(t.column("sig").combine_chunks()), {}, []
        texts, set_keys = t.column("text").combine_chunks(), t.column("key").combine_chunks()
        keys = band_keys(sig)
        mine = np.flatnonzero(own)
        parent = {r: r for r in set(roots.tolist())}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        left, right = np.repeat(mine, len(reps)), np.tile(np.arange(len(reps)), len(mine))
        apart = (roots[left] != roots[right]) & (~own[right] | (left < right))
        left, right = left[apart], right[apart]
        shared = np.zeros(len(left), bool)
        for band in range(BANDS):
            shared |= keys[left, band] == keys[right, band]
        left, right = left[shared], right[shared]
        alive, matches = survivors(sig[left], sig[right], percent / 100, miss)
        for i in alive[np.argsort(-matches, kind="stable")]:
            x, y = int(left[i]), int(right[i])
            p, q = find(roots[x]), find(roots[y])
            if p == q:
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = next(_own(shingle_sets(texts.slice(z, 1), width), set_keys.slice(z, 1)))
            if sets[x] is not None and sets[y] is not None and linked(sets[x], sets[y], percent):
                parent[max(p, q)] = min(p, q)
                found.append((reps[x], reps[y]))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-7, block: int = 128) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space, A-Z lower-cased; a set holds the distinct `width`-word shingles, or the whole sequence of a
    shorter text. Sets are linked where 100 * |intersection| >= percent * |union|. A null or empty text has an empty set and is
    linked with nothing. Rows that share an id are one document, linked wherever one of its texts is; n_shingles is each row's own. A row without an id stays alone, with a null
    component, and is kept. Other columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    # Read three times, then let go: kept on the executors' disks, and made again where one is lost.
    sketch = d.mapInArrow(_signatures(width), "doc_id long, n_shingles long, k1 long, k2 long, sig binary").persist(StorageLevel.DISK_ONLY)
    n = sketch.count()
    full = sketch.where("doc_id is not null and n_shingles > 0")
    # equal sets have equal signatures: any row's will do
    classes = checkpoint(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("rows")), n, 5_000)
    in_class = lookup(full.select("doc_id", "n_shingles", "k1", "k2"), classes.select("k1", "k2", "rep", "rows"), ["k1", "k2"], "rows", hot_rows(n))
    alone = sketch.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    known = checkpoint(in_class.select("doc_id", "n_shingles", "rep").union(alone), n)
    per_rep = classes.groupBy("rep").agg(F.sum("rows").alias("rows"))
    ids = known.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most"), F.count("*").alias("c")).where("c > 1")
    shared = checkpoint(ids, n)
    repeated = not shared.isEmpty()
    texts_of_one = shared.where("b < most").select("doc_id", "b").join(known, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")
    reps = classes.select("rep", F.col("k1").alias("key"), "sig")
    sketch.unpersist()
    del sketch, full, in_class, alone, ids
    release(spark)

    bands = reps.select("rep", "sig").mapInArrow(_bands, "key long, rep long")
    lead = bands.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("most"), F.count("*").alias("size")).where("b < most").select("key", "b", "size")
    stars = checkpoint(lookup(bands, lead, "key", "size", hot_rows(BANDS * n)).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), n)
    del bands, lead
    release(spark)
    around = components(stars)
    nodes = around.join(reps, F.col("node") == F.col("rep")).join(d.where("doc_id is not null"), F.col("node") == F.col("doc_id")).where(F.length("text") > 0)
    nodes = nodes.select(F.col("node").alias("rep"), "key", F.col("root").alias("around"), "sig", "text")
    if repeated:
        nodes = nodes.withColumn("same", F.xxhash64("text")).dropDuplicates(["rep", "key", "same"]).drop("same")
    nodes = checkpoint(nodes, n, 10_000)
    del around, reps
    release(spark)

    most = hot_rows(n)
    sizes = stars.groupBy("b").agg(F.count("*").alias("size")).where(F.col("size") > most).select("b", salted(F.col("size"), most).alias("parts"))  # at most MOST_HOT rows
    parts = F.coalesce("parts", F.lit(1))
    split = stars.join(F.broadcast(sizes), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    centres = nodes.join(stars.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi").join(F.broadcast(sizes.withColumnRenamed("b", "rep")), "rep", "left")
    centres = centres.select(F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("sig").alias("sig_b"), F.col("text").alias("text_b"), F.col("key").alias("key_b"))
    members = nodes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("text").alias("text_a"), F.col("key").alias("key_a"))
    pairs = split.join(members, "a").join(centres, ["b", "part"]).select("a", "sig_a", "text_a", "key_a", "b", "sig_b", "text_b", "key_b")
    links = pairs.mapInArrow(_verify_pairs(width, percent, miss), "a long, b long")
    links = checkpoint(links.union(texts_of_one) if repeated else links)
    del pairs, split, centres, members, stars, shared, texts_of_one
    release(spark)
    first = components(links)
    rest = _outside(nodes, first, block).groupBy("around", "i", "j").applyInArrow(_verify_block(width, percent, miss), "a long, b long")
    stars_of = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars_of.union(rest)).select(F.col("node").alias("rep"), "root")
    del nodes, links, first, rest, stars_of
    release(spark)
    # every class has a component: that of its representative where it has links, else its own
    of_rep = per_rep.join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("component_id"), "rows")
    linked_rows = lookup(known.where("n_shingles > 0 and doc_id is not null"), of_rep, "rep", "rows", hot_rows(n))
    out = linked_rows.select("doc_id", "n_shingles", "component_id").union(known.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("rep").alias("component_id")))
    return out.coalesce(1 + n // TASK_ROWS).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _outside(nodes: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Blocks in which what is not in a candidate component's largest linked group meets all of the component.

    Component sizes are found first; a component of m documents with r outside gives ceil(r/block) * ceil(m/block)
    groups of two blocks at most.
    """
    n = nodes.select("rep", "around").distinct().join(roots, F.col("rep") == F.col("node"), "left").select("rep", "around", F.coalesce("root", "rep").alias("root"))
    groups = n.groupBy("around", "root").agg(F.count("*").alias("c"))
    shape = groups.groupBy("around").agg(F.sum("c").alias("m"), F.max(F.struct("c", F.col("root").alias("main"))).alias("top")).select("around", "m", (F.col("m") - F.col("top.c")).alias("r"), "top.main").where("r > 0")
    cuts = shape.select("around", "main", F.ceil(F.col("r") / block).cast("int").alias("ni"), F.ceil(F.col("m") / block).cast("int").alias("nj"))
    n = checkpoint(n.join(cuts, "around").withColumn("own", F.col("root") != F.col("main")).withColumn("h", F.xxhash64("rep")))
    mine = n.where("own").select("rep", "root", "around", F.lit(True).alias("own"), F.expr("cast(pmod(h, ni) as int)").alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"))
    all_ = n.select("rep", "root", "around", F.lit(False).alias("own"), F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), F.expr("cast(pmod(h, nj) as int)").alias("j"))
    return mine.union(all_).join(nodes.select("rep", "key", "sig", "text"), "rep").select("around", "i", "j", "rep", "root", "own", "key", "sig", "text")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each group of near duplicates the document of least id.

    Where several rows have that id, the one of least hash of all columns stays. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, **options).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    judged = found.where("not _kept or _rows > 1").select(F.col("doc_id").alias("_id"), F.struct("_kept", "_rows").alias("_found"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    marked = docs.select(row.alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("_hash")).join(judged, "_id", "left")
    once = marked.where("_found is null").select("_row")
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_hash"))
    often = marked.where("_found._kept").withColumn("_place", place).where("_place = 1").select("_row")
    return once.union(often).select("_row.*")


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
