"""Nearest neighbours by inner product with additive quantisation.

A vector is approximated by a sum of one full-dimensional code word from each codebook. Codebooks are fitted by k-means on residuals over a
bounded sample, then refined by least squares; vectors are encoded by beam search. Beside the code the norm of the vector and of its
approximation is stored: the approximation is shorter than the vector, by more or less, so that scores are scaled by the ratio of both.

Search scores every code against the queries with lookup tables (one table entry per codebook and code word). In each block of codes
the best `pool` of each query are reranked exactly, in double precision, on the original vectors, which travel with their codes; only the
k + 1 best of each query leave a block. All rows are indexed and scored: on vectors without strong clusters, coarse lists of them would
have to be read by half to keep nine tenths of the neighbours.

Copies of a vector are indexed once: each distinct vector keeps the k + 1 smallest ids of its copies, all that a result can name, and is
expanded to them at the end. Where scores tie, the smaller id comes first, in whatever order blocks come.

The stated queries meet the rows in blocks: `query_block` queries with about `code_block` rows at a time. A task takes several blocks of rows in turn
and keeps the best so far, so that a query leaves at most `most_parts` lists, which are merged as a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hot_rows, lookup

BOOKS, WORDS, BEAM, SAMPLE, SEED = 20, 256, 4, 16384, 5
#: Times the books are refitted in turn.
SWEEPS = 4
#: Bytes of vectors in a block, and ids of copies that meet in one group.
BLOCK_BYTES, MOST_COPIES = 16 << 20, 65_536


@dataclass
class AdditiveQuantiser:
    books: np.ndarray  # books x words x dimension, float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows x books) of least squared error found by beam search over the books in turn."""
        n, (m, k, d) = len(x), self.books.shape
        x = x.astype(np.float32)
        residual, codes, error = x[:, None, :].copy(), np.zeros((n, 1, m), np.uint8), (x * x).sum(1)[:, None]
        for b in range(m):
            book = self.books[b]
            e = error[:, :, None] - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, -1, k) + (book * book).sum(1)
            flat = e.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // k, best % k
            error = np.take_along_axis(flat, best, 1)
            residual = np.take_along_axis(residual, parent[:, :, None], 1) - book[word]
            codes = np.take_along_axis(codes, parent[:, :, None], 1)
            codes[:, :, b] = word
        return np.take_along_axis(codes, error.argmin(1)[:, None, None], 1)[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for b in range(len(self.books)):
            out += self.books[b][codes[:, b]]
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of all code words with the queries: books x words x queries."""
        return np.ascontiguousarray(self.books @ queries.T.astype(np.float32))

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = SEED) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        words = min(words, len(x))
        residual, out = x.copy(), []
        for _ in range(books):
            centre = residual[rng.choice(len(x), words, replace=False)].copy()
            for _ in range(8):
                near = ((centre * centre).sum(1) - 2 * residual @ centre.T).argmin(1)
                count = np.bincount(near, minlength=words)
                total = np.zeros_like(centre)
                np.add.at(total, near, residual)
                centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre).astype(np.float32)
            near = ((centre * centre).sum(1) - 2 * residual @ centre.T).argmin(1)
            residual = residual - centre[near]
            out.append(centre)
        q = cls(np.stack(out))
        for _ in range(rounds):  # codes by beam search, then the books in turn: least squares given the others, held near what they were
            codes = np.concatenate([q.encode(x[i : i + 1024]) for i in range(0, len(x), 1024)])
            residual = x - q.decode(codes)
            for b in np.tile(np.arange(books), SWEEPS):
                own, code = q.books[b], codes[:, b].astype(np.int64)
                total = own.copy()
                np.add.at(total, code, residual + own[code])
                new = total / (1 + np.bincount(code, minlength=words))[:, None].astype(np.float32)
                residual += own[code] - new[code]
                q.books[b] = new
        return q


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) without null, zero or non-finite vectors; one row per id (the least vector), of the commonest dimension."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists("v", lambda c: c != 0)
    v = v.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))
    return v


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def search(vectors: DataFrame, every: int = 20, k: int = 20, pool: int = 160, id_col: str = "vec_id", vec_col: str = "embedding",
           query_block: int = 4096, code_block: int = 8192, most_parts: int = 64, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, its k nearest among all other rows.

    Nearest first, ties to the smaller id; all candidates if there are fewer. Vectors that are null, zero, hold null or non-finite components,
    or are not of the commonest dimension take no part; rows that share an id are one (the least vector). Empty input gives no rows.
    Books are fitted on `sample` vectors of least id hash; every distinct vector is indexed.
    """
    spark = vectors.sparkSession
    v = checkpoint(usable(vectors, id_col, vec_col))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    d, total = dims["d"], dims["count"]
    v = v.where(F.size("v") == d)
    hashed = v.select("v", F.xxhash64("vec_id").alias("h"))
    if total > 4 * sample:  # four times as many as are wanted are sorted: fewer than wanted are found with a probability under 1e-100
        hashed = hashed.where(F.col("h") < int(-(2**63) + 4 * sample / total * 2**64))
    rows = hashed.orderBy("h").limit(sample).toArrow()
    quantiser = AdditiveQuantiser.fit(_matrix(rows.sort_by("h").column("v").combine_chunks(), d))
    del rows

    def classes_of(t: DataFrame, *by: str) -> DataFrame:
        return t.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))

    copies, n_part = v.select("v", F.array("vec_id").alias("ids"), "vec_id"), -(-total // MOST_COPIES)
    if n_part > 1:  # no aggregate of very common vectors holds all their ids
        copies = classes_of(copies.withColumn("part", F.expr(f"pmod(xxhash64(vec_id), {n_part})")), "v", "part")
    classes = checkpoint(classes_of(copies, "v").select(F.col("ids")[0].alias("vec_id"), "v", "ids"))

    code_block = max(1, min(code_block, BLOCK_BYTES // (8 * d)))
    n_code, n_query = -(-total // code_block), -(-(total // every + 1) // query_block)

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1), d)
                codes = quantiser.encode(x)
                near = np.linalg.norm(quantiser.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), _blobs(x), _blobs(codes), pa.array(np.linalg.norm(x, axis=1).astype(np.float32)), pa.array(near.astype(np.float32))], names=["vec_id", "x", "code", "norm", "near"])

    codes = classes.select("vec_id", "v").mapInArrow(encode, "vec_id long, x binary, code binary, norm float, near float").withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id), {n_code}) as int)"))

    def pack_codes(key, t):
        t = t.sort_by("vec_id")
        scale = t.column("norm").to_numpy() / np.maximum(t.column("near").to_numpy(), np.float32(1e-30))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()), "scale": pa.array([scale.astype(np.float32).tobytes()], pa.binary()), **{c: pa.array([b"".join(t.column(c).to_pylist())], pa.binary()) for c in ("code", "x")}})

    packed = checkpoint(codes.groupBy("block").applyInArrow(pack_codes, "block int, ids binary, scale binary, code binary, x binary"))

    def pack_queries(key, t):
        t = t.sort_by("vec_id")
        return pa.table({"q": pa.array([key[0].as_py()], pa.int32()), "qids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()), "qv": pa.array([_matrix(t.column("v").combine_chunks(), d).tobytes()], pa.binary())})

    queries = v.where(F.col("vec_id") % every == 0).withColumn("q", F.expr(f"cast(pmod(xxhash64(vec_id, 1), {n_query}) as int)"))
    q_blocks = queries.groupBy("q").applyInArrow(pack_queries, "q int, qids binary, qv binary")
    per_task = -(-n_code // most_parts)
    met = packed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))).join(q_blocks, "q").withColumn("part", F.floor(F.col("block") / per_task).cast("int"))
    met = met.repartition("q", "part").sortWithinPartitions("q", "part", "block")

    def score(batches):
        """The best of each query in the blocks of a part, one block in hand."""
        now = qids = i = s = None

        def best():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([qids.tobytes()], pa.binary()), pa.array([len(s)], pa.int32()), pa.array([np.ascontiguousarray(i).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(s).tobytes()], pa.binary())], names=["q", "qids", "n", "ids", "s"])

        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if now is not None and now != (r["q"], r["part"]):
                    yield best()
                    now = None
                if now is None:
                    now, qids, i, s = (r["q"], r["part"]), np.frombuffer(r["qids"], np.int64), None, None
                    qv = np.frombuffer(r["qv"]).reshape(-1, d)
                ids, code = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["code"], np.uint8).reshape(-1, BOOKS)
                new_i, new_s = block_best(quantiser, ids, code, np.frombuffer(r["scale"], np.float32), np.frombuffer(r["x"]).reshape(-1, d), qv, pool, k + 1)
                i, s = (new_i, new_s) if i is None else _top(np.concatenate([i, new_i]), np.concatenate([s, new_s]), k + 1)
        if now is not None:
            yield best()

    def merge(batches):
        """Rows come sorted by block of queries; only the best of one block are held."""
        q = qids = i = s = None

        def best():
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qids[None], i.shape).ravel()), pa.array(i.ravel()), pa.array(s.ravel())], names=["query_id", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                own_i, own_s = (np.frombuffer(r[c], t).reshape(r["n"], -1) for c, t in (("ids", np.int64), ("s", np.float64)))
                if q == r["q"]:
                    i, s = _top(np.concatenate([i, own_i]), np.concatenate([s, own_s]), k + 1)
                    continue
                if q is not None:
                    yield best()
                q, qids, i, s = r["q"], np.frombuffer(r["qids"], np.int64), own_i, own_s
        if q is not None:
            yield best()

    scored = met.select("q", "part", "qids", "qv", "ids", "scale", "code", "x").mapInArrow(score, "q int, qids binary, n int, ids binary, s binary")
    found = checkpoint(scored.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "query_id long, vec_id long, score double"))
    named = found.groupBy("vec_id").agg(F.count("*").alias("c")).join(classes.select("vec_id", "ids"), "vec_id")
    scores = lookup(found, named, "vec_id", "c", hot_rows((k + 1) * (total // every + 1))).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))  # at most (k + 1)^2 rows a query
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def block_best(quantiser: AdditiveQuantiser, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, x: np.ndarray, queries: np.ndarray, pool: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores (n x queries, or fewer) of the best rows of a block for each query: `pool` by lookup tables, then exactly."""
    out_i, out_s = [], []
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        tables = quantiser.tables(q)
        s = tables[0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            s += tables[m][codes[:, m]]
        s *= scale[:, None]
        places, _ = _top(np.broadcast_to(np.arange(len(ids))[:, None], s.shape), s, pool)
        exact = np.stack([np.einsum("ij,j->i", x[places[:, c]], q[c]) for c in range(len(q))], axis=1)
        best_i, best_s = _top(ids[places], exact, n)
        out_i.append(best_i)
        out_s.append(best_s)
    return np.concatenate(out_i, axis=1), np.concatenate(out_s, axis=1)


def _top(i: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best of each column, in no order: greatest scores, ties to the smaller id."""
    if len(s) <= n:
        return np.ascontiguousarray(i), np.ascontiguousarray(s)
    best = np.argpartition(-s, n - 1, axis=0)[:n]
    least = np.take_along_axis(s, best, 0).min(0)
    for c in np.flatnonzero((s >= least).sum(0) > n):
        best[:, c] = np.lexsort((i[:, c], -s[:, c]))[:n]
    return np.take_along_axis(i, best, 0), np.take_along_axis(s, best, 0)


def op9_additive_quantisation(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
