"""Language identification by a byte convolutional network, trained and run in NumPy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter is max-pooled over
its window, and a softmax layer gives the language. The network is trained on the driver on a bounded
sample of labelled texts (`per_lang` documents of each language, fewer where there are very many languages, and `windows` windows of each)
and shipped, some tens of kilobytes, with the plan. Prediction reads every window of every text; windows overlap by the widest
filter less one, so no n-gram is lost at a seam. A document's log-probability is the mean of its windows', by length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 12
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1
UNDETERMINED = "und"
#: Rows of a language are ranked in so many parts first, so that none is ranked whole by one task.
SALTS = 64


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the rows: start, length, row. An empty row has none."""
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(1, -(-(size - (WIDEST - 1)) // STRIDE)), 0)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + k * STRIDE
    return start, np.minimum(WINDOW, offsets[1:][row] - start), row


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as a byte matrix, padded with 0."""
    at = start[:, None] + np.arange(WINDOW)
    out = buf[np.minimum(at, len(buf) - 1)]
    out[np.arange(WINDOW) >= length[:, None]] = 0
    return out


@dataclass
class ByteCNN:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filt: np.ndarray  # WIDEST * EMBED x filters; narrower filters are 0 beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        return np.concatenate([np.repeat((np.arange(WIDEST * EMBED) < w * EMBED)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> ByteCNN:
        f = len(WIDTHS) * FILTERS
        g = lambda *s: rng.standard_normal(s).astype(np.float32)
        return cls(langs, g(256, EMBED) * 0.5, g(WIDEST * EMBED, f) * 0.25 * cls.mask(), np.zeros(f, np.float32), g(f, len(langs)) * 0.2, np.zeros(len(langs), np.float32))

    def columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        v = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), WIDEST * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(v).reshape(-1, WIDEST * EMBED)

    def pool(self, x: np.ndarray) -> np.ndarray:
        z = (self.columns(x) @ self.filt).reshape(len(x), STRIDE, -1)
        return np.maximum(z.max(axis=1) + self.bias, 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        s = self.pool(x) @ self.out + self.out_bias
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, steps: int = 700, batch: int = 96, rate: float = 4e-3) -> ByteCNN:
        params = [self.embed, self.filt, self.bias, self.out, self.out_bias]
        m, v, mask = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], self.mask()
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            cols = self.columns(xb)
            z = (cols @ self.filt).reshape(batch, STRIDE, -1)
            arg = z.argmax(axis=1)
            top = np.take_along_axis(z, arg[:, None], 1)[:, 0] + self.bias
            h = np.maximum(top, 0)
            s = h @ self.out + self.out_bias
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            p /= batch
            dh = (p @ self.out.T) * (top > 0)
            at = (np.arange(batch)[:, None] * STRIDE + arg).ravel()
            seen = cols[at].reshape(batch, -1, WIDEST * EMBED)
            d_filt = np.einsum("bfk,bf->kf", seen, dh) * mask
            d_cols = (dh[:, :, None] * self.filt.T[None]).reshape(batch, -1, WIDEST, EMBED)
            d_embed = np.zeros_like(self.embed)
            for w in range(WIDEST):
                np.add.at(d_embed, xb[np.arange(batch)[:, None], arg + w], d_cols[:, :, w])
            grads = [d_embed, d_filt, dh.sum(0), h.T @ p, p.sum(0)]
            lr = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
            for q, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def fit(labelled: DataFrame, per_lang: int = 300, windows: int = 16, most_documents: int = 60_000, seed: int = 11) -> ByteCNN | None:
    """Train on (doc_id, text, lang): of each language `per_lang` documents, those of least hash of id and text.

    Every language is learned. With so many that `per_lang` of each were more than `most_documents` in all, each has fewer, one at least. Null ids
    hash like any other value; equal rows count each, and no more than `per_lang` of them are taken. Rows without text or label are left out; None if nothing
    is left. At most `windows` windows of a document, evenly spaced, reach the driver.
    """
    own = F.xxhash64("doc_id", "text")
    d = labelled.where("text is not null and lang is not null").select("text", "lang", own.alias("h"))
    n_langs = d.select("lang").distinct().count()
    if not n_langs:
        return None
    per_lang = max(1, min(per_lang, most_documents // n_langs))

    def least(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("place") <= per_lang).drop("place")

    # The greatest hash among the first of each language, found on hashes alone; then the rows up to it, no more than are wanted.
    first = least(least(d.select("lang", "h").withColumn("salt", F.pmod(F.xxhash64("h", F.spark_partition_id()), F.lit(SALTS))), "lang", "salt"), "lang")
    cuts = F.broadcast(first.groupBy("lang").agg(F.max("h").alias("cut")))  # one row a language
    chosen = least(d.join(cuts, "lang").where("h <= cut"), "lang").select("text", "lang")

    def sample(batches):
        for b in batches:
            buf, offsets = K.utf8(b.column(0))
            start, length, row = cut(buf, offsets)
            n = np.bincount(row, minlength=b.num_rows)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            step = -(-n // windows)
            keep = k % np.maximum(step, 1)[row] == 0
            start, length, row = start[keep], length[keep], row[keep]
            x = gather(buf, start, length) if len(row) else np.zeros((0, WINDOW), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), pa.array([w.tobytes() for w in x], pa.binary())], names=["lang", "x"])

    rows = chosen.mapInArrow(sample, "lang string, x binary").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "x"])
    langs = sorted(rows["lang"].unique())
    x = np.frombuffer(b"".join(rows["x"]), np.uint8).reshape(-1, WINDOW)
    y = rows["lang"].map({name: k for k, name in enumerate(langs)}).to_numpy()
    rng = np.random.default_rng(seed)
    return ByteCNN.fresh(langs, rng).train(x, y, rng, steps=max(700, 3 * len(langs)))


def _predict(model: ByteCNN | None):
    def run(batches):
        for b in batches:
            n = b.num_rows
            score = np.zeros(n)
            best = np.full(n, -1)
            if model is not None:
                buf, offsets = K.utf8(b.column(1))
                for i, j in K.slices(offsets, 1 << 20):
                    start, length, row = cut(buf, offsets[i : j + 1])
                    total, weight = np.zeros((j - i, len(model.langs))), np.zeros(j - i)
                    for c in range(0, len(row), 64):
                        part = slice(c, c + 64)
                        lp = model.log_probs(gather(buf, start[part], length[part])) * length[part][:, None]
                        r = row[part]
                        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                        total[r[head]] += np.add.reduceat(lp, head, axis=0)
                        weight[r[head]] += np.add.reduceat(length[part], head)
                    mean = total / np.maximum(weight, 1)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            known = b.column(2).to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
            names = np.array([*(model.langs if model else []), UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score. A null text, or one without a letter, is `und` with score 0."""
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return d.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit_documents(docs: DataFrame) -> ByteCNN | None:
    """The model of the query: from text and lang of the documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def op6_language_id(spark, sf_dir):
    """Null ids hash as the empty string; repeated rows are predicted each; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit_documents(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: ByteCNN | None, least: float = 0.35, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose language is determined with at least probability `least`.

    With `lang_col` that column, where it is null, is filled with the prediction; a label that is there stays.
    """
    judge = _predict(model)

    def run(batches):
        for b in batches:
            letters = b.column(b.num_columns - 1)
            own = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(b.schema.get_field_index(text_col)), letters], names=["doc_id", "text", "letters"])
            for p in judge([own]):
                good = (p.column(2).to_numpy(zero_copy_only=False) >= least) & (p.column(1).to_numpy(zero_copy_only=False) != UNDETERMINED)
                kept = b.select(list(range(b.num_columns - 1)))
                if lang_col is not None:
                    at = kept.schema.get_field_index(lang_col)
                    kept = kept.set_column(at, lang_col, pc.coalesce(kept.column(at), p.column(1).cast(kept.column(at).type)))
                yield kept.filter(pa.array(good))

    own = "_letters"
    while own in docs.columns:
        own += "_"
    marked = docs.withColumn(own, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, docs.schema)
