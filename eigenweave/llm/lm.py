"""Language-model scoring by deleted interpolation of word n-grams.

The probability of a token mixes three estimates: the bigram's and the unigram's maximum likelihood and a uniform one,

    P(w | h) = l2[b] * c(h w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1),

with weights l[b] for the bucket b of the context's frequency c(h). The weights are learned by expectation-maximisation on
held-out counts: every training token in turn is deleted from the counts and predicted from the rest.

Counts cover the whole corpus and grow with it, so no table of them is collected or broadcast. Texts are packed once, in batches,
and vocabularies are exchanged through a butterfly of group-bys:

1. each batch sends its distinct unigram and bigram hashes, with its training counts, in up to 2**STEP_BITS ranges of the hash space, to a
   group of about as many batches; a word as frequent as it may be is sent once by each batch;
2. a group and range merges what it gets and passes it on, in as many times finer ranges, to a group of as many times more batches, until
   one group holds all batches of a range: these are the corpus's counts;
3. the answers take the same way back, each step putting them in the order in which they were asked for, to the batch, which stores the two
   counts of each of its tokens;
4. one pass over those counts fills a bounded histogram for EM, another scores the texts.

What a task holds is about `part_bytes` of text's worth of words at every step and size of the corpus; cells are batches times ranges
times steps, and steps grow with the logarithm of the corpus: one up to 32 GB, two up to 128 TB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checkpoint

U = np.uint64
_END, _START = U(0x5DEECE66D1234567), U(0x2545F4914F6CDD1D)
_LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_KEEP = U(0xFFFFFFFFFFFFFF00)  # bigrams: 56 bits
BATCH_BYTES, PART_BYTES = 16 << 20, 8 << 20
STEP_BITS = 12
BUCKETS = 26
B2, B1 = 4, 4  # histogram bins an octave; a bin keeps the mean of what is in it
N2, N1 = 34 * B2 + 1, 42 * B1 + 1


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _zip(data: bytes) -> bytes:
    return _ZIP.compress(data)


def _unzip(data: bytes, size: int) -> bytes:
    return _UNZIP.decompress(data, max_output_size=max(1, size))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    out = []
    for a in arrays:
        z = _zip(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out += [np.array([len(a), a.itemsize, len(z)], np.int64).tobytes(), z]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, size, length = np.frombuffer(blob, np.int64, 3, at)
        at += 24
        raw = _unzip(blob[at : at + length], int(n * size))
        at += int(length)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(int(size), int(n)).T).view(f"u{size}").ravel())
    return out


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by an end token; bigram keys, each of a token and the one before; token offsets by row."""
    parts, counts = [], []
    for i, j in K.slices(offsets):
        starts, ends, first = K.words(buf, offsets[i : j + 1])
        parts.append(K.word_hashes(buf, starts, ends))
        counts.append(np.diff(first))
    hashes = np.concatenate(parts) if parts else np.zeros(0, U)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + 1, out=at[1:])
    out = np.empty(at[-1], U)
    end = np.zeros(at[-1], bool)
    end[at[1:] - 1] = True
    out[end], out[~end] = _END, hashes
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = _START
    return out, K.mix64(before * _LEFT + K.mix64(out * _RIGHT)) & _KEEP, at


def steps(part_bits: int, step_bits: int = STEP_BITS) -> list[int]:
    """Bits of the hash space that each step of the exchange tells apart; their sum is part_bits."""
    n = max(1, -(-part_bits // step_bits))
    return [part_bits // n + (k < part_bits % n) for k in range(n)]


def _cells(keys: np.ndarray, counts: np.ndarray, prefix: int, known: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys, all with the same `known` first bits `prefix`, and their counts by the next `bits` bits."""
    edges = np.array([((prefix << bits) + k) << (64 - known - bits) for k in range(1, 1 << bits)], U)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    return [(keys[i:j], counts[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64 if len(x) and x.max() >= 2**32 else np.uint32)


def _pack_cells(uni, bi) -> list[bytes]:
    return [_pack(np.diff(a, prepend=U(0)), _narrow(m), np.diff(b, prepend=U(0)), _narrow(n)) for (a, m), (b, n) in zip(uni, bi, strict=True)]


def _batches(batch: pa.RecordBatch, most: int):
    """Pieces of at most `most` bytes of (doc_id, text, held out): ids, flags, bytes and sizes."""
    buf, offsets = K.utf8(batch.column(1))
    ids = batch.column(0)
    held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    for i, j in K.slices(offsets, most):
        yield ids[i:j], known[i:j], held[i:j], buf[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1])


def _pack_texts(most: int):
    """One row a batch; its number, unlike all others, is mixed from those of the partition and of the batch in it."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for ids, known, held, buf, size in _batches(b, most):
                name = int(K.mix64(np.array([(task << 32) + n], U)).view(np.int64)[0])
                text = _zip(buf.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_pack(ids, known.astype(np.uint8), held.astype(np.uint8), size)], pa.binary()), pa.array([text], pa.binary())], names=["batch", "rows", "text"])
                n += 1

    return run


def _unpack_texts(rows: bytes, text: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    got = _unpack(rows)
    offsets = np.concatenate([[0], np.cumsum(got[3].view(np.int64))]).astype(np.int64)
    return got, np.frombuffer(_unzip(text, int(offsets[-1])), np.uint8), offsets


_ASKED = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("child", pa.int64()), ("blob", pa.binary())])


def _requests(bits: int, group_bits: int):
    """What batches ask for: cells of `bits` bits of hash space, to groups of the first `group_bits` bits of the batch's number."""

    def run(batches):
        for b in batches:
            for name, rows, text in zip(*b.columns, strict=True):
                got, buf, offsets = _unpack_texts(rows.as_py(), text.as_py())
                uni, bi, at = tokens(buf, offsets)
                train = np.repeat(got[2] == 0, np.diff(at))
                cells = []
                for keys in (uni, bi):
                    distinct, place = np.unique(keys, return_inverse=True)
                    cells.append(_cells(distinct, np.bincount(place[train], minlength=len(distinct)), 0, 0, bits))
                blobs, child = _pack_cells(*cells), name.as_py()
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array([(child % 2**64) >> (64 - group_bits)] * n, pa.int64()), pa.array(np.arange(n)), pa.array([child] * n, pa.int64()), pa.array(blobs, pa.binary())], schema=_ASKED)

    return run


def _merged(blobs: pa.ChunkedArray):
    """Of each kind: the distinct keys asked for, their summed counts, each asker's places among them."""
    asked = [_unpack(b.as_py()) for b in blobs]
    for kind in (0, 2):
        sizes = np.cumsum([len(a[kind]) for a in asked])[:-1]
        distinct, place = np.unique(np.concatenate([np.cumsum(a[kind], dtype=U) for a in asked]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([a[kind + 1] for a in asked]).astype(np.int64))
        yield distinct, total, np.split(place, sizes)


def _merge(known: int, bits: int):
    """Pass the sums of a group and range on, by finer ranges, to the group of groups."""

    def run(key, t):
        g, r = (k.as_py() for k in key)
        cells = [_cells(keys, total, r, known, bits) for keys, total, _ in _merged(t.column("blob"))]
        blobs = _pack_cells(*cells)
        n = len(blobs)
        return pa.Table.from_arrays([pa.array([g >> bits] * n, pa.int64()), pa.array((r << bits) + np.arange(n)), pa.array([g] * n, pa.int64()), pa.array(blobs, pa.binary())], schema=_ASKED)

    return run


_REPLY = pa.schema([("child", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("reply", pa.binary())])


def _replies(t, r: int, n: int, v: int, uni, bi) -> pa.Table:
    rows = t.num_rows
    blobs = [_pack(a, b) for a, b in zip(*[[_narrow(total[p]) for p in places] for total, places in (uni, bi)], strict=True)]
    return pa.Table.from_arrays([t.column("child").combine_chunks(), pa.array([r] * rows, pa.int64()), pa.array([n] * rows, pa.int64()), pa.array([v] * rows, pa.int64()), pa.array(blobs, pa.binary())], schema=_REPLY)


def _answer(key, t):
    """The corpus's counts of a range, to all that asked; with them, of the range, training tokens and distinct ones."""
    (_, u_total, u_places), (_, b_total, b_places) = _merged(t.column("blob"))
    return _replies(t, key[1].as_py(), int(u_total.sum()), int((u_total > 0).sum()), (u_total, u_places), (b_total, b_places))


def _whole(replies: pa.Table, parts: int) -> tuple[list[np.ndarray], int, int]:
    """Replies of all parts of a range in order, and the sums of their tokens and distinct tokens."""
    t = replies.sort_by("r").to_pylist()
    if len(t) != parts:
        raise RuntimeError(f"{len(t)} of {parts} answers arrived")
    got = [_unpack(x["reply"]) for x in t]
    return [np.concatenate([g[k].astype(U) for g in got]) for k in (0, 1)], sum(x["n"] for x in t), sum(x["v"] for x in t)


def _route(bits: int):
    """Answers of the finer ranges back to those that asked this group and range."""

    def run(key, asked, replies):
        totals, n, v = _whole(replies, 1 << bits)
        places = [p for _, _, p in _merged(asked.column("blob"))]
        return _replies(asked, key[1].as_py(), n, v, *[(x, p) for x, p in zip(totals, places, strict=True)])

    return run


_COUNTED = pa.schema([("rows", pa.binary()), ("at", pa.binary()), ("uni", pa.binary()), ("bi", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _meet(parts: int):
    def run(left, right):
        out = {f.name: [] for f in _COUNTED}
        if left.num_rows:
            sums, n, v = _whole(right, parts)
        for r in left.to_pylist():  # one: numbers of batches are unlike
            _, buf, offsets = _unpack_texts(r["rows"], r["text"])
            uni, bi, at = tokens(buf, offsets)
            counts = [_narrow(s[np.unique(k, return_inverse=True)[1]]) for k, s in zip((uni, bi), sums, strict=True)]
            for key, x in zip(out, (r["rows"], _pack(np.diff(at)), _pack(counts[0]), _pack(counts[1]), n, v), strict=True):
                out[key].append(x)
        return pa.table(out, schema=_COUNTED)

    return run


def _contexts(uni: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the token before; a row's start counts as often as the end token."""
    out = np.empty_like(uni)
    out[1:] = uni[:-1]
    out[at[:-1]] = uni[at[1:] - 1]
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def _bins(p: np.ndarray, per_octave: int, n: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        k = np.round(-np.log2(p) * per_octave)
    return np.where(p > 0, np.minimum(1 + k, n - 1), 0).astype(np.int64)


def _read(r: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    rows, counts = _unpack(r["rows"]), _unpack(r["at"])[0].view(np.int64)
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return rows, at, _unpack(r["uni"])[0].astype(np.float64), _unpack(r["bi"])[0].astype(np.float64)


def _histogram(batches):
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("p2", pa.float64()), ("p1", pa.float64()), ("v", pa.int64())])
    for b in batches:
        for r in b.to_pylist():
            rows, at, uni, bi = _read(r)
            context = _contexts(uni, at)
            train = np.repeat(rows[2] == 0, np.diff(at))
            c, u, h = bi[train] - 1, uni[train] - 1, context[train] - 1
            p2, p1 = np.where(h > 0, c / np.maximum(h, 1), 0), u / max(r["n"] - 1, 1)
            cells, place, n = np.unique((bucket(h) * N2 + _bins(p2, B2, N2)) * N1 + _bins(p1, B1, N1), return_inverse=True, return_counts=True)
            sums = [np.bincount(place, p, len(cells)) for p in (p2, p1)]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array([r["v"]] * len(n), pa.int64())], schema=schema)


def learn_weights(buckets: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (BUCKETS x 3: bigram, unigram, uniform) by EM on held-out tokens: n of a bucket with these estimates."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    p = np.stack([p2, p1, np.full(len(n), 1 / (vocabulary + 1))], 1)
    for _ in range(rounds):
        share = weights[buckets] * p
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(buckets, share[:, k], BUCKETS) for k in range(3)], 1) + np.array([1e-3, 1e-3, 1e-3])
        weights = total / total.sum(1, keepdims=True)
    return weights


def _score(weights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows, at, uni, bi = _read(r)
                if not len(rows[0]):
                    continue
                n, v = r["n"], r["v"]
                context = _contexts(uni, at)
                w = weights[bucket(context)]
                # an unseen context has no bigram estimate: its share goes to the others
                seen = context > 0
                p = np.where(seen, w[:, 0] * bi / np.maximum(context, 1), 0) + w[:, 1] * uni / max(n, 1) + w[:, 2] / (v + 1)
                p /= np.where(seen, 1, w[:, 1] + w[:, 2])
                sums = [np.add.reduceat(x, at[:-1]) for x in (np.log10((uni + 0.5) / (n + 0.5 * (v + 1))), np.log10(p), (uni > 0).astype(np.int64))]
                ids = pa.array(rows[0].view(np.int64), pa.int64(), mask=rows[1] == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows[2] == 1), pa.array(np.diff(at)), pa.array(sums[2]), pa.array(np.full(len(ids), n)), pa.array(sums[0]), pa.array(sums[1])], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, step_bits: int = STEP_BITS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone. Null ids hash as the empty string; repeated rows count and are scored each; other columns
    are ignored; an empty table gives no rows. Without training rows all counts are 0 and both scores come from the uniform share. Texts
    are read once, so that batches are the same wherever they are used.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    packed = checkpoint(d.mapInArrow(_pack_texts(batch_bytes), "batch long, rows binary, text binary"))
    size = docs.select(F.octet_length(F.col(text_col).cast("string")).alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = steps(max(3, int(-(-size // part_bytes) - 1).bit_length()), step_bits)
    kind = "g long, r long, child long, blob binary"
    asked = [packed.mapInArrow(_requests(bits[0], sum(bits[1:])), kind)]
    for k in range(1, len(bits)):
        asked.append(asked[-1].groupBy("g", "r").applyInArrow(_merge(sum(bits[:k]), bits[k]), kind))
    reply = "child long, r long, n long, v long, reply binary"
    answers = asked[-1].groupBy("g", "r").applyInArrow(_answer, reply)
    for k in range(len(bits) - 1, 0, -1):
        back = answers.select(F.col("child").alias("g"), F.shiftright("r", bits[k]).alias("up"), "r", "n", "v", "reply")
        answers = asked[k - 1].groupBy("g", "r").cogroup(back.groupBy("g", "up")).applyInArrow(_route(bits[k]), reply)
    counted = checkpoint(packed.groupBy("batch").cogroup(answers.groupBy("child")).applyInArrow(_meet(1 << bits[0]), "rows binary, at binary, uni binary, bi binary, n long, v long"))
    sums = [F.sum(c).alias(c) for c in ("n", "p2", "p1")]
    cells = counted.mapInArrow(_histogram, "cell long, n long, p2 double, p1 double, v long").groupBy("cell").agg(*sums, F.max("v").alias("v")).toPandas().sort_values("cell")  # at most BUCKETS * N2 * N1 rows
    n = cells["n"].to_numpy()
    weights = learn_weights(cells["cell"].to_numpy() // (N2 * N1), n, cells["p2"].to_numpy() / n, cells["p1"].to_numpy() / n, int(cells["v"].max()) if len(cells) else 0)
    return counted.mapInArrow(_score(weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
