"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over all passages of the corpus; each item
   keeps its rarest words as index terms: `least_item_terms`, and up to `item_terms` while they are in at most a share `common` of the passages.
2. Items longer than a passage are cut into overlapping pieces of a passage's length, each a key of its own. The TF-IDF matrix of all
   corpus passages over the keys' terms, with the keys themselves as further rows of `ITEM_MASS` times the
   corpus's mass, so that they are not lost among its prose, is factored by a distributed randomised SVD: partitions add up A'(A Q) for a
   shared Q, the driver only orthonormalises a terms x rank matrix. The rank grows with the keys up to `most_rank`; beyond that, keys are
   dealt into groups, all of which are factored from one compact copy of the passages' index terms and judged together.
3. Every passage is projected to the latent space; items with a key at a cosine of `cosine` or more are its candidates (the passage's
   norm is that of its whole vector, so what the latent space leaves out counts against it).
4. A candidate whose words can reach the share at all (counted without order) is aligned, the whole item with all the text it can reach from there. It is a leak if the longest common subsequence of item and passage covers `verbatim` of the item's
   words, or `paraphrase` of them while the item's answer (its last sentence) is found too.

Passages are windows of two blocks of `BLOCK` words, one block apart, over whole texts. What is shipped with the plan
grows with the benchmark (checked against `most_items`), never with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from ..plans.matrix import total
from .common import checkpoint

BLOCK, LEAST_TERMS, SEED = 32, 3, 9
ITEM_MASS = 10.0
U = np.uint64


@dataclass
class Terms:
    """Sorted word hashes with a bitmap in front, to look words up fast."""

    hashes: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `h` of known words, and their numbers."""
        at = np.flatnonzero(self.bits[(h >> U(44)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        good = self.hashes[k] == h[at]
        return at[good], k[good]


def word_hashes(text: str) -> np.ndarray:
    buf, offsets = K.utf8(pa.array([text]))
    starts, ends, _ = K.words(buf, offsets, K.NOT_WORD)
    return K.word_hashes(buf, starts, ends)


def answer_of(text: str) -> str:
    """The last sentence of three words or more, else the last quarter of the words (three at least)."""
    for s in reversed(re.split(r"(?<=[.!?])\s+|\n+", text.strip())):
        if len(s.split()) >= 3:
            return s
    words = text.split()
    return " ".join(words[-max(3, len(words) // 4) :])


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


def pieces(words: np.ndarray) -> list[np.ndarray]:
    """The keys of an item: itself, or stretches of a passage's length, a block apart, the last one at its end."""
    size = 2 * BLOCK
    if len(words) <= size:
        return [words]
    return [words[i : i + size] for i in sorted({*range(0, len(words) - size, BLOCK), len(words) - size})]


def lcs_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: the places of every word of the other sequence of n."""
    v = full = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def place_masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _pieces(column: pa.Array):
    """(first row, word hashes, first word of each row) for pieces of the rows."""
    buf, offsets = K.utf8(column)
    for i, j in K.slices(offsets):
        starts, ends, first = K.words(buf, offsets[i : j + 1], K.NOT_WORD)
        yield i, K.word_hashes(buf, starts, ends), first


def _blocks(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of every word position and a block number that rises over rows, with a gap between rows."""
    row = np.searchsorted(first, at, "right") - 1
    n = np.diff(first) // BLOCK + 2
    base = np.cumsum(n) - n
    return row, base[row] + (at - first[row]) // BLOCK


def _frequencies(terms: Terms):
    def run(batches):
        for b in batches:
            for _, h, first in _pieces(b.column(0)):
                at, k = terms.find(h)
                _, block = _blocks(at, first)
                seen = np.unique(block * (len(terms.hashes) + 1) + k) % (len(terms.hashes) + 1)
                total = int((-(-np.diff(first) // BLOCK)).sum())
                k, n = np.unique(seen, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, -1].astype(np.int64)), pa.array(np.r_[n, total].astype(np.int64))], names=["term", "n"])

    return run


class Windows:
    """Passages of index terms: entries sorted by block; a window is a block and the next one."""

    def __init__(self, block: np.ndarray, term: np.ndarray):
        self.block, self.term = block, term
        self.heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        self.ids = block[self.heads]
        self.of = np.repeat(np.arange(len(self.ids)), np.diff(np.r_[self.heads, len(block)]))
        self.has_next = np.r_[self.ids[1:] == self.ids[:-1] + 1, False] if len(self.ids) else np.zeros(0, bool)
        self.stops = np.r_[self.heads[1:], len(block)] if len(self.ids) else self.heads

    def rich(self, least: int) -> np.ndarray:
        """Windows of at least `least` distinct terms."""
        if not len(self.ids):
            return np.zeros(0, bool)
        end = np.where(self.has_next, np.r_[self.stops[1:], 0], self.stops)
        enough = end - self.heads >= least
        own, before = enough[self.of], np.r_[False, (enough & self.has_next)[:-1]][self.of]
        n = int(self.term.max(initial=0)) + 1
        seen = np.unique(np.concatenate([self.of[own] * n + self.term[own], (self.of[before] - 1) * n + self.term[before]]))
        return np.bincount(seen // n, minlength=len(self.ids)) >= least

    def project(self, basis: np.ndarray, alive: np.ndarray) -> np.ndarray:
        z = basis[self.term[self.heads]]
        size, j = self.stops - self.heads, 1
        while len(some := np.flatnonzero(size > j)):  # the j-th term of all blocks that have one
            z[some] += basis[self.term[self.heads[some] + j]]
            j += 1
        more = np.flatnonzero(self.has_next)
        z[more] += z[more + 1].copy()  # sums of single blocks: the right side is read before any is written
        z[~alive] = 0
        return z

    def norms(self, idf: np.ndarray) -> np.ndarray:
        """Length of every window's TF-IDF vector."""
        n = len(idf)
        before = np.r_[False, self.has_next[:-1]][self.of] if len(self.ids) else np.zeros(0, bool)
        cells, tf = np.unique(np.concatenate([self.of * n + self.term, (self.of[before] - 1) * n + self.term[before]]), return_counts=True)
        return np.sqrt(np.bincount(cells // n, (tf * idf[cells % n]) ** 2, minlength=len(self.ids)))

    def back(self, z: np.ndarray) -> np.ndarray:
        """For every block, the sum of z over the windows that hold it."""
        out = z.copy()
        prev = np.flatnonzero(self.has_next) + 1
        out[prev] += z[prev - 1]
        return out


def _compact(terms: Terms, least: int):
    def run(batches):
        for b in batches:
            for _, h, first in _pieces(b.column(0)):
                at, k = terms.find(h)
                if not len(at):
                    continue
                _, block = _blocks(at, first)
                w = Windows(block, k)
                good = w.rich(least)
                keep = good.copy()
                keep[1:] |= good[:-1] & w.has_next[:-1]
                entry = keep[w.of]
                if entry.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block[entry].astype(np.int64).tobytes()], pa.binary()), pa.array([k[entry].astype(np.int32).tobytes()], pa.binary())], names=["block", "term"])

    return run


def _apply_gram(compact: DataFrame, own: np.ndarray, idf: np.ndarray, q: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """A'(A q) for the passages of the corpus and the keys' own rows; `own` numbers the terms of the compact copy, -1 for those of other groups."""
    basis, some = (idf[:, None] * q).astype(np.float32), bool((own < 0).any())

    def work(batch):
        out = np.zeros(q.shape, np.float32)
        for blocks, ks in zip(batch.column(0), batch.column(1), strict=True):
            block, k = np.frombuffer(blocks.as_py(), np.int64), own[np.frombuffer(ks.as_py(), np.int32)]
            if some:
                block, k = block[k >= 0], k[k >= 0]
            w = Windows(block, k)
            z = w.back(w.project(basis, w.rich(least)))
            for c in range(0, z.shape[1], 16):
                add = np.ascontiguousarray((z[:, c : c + 16][w.of] * idf[w.term][:, None]).T)
                for j, v in enumerate(add, c):
                    out[:, j] += np.bincount(w.term, v, minlength=len(out))
        return out

    return total(compact, q.shape, work, np.float32).astype(np.float64) + keys.T @ (keys @ q)


def latent_space(compact: DataFrame, own: np.ndarray, idf: np.ndarray, keys: np.ndarray, rank: int, least: int, power: int = 0) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix by a randomised range finder with `power` more rounds."""
    rng = np.random.default_rng(SEED)
    q = rng.standard_normal((len(idf), min(len(idf), rank + 8)))
    for _ in range(1 + power):
        q, _ = np.linalg.qr(_apply_gram(compact, own, idf, q, keys, least))
    small = q.T @ _apply_gram(compact, own, idf, q, keys, least)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


@dataclass
class Space:
    """A group of keys with its index terms and latent space."""

    item: np.ndarray  # the item of every key
    terms: Terms
    idf: np.ndarray
    scaled: np.ndarray  # terms x rank, float32
    latent: np.ndarray  # keys x rank, float32
    least: int

    def candidates(self, h: np.ndarray, first: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, first word of the passage, cosine) of every passage and key near it."""
        at, k = self.terms.find(h)
        if not len(at):
            return
        row, block = _blocks(at, first)
        w = Windows(block, k)
        alive = w.rich(self.least)
        some = np.flatnonzero(alive)
        if not len(some):
            return
        size, z = w.norms(self.idf), w.project(self.scaled, alive)
        for c in range(0, len(some), 4096):
            part = some[c : c + 4096]
            cos = z[part] @ self.latent.T / np.maximum(size[part], 1e-12)[:, None]
            for x, key in zip(*np.nonzero(cos >= cosine), strict=True):
                head = w.heads[part[x]]
                r = int(row[head])
                yield r, int(self.item[key]), int(first[r] + (at[head] - first[r]) // BLOCK * BLOCK), float(cos[x, key])

    def bytes(self) -> int:
        return self.scaled.nbytes + self.latent.nbytes + 24 * len(self.idf)


@dataclass
class Judge:
    """What every task needs to judge passages: the items and the spaces of some groups of their keys."""

    items: list[Item]
    every: Terms
    spaces: list[Space]
    cosine: float
    verbatim: float
    paraphrase: float
    answer: float

    def _aligner(self, it: int):
        if not hasattr(self, "_ready"):
            self._ready = {}
        if it not in self._ready:
            i = self.items[it]
            self._ready[it] = (place_masks(i.words), len(i.words), place_masks(i.answer), len(i.answer), np.unique(np.searchsorted(self.every.hashes, i.words)))
        return self._ready[it]

    def judge(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, float, float, int]]:
        """(row, item) of every leak: the share aligned, the answer's share, the cosine and the first word of the best passage."""
        low = min(self.paraphrase, self.verbatim)
        best: dict[tuple[int, int], tuple] = {}
        for i0, h, first in _pieces(texts):
            found: dict[tuple[int, int, int], tuple[int, float]] = {}
            for space in self.spaces:
                for r, it, start, cos in space.candidates(h, first, self.cosine):
                    # passages less than a quarter of a long item apart are aligned once, with all they can reach
                    place = (r, it, (start - int(first[r])) // max(BLOCK, len(self.items[it].words) // 4))
                    old = found.get(place, (start, cos))
                    found[place] = (min(old[0], start), max(old[1], cos))
            if not found:
                continue
            known, word = self.every.find(h)
            for (r, it, _), (start, cos) in sorted(found.items()):
                mask, n, amask, an, own = self._aligner(it)
                lo, hi = max(int(first[r]), start - n), min(int(first[r + 1]), start + max(0, n // 4 - BLOCK) + 2 * BLOCK + n)
                a, b = np.searchsorted(known, (lo, hi))
                if (own[np.minimum(np.searchsorted(own, word[a:b]), len(own) - 1)] == word[a:b]).sum() < low * n:  # no order can align as many
                    continue
                near = h[known[a:b]].tolist()
                share = lcs_length(mask, n, near) / n
                if share < low:
                    continue
                answered = lcs_length(amask, an, near) / max(an, 1)
                if share >= self.verbatim or share >= self.paraphrase and answered >= self.answer:
                    new = (share, answered, cos, start - int(first[r]))
                    if (i0 + r, it) not in best or new > best[i0 + r, it]:
                        best[i0 + r, it] = new
        return best


def _report(judge: Judge):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer_lcs", pa.float64()), ("first_word", pa.int64())])

    def run(batches):
        for b in batches:
            best = judge.judge(b.column(1))
            keys = sorted(best)
            v = [best[k] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([judge.items[k[1]].item_id for k in keys], pa.int64()), *[pa.array([x[n] for x in v], pa.float64()) for n in (2, 0, 1)], pa.array([x[3] for x in v], pa.int64())], schema=schema)

    return run


def _filter(judge: Judge, text_col: str):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[k[0] for k in judge.judge(b.column(b.schema.get_field_index(text_col)).cast(pa.string()))]] = False
            yield b.filter(pa.array(keep))

    return run


def _judges(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", item_terms: int = 16, least_item_terms: int = 10, common: float = 0.003, rank: int = 256, most_rank: int = 1024, group: int | None = None,
            cosine: float = 0.35, verbatim: float = 0.7, paraphrase: float = 0.5, answer: float = 0.6, most_items: int = 200_000, judge_bytes: int = 256 << 20) -> Iterator[Judge]:
    """One judge, or as many as keep the spaces of each under `judge_bytes`. A group has `group` keys, by default as many as the rank tells apart."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} benchmark items")
    items = [Item(r["item_id"], word_hashes(r["text"]), word_hashes(answer_of(r["text"]))) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))]
    items = [i for i in items if len(i.words)]
    if not items:
        return
    every = Terms(np.unique(np.concatenate([i.words for i in items])))
    counts = {r["term"]: r["n"] for r in texts.mapInArrow(_frequencies(every), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # words of the benchmark
    n = max(counts.get(-1, 0), 1)
    df = np.array([counts.get(k, 0) for k in range(len(every.hashes))], np.float64)
    all_idf = np.log((counts.get(-1, 0) + 2) / (df + 1))
    keys = [(it, w) for it, i in enumerate(items) for w in pieces(i.words)]
    rank = max(rank, min(most_rank, -(-len(keys) * 8 // 7 // 256) * 256))
    group = group or rank * 7 // 8
    groups = []
    for at in range(0, len(keys), group):
        part, kept = keys[at : at + group], set()
        for _, words in part:
            own = np.searchsorted(every.hashes, np.unique(words))
            own = own[np.argsort(-all_idf[own], kind="stable")][:item_terms]
            kept.update(own[(df[own] <= common * n) | (np.arange(len(own)) < least_item_terms)].tolist())
        keep = np.array(sorted(kept))
        matrix, terms = np.zeros((len(part), len(keep)), np.float32), Terms(every.hashes[keep])
        for k, (_, words) in enumerate(part):
            np.add.at(matrix[k], terms.find(words)[1], all_idf[keep][terms.find(words)[1]])
        groups.append((part, keep, max(1, min(LEAST_TERMS, int((matrix > 0).sum(1).min())))))
    whole = np.unique(np.concatenate([keep for _, keep, _ in groups]))
    compact = checkpoint(texts.mapInArrow(_compact(Terms(every.hashes[whole]), min(least for *_, least in groups)), "block binary, term binary"))
    compact = compact.coalesce(1 + compact.count() // 64)
    spaces: list[Space] = []
    for part, keep, least in groups:
        terms, idf, own = Terms(every.hashes[keep]), all_idf[keep], np.full(len(whole), -1)
        own[np.searchsorted(whole, keep)] = np.arange(len(keep))
        matrix = np.zeros((len(part), len(keep)))
        for k, (_, words) in enumerate(part):
            _, t = terms.find(words)
            np.add.at(matrix[k], t, idf[t])
        mass = 2 * (df[keep] * idf**2).sum()
        weight = np.sqrt(max(ITEM_MASS * mass / (matrix**2).sum(), 1.0))
        basis = latent_space(compact, own, idf, matrix * weight, min(rank, len(keep)), least)
        latent = ((matrix @ basis) / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        spaces.append(Space(np.array([it for it, _ in part]), terms, idf, (idf[:, None] * basis).astype(np.float32), latent, least))
        if sum(s.bytes() for s in spaces) >= judge_bytes:
            yield Judge(items, every, spaces, cosine, verbatim, paraphrase, answer)
            spaces = []
    if spaces:
        yield Judge(items, every, spaces, cosine, verbatim, paraphrase, answer)


_LEAKS = ("doc_id", "item_id", "cosine", "lcs", "answer_lcs", "first_word")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer_lcs, first_word): one row for each row of docs and each item it leaks, from the best passage.

    Words are runs of ASCII digits and letters and of characters outside ASCII, A-Z lower-cased. Null or empty texts and items, and items without
    a word, leak nothing; repeated rows are judged each, repeated items too; rows with a null id come out with it; other columns are ignored. An empty table on
    either side gives no rows. More than `most_items` items are an error. For `options` see `_judges`.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, lcs double, answer_lcs double, first_word long"
    out, more = None, False
    for judge in _judges(d.select("text"), benchmark, **options):
        found = d.mapInArrow(_report(judge), schema)
        out, more = (found, False) if out is None else (out.union(found), True)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out if not more else out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer_lcs", "cosine", "first_word")).alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer_lcs", "m.first_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all their columns, that leak no item, judged as by `leaks`. A projection of each row: nothing is joined back."""
    out = docs
    for judge in _judges(docs.select(F.col(text_col).cast("string").alias("text")), benchmark, **options):
        out = out.mapInArrow(_filter(judge, text_col), docs.schema)
    return out


def op4_decontaminate(spark, sf_dir):
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
