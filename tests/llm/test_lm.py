import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eigenweave.llm import lm
from eigenweave.llm import textkernel as K

from .helpers import clashing, documents, prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    base = [(i, prose(rng, rng.randint(1, 60))) for i in range(150)]
    return [*base, (200, None), (201, ""), (202, " \t"), (203, "Ab aB AB É é"), (204, prose(rng, 20_000)), (None, "no id"), base[3], base[3]]


@pytest.fixture(scope="module")
def scored(spark, rows):
    d = lm.score(clashing(documents(spark, rows)).repartition(3))
    return d.collect()


def test_base_against_brute_force(rows, scored):
    docs = [(i, [*words(t), "\n"]) for i, t in rows]
    c = Counter(w for i, ws in docs if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, out(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in docs)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_score_is_the_interpolated_model(rows, scored):
    """Against the model in plain Python, its weights learned by EM on each deleted token's own estimates."""
    docs = [(i, [*words(t), "\n"]) for i, t in rows]
    train = [ws for i, ws in docs if not out(i)]
    c, b = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["\r", *ws], ws, strict=False))
    n, v = sum(c.values()), len(c)
    c["\r"] = c["\n"]
    tokens = []
    for ws in train:
        for h, w in zip(["\r", *ws], ws, strict=False):
            hh = c[h] - 1
            tokens.append((int(math.log2(hh + 1)), (b[h, w] - 1) / hh if hh > 0 else 0.0, (c[w] - 1) / (n - 1)))
    weights = [[1 / 3] * 3 for _ in range(lm.BUCKETS)]
    for _ in range(60):
        total = [[1e-3] * 3 for _ in range(lm.BUCKETS)]
        for k, p2, p1 in tokens:
            share = [x * y for x, y in zip(weights[k], (p2, p1, 1 / (v + 1)), strict=True)]
            for j, x in enumerate(share):
                total[k][j] += x / sum(share)
        weights = [[x / sum(t) for x in t] for t in total]

    def log_p(ws):
        total = 0.0
        for h, w in zip(["\r", *ws], ws, strict=False):
            l2, l1, l0 = weights[int(lm.bucket(np.array([float(c[h])]))[0])]
            p = (l2 * b[h, w] / c[h] if c[h] else 0) + l1 * c[w] / n + l0 / (v + 1)
            total += math.log10(p if c[h] else p / (l1 + l0))
        return total

    want = sorted(((i if i is not None else -1), round(log_p(ws), 4)) for i, ws in docs)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), round(r["score"], 4)) for r in scored)
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=2e-3, atol=2e-3)


def test_bigrams_help_on_held_out_text(spark):
    rng = random.Random(1)
    chain = {w: [prose(rng, 1) for _ in range(2)] for w in (prose(rng, 1) for _ in range(40))}
    names = list(chain)
    def text():
        w, ws = rng.choice(names), []
        for _ in range(60):
            ws.append(w)
            nxt = rng.choice(chain[w])
            w = nxt if nxt in chain else rng.choice(names)
        return " ".join(ws)
    got = [r for r in lm.score(documents(spark, [(i, text()) for i in range(300)])).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


@pytest.mark.parametrize("part_bytes, step_bits", [(1 << 12, 2), (1 << 11, 3), (1 << 14, 1)])
def test_exchange_in_many_steps(spark, rows, scored, part_bytes, step_bits):
    d = documents(spark, rows).repartition(7)
    got = sorted(lm.score(d, batch_bytes=1 << 11, part_bytes=part_bytes, step_bits=step_bits).collect(), key=str)
    assert len(lm.steps(6, 2)) == 3 and lm.steps(7, 6) == [4, 3] and lm.steps(12) == [12] and lm.steps(13) == [7, 6]
    want = sorted(scored, key=str)
    key = lambda r: (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 5))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_empty_and_untrained(spark):
    assert lm.score(documents(spark, []).limit(0)).count() == 0
    i = next(i for i in range(100) if out(i))
    r = lm.score(documents(spark, [(i, "a b")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and math.isclose(r["base_score"], 0.0, abs_tol=1e-9) and math.isfinite(r["score"])


def test_packing():
    a, b = np.arange(1000, dtype=np.uint64) ** 3, np.zeros(0, np.uint32)
    x, y = lm._unpack(lm._pack(a, b))
    assert (x == a).all() and len(y) == 0
    buf, offsets = K.utf8(pa.array(["a b", None, ""]))
    uni, bi, at = lm.tokens(buf, offsets)
    assert np.diff(at).tolist() == [3, 1, 1] and len(uni) == len(bi) == 5 and uni[2] == uni[3] == uni[4]
