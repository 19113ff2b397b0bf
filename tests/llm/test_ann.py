from pathlib import Path

import numpy as np
import pytest

from eigenweave.llm import ann

SF = "/root/testdata/sf0.01"


def brute(ids, v, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = v @ v[q]
        order = sorted((j for j in range(len(ids)) if j != q), key=lambda j: (-s[j], ids[j]))[:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    got = ann.search(table(spark, [(i, list(map(float, x))) for i, x in enumerate(v)]).repartition(5), code_block=400, query_block=32).collect()
    want = brute(np.arange(1500), v, 20, 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert np.isclose(r["score"], v[r["query_id"]] @ v[r["vec_id"]], rtol=1e-12)
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(rows, rows[1:]))
        hits += len({r[1] for r in rows} & {j for j, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_odd_vectors(spark):
    good = [(i, [1.0, float(i), 0.5]) for i in range(1, 6)] + [(20, [1.0, 1.0, 1.0])]
    bad = [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 1.0]), (100, [1.0, float("nan"), 1.0]), (120, [float("inf"), 1.0, 1.0]), (140, []), (160, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    from pyspark.sql import functions as F

    d = table(spark, [*good, *bad, good[0]]).withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).withColumn("query_id", F.lit(0))
    got = ann.search(d).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {20} and [r["vec_id"] for r in got] == [5, 4, 3, 2, 1]
    assert [r["score"] for r in got] == [6.5, 5.5, 4.5, 3.5, 2.5]


def test_ties_go_to_the_smaller_id(spark):
    got = ann.search(table(spark, [(i, [1.0, 1.0]) for i in range(60)])).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(60) if i != 20][:20]


def test_more_copies_than_the_pool(spark):
    rng = np.random.default_rng(2)
    copies = set(rng.choice(1000, 400, replace=False).tolist())
    rows = [(i, [1.0] * 8 if i in copies else list(map(float, rng.uniform(0, 0.3, 8)))) for i in range(1000)]
    got = {}
    for r in ann.search(table(spark, rows).repartition(5), code_block=100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: [x[n] for n in sorted(x)] for q, x in got.items()} == {q: sorted(copies - {q})[:20] for q in range(0, 1000, 20)}


def test_ties_at_the_end_of_a_pool():
    i, s = np.arange(50)[::-1, None].copy(), np.ones((50, 1))
    s[3] = 2.0
    assert sorted(ann._top(i, s, 10)[0][:, 0].tolist()) == [*range(9), 46]


def test_empty(spark):
    assert ann.search(table(spark, [])).count() == 0
    assert ann.search(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert ann.search(table(spark, [(20, [1.0, 2.0])])).count() == 0


def test_encoding_improves_with_books():
    x = np.random.default_rng(1).normal(size=(600, 12)).astype(np.float32)
    error = [((x - q.decode(q.encode(x))) ** 2).mean() for q in (ann.AdditiveQuantiser.fit(x, books=b, words=32) for b in (1, 4, 8))]
    assert error[0] > error[1] > error[2]
    q = ann.AdditiveQuantiser.fit(x, books=4, words=32)
    assert ((x - q.decode(q.encode(x, 8))) ** 2).mean() <= ((x - q.decode(q.encode(x, 1))) ** 2).mean()
    t = q.tables(x[:3])
    codes = q.encode(x[:5])
    assert np.allclose(sum(t[b][codes[:, b]] for b in range(4)), q.decode(codes) @ x[:3].T, atol=1e-3)


def test_query(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = brute(ids, v, 20, 20)
    got = ann.op9_additive_quantisation(spark, SF).collect()
    hits = sum(r["vec_id"] in {j for j, _ in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values())) and len(got) == sum(map(len, want.values()))
