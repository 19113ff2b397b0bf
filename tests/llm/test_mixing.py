import random
from pathlib import Path

import pytest

from eigenweave.llm import mixing

from .helpers import clashing, documents, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 5, 30, 200])), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(9000, None, "en", "a"), (9001, "", "en", "empty"), (9002, "one", "en", "\U0001f600"), (9003, prose(rng, 30_000), "en", "b"), (None, "two words", "en", "b"), (5, rows[5][1], "en", rows[5][3])]
    return documents(spark, rows).cache()


def test_mix(spark, docs):
    got = mixing.mix(clashing(docs)).collect()
    assert len(got) == docs.count()
    sources = {(r["doc_id"], len((r["text"] or "").split())): r["source"] for r in docs.collect()}
    by: dict = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by.setdefault(sources[r["doc_id"], r["size"]], []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode("utf-32-be")) + [None]
    total = sum(r["size"] for r in got)
    sizes, weights = [sum(r["size"] for r in by[n]) for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))]
    # by hand: share by weight, stop at three times the size, reshare what is over
    target, open_ = [0.0] * len(names), set(range(len(names)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i], left = 3.0 * sizes[i], left - 3.0 * sizes[i]
            open_.discard(i)
    for n, s, t in zip(names, sizes, target, strict=True):
        assert {r["source_size"] for r in by[n]} == {s} and all(abs(r["target"] - t) < 1e-6 * max(t, 1) for r in by[n])
        longest = max(r["size"] for r in by[n])
        assert abs(sum(r["taken"] for r in by[n]) - t) <= max(0.06 * t, 2 * longest)


def test_reruns_agree_on_any_partitioning(docs):
    key = lambda d: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in d.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7, "text")))


def test_emit(docs):
    d = clashing(docs)
    got = mixing.emit(d)
    assert got.columns == d.columns
    want = {}
    for r in mixing.mix(docs).collect():
        k = (r["doc_id"], r["size"])
        want[k] = want.get(k, 0) + r["copies"]
    have = {}
    for r in got.collect():
        k = (r["doc_id"], len((r["text"] or "").split()))
        have[k] = have.get(k, 0) + 1
    assert have == {k: v for k, v in want.items() if v}


def test_water_fill_and_limits(docs):
    assert mixing.water_fill([10, 10], [1, 1], 3) == [10, 10]
    assert mixing.water_fill([1, 99], [9, 1], 3) == [3, 97]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.emit(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, max_sources=2)


def test_systematic_boundaries(spark):
    rows = spark.createDataFrame([("g", 0, 0, i, u << 24, 3 << 24) for i, u in enumerate([1, 3, 2, 9, 0, 5])], "g string, c int, f int, i int, u long, o long")
    got = [r["copies"] for r in mixing.systematic_copies(rows, "g", "u", ("c", "f"), ("i",), "o").orderBy("i").collect()]
    run, want = 3, []
    for u in [1, 3, 2, 9, 0, 5]:
        want.append((run + u) // 4 - run // 4)
        run += u
    assert got == want


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = mixing.op5_mix_sources(spark, SF)
    want = con.sql(mixing.OP5_SQL).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
