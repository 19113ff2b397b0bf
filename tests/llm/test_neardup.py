import random
import re
from pathlib import Path

import numpy as np
import pytest

from eigenweave.llm import components, neardup

from .helpers import clashing, documents, prose

SF = "/root/testdata/sf0.001"


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent=80):
    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, set()).update(shingles(t, width))
    ids = sorted(by)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = {}
    for i in ids:
        for s in by[i]:
            post.setdefault(s, []).append(i)
    pairs = {(a, b) for v in post.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        if 100 * len(by[a] & by[b]) >= percent * len(by[a] | by[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(by[i]), find(i)) for i in ids}


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out, k = [], 0
    for _ in range(25):
        base = prose(rng, rng.randint(5, 150))
        for _ in range(rng.choice([1, 2, 6])):
            out.append((k, edited(rng, base, rng.choice([0, 0.01, 0.02, 0.05]))))
            k += 1
    chain = prose(rng, 120).split()
    for step in range(12):  # each like the next, the ends unlike
        out.append((k, " ".join(chain[step * 6 : step * 6 + 60])))
        k += 1
    return [*out, (k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "one two"), (k + 6, prose(rng, 30_000)), (-5, out[0][1].upper())]


@pytest.mark.parametrize("width", [4, 5])
def test_components_against_brute_force(spark, rows, width):
    d = clashing(documents(spark, rows)).repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(d, width=width, block=4).collect()}
    want = brute(rows, width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_large_group_of_copies(spark):
    rng = random.Random(1)
    base = prose(rng, 80)
    rows = [(i, base) for i in range(400)] + [(1000 + i, edited(rng, base, 0.012)) for i in range(150)] + [(5000, prose(rng, 80))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, rows), width=4, block=32).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_null_ids_and_empty(spark):
    got = neardup.near_duplicates(documents(spark, [(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")])).collect()
    assert len(got) == 3 and all(r["kept"] for r in got)
    assert neardup.near_duplicates(documents(spark, []).limit(0)).count() == 0
    twice = neardup.near_duplicates(documents(spark, [(3, "a b c d e"), (3, "a b c d e"), (4, "a b c d e")])).collect()
    assert len(twice) == 3 and {r["component_id"] for r in twice} == {3}


def test_pruning_keeps_what_is_over_the_threshold():
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(60):
        n = 400
        common = int(n * 0.9)
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common).astype(np.uint64)])
        alive, _ = neardup.survivors(neardup.minhash(np.unique(a))[None], neardup.minhash(np.unique(b))[None], 0.8, 1e-7)
        lost += len(alive) == 0
    assert lost == 0
    x, y = (rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(2))
    assert len(neardup.survivors(neardup.minhash(np.unique(x))[None], neardup.minhash(np.unique(y))[None], 0.8, 1e-7)[0]) == 0
    floors = neardup.posterior_floor(0.8, 1e-7)
    assert [n for n, _ in floors] == list(range(33, 265, 33)) and all(m < 0.8 * n for n, m in floors)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 3)], "a long, b long")
    assert {tuple(r) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["root"] for r in components.components(path).collect()} == {0}
    assert components.components(e.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op10_near_duplicates(spark, SF).collect()}
    assert got == brute(rows, 4)


def test_signatures_of_unlike_large_sets_differ():
    rng = np.random.default_rng(5)
    for n in (20_000, 60_000, 200_000):
        sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(4)]
        sigs = np.stack([neardup.minhash(u) for u in sets])
        assert max((sigs[a] == sigs[b]).mean() for a in range(4) for b in range(a)) < 0.01
        keys = neardup.band_keys(sigs)
        assert not any(set(keys[a].tolist()) & set(keys[b].tolist()) for a in range(4) for b in range(a))
        close = np.unique(np.concatenate([sets[0][: int(n * 0.95)], sets[1][: int(n * 0.05)]]))
        alive, _ = neardup.survivors(sigs[:1], neardup.minhash(close)[None], 0.8, 1e-7)
        assert len(alive) == 1


def test_long_unlike_texts_are_no_candidates(spark):
    rng = random.Random(8)
    texts = [prose(rng, 70_000) for _ in range(3)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10 + k, edited(rng, t, 0.005)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(spark, rows), width=4).collect()}
    assert got == brute(rows, 4)


def test_hub_keys_are_split(spark, monkeypatch):
    from eigenweave.llm import common

    rng = random.Random(3)
    base = prose(rng, 90)
    rows = [(i, base) for i in range(60)] + [(100 + i, edited(rng, base, 0.01)) for i in range(80)] + [(500 + i, prose(rng, 90)) for i in range(20)]
    monkeypatch.setattr(common, "LEAST_HOT", 7)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, rows), width=4, block=16).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, a), (3, b), (3, b), (2, a), (5, b), (7, c), (7, c), (8, edited(rng, b, 0.01))]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(spark, rows), width=4).collect()]
    assert sorted(got) == sorted((i, {3: 2, 2: 2, 5: 2, 8: 2, 7: 7}[i], i in (2, 7)) for i, _ in rows)


def test_keep_one(spark):
    rng = random.Random(7)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(4, a), (4, a), (6, a), (9, b), (9, b), (None, b), (11, None), (12, "")]
    got = neardup.keep_one(clashing(documents(spark, rows)))
    assert got.columns == clashing(documents(spark, rows)).columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["11", "12", "4", "9", "None"]
