import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from eigenweave.llm import decontam

from .helpers import clashing, documents, prose

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    bench = [(i, prose(rng, rng.randint(15, 60)) + ". " + prose(rng, 5) + ".") for i in range(30)]
    docs, want = [], set()
    for k in range(120):
        body = prose(rng, rng.choice([20, 200, 700]))
        if k % 4 == 0:
            i = rng.randrange(30)
            w = body.split()
            at = rng.randrange(len(w))
            leak = bench[i][1]
            if k % 8 == 0:  # paraphrase: a quarter of the words changed, the answer kept
                q = leak.rpartition(". ")[0].split()
                for j in rng.sample(range(len(q)), len(q) // 4):
                    q[j] = prose(rng, 1)
                leak = " ".join(q) + ". " + leak.rpartition(". ")[2]
            body = " ".join([*w[:at], leak.upper() if k % 3 == 0 else leak, *w[at:]])
            want.add((k, i))
        docs.append((k, body))
    docs += [(500, None), (501, ""), (502, "..."), (None, bench[0][1]), (503, prose(rng, 40_000) + " " + bench[1][1])]
    want |= {(None, 0), (503, 1)}
    return clashing(documents(spark, docs)), items(spark, [*bench, (900, None), (901, ""), (902, "--")]), want


def test_planted_items(case):
    docs, bench, want = case
    got = decontam.leaks(docs.drop("item_id"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["lcs"] >= 0.5 and 0 <= r["answer_lcs"] <= 1 for r in got)


def test_groups_of_items_find_the_same(case):
    docs, bench, want = case
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, group=7).collect()} == want
    apart = decontam.leaks(docs, bench, group=7, judge_bytes=1)
    assert {(r["doc_id"], r["item_id"]) for r in apart.collect()} == want and apart.count() == len(want)
    gone = {i for i, _ in want}
    assert {r["doc_id"] for r in decontam.drop_leaks(docs, bench, group=7, judge_bytes=1).collect()} == {r["doc_id"] for r in docs.collect()} - gone


def test_long_items(spark):
    rng = random.Random(21)
    bench = [(k, prose(rng, n)) for k, n in enumerate((65, 100, 500, 1200, 3000))]
    docs = [(k, f"{prose(rng, rng.randint(0, 90))} {t} {prose(rng, 50)}") for k, t in bench]
    docs += [(10 + k, f"{prose(rng, 40)} {' '.join(w for w in t.split() if rng.random() > 0.2)}") for k, t in bench] + [(20 + k, prose(rng, 900)) for k in range(20)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(documents(spark, docs), items(spark, bench)).collect()}
    assert got == {(k, k) for k in range(5)} | {(10 + k, k) for k in range(5)}


def test_drop(case):
    docs, bench, want = case
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    gone = {i for i, _ in want}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - gone


def test_repeats_and_empty(spark, case):
    docs, bench, _ = case
    one = docs.where("doc_id = 4")
    n = decontam.leaks(one, bench).count()
    assert decontam.leaks(one.union(one), bench).count() == 2 * n > 0
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    with pytest.raises(ValueError):
        decontam.leaks(docs, bench, most_items=3)


def test_alignment():
    rng = random.Random(0)
    for _ in range(100):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 80))], [rng.randrange(6) for _ in range(rng.randint(0, 80))]
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        assert decontam.lcs_length(decontam.place_masks(np.array(a)), len(a), b) == row[-1]
    assert decontam.answer_of("A b c. What is it? It is the fish.") == "It is the fish."


def test_latent_space_against_an_exact_svd(spark, case):
    docs, bench, _ = case
    judge = next(decontam._judges(docs.select("text"), bench))
    space = judge.spaces[0]
    assert len(judge.spaces) == 1 and len(space.item) == 30
    rows = []
    for t in [r["text"] or "" for r in docs.select("text").collect()]:
        for _, h, first in decontam._pieces(pa.array([t])):
            at, k = space.terms.find(h)
            _, block = decontam._blocks(at, first)
            w = decontam.Windows(block, k)
            alive = w.rich(space.least)
            dense = w.project(np.diag(space.idf), alive)
            assert np.allclose(np.linalg.norm(dense[alive], axis=1), w.norms(space.idf)[alive])
            rows.append(dense[alive])
    exact = np.concatenate(rows)
    q = np.random.default_rng(0).standard_normal((len(space.idf), 5))
    compact = docs.select("text").mapInArrow(decontam._compact(space.terms, space.least), "block binary, term binary")
    none = np.zeros((1, len(space.idf)))
    assert np.allclose(decontam._apply_gram(compact, np.arange(len(space.idf)), space.idf, q, none, space.least), exact.T @ (exact @ q), rtol=1e-3, atol=1e-2)


def test_query_against_alignment_of_everything(spark, tmp_path):
    """Paraphrases of the real items planted in the real documents: every passage is aligned with every item."""
    if not Path(SMALL).is_dir():
        pytest.skip("no test tables here")
    rng = random.Random(31)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for k in range(0, len(docs), 3):
        i, text = bench[k % len(bench)]
        words, body = text.split(), docs[k][1].split()[:2000]
        keep = len(decontam.answer_of(text).split())
        for j in rng.sample(range(len(words) - keep), int((len(words) - keep) * rng.choice([0, 0.1, 0.2, 0.3]))):
            words[j] = rng.choice(["", prose(rng, 1), prose(rng, 2)])
        at = rng.randint(0, len(body))
        docs[k] = (docs[k][0], " ".join([*body[:at], *words, *body[at:]]))
        planted[docs[k][0], i] = True
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    keys = [(i, decontam.word_hashes(t), decontam.word_hashes(decontam.answer_of(t))) for i, t in bench]
    keys = [(i, decontam.place_masks(w), len(w), decontam.place_masks(a), len(a), set(w.tolist())) for i, w, a in keys if len(w)]
    want = set()
    for d, t in docs:
        h = decontam.word_hashes(t).tolist()
        for i, mask, n, amask, an, own in keys:
            for start in range(0, len(h), decontam.BLOCK):
                near = h[max(0, start - n) : start + 2 * decontam.BLOCK + n]
                if sum(w in own for w in near) < 0.5 * n:
                    continue
                share = decontam.lcs_length(mask, n, near) / n
                if share >= 0.7 or share >= 0.5 and decontam.lcs_length(amask, an, near) / an >= 0.6:
                    want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op4_decontaminate(spark, str(tmp_path)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert len(set(planted) & got) >= 0.97 * len(planted)


def test_query_finds_every_verbatim_passage(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    import re

    low = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    docs = {r["doc_id"]: f" {low(r['text'])} " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = {r["item_id"]: low(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for i, b in bench.items() if b for d, t in docs.items() if f" {b} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op4_decontaminate(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 3
