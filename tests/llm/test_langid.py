import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenweave.llm import langid

from .helpers import clashing, documents

SF = "/root/testdata/sf0.01"
A, B = "ka lo mi ren tos".split(), "zwy qux brr ghh pft".split()


def text(rng, syl, n):
    return " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, text(rng, A if i % 2 else B, rng.randint(3, 60)), "aa" if i % 2 else "bb") for i in range(240)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return langid.fit_documents(documents(spark, rows))


def test_held_out_accuracy(spark, rows, model):
    d = documents(spark, rows)
    got = langid.predict(d, model).withColumn("held", langid.held_out(F.col("doc_id"))).join(d.select("doc_id", "lang"), "doc_id").where("held").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, model):
    rng = random.Random(3)
    d = clashing(documents(spark, [(1, None), (2, ""), (3, "123 ... !"), (4, text(rng, A, 30_000)), (None, text(rng, B, 20)), (4, "ka"), (7, "中")]))
    got = sorted(((r["doc_id"] or 0), r["lang_pred"]) for r in langid.predict(d, model).collect())
    assert got[:4] == [(0, "bb"), (1, "und"), (2, "und"), (3, "und")] and got[4][0] == 4 and ("aa" in (got[4][1], got[5][1])) and got[6][1] in ("aa", "bb")
    kept = langid.keep_identified(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} >= {None, 4} and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    assert langid.predict(d.limit(0), model).count() == 0


def test_predictions_see_the_text_alone(spark, rows, model):
    d = documents(spark, rows[:40])
    other = d.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 5000)
    a = [r["lang_pred"] for r in langid.predict(d, model).orderBy("doc_id").collect()]
    assert a == [r["lang_pred"] for r in langid.predict(other, model).orderBy("doc_id").collect()]


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    one = text(rng, B, 20)
    many = [(k, text(rng, A, 6), f"l{k % 501:03}") for k in range(1002)]
    assert langid.fit(documents(spark, many), per_lang=2, windows=1).langs == sorted({r[2] for r in many})
    rows = [(7, text(rng, A, 20), "aa") for _ in range(900)] + [(None, text(rng, B, 20), "bb") for _ in range(900)] + [(k, one, "cc") for k in range(900)] + [(5, "ki ku", "dd")]
    sizes = []
    plain = langid.ByteCNN.train

    def seen(self, x, y, *a, **k):
        sizes.append(np.bincount(y).tolist())
        return plain(self, x, y, *a, **{**k, "steps": 5})

    langid.ByteCNN.train = seen
    try:
        d = documents(spark, rows).repartition(5)
        assert langid.fit(d, per_lang=40, windows=1).langs == ["aa", "bb", "cc", "dd"] and sizes[-1] == [40, 40, 40, 1]
        assert langid.fit(d, per_lang=40, windows=1, most_documents=12).langs == ["aa", "bb", "cc", "dd"] and sizes[-1] == [3, 3, 3, 1]
    finally:
        langid.ByteCNN.train = plain


def test_predicted_language_fills_the_gap(spark, model):
    rng = random.Random(5)
    d = documents(spark, [(1, text(rng, A, 30), None), (2, text(rng, B, 30), None), (3, text(rng, A, 30), "xx"), (4, None, None)])
    assert {(r["doc_id"], r["lang"]) for r in langid.keep_identified(d, model, lang_col="lang").collect()} == {(1, "aa"), (2, "bb"), (3, "xx")}


def test_without_labels(spark):
    d = documents(spark, [(1, "ka lo", None), (2, None, "aa")])
    assert langid.fit_documents(d) is None
    assert {r["lang_pred"] for r in langid.predict(d, None).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(0)
    m = langid.ByteCNN.fresh(["a", "b"], rng)
    x = rng.integers(1, 255, (8, langid.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 2, 8)
    before = -m.log_probs(x)[np.arange(8), y].mean()
    m.train(x, y, np.random.default_rng(1), steps=30, batch=8)
    assert -m.log_probs(x)[np.arange(8), y].mean() < before / 2


def test_windows_cover_every_byte_with_overlap():
    for n in (1, 5, langid.WINDOW, langid.WINDOW + 1, 1000):
        start, length, row = langid.cut(np.zeros(n, np.uint8), np.array([0, n]))
        seen = np.zeros(n, bool)
        for s, k in zip(start, length):
            seen[s : s + k] = True
        assert seen.all() and (np.diff(start) == langid.STRIDE).all()


def test_query(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op6_language_id(spark, SF)
    assert got.count() == docs.count()
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
