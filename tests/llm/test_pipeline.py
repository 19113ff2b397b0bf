from pathlib import Path

import pytest
from pyspark.sql import functions as F

from .test_neardup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns on the smallest tables, written and read again."""
    import corpus_pipeline as P

    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language", "near_duplicates", "decontaminate", "personal_data", "mix"]
    for _, before, after in stages:
        assert after.columns == before.columns


def test_decisions(spark, stages):
    from eigenweave.llm import decontam, mixing, neardup, pii

    _, docs, spoken = stages[0]
    assert docs.join(spoken, "doc_id", "left_anti").where(F.col("text").rlike(r"\p{L}{40}")).count() == 0
    assert spoken.where("lang is null").count() == 0
    assert spoken.join(docs.where("lang is not null").select("doc_id", F.col("lang").alias("old")), "doc_id").where("lang <> old").count() == 0
    _, before, after = stages[1]
    kept = {r["doc_id"] for r in neardup.near_duplicates(before).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    roots = brute([tuple(r) for r in before.select("doc_id", "text").collect()], 5)
    assert kept == {i for i, (n, root) in roots.items() if root == i}
    _, before, after = stages[2]
    gone = {r["doc_id"] for r in decontam.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - gone
    _, before, after = stages[3]
    assert before.count() == after.count()
    old, new = ({r["doc_id"]: r for r in d.collect()} for d in (before, after))
    for i, r in new.items():
        assert r["text"] == (None if old[i]["text"] is None else pii.redact_text(old[i]["text"], pii.find_spans(old[i]["text"])[1]))
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    _, before, after = stages[4]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}


def test_run_equals_the_stages(spark, stages):
    import corpus_pipeline as P

    assert sorted(map(tuple, P.run(spark, SF).collect()), key=repr) == sorted(map(tuple, stages[-1][2].collect()), key=repr)


def test_files_of_finished_stages_are_removed(spark):
    import corpus_pipeline as P
    from eigenweave.llm.common import ensure_checkpoint_dir

    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(root.glob("pipeline-*"))
    P.run(spark, SF)
    (place,) = set(root.glob("pipeline-*")) - before
    assert {x.name for x in place.iterdir() if not x.name.startswith(".")} == {"3"}


def test_odd_rows_and_extra_columns(spark, tmp_path):
    import corpus_pipeline as P

    from .helpers import clashing, documents, prose
    import random

    rng = random.Random(0)
    rows = [(i, prose(rng, 40), rng.choice(["aa", "bb", None]), rng.choice(["s", "t", None])) for i in range(40)] + [(None, prose(rng, 9), None, None), (77, None, None, None), (78, "", None, None), (3, prose(rng, 5), "aa", "s")]
    docs = clashing(documents(spark, rows))
    for name, f in P.STAGES:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        assert f(spark, docs.limit(0), SF).count() == 0
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            assert [r["doc_id"] for r in docs.where("doc_id = 3").collect()] == [3]
    assert docs.count() > 0
