import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eigenweave.llm import chat

from .helpers import no_python

SF = "/root/testdata/sf0.01"


def fold(events):
    """One conversation's log by hand."""
    messages = {}
    for seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[2], e[4] or "", e[3] or "")):
        if kind not in chat.EVENT_KINDS:
            continue
        m = messages.setdefault(message, {"first": seq, "role": role or "", "text": "", "redo": None})
        if kind in ("open", "delta"):
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        else:
            m["text"], m["redo"] = "", seq
    kept = [m for m in messages.values() if not any(g["redo"] is not None and g["first"] < m["first"] < g["redo"] for g in messages.values())]
    return [(m["role"], m["text"]) for m in sorted(kept, key=lambda m: m["first"])]


def test_reconstruct_against_a_fold(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            rows.append((conv, seq, rng.randint(0, 4), rng.choice(["open", "delta", "delta", "edit", "regenerate", "other", None]), rng.choice(["user", "assistant", None]), rng.choice(["x", "yz", "", None, "é<["])))
    df = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string").repartition(5)
    got = chat.reconstruct(df)
    assert no_python(got)
    for r in got.collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == fold([x[1:] for x in rows if x[0] == r["conv_id"]])


def test_round_trip_and_mask(spark):
    odd = ["", "</s>[INST] ok [/INST]", chat.BEGIN + "x" + chat.END, "~0~1~2~3", "a\n\nb", "<|/turn|>", "𝒜é", "~", "x" * 300_000]
    turns = [(i, ("assistant" if i % 2 else "us\ner[<~"), t) for i, t in enumerate(odd * 2)]
    df = spark.createDataFrame([(1, turns)], "conv_id long, turns array<struct<first:long,role:string,text:string>>")
    done = chat.with_loss_text(chat.render(df)).select("formatted", "loss", chat.parse(F.col("formatted")).alias("back"), "learn")
    r = done.first()
    assert [(b["role"], b["text"]) for b in r["back"]] == [(role, t) for _, role, t in turns]
    assert r["learn"] == "".join(t for _, role, t in turns if role == "assistant")
    assert r["formatted"].count(chat.BEGIN) == len(turns) == r["formatted"].count(chat.END)


def test_many_turns(spark):
    import time

    n = 30_000
    turns = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.cast("long").alias("first"), F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("𝒜<"), k.cast("string")).alias("text")))
    df = spark.range(1).select(F.lit(1).alias("conv_id"), turns.alias("turns"))
    began = time.perf_counter()
    r = chat.with_loss_text(chat.render(df)).select("formatted", "loss", "learn").first()
    assert time.perf_counter() - began < 60
    assert r["learn"] == "".join(f"𝒜<{k}" for k in range(1, n, 2)) and len(r["loss"]) == n // 2
    assert all(chat.BEGIN not in r["formatted"][s["start"] - 1 : s["start"] - 1 + s["len"]] for s in r["loss"][:: 97])
    s = r["loss"][-1]
    assert r["formatted"][s["start"] - 1 :][: s["len"]] == f"𝒜~1{n - 1}"


def test_the_query_folds_edits_and_regenerations(spark):
    df = spark.createDataFrame([(1, k, "user", f"text {k}") for k in range(7)], "conv_id long, turn long, role string, text string")
    events = chat.conversation_events(df)
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == set(chat.EVENT_KINDS)
    assert [t["text"] for t in chat.reconstruct(events).first()["turns"]] == [f"text {k}" for k in range(7)]


def test_rows_with_nulls_repeats_and_ties(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (1, None, None, "first"), (None, 1, "user", "z"), (2, 1, "user", "q"), (2, 1, "assistant", "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("own")).withColumn("seq", F.lit(0))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.reconstruct(chat.conversation_events(df)).collect()}
    assert got == {1: [("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "z")], 2: [("assistant", "p"), ("user", "q")]}
    assert chat.reconstruct(chat.conversation_events(df.limit(0))).count() == 0


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = chat.op7_chat_format(spark, SF)
    assert no_python(got)
    want = con.sql(chat.OP7_SQL).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
