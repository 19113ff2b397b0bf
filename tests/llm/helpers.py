"""Small tables for the training-data operators: nulls, empty and very long texts, ties, repeats and columns with clashing names."""

import random

SYL = "ka lo mi ren tos vi dar el un pra se ol".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text) or longer tuples."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


#: Names that the operators use for their own columns.
CLASHING = ("score", "labels", "kept", "component_id", "n_words", "size", "copies", "row", "id", "k", "h", "n", "rep", "sig", "key", "a", "b", "_letters", "_k", "held_out", "rank", "target", "item_id", "spans", "root", "node")


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING if c not in df.columns])


def no_python(df) -> bool:
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return not any(w in plan for w in ("Python", "Pandas", "Arrow", "MapPartitions", "SerializeFromObject"))
