"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events (conversation, sequence, message, kind, role, text). Partitioned by conversation
and sorted by sequence, they fold into final messages:

* ``open`` starts a message, ``delta`` appends a streamed piece;
* ``edit`` replaces the whole text of its message;
* ``regenerate`` clears its message, to be rebuilt by later deltas, and withdraws every message that was
  opened after it and before the regeneration.

Messages are then rendered between control strings. ``~ < [`` and, in roles, line breaks are escaped
inside texts as ``~0 ~1 ~2 ~3``, so that no text can contain a control string and reading back is exact.

Work grows in proportion to a conversation: withdrawn messages are told by a running maximum, positions are summed and masked text is cut out
by blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|turn|>", "<|/turn|>\n"
_ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
EVENT_KINDS = ("open", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("\n")))


def reconstruct(events: DataFrame, conv="conv_id", seq="seq", message="message", kind="kind", role="role", text="text") -> DataFrame:
    """Fold a log into (conv_id, turns: array<struct<first, role, text>>), one row per conversation.

    Null texts and roles are empty; events of unknown or null kind are ignored; events tied in sequence are taken
    in order of kind and text. A message whose first event is not ``open`` starts there all the same, with
    the role of its first event. A null conversation, message or sequence is a value like any other (null
    sequences come first). Further columns are ignored; an empty log gives no rows.
    """
    e = events.select(
        F.col(conv).alias("conv_id"), F.col(seq).alias("seq"), F.col(message).alias("message"), F.col(kind).alias("kind"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where(F.col("kind").isin(*EVENT_KINDS))
    own = e.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("log"))
    # The text is what follows the last event that sets it anew, that event included.
    log = F.col("log")
    last = F.array_max(F.transform(log, lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i + 1).otherwise(1)))
    own = own.withColumn("last", last)
    alive = F.expr("slice(log, last, size(log) - last + 1)")
    built = F.array_join(F.transform(alive, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    redo = F.array_max(F.transform(log, lambda x: F.when(x["kind"] == "regenerate", x["seq"])))
    own = own.select("conv_id", log[0]["seq"].alias("first"), "message", log[0]["role"].alias("role"), built.alias("text"), redo.alias("redo"))
    # A message is withdrawn if one opened before it was regenerated after it was opened.
    own = own.withColumn("step", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first")))
    own = own.withColumn("until", F.max("redo").over(Window.partitionBy("conv_id").orderBy("step").rangeBetween(Window.unboundedPreceding, -1)))
    m = F.struct("first", "message", "role", "text")
    all_ = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.coalesce(F.col("first") < F.col("until"), F.lit(False)), m))).alias("ms"))
    return all_.select("conv_id", F.transform("ms", lambda m: F.struct(m["first"].alias("first"), m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


#: Turns and characters of a block: work within a block may be quadratic, over blocks it is linear.
TURNS, CHARS = 128, 1024


def _once(column: str, value: Column) -> Column:
    """`value`, whose lambdas use an array column: as it is also used outside of them, it is made once a row and not for every element."""
    return F.when(F.size(column) >= 0, value)


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss``: code-point spans (start from 1, length) of `loss_role` texts in it."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(BEGIN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("own")))
    out = conversations.withColumn("_p", parts)
    out = out.withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    n_blocks = F.ceil(F.size("_p") / TURNS).cast("int")
    out = out.withColumn("_b", F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>")))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    block = lambda b: F.slice("_p", b * TURNS + 1, TURNS)
    out = out.withColumn("_s", F.transform("_b", lambda b: F.aggregate(block(b), F.lit(0), lambda a, p: a + size(p))))
    out = out.withColumn("_at", _once("_s", F.transform("_b", lambda b: F.aggregate(F.slice("_s", 1, b), F.lit(1), lambda a, n: a + n))))

    def spans(b: Column) -> Column:
        zero = F.struct(F.get("_at", b).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
        step = lambda a, p: F.struct(
            (a["at"] + size(p)).alias("at"),
            F.when(p["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("len"))))).otherwise(a["spans"]).alias("spans"),
        )
        return F.aggregate(block(b), zero, step)["spans"]

    return out.withColumn("loss", _once("_at", F.flatten(F.transform("_b", spans)))).drop("_p", "_b", "_s", "_at")


def parse(formatted: Column) -> Column:
    """Read a rendered conversation back: array<struct<role, text>>."""
    body = F.split(formatted, END.replace("|", r"\|"), -1)
    turns = F.slice(body, F.lit(1), F.size(body) - 1)

    def one(x: Column) -> Column:
        x = F.substr(x, F.lit(len(BEGIN) + 1))
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(x, F.length(role) + 2)).alias("text"))

    return F.transform(turns, one)


def with_loss_text(rendered: DataFrame, name: str = "learn") -> DataFrame:
    """Add all text under the loss mask, unescaped, nothing between. A span is cut out of the blocks of characters that it touches."""
    out = rendered.withColumn("_chunks", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)))

    def cut(s: Column) -> Column:
        first = F.floor((s["start"] - 1) / CHARS).cast("int")
        count = F.ceil((s["start"] - 1 + s["len"]) / CHARS).cast("int") - first
        near = F.array_join(F.slice("_chunks", first + 1, count), "")
        return F.when(s["len"] > 0, unescape(F.substr(near, s["start"] - first * CHARS, s["len"]))).otherwise("")

    return out.withColumn(name, _once("_chunks", F.array_join(F.transform("loss", cut), ""))).drop("_chunks")


def conversation_events(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as the log of a chat: each row opens a message, which is streamed in two deltas; every third message
    begins as a draft and is edited, every third is begun, regenerated and streamed anew.

    Rows of one conversation are taken by turn (null first), then role and text; repeated rows stay separate turns.
    """
    r = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    r = r.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    half = (F.length("text") / 2).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    empty, first, rest, draft = F.lit(""), F.substr("text", F.lit(1), half), F.substr("text", half + 1), F.lit("...")
    opened, streamed = [event("open", empty)], [event("delta", first), event("delta", rest)]
    way = F.col("message") % 3
    log = F.when(way == 1, F.array(*opened, *streamed)).when(way == 2, F.array(*opened, event("delta", draft), event("edit", F.col("text")))).otherwise(F.array(*opened, event("delta", draft), event("regenerate", empty), *streamed))
    return r.select("conv_id", "message", "role", F.posexplode(log).alias("k", "e")).select("conv_id", (F.col("message") * 8 + F.col("k")).alias("seq"), "message", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def op7_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    two = spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    done = with_loss_text(render(reconstruct(conversation_events(rows.unionByName(two))))).select("conv_id", "formatted", parse(F.col("formatted")).alias("back"), "learn")
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learn").cast("long").alias("loss_chars"), F.sha2(F.col("learn"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, length(text) + length(text) * 3 - length(replace(text, '~', '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) AS text_chars,
         length(role) * 5 - length(replace(role, '~', '')) - length(replace(role, '<', '')) - length(replace(role, '[', '')) - length(replace(role, chr(10), '')) AS role_chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + role_chars + 19)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
