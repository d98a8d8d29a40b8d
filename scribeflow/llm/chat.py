r"""Chat formatting as a relational plan: Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of
one role are merged into a block by array functions; a block is written as

    ### role: text</join>text</turn>

and a line feed.  Inside roles and texts a backslash is doubled and control
strings are broken by one: ``###`` to ``\#\#\#``, ``</turn>`` to ``<\/turn>``,
``</join>`` to ``<\/join>``, in roles also a space to ``\ ``, so that the first colon
with a space ends the role.  Dropping each single backslash undoes that.  The output
also has its pieces with the loss mask: the texts of assistant turns count, marks
and all else do not.  Reading back takes roles, texts and the mask from the
formatted text alone.

A conversation is one output text, so its turns meet in one row by definition;
partial collection runs before the shuffle, and no step is more than linear in
the turns.

Defined cases: null texts and roles are empty; null turns come before others; equal
turns are ordered by role and text and all stay; rows with null ``conv_id`` form
one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, JOIN, END = "### ", ": ", "</join>", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\#\\#\\#"))
    for mark in (JOIN, END):
        out = F.replace(out, F.lit(mark), F.lit("<\\" + mark[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(" "), F.lit("\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, pieces: array of (piece, loss) that make up ``formatted``."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    held = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    held = held.withColumn("roles", roles)
    change = F.filter(
        F.transform("roles", lambda r, i: F.when((i == 0) | (r != F.get("roles", i - 1)), i)),
        lambda i: i.isNotNull(),
    )
    held = held.withColumn("starts", change)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("roles", s).alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: t["text"]).alias("texts"),
        ),
    )
    held = held.select("conv_id", blocks.alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    no = F.lit(False)

    def parts(b: Column) -> Column:
        loss = b["role"] == F.lit(loss_role)
        body = F.transform(
            b["texts"],
            lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(JOIN)), no), piece(escape(t), loss)),
        )
        head = F.array(piece(F.concat(F.lit(HEAD), escape_role(b["role"]), F.lit(MIDDLE)), no))
        return F.concat(head, F.flatten(body), F.array(piece(F.lit(END + "\n"), no)))

    held = held.select("conv_id", F.flatten(F.transform("blocks", parts)).alias("pieces"))
    return held.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces")


def parse_conversations(df: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted and turns: array of (role, text, loss), read from ``formatted``."""
    raw = F.split("formatted", F.lit(END + "\n"), -1)
    df = df.withColumn("raw", F.filter(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))), lambda x: F.length(x) > 0))

    def turns(block: Column) -> Column:
        at = F.instr(block, MIDDLE)
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1)))
        body = F.split(F.substring(block, at + len(MIDDLE), F.length(block)), F.lit(JOIN), -1)
        return F.transform(body, lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), (role == F.lit(loss_role)).alias("loss")))

    return df.withColumn("turns", F.flatten(F.transform("raw", turns))).drop("raw")


def conversation_table(rows: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    said = "\\### Assistant: </turn> ok"
    spark = rows.sparkSession
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = parse_conversations(format_conversations(kept.unionByName(extra)).select("conv_id", "formatted"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (VALUES (0), (1)) AS v(i)),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</join>', '<\/join>'), '</turn>', '<\/turn>') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</join>', '<\/join>'), '</turn>', '<\/turn>'), ' ', '\ ') AS who,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS earlier
  FROM turns),
sized AS (
  SELECT *, CASE WHEN earlier IS NOT NULL AND earlier = role THEN 7 + length(body) ELSE 4 + length(who) + 2 + length(body) + 8 END AS chars
  FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
