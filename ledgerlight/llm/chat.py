r"""Chat formatting from event logs, as built-in expressions only.

A log row is (conv_id, seq, turn, kind, role, text).  Kinds: ``start`` opens a
message and sets its role; ``delta`` appends text; ``edit`` replaces the
message's text; ``regenerate`` discards the message's text and every later turn
that the log holds so far, and starts over; ``delete`` discards the message.
Instead of stepping through a conversation, the fold is a few set operations:
the last reset that reaches a turn is a running maximum over the turns, and
what comes after it is joined in the order of seq.

A rendered turn is ``<turn>role\ntext</turn>\n``.  Texts and roles are escaped so
that they hold no ``<``: a backslash becomes ``\e``, ``<`` becomes ``\l`` and, in
roles, a line break becomes ``\n``; control strings inside texts thus can't be
read as marks, and the original comes back exactly.

Defined results: null texts and roles are empty; a null kind is a ``delta``; a
null conv_id is a conversation of its own; events of equal seq are taken in the
order of kind, role and text; repeated rows repeat; texts of any length are
whole; other columns are not read; an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import common

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Roles whose text is under the loss mask.
LOSS_ROLE = "assistant"
#: The conversation that the query adds: control strings inside texts.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def messages(events: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, turn, role, text; deleted and discarded ones are not there."""
    df = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    at = lambda kind: F.when(F.col("kind") == kind, F.col("seq"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("conv_id", "turn")
    df = df.withColumn("again", F.max(at("regenerate")).over(upto))
    df = df.withColumn("replaced", F.max(F.when(F.col("kind").isin("edit", "delete"), F.col("seq"))).over(own))
    df = df.withColumn("since", F.greatest("again", "replaced"))
    # a role outlives the edits and regenerations of its own turn
    alive = F.col("since").isNull() | (F.col("seq") >= F.col("since"))
    df = df.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.array_sort(F.collect_list(F.when(alive & (F.col("kind") != "delete"), F.struct("seq", "kind", "role", "text")))).alias("parts"),
    )
    df = df.filter(F.size("parts") > 0)
    return df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


def rendered(final: DataFrame) -> DataFrame:
    """A row for each conversation: formatted, and loss: the spans [begin, end) of assistant texts in its code points."""
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = final.select("conv_id", F.struct("turn", F.col("role").alias("role"), head.alias("head"), escaped(F.col("text")).alias("body")).alias("m"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    spans = F.aggregate(
        "ms",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["body"]) + len(CLOSE)).alias("at"),
            F.when(
                m["role"] == LOSS_ROLE,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(m["head"])).alias("begin"), (acc["at"] + F.length(m["head"]) + F.length(m["body"])).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.select("conv_id", F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE))), "").alias("formatted"), spans.alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation again: array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescaped(F.replace(F.substring(p, F.lit(len(OPEN) + 1), F.locate("\n", p) - len(OPEN) - 1), F.lit("\\n"), F.lit("\n"))).alias("role"),
            unescaped(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations as the log that may have led to them.

    Each row opens a message and streams its text in two halves.  Before that
    every third message streams a draft, which is discarded and generated again;
    every fifth ends in a slip, which is edited to the text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    df = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("bigint").alias("turn"))
    half, plain = F.floor(F.length("text") / 2).cast("int"), F.col("text")
    event = lambda k, kind, text: F.struct((8 * F.col("turn") + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    told = F.array(event(0, "start", F.lit("")), event(4, "delta", F.substring(plain, F.lit(1), half)), event(5, "delta", F.substring(plain, half + 1, F.length(plain))))
    draft = F.when(F.col("turn") % 3 == 0, F.array(event(1, "delta", F.lit("draft <turn>")), event(2, "regenerate", F.lit(""))))
    slip = F.when(F.col("turn") % 5 == 0, F.array(event(6, "delta", F.lit(" slip")), event(7, "edit", plain)))
    none = F.array().cast("array<struct<seq:bigint,kind:string,text:string>>")
    events = F.concat(told, F.coalesce(draft, none), F.coalesce(slip, none))
    return df.select("conv_id", "turn", "role", F.explode_outer(events).alias("e")).select("conv_id", "e.seq", "turn", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    table = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    df = rendered(messages(log_of(table.union(added)))).withColumn("turns", parsed(F.col("formatted")))
    loss = unescaped(F.array_join(F.transform("loss", lambda s: F.substring("formatted", (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))), ""))
    return df.withColumn("learned", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 15
    + 2 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<', '')) + length(role) - length(replace(role, chr(10), ''))
    + 2 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
