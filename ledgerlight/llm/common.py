"""Shared helpers of the corpus operators.

Every operator takes DataFrames whose columns may carry any extra names.  It
reads the columns it needs into a narrow frame of its own, and where it hands
rows back, the original row travels inside one struct so that extra columns
can never clash with working columns; an output column replaces an input
column of the same name (names compare without case, as Spark does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.plan import checkpoint

__all__ = ["ascii_lower", "checkpoint", "fenced", "packed", "quoted", "small", "table", "unpacked", "words"]

#: The separators of a word, as a Java regular expression: the complement is ``[^\x20\x09-\x0D]``.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: The same characters, for trimming.
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be of any file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def packed(docs: DataFrame, **needed: Column) -> DataFrame:
    """``row`` (the whole input row) beside the working columns asked for."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in needed.items()])


def unpacked(df: DataFrame, columns: list[str], **outputs: Column) -> DataFrame:
    """The input columns again, less those that an output replaces, then the outputs."""
    taken = {k.lower() for k in outputs}
    return df.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in columns if c.lower() not in taken], *[c.alias(k) for k, c in outputs.items()])


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with these columns behind a generator.

    A filter on them would else be moved below the steps that compute them and
    be expanded to one expression, in which a lambda computes whole arrays again
    for each of its elements.
    """
    rest = [F.col(quoted(c)) for c in df.columns if c not in names]
    both = df.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("b_fence"))
    return both.select(*rest, *[F.col(f"b_fence.{c}").alias(c) for c in names])


#: Rows of a table that may be broadcast after they have been counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has few rows; else it is joined as any other."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
