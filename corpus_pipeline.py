"""The corpus pipeline: documents of good quality, one of each group of near copies, free of benchmark passages, under pseudonyms, mixed to target weights.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.  Extra
columns of documents are carried through, texts of any length are read whole, an
empty table gives an empty result at every stage, and no stage depends on the
order or the partitions of its input.  A plain version of every stage is in the
tests (``tests/llm/brute.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import common, decontaminate, mixing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the raw corpus of the ratio is the stage's own input.

    Null and blank texts fail the base rule and go; repeated rows get one verdict each, the same; a ratio equal to the threshold is kept.
    """
    scored = quality.score(docs.drop("kept"), common.table(spark, sf_dir, "labels"))
    return scored.filter("kept").select(*[common.quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id, of equal ids that whose text has the least hash.

    Rows without a doc_id come after all others; rows of one id and unlike texts all stay; blank texts are copies of nothing.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and blank texts contain none; repeated rows are judged one by one; a coverage of exactly a half is contained.
    """
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the personal data in their texts under pseudonyms.

    Null and empty texts stay as they are; repeated rows stay repeated and equal.
    """
    return pii.pseudonymised(docs, count=None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each.

    Null and blank texts have no words and are not taken; a null source is a source; repeated rows are taken row by row.
    """
    return mixing.mix_stage(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
]

#: The stages hash, link and schedule in ways that SQL can't express; tests hold each of them against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = common.checkpoint(docs)
    return docs
