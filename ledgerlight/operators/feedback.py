"""Feedback: a validated append-only table, the tolerance it adds up to, and alerts scored anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.detection import severity

KINDS = ("expected", "unexpected", "cancel", "remind_later")
SCHEMA = "feedback_id string, merchant string, category string, expected_amount double, actual_amount double, feedback string, date date, note string, seq bigint"
UP, DOWN, MOST = 0.25, 0.15, 3.0


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a known kind, and the others."""
    known = F.coalesce(F.col("feedback").isin(*KINDS), F.lit(False))
    return rows.filter(known), rows.filter(~known)


def recorded(path: str, rows: DataFrame) -> int:
    """Appends the valid rows to the table at ``path``; the number of rejected ones."""
    good, bad = validated(rows)
    good.write.mode("append").parquet(path)
    return bad.count()


def tolerance(kinds: Column) -> Column:
    """The multiplier after feedback in order; the bounds make the order count."""
    step = lambda m, k: F.when(k == "expected", F.least(m + UP, F.lit(MOST))).when(k.isin("unexpected", "cancel"), F.greatest(m - DOWN, F.lit(1.0))).otherwise(m)
    return F.round(F.aggregate(kinds, F.lit(1.0), step), 3)


def tolerances(feedback: DataFrame, merchant: str = "merchant") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "feedback")))
    return feedback.groupBy(merchant).agg(ordered.alias("f")).select(merchant, tolerance(F.transform("f", lambda x: x["feedback"])).alias("multiplier"))


def adjusted(alerts: DataFrame, feedback: DataFrame, merchant: str = "merchant") -> DataFrame:
    """Alerts with their score over the merchant's multiplier, where that is above 1; ``feedback_adjusted`` tells."""
    df = alerts.join(tolerances(feedback, merchant), merchant, "left").withColumn("feedback_adjusted", F.coalesce(F.col("multiplier") > 1.0, F.lit(False)))
    score = F.col("outlier_score") / F.col("multiplier")
    df = df.withColumn("severity", F.when(F.col("feedback_adjusted"), severity(score)).otherwise(F.col("severity")))
    return df.withColumn("outlier_score", F.when(F.col("feedback_adjusted"), F.round(score, 3)).otherwise(F.col("outlier_score"))).drop("multiplier")
