"""Charges, alerts, resolutions, registries and feedback to files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators import feedback, registry

ALERT_FIELDS = ["transaction_id", "canonical_name", "category", "date", "expected", "actual", "difference", "percentage_change", "severity", "outlier_score", "possible_reasons"]


def records(txns: DataFrame) -> DataFrame:
    """Charges with ISO dates."""
    return txns.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def alerts_csv(alerts: DataFrame) -> DataFrame:
    """Alerts as flat rows; the reasons are one text."""
    return alerts.select(*[F.concat_ws("; ", c).alias(c) if c == "possible_reasons" else F.col(c) for c in ALERT_FIELDS])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def resolutions_csv(resolutions: DataFrame) -> DataFrame:
    return resolutions.select("merchant_raw", "cleaned", "canonical_name", "category", "method", "confidence")


def write_registry(services: DataFrame, path: str, version: int) -> str:
    """A version of the registry in a folder of its own; earlier ones stay readable while jobs use them."""
    target = f"{path}/version={version}"
    services.write.mode("overwrite").parquet(target)
    return target


def read_registry(spark, path: str) -> DataFrame:
    """The newest version; an empty registry where there is none."""
    try:
        all_versions = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return registry.empty(spark)
        raise
    newest = all_versions.agg(F.max("version")).first()[0]
    return all_versions.filter(F.col("version") == newest).drop("version")


def read_feedback(spark, path: str) -> DataFrame:
    return spark.read.schema(feedback.SCHEMA).parquet(path)
