"""Views of the star-schema tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_charges(spark, sf_dir: str) -> DataFrame:
    """Events as charges: the service is a user's event type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("service"), F.lit("general").alias("category"),
        F.col("event_id").alias("transaction_id"), F.col("event_id").alias("seq"), F.col("value").alias("amount"), F.to_date("ts").alias("date"),
    )


def order_charges(spark, sf_dir: str) -> DataFrame:
    """Orders as charges: the service is the customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("service"), F.lit("general").alias("category"),
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("date"),
    )
