"""The service registry as a table: registration, aliases, sightings, merging; and keyed tables in general.

Columns: service_id, service_ord, canonical_name, category, aliases, first_seen,
last_seen, transaction_count, confidence, source.  Every operator returns a new
table; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import fixed
from ledgerlight.functions.text import cleaned_any

SCHEMA = "service_id string, service_ord bigint, canonical_name string, category string, aliases array<string>, first_seen date, last_seen date, transaction_count bigint, confidence double, source string"


def service_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 16)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def seeds(spark) -> DataFrame:
    """The services of a new registry."""
    rows = spark.createDataFrame([(k, *s) for k, s in enumerate(fixed.SEEDS)], "service_ord bigint, canonical_name string, category string, aliases array<string>")
    return registered(rows, source="manual", confidence=0.95)


def registered(rows: DataFrame, source: str = "auto", confidence: float = 0.5) -> DataFrame:
    """Rows (service_ord, canonical_name, category, aliases) as services; ids follow from the names."""
    none = F.lit(None).cast("date")
    return rows.select(
        service_id(F.lower("canonical_name")).alias("service_id"), F.col("service_ord").cast("bigint").alias("service_ord"), "canonical_name", "category",
        F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))).alias("aliases"),
        none.alias("first_seen"), none.alias("last_seen"), F.lit(0).cast("bigint").alias("transaction_count"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"),
    )


def with_missing_seeds(services: DataFrame) -> DataFrame:
    """The registry with the seeds whose names it lacks."""
    known = services.select(F.lower("canonical_name").alias("known"))
    new = seeds(services.sparkSession)
    return services.unionByName(new.join(known, F.lower(new["canonical_name"]) == F.col("known"), "left_anti"))


def aliases(services: DataFrame) -> DataFrame:
    """service_id, service_ord, alias and its place."""
    return services.select("service_id", "service_ord", F.posexplode("aliases").alias("alias_ord", "alias"))


def with_aliases(services: DataFrame, learned: DataFrame) -> DataFrame:
    """Aliases ``learned(service_id, alias)`` added where they are new, without regard to case."""
    new = learned.groupBy("service_id").agg(F.array_sort(F.collect_set(F.lower("alias"))).alias("new"))
    return services.join(new, "service_id", "left").withColumn("aliases", F.array_distinct(F.concat("aliases", F.coalesce("new", F.array().cast("array<string>"))))).drop("new").select(services.columns)


def seen(services: DataFrame, sightings: DataFrame) -> DataFrame:
    """Counts and dates after ``sightings(service_id, date)``."""
    new = sightings.groupBy("service_id").agg(F.count("*").alias("n"), F.min("date").alias("low"), F.max("date").alias("high"))
    df = services.join(new, "service_id", "left")
    df = df.withColumn("transaction_count", F.col("transaction_count") + F.coalesce("n", F.lit(0)))
    return df.withColumn("first_seen", F.least("first_seen", "low")).withColumn("last_seen", F.greatest("last_seen", "high")).select(services.columns)


def adjusted(services: DataFrame, deltas: DataFrame) -> DataFrame:
    """Confidences after ``deltas(service_id, seq, delta)`` in order; each step stays within 0 and 1."""
    steps = deltas.groupBy("service_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("steps"))
    step = lambda c, x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c + x["delta"]))
    new = F.when(F.col("steps").isNull(), F.col("confidence")).otherwise(F.aggregate("steps", F.col("confidence"), step))
    return services.join(steps, "service_id", "left").withColumn("confidence", new).select(services.columns)


def merged(services: DataFrame, pairs: DataFrame) -> DataFrame:
    """Services ``pairs(keep, drop)`` made one: aliases united, counts summed, dates widened."""
    df = services.join(pairs, services["service_id"] == pairs["drop"], "left").withColumn("target", F.coalesce("keep", "service_id"))
    kept = F.col("keep").isNull()
    own = lambda c: F.max(F.when(kept, F.struct(c)))[c].alias(c)
    return (
        df.groupBy("target")
        .agg(
            own("service_ord"), own("canonical_name"), own("category"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("transaction_count").alias("transaction_count"), own("confidence"), own("source"),
        )
        .withColumnRenamed("target", "service_id")
        .select(services.columns)
    )


def keep_last(rows: DataFrame, keys: list[str], order: list[str], position: str) -> DataFrame:
    """The last row of each key, with ``first``: the least position at which the key was met."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("first", F.min(position).over(Window.partitionBy(*keys))).withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")


def upserted(table: DataFrame, new: DataFrame, key: str = "Provider", number: str = "#") -> DataFrame:
    """Rows of ``new`` in place of those whose cleaned key is equal; others get the next numbers, in order of the key.

    The number of a replaced row stays.  ``new`` has no number.
    """
    keyed = lambda df: df.withColumn("k", cleaned_any(F.col(key)))
    old, fresh = keyed(table), keyed(new).dropDuplicates(["k"])
    stays = old.join(fresh.select("k"), "k", "left_anti")
    numbered = fresh.join(old.groupBy("k").agg(F.min(number).alias("n")), "k", "left")
    top = old.agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    order = F.row_number().over(Window.partitionBy(F.col("n").isNull()).orderBy("k"))
    numbered = numbered.withColumn("n", F.coalesce("n", top.scalar() + order)).withColumn(number, F.col("n").cast(dict(table.dtypes)[number]))
    return stays.select(table.columns).unionByName(numbered.select(table.columns))
