"""The whole analysis as one plan, and its report."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import text
from ledgerlight.functions.plan import checkpoint
from ledgerlight.operators import detection, feedback, registry, resolution
from ledgerlight.operators.prediction import AmountModel, features

#: Of a service: its id, name and category, and when it was met first.
KEYS = ["service", "canonical_name", "category", "met"]


def severity_counts(alerts: DataFrame) -> DataFrame:
    """A row for each severity, also where it has no alert."""
    levels = alerts.sparkSession.createDataFrame([("high",), ("warning",), ("low",)], "severity string")
    return levels.join(alerts.groupBy("severity").agg(F.count("*").alias("found")), "severity", "left").select("severity", F.coalesce("found", F.lit(0)).cast("bigint").alias("n"))


def compared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Severities of two runs side by side; what only one has is a dash before and suppressed after."""
    a, b = (df.groupBy(key).agg(F.max_by("severity", F.struct("date", "seq")).alias(s)) for df, s in ((before, "before"), (after, "after")))
    return a.join(b, key, "full").select(key, F.coalesce("before", F.lit("—")).alias("before"), F.coalesce("after", F.lit("suppressed")).alias("after"))


def formatted() -> Column:
    """An alert as a block of text."""
    return F.concat_ws(
        "\n",
        F.format_string("[%s] Unusual charge detected", F.upper("severity")),
        F.format_string("  Merchant:         %s", "canonical_name"),
        F.format_string("  Category:         %s", "category"),
        F.format_string("  Expected:         $%.2f", "expected"),
        F.format_string("  Prediction CI:    $%.2f – $%.2f", "lower_bound", "upper_bound"),
        F.format_string("  Actual:           $%.2f", "actual"),
        F.format_string("  Difference:       +$%.2f (%.1f%%)", "difference", "percentage_change"),
        F.format_string("  Date:             %s", F.col("date").cast("string")),
        F.format_string("  Outlier score:    %.3f", "outlier_score"),
        F.format_string("  Possible reasons: %s", F.array_join(F.slice("possible_reasons", 1, 3), ", ")),
    )


def detected(txns: DataFrame, given: DataFrame | None = None, model: AmountModel | None = None) -> DataFrame:
    """Alerts of resolved transactions, most severe first, then by the service that was met first.

    A service has one category: its own in the registry, else that of its first
    charge.  With a model, its bounds and expectation replace the median's.
    """
    grouped = txns.withColumn("service", F.coalesce("service_id", F.concat(F.lit("unresolved::"), "cleaned")))
    of_service = Window.partitionBy("service")
    grouped = grouped.withColumn("own", text.category(F.col("merchant_raw"), F.col("category_mcc")))
    first = F.min(F.struct("date", "seq", "own")).over(of_service)
    grouped = grouped.withColumn("canonical_name", F.coalesce(F.max("canonical_name").over(of_service), F.nullif("cleaned", F.lit("")), F.lit("Unknown")))
    grouped = grouped.withColumn("first", first).withColumn("category", F.coalesce(F.max("service_category").over(of_service), "first.own")).withColumn("met", F.struct("first.date", "first.seq"))
    predicted = detection.predictions(grouped, KEYS)
    if model is not None:
        one = [*KEYS, "now", "cycle_days"]
        history = predicted.select(*one, F.explode("base").alias("t")).select(*one, "t.date", "t.seq", "t.amount")
        gap = F.datediff("now.date", "last_date")
        last = history.groupBy(*one).agg(F.max("date").alias("last_date")).withColumn("gap", gap)
        rows = features(history.join(last, one), [*one, "gap"], F.col("cycle_days"), F.col("gap"))
        better = model.predict(rows).select(*one, *[F.col(c).alias(f"m_{c}") for c in ("expected", "lower_bound", "upper_bound")])
        predicted = predicted.join(better, one, "left")
        predicted = predicted.withColumns({c: F.coalesce(f"m_{c}", c) for c in ("expected", "lower_bound", "upper_bound")})
    found = detection.judged(predicted, KEYS)
    if given is not None:
        found = feedback.adjusted(found, given.withColumnRenamed("merchant", "canonical_name"), "canonical_name")
    else:
        found = found.withColumn("feedback_adjusted", F.lit(False))
    return detection.by_severity(found.filter("severity <> 'none'"), "met", "date", "seq").drop("met")


def analyze(txns: DataFrame, services: DataFrame | None = None, given: DataFrame | None = None, use_ml: bool = False, seed_registry: bool = True, reset_registry: bool = False, reset_feedback: bool = False) -> dict:
    """Deduplicates, resolves, detects and reports.

    Returns DataFrames ``alerts``, ``resolutions``, ``services`` and
    ``summary``, and the counts.  Names are resolved once.  A reset leaves the
    given registry or feedback out.
    """
    services, given = None if reset_registry else services, None if reset_feedback else given
    spark = txns.sparkSession
    services = services if services is not None else registry.empty(spark)
    if seed_registry:
        services = registry.with_missing_seeds(services)
    once = registry.keep_last(txns, ["transaction_id"], ["date", "seq"], "seq").drop("first")
    known, after = resolution.resolved(once, services)
    known, after = checkpoint(known), checkpoint(after)  # scored once, read by all that follows
    alerts = detected(known, given, AmountModel(spark) if use_ml else None)
    first = resolution.top_n(known, ["merchant_raw"], [F.col("seq")], 1)
    resolutions = first.select("merchant_raw", "cleaned", "canonical_name", F.col("service_category").alias("category"), "method", "confidence").orderBy("merchant_raw")
    return {
        "alerts": alerts.withColumn("text", formatted()), "resolutions": resolutions, "services": after, "summary": severity_counts(alerts),
        "transaction_count": once.count(), "service_count": after.count(), "run_at": dt.datetime.now(dt.UTC).isoformat(), "use_ml": use_ml,
    }


def report_json(report: dict, indent: int = 2) -> str:
    """The report as text, for reports of a size that one reader reads."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]
    whole = {k: v if not isinstance(v, DataFrame) else rows(v) for k, v in report.items() if k != "services"}
    whole["alert_count"] = len(whole["alerts"])
    whole["summary"] = {r["severity"]: r["n"] for r in whole["summary"]}
    return json.dumps(whole, indent=indent, default=str)
