"""Charges as they arrive: each micro-batch is judged against the history so far.

The history is a table partitioned by a hash of the service and the batch; a
batch reads only the partitions of the services that it brings, and appends
itself after it has been judged.  A batch that is run again replaces what it
wrote before, so results are the same after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.operators import detection

KEYS = ["service", "category"]
COLUMNS = ["service", "category", "transaction_id", "date", "seq", "amount"]


#: Partitions of the history by service.
BUCKETS = 64


def judge_batch(batch: DataFrame, number: int, history: str, alerts: str) -> None:
    """Writes the alerts of a batch, then adds the batch to the history."""
    spark = batch.sparkSession
    new = batch.select(*COLUMNS, F.pmod(F.xxhash64("service"), F.lit(BUCKETS)).cast("int").alias("bucket")).persist()
    try:
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        try:
            old = spark.read.parquet(history).filter(F.col("bucket").isin(buckets) & (F.col("batch") < number))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = new.limit(0)
        known = old.select(*COLUMNS).join(new.select("service").distinct(), "service", "left_semi")
        mine = new.select("service", F.col("transaction_id").cast("string").alias("transaction_id"), "date", F.col("seq").cast("bigint").alias("seq")).distinct()
        found = detection.alerts(known.unionByName(new.select(*COLUMNS)), KEYS).join(mine, ["service", "transaction_id", "date", "seq"], "left_semi")
        found.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        out = new.withColumn("batch", F.lit(number)).repartition("bucket").write.partitionBy("bucket", "batch")
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(history)
    finally:
        new.unpersist()


def stream(charges: DataFrame, history: str, alerts: str, checkpoint: str) -> StreamingQuery:
    """Judges a stream of charges (service, category, transaction_id, date, seq, amount) batch by batch."""
    return charges.writeStream.foreachBatch(lambda df, n: judge_batch(df, n, history, alerts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
