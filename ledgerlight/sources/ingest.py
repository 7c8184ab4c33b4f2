"""Records, CSV and JSON to typed charges: valid rows, and rejected rows with their reason."""

from __future__ import annotations

import csv
import io
import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text

FIELDS = ["transaction_id", "merchant_raw", "amount", "date", "currency", "category_mcc", "payment_method", "description"]
SCHEMA = "transaction_id string, merchant_raw string, amount double, date date, currency string, category_mcc string, payment_method string, description string, seq bigint"


def renamed(df: DataFrame) -> DataFrame:
    """String columns under the fields that their headers stand for; of two headers of one field the last counts, even where it is blank."""
    place = {text.header(c): k for k, c in enumerate(df.columns)}
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return numbered.select(*[(F.col(f"c{place[f]}").cast("string") if f in place else F.lit(None).cast("string")).alias(f) for f in FIELDS], *([F.col(f"c{df.columns.index('seq')}").alias("seq")] if "seq" in df.columns else []))


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def typed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw``: string columns and seq (from 1) to valid charges and to rejects (row_no, error).

    Numbers that are not finite and rows without a name are rejected.  Ids that
    are missing follow from the row, so that a second run gives the same.
    """
    df = renamed(raw)
    df = df.withColumn("merchant_raw", _blank("merchant_raw")).withColumn("number", text.parsed_amount(F.col("amount"))).withColumn("day", text.parsed_date(F.col("date")))
    error = (
        F.when(F.col("merchant_raw").isNull(), "missing merchant (merchant_raw / merchant / description)")
        .when(F.coalesce(_blank("amount"), F.lit("")) == "", "empty amount")
        .when(F.col("number").isNull(), F.concat(F.lit("could not convert string to float: "), "amount"))
        .when(F.coalesce(_blank("date"), F.lit("")) == "", "empty date")
        .when(F.col("day").isNull(), F.concat(F.lit("unrecognized date format: "), "date"))
    )
    df = df.withColumn("error", error)
    made = F.concat(F.lit("ingest-"), F.substring(F.sha2(F.concat_ws("|", "seq", "merchant_raw", "amount", "date"), 256), 1, 8))
    valid = df.filter("error IS NULL").select(
        F.coalesce(_blank("transaction_id"), made).alias("transaction_id"), "merchant_raw", F.col("number").alias("amount"), F.col("day").alias("date"),
        F.coalesce(_blank("currency"), F.lit("USD")).alias("currency"), _blank("category_mcc").alias("category_mcc"), _blank("payment_method").alias("payment_method"), _blank("description").alias("description"), "seq",
    )
    rejects = df.filter("error IS NOT NULL").select(F.col("seq").alias("row_no"), F.concat(F.lit("Row "), F.col("seq").cast("string"), F.lit(": "), "error").alias("error"))
    return valid, rejects


def records(spark, rows: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Rows of a list; what is no mapping is rejected for want of a name."""
    maps = [{str(k): None if v is None else str(v) for k, v in r.items() if k is not None} if isinstance(r, dict) else {} for r in rows]
    names = list(dict.fromkeys(k for m in maps for k in m)) or ["merchant"]
    data = [(n, *(m.get(k) for k in names)) for n, m in enumerate(maps, 1)]
    schema = "`seq` bigint, " + ", ".join(f"`h{k}` string" for k in range(len(names)))
    return typed(spark.createDataFrame(data, schema).toDF("seq", *names))


def delimiter(start: str) -> str:
    return "," if start[:4096].count(",") >= start[:4096].count(";") else ";"


def csv_text(spark, content: str | bytes, sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """An uploaded CSV text with a header."""
    content = content.decode("utf-8-sig") if isinstance(content, bytes) else content
    if not content.strip():
        raise ValueError("CSV file is empty.")
    return records(spark, list(csv.DictReader(io.StringIO(content), delimiter=sep or delimiter(content))))


def numbered(df: DataFrame) -> DataFrame:
    """``seq`` from 1 over all partitions; only the sizes of the partitions reach the driver."""
    parted = df.withColumn("seq", F.monotonically_increasing_id())
    part, within = F.shiftright("seq", 33), F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in parted.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before = itertools.accumulate((n for _, n in sizes), initial=0)
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "numbered_p bigint, numbered_b bigint")
    return parted.join(F.broadcast(starts), part == F.col("numbered_p")).withColumn("seq", F.col("numbered_b") + within + 1).drop("numbered_p", "numbered_b")


def csv_files(spark, path: str, sep: str | None = None, quoted_breaks: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV files read by the executors; the separator is taken from the first 4,096 characters of one.

    Without ``quoted_breaks`` no field may hold a line break, and a large file is read by many tasks.
    """
    if sep is None:
        first = "\n".join(r[0] for r in spark.read.text(path).limit(64).collect())
        if not first.strip():
            raise ValueError("CSV file is empty.")
        sep = delimiter(first)
    df = spark.read.csv(path, header=True, sep=sep, multiLine=quoted_breaks, quote='"', escape='"', mode="PERMISSIVE")
    return typed(numbered(df))


def json_text(spark, content: str | bytes) -> tuple[DataFrame, DataFrame]:
    """An array of rows, or an object that holds one under ``transactions`` or else ``data``."""
    content = content.decode("utf-8-sig") if isinstance(content, bytes) else content
    if not content.strip():
        raise ValueError("JSON file is empty.")
    try:
        data = json.loads(content)
    except json.JSONDecodeError as e:
        raise ValueError(f"Invalid JSON: {e}") from e
    if isinstance(data, dict):
        data = data.get("transactions", data.get("data"))
    if not isinstance(data, list):
        raise ValueError("JSON must be an array of transactions or an object with a 'transactions' array.")
    return records(spark, data)


def json_files(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of JSON lines, or of an array of rows, or of an object that holds one under ``transactions`` or else ``data``; all values as strings.

    How the first file begins tells which; arrays and objects are read a file a task.
    """
    start = next((r[0].strip() for r in spark.read.text(path).limit(64).collect() if r[0].strip()), "")
    try:
        row = json.loads(start)
        lines = isinstance(row, dict) and not any(isinstance(row.get(k), list) for k in ("transactions", "data"))
    except json.JSONDecodeError:
        lines = False
    df = spark.read.option("primitivesAsString", True).option("multiLine", not lines).json(path)
    held = next((k for k in ("transactions", "data") if not lines and k in df.columns), None)
    return typed(numbered(df.select(F.explode(held).alias("row")).select("row.*") if held else df))
