"""Helpers on the shape of plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with these columns behind a generator.

    A filter on them would else be moved below the steps that compute them and
    be expanded to one expression, in which a lambda computes whole arrays again
    for each of its elements.
    """
    rest = [c for c in df.columns if c not in names]
    both = df.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("behind"))
    return both.select(*rest, *[F.col(f"behind.{c}").alias(c) for c in names])


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with reliable copies in the folder of ``spark.checkpoint.dir``.

    The folder is the cluster's.  Only a session on one machine that names none
    gets a folder of its own; a cluster without one is an error, since a lost
    executor would take copies in a local folder with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "ledgerlight-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
