"""Entity resolution: raw names to services of a registry.

Distinct cleaned names are resolved once.  Known aliases and names are equi-joins;
only what they miss is scored against the registry, which is sent to the
executors in blocks of bounded size, and the best of all blocks decides.  Names
without a match become services of their own; near-duplicates among those are
joined by :func:`clustered`.  ``sequential`` learns in input order, as a
single pass over the distinct names would.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import text
from ledgerlight.functions.plan import checkpoint
from ledgerlight.functions.similarity import NameIndex, char_grams, cosine_pairs, inverse_frequencies, plain_name, tfidf
from ledgerlight.operators import registry

#: Edit similarity, cosine; and what of both together is enough.
FUZZY_HIGH, COSINE_HIGH, FUZZY_LEAST, COSINE_LEAST = 92.0, 0.75, 80.0, 0.55
LEARN_FROM, NEW_CONFIDENCE = 0.80, 0.30
#: Cosine from which two unresolved names are linked.
LINK = 0.60
#: Names of the registry that are scored together.
BLOCK = 50_000


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


class _Grams:
    """Names to the grams that each holds, and an empty one for each name."""

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([g for n in frame["name"] if n and n.strip() for g in ("", *set(char_grams(plain_name(n))))], columns=["gram"], dtype=object)


class _Score:
    def __init__(self, names, idf):
        self.names, self.idf = names, idf

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = NameIndex(self.names.value, self.idf and self.idf.value)
        for frame in frames:
            rows = [(name, kind, int(s), float(x)) for name in frame["cleaned"] for kind, found in (("fuzzy", index.fuzzy(name)), ("cosine", index.cosine(name))) for s, x in found]
            yield pd.DataFrame(rows, columns=["cleaned", "kind", "service_ord", "score"])


def candidates(names: DataFrame, services: DataFrame, block: int = BLOCK) -> DataFrame:
    """``names(cleaned)`` to their three best services by each similarity: cleaned, kind, service_ord, score, rank.

    Cosines weigh n-grams by their frequency in the whole registry, also where
    it is scored in several blocks; those frequencies are then counted first.
    """
    listed = services.select("service_ord", F.posexplode(F.concat(F.array("canonical_name"), "aliases")).alias("place", "name"))
    total = services.agg(F.coalesce(F.sum(F.size("aliases") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    context, out, idf = names.sparkSession.sparkContext, None, None
    if blocks > 1:
        found = {r.gram: r.n for r in listed.select("name").mapInPandas(_Grams(), "gram string").groupBy("gram").agg(F.count("*").alias("n")).toLocalIterator()}
        idf = context.broadcast(inverse_frequencies(found, found.pop("", 0)))
    for k in range(blocks):
        part = listed.filter(F.pmod("service_ord", F.lit(blocks)) == k).orderBy("service_ord", "place")
        rows = [(r.service_ord, r.name, r.place == 0) for r in part.toLocalIterator()]
        found = names.select("cleaned").mapInPandas(_Score(context.broadcast(rows), idf), "cleaned string, kind string, service_ord bigint, score double")
        out = found if out is None else out.union(found)
    return top_n(out, ["cleaned", "kind"], [F.col("score").desc(), F.col("service_ord")], 3)


def decided(found: DataFrame) -> DataFrame:
    """One row for each scored name: service_ord (null: none), method, confidence and candidates."""
    best = lambda kind, c: F.max(F.when((F.col("kind") == kind) & (F.col("rank") == 1), F.col(c)))
    df = found.groupBy("cleaned").agg(
        best("fuzzy", "service_ord").alias("f"), best("fuzzy", "score").alias("fs"), best("cosine", "service_ord").alias("c"), best("cosine", "score").alias("cs"),
        F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "fuzzy", 0).otherwise(1).alias("k"), "rank", "service_ord", F.when(F.col("kind") == "fuzzy", F.col("score") / 100).otherwise(F.col("score")).alias("score")))).alias("all"),
    )
    fuzzy, cosine = F.col("fs") >= FUZZY_HIGH, F.col("cs") >= COSINE_HIGH
    both = (F.col("f") == F.col("c")) & (F.col("fs") >= FUZZY_LEAST) & (F.col("cs") >= COSINE_LEAST)
    pick = lambda a, b, c: F.when(fuzzy, a).when(cosine, b).when(both, c)
    return df.select(
        "cleaned", pick(F.col("f"), F.col("c"), F.col("f")).alias("service_ord"), pick(F.lit("fuzzy"), F.lit("embedding"), F.lit("fuzzy+embedding")).alias("method"),
        F.round(pick(F.col("fs") / 100, F.col("cs"), F.col("fs") / 200 + F.col("cs") / 2), 3).alias("confidence"),
        F.transform("all", lambda x: F.struct(x["service_ord"].alias("service_ord"), F.round(x["score"], 3).alias("score"))).alias("candidates"),
    )


def low_confidence(resolutions: DataFrame, below: float = 0.5) -> DataFrame:
    """Resolutions to look at: those of less confidence."""
    return resolutions.filter(F.col("confidence") < below)


def exact(names: DataFrame, services: DataFrame) -> DataFrame:
    """``names(cleaned)`` that are an alias or else a name of a service: cleaned, service_ord of the first such."""
    by_alias = registry.aliases(services).select(F.lower("alias").alias("cleaned"), F.lit(0).alias("way"), "service_ord")
    by_name = services.select(F.lower("canonical_name").alias("cleaned"), F.lit(1).alias("way"), "service_ord")
    known = by_alias.union(by_name).groupBy("cleaned").agg(F.min(F.struct("way", "service_ord"))["service_ord"].alias("service_ord"))
    return names.join(known, "cleaned")


def resolved(txns: DataFrame, services: DataFrame, auto_create: bool = True) -> tuple[DataFrame, DataFrame]:
    """The transactions with cleaned, service_id, canonical_name, service_category, method and confidence; and the registry after them.

    ``txns``: merchant_raw, date, category_mcc, seq.  All names meet the registry
    as it was; what it learns counts from the next batch on.
    """
    df = txns.withColumn("cleaned", text.cleaned_any(F.col("merchant_raw")))
    first = F.min(F.struct("seq", "merchant_raw", "category_mcc"))
    names = df.filter("cleaned <> ''").groupBy("cleaned").agg(first.alias("first")).select("cleaned", "first.*")
    hits = exact(names.select("cleaned"), services).select("cleaned", "service_ord", F.lit("exact_alias").alias("method"), F.lit(1.0).alias("confidence"))
    misses = names.join(hits, "cleaned", "left_anti")
    scored = decided(candidates(misses, services)).filter("service_ord IS NOT NULL").select("cleaned", "service_ord", "method", "confidence")
    known = hits.union(scored).join(services.select("service_ord", "service_id", "canonical_name", "category"), "service_ord")
    known = known.select("cleaned", "service_id", "canonical_name", "category", "method", "confidence")
    after = registry.with_aliases(services, scored.filter(F.col("confidence") >= LEARN_FROM).join(services.select("service_ord", "service_id"), "service_ord").select("service_id", F.col("cleaned").alias("alias")))
    if auto_create:
        new = misses.join(scored, "cleaned", "left_anti")
        top = services.agg(F.coalesce(F.max("service_ord"), F.lit(-1))).first()[0]
        rows = new.select(
            (F.col("seq") + top + 1).alias("service_ord"), text.display(F.col("cleaned")).alias("canonical_name"),
            text.category(F.col("merchant_raw"), F.col("category_mcc")).alias("category"), F.array("cleaned").alias("aliases"),
        )
        created = registry.registered(rows, confidence=NEW_CONFIDENCE)
        after = after.unionByName(created)
        known = known.union(created.select(F.get("aliases", F.lit(0)), "service_id", "canonical_name", "category", F.lit("new_service"), F.lit(NEW_CONFIDENCE)))
    out = df.join(known.withColumnRenamed("category", "service_category"), "cleaned", "left")
    out = out.withColumn("method", F.coalesce("method", F.lit("unresolved"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return out, registry.seen(after, out.filter("service_id IS NOT NULL AND date IS NOT NULL").select("service_id", "date"))


def sequential(txns: DataFrame, services: DataFrame, as_of: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """As :func:`resolved`, but every distinct name meets the registry that the names before it have taught.

    The fold runs on the driver over distinct names, one small batch after the
    other; it is for registries and imports of one user.
    """
    df = txns.withColumn("cleaned", text.cleaned_any(F.col("merchant_raw")))
    order = [r.cleaned for r in df.filter("cleaned <> ''").groupBy("cleaned").agg(F.min("seq").alias("s")).orderBy("s").toLocalIterator()]
    out = df.filter("cleaned = ''").transform(lambda d: resolved(d.drop("cleaned"), services)[0])
    for name in order:
        found, services = resolved(df.filter(F.col("cleaned") == name).drop("cleaned"), services)
        rows = services.collect()
        services = services.sparkSession.createDataFrame(rows, registry.SCHEMA)
        out = out.unionByName(found)
    return out, services


def clustered(names: DataFrame, key: str = "name") -> DataFrame:
    """Unresolved names to clusters: ``name``, cluster (the least name reachable), canonical and size.

    With two points enough for a core, density clusters are the connected
    components of the names within the distance; labels spread until none
    changes.
    """
    distinct = names.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"))
    edges = cosine_pairs(tfidf(distinct, "name", "name"), "name", LINK - 1e-9).select("a", "b")
    both = edges.union(edges.select("b", "a")).toDF("name", "other").cache()
    labels = distinct.select("name", F.col("name").alias("cluster"))
    while True:
        near = both.join(labels.withColumnRenamed("name", "other"), "other").groupBy("name").agg(F.min("cluster").alias("low"))
        after = checkpoint(labels.join(near, "name", "left").select("name", F.least("cluster", "low").alias("cluster"), (F.col("low") < F.col("cluster")).alias("moved")))
        labels = after.select("name", "cluster")
        if after.filter("moved").isEmpty():
            break
    rows = distinct.join(labels, "name")
    ranked = top_n(rows, ["cluster"], [F.col("n").desc(), F.length("name"), F.col("name")], 1).select("cluster", text.display(F.col("name")).alias("canonical"))
    return rows.join(ranked, "cluster").withColumn("size", F.sum("n").over(Window.partitionBy("cluster"))).select("name", "cluster", "canonical", "size")
