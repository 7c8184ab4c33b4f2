"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of words: its documents in hashed order, passed over
up to three times.  A schedule of slots puts golden-ratio points through the
cumulative shares of the sources, so that every stretch of the mix holds each
source close to its share.  A source's slots are ranked, its stream is cut into
as many equal blocks as it has slots, and the two are joined: the slot of rank
r takes block r.  Ranks and running sums are taken in two levels (within chunks
of bounded size, and over the chunks), so that no source's rows meet in one
task.  Everything runs as built-in expressions.

Defined results: a null or blank text has size 0 and is never taken; a null
source is a source of its own, the last; repeated rows are mixed row by row;
sources without words have target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import common

#: Words of a slot, as long as a source's share is not rounded to none.
BLOCK = 1024
#: Passes over a source at most.
EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = 42
#: Slots, and documents on average, of a chunk.
SLOT_CHUNK, DOC_CHUNK = 4096, 512
#: Fractional parts of the golden ratio and of 2^20 times it.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.6077874097903648
#: Cells that the unit interval is cut into, to find the source of a point by an equi-join.
CELLS = 4096


def sizes_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sizes(source, size)`` to a row for each source: source, sid, source_size, target.

    Targets share the sum of all sizes by weight; one above ``epochs`` times its
    source stops there and the excess is shared again.  Ordered by the level at
    which a source stops, the first that stays under the level of the rest
    gives the level of all.  The windows hold one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("level", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("level", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("own", rest / free)
    share = F.min(F.when(F.col("own") <= F.col("level"), F.struct("level", "sid", "own"))).over(every)["own"]
    return per.withColumn("target", F.least(F.col("cap"), F.coalesce(share, F.lit(0.0)) * F.col("weight"))).select("source", "sid", "source_size", "target")


def streams(docs: DataFrame, per: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The columns asked for, with sid, source_size, target, size and start: the place of the document's first word in its source."""
    df = docs.select(*[c.alias(k) for k, c in keep.items()], F.col("source").alias("m_source"), sizes_of(F.col("text")).alias("size"), F.col("doc_id").alias("m_id"))
    df = df.join(common.small(per.withColumnRenamed("source", "p_source")), F.col("m_source").eqNullSafe(F.col("p_source"))).drop("m_source", "p_source")
    bits = max(1, (max(1, docs.count()) // DOC_CHUNK).bit_length())
    df = df.withColumn("h", F.xxhash64(F.lit(SEED), "m_id", "size")).withColumn("chunk", F.shiftrightunsigned("h", 64 - bits))
    chunks = df.groupBy("sid", "chunk").agg(F.sum("size").alias("in_chunk"))
    chunks = chunks.withColumn("ahead", F.sum("in_chunk").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("in_chunk")).select("sid", "chunk", "ahead")
    within = Window.partitionBy("sid", "chunk").orderBy("h", "m_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("upto", F.sum("size").over(within)).join(chunks, ["sid", "chunk"])
    return df.withColumn("start", F.col("ahead") + F.col("upto") - F.col("size")).drop("h", "chunk", "upto", "ahead", "m_id")


def schedule(per: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots (sid, slot, rank, slots, words): the source of each, its rank within it, and the source's number of slots and words to take."""
    spark = per.sparkSession
    shares = per.filter("target >= 1").select("sid", F.floor("target").alias("words"))
    every = Window.partitionBy(F.lit(0))
    upto = F.sum("words").over(every.orderBy("sid"))
    shares = shares.select("sid", "words", ((upto - F.col("words")) / F.sum("words").over(every)).alias("low"), (upto / F.sum("words").over(every)).alias("high"))
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    n = -(-total // block)
    i = F.col("id")
    point = ((i / 2**20).cast("bigint") * GOLDEN_20) % 1.0 + ((i % 2**20) * GOLDEN + 0.5) % 1.0
    points = spark.range(n).select(i.alias("slot"), (point % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))
    spans = shares.withColumn("cell", F.explode_outer(cells))
    slots = points.join(spans, "cell").filter("low <= u AND u < high").select("sid", "slot", "words", F.floor(F.col("slot") / SLOT_CHUNK).alias("part"))
    parts = slots.groupBy("sid", "part").agg(F.count("*").alias("n"))
    source = Window.partitionBy("sid")
    parts = parts.select("sid", "part", (F.sum("n").over(source.orderBy("part")) - F.col("n")).alias("ahead"), F.sum("n").over(source).alias("slots"))
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1).join(parts, ["sid", "part"])
    ranked = ranked.select("sid", "slot", (F.col("rank") + F.col("ahead")).alias("rank"), "slots", "words")
    # a source whose share is less than any gap of the points gets one slot, after the others
    missing = shares.join(parts.select("sid").distinct(), "sid", "left_anti").select("sid", (F.lit(n) + F.col("sid")).alias("slot"), F.lit(0).cast("bigint").alias("rank"), F.lit(1).cast("bigint").alias("slots"), "words")
    return ranked.union(missing)


def pieces(rows: DataFrame, slots: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``rows`` of :func:`streams` joined with their slots: sid, start, slot and the words [from_word, to_word) taken of the document."""
    per = common.small(common.checkpoint(slots.groupBy("sid").agg(F.max("slots").alias("slots"), F.max("words").alias("words"))))
    df = rows.filter("size > 0").select("sid", "start", "size", "source_size").join(per, "sid").withColumn("block", F.ceil(F.col("words") / F.col("slots")))
    # the passes that reach the document: those that begin before the last word to take
    last = F.least(F.lit(epochs - 1), F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size"))).cast("int")
    df = df.filter("start < words").withColumn("epoch", F.explode_outer(F.sequence(F.lit(0), last)))
    df = df.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start"))
    df = df.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    ranks = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))
    df = df.withColumn("rank", F.explode_outer(ranks))
    df = df.join(slots.select("sid", "rank", "slot"), ["sid", "rank"])
    low, high = F.greatest(F.col("begin"), F.col("rank") * F.col("block")), F.least(F.col("end"), (F.col("rank") + 1) * F.col("block"))
    return df.select("sid", "start", "slot", "epoch", (low - F.col("begin")).alias("from_word"), (high - F.col("begin")).alias("to_word"))


def mixed(docs: DataFrame, block: int = BLOCK, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """A row for each document with size, source_size, target and taken; and the pieces of the mix in slots.

    With ``carry`` the first keeps all input columns (in ``row``), else doc_id.
    """
    per = common.checkpoint(targets(docs.select("source", sizes_of(F.col("text")).alias("size"))))
    keep = {"row": F.struct(*[F.col(common.quoted(c)) for c in docs.columns])} if carry else {"doc_id": F.col("doc_id")}
    rows = common.checkpoint(streams(docs, per, keep))
    slots = common.checkpoint(schedule(per, block))
    parts = pieces(rows, slots)
    taken = parts.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # documents of size 0 share the start of the next one, so they get a key of their own
    keyed = rows.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    out = keyed.join(taken.withColumnRenamed("start", "key"), ["sid", "key"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    return out, parts


def mix_stage(docs: DataFrame) -> DataFrame:
    """The documents of the mix: the input columns, then source_size, target and taken (words, repeats counted); what is not taken at all goes."""
    out, _ = mixed(docs, carry=True)
    out = out.filter("taken > 0")
    return common.unpacked(out, docs.columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), taken=F.col("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 1, 2, 3."""
    out, _ = mixed(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
