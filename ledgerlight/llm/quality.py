r"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed token n-grams are estimated, one on trusted
documents and one on the raw corpus; a document's verdict is the mean log ratio
of its n-grams, compared with a fixed threshold, so equal texts always get
equal verdicts.  Everything runs as built-in expressions.

Defined results: a null or blank text has no words, base counts of zero, a
ratio of zero, fails the base rule and is not kept.  Repeated rows are scored
one by one and count one by one in the corpus model.  An empty corpus gives an
empty result; without a trusted document every ratio is zero, so only the base
rule and the threshold decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Model tokens: runs of letters and digits, or runs of other visible characters.
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
#: Words in a window of the repetition count.
WINDOW = 8
BUCKETS = 8192
#: Pseudo-observations of the raw distribution in the trusted one.
PRIOR = 2000.0
#: Trusted documents are at most this many, those with the smallest hash of their id.
MAX_TRUSTED = 20_000
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.2


def beside(array: str, by: int) -> Column:
    """Hashes of each hash of an array with the one ``by`` places on; the last ``by`` have nothing there and mean nothing."""
    later = F.slice(F.col(array), by + 1, F.greatest(F.size(array) - by, F.lit(0)))
    return F.zip_with(F.col(array), later, lambda x, y: F.xxhash64(x, y))


def covered(starts: Column) -> Column:
    """Number of words under windows that start at these places, given in order."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words for the text column."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(common.SEPARATOR_CHARS)) != "")
    df = df.withColumns({"b_words": common.words(F.col(text)), "b_lines": lines})
    # Each step is a column of its own: inside a lambda an expression would run
    # once an element, and what is named twice would run twice.
    df = df.withColumns(
        {
            "n_words": F.size("b_words").cast("bigint"),
            "word_chars": F.length(F.array_join("b_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint"),
            "n_dup_lines": (F.size("b_lines") - F.size(F.array_distinct("b_lines"))).cast("bigint"),
            "b_one": F.transform("b_words", lambda w: F.xxhash64(w)),
        }
    )
    # Windows of one word, two, four and eight.  Only texts that repeat four
    # words are hashed further, and only those that repeat eight are sorted.
    df = df.withColumn("b_two", beside("b_one", 1)).withColumn("b_four", beside("b_two", 2))
    df = df.withColumn("b_eight", F.when(F.size(F.array_distinct("b_four")) < F.size("b_four"), beside("b_four", 4)))
    df = df.withColumn("b_windows", F.slice("b_eight", 1, F.greatest(F.size("b_eight") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("b_windows")) < F.size("b_windows")
    df = df.withColumn("b_sorted", F.when(repeats, F.sort_array(F.transform("b_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("b_sorted", lambda x, i: F.coalesce(F.get("b_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("b_sorted", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("b_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    return df.withColumn("n_repeat_words", F.coalesce(covered(F.col("b_again")), F.lit(0).cast("bigint"))).drop(
        "b_words", "b_lines", "b_one", "b_two", "b_four", "b_eight", "b_windows", "b_sorted", "b_again"
    )


def token_hashes(text: Column) -> Column:
    """The hashes of a text's model tokens, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t))


def bucket(hashed: Column, buckets: int) -> Column:
    """The bucket of a token's hash, or of ``xxhash64`` of two of them for a bigram."""
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most ``limit`` ids labelled good and not toxic, by least hash: a bounded, repeatable sample."""
    ids = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return ids.select(F.col("doc_id").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with ``weights``: for each bucket the log of its trusted over its raw probability.

    The raw counts cover all documents; the trusted ones are found by a
    broadcast of at most MAX_TRUSTED ids.
    """
    hashes = docs.select("doc_id", token_hashes(F.col("text")).alias("b_hashes"))
    hashes = hashes.join(F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("trusted_id"), "left")
    # A row for each token and the next one, null after the last; two buckets of each, by expressions outside lambdas.
    # The outer forms: for the plain ones, Spark adds a filter on the size of the array, and computes the array within it
    pairs = F.arrays_zip(F.col("b_hashes").alias("x"), F.slice("b_hashes", 2, F.greatest(F.size("b_hashes") - 1, F.lit(0))).alias("y"))
    tokens = hashes.select(F.col("trusted_id").isNotNull().cast("int").alias("trusted"), F.inline_outer(pairs))
    both = F.array(bucket(F.col("x"), buckets), F.when(F.col("y").isNotNull(), bucket(F.xxhash64("x", "y"), buckets)))
    counts = (
        tokens.select("trusted", F.explode_outer(both).alias("bucket"))
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("good"))
    )
    filled = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    total = filled.agg(
        F.sum("raw").alias("all_raw"),
        F.sum("good").alias("all_good"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"),
    )
    raw = lambda x: (x["raw"] + 1.0) / (F.col("all_raw") + float(buckets))
    return total.select(
        F.transform("rows", lambda x: F.when(F.col("all_good") == 0, F.lit(0.0)).otherwise(F.log((x["good"] + prior * raw(x)) / (F.col("all_good") + prior) / raw(x)))).alias("weights")
    )


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """All input columns, then the base counts, base_failed, llr (mean log ratio) and kept."""
    weights = log_ratios(docs, labels, buckets)
    df = common.packed(docs, text=F.col("text"))
    df = base_counts(df, "text").withColumn("b_hashes", token_hashes(F.col("text"))).drop("text")
    n = F.size("b_hashes")
    # For each token its weight and that of the bigram with the next one.  Each of the two columns of weights is named
    # once, and in a step apart from the hashes, so that Spark puts the subquery in their place: a column named twice is
    # copied into every row.
    df = df.withColumns({"b_next": F.slice("b_hashes", 2, F.greatest(n - 1, F.lit(0))), "b_unigrams": weights.scalar(), "b_bigrams": weights.scalar()})
    sums = F.zip_with(
        "b_hashes",
        "b_next",
        lambda x, y: F.get("b_unigrams", bucket(x, buckets)) + F.when(y.isNull(), F.lit(0.0)).otherwise(F.get("b_bigrams", bucket(F.xxhash64(x, y), buckets))),
    )
    df = df.withColumn("b_sum", F.aggregate(sums, F.lit(0.0), lambda acc, w: acc + w))
    df = df.withColumn("llr", F.when(n == 0, F.lit(0.0)).otherwise(F.col("b_sum") / (2 * n - 1))).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return common.unpacked(
        common.fenced(df.select("row", *counts, "base_failed", "llr"), *counts, "base_failed", "llr"),
        docs.columns,
        n_words=F.col("n_words"),
        word_chars=F.col("word_chars"),
        n_symbols=F.col("n_symbols"),
        n_dup_lines=F.col("n_dup_lines"),
        n_repeat_words=F.col("n_repeat_words"),
        base_failed=F.col("base_failed"),
        llr=F.col("llr"),
        kept=~F.col("base_failed") & (F.col("llr") >= threshold),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The quality rules over all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.table(spark, sf_dir, "labels")).drop("text")
