r"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, anything but letters becomes one space, and n-grams of
1 to 3 characters are hashed to buckets.  Document frequencies are counted over
all training documents; the regression is trained by follow the regularised
leader (FTRL-proximal) with elastic-net penalties on a bounded, repeatable
sample of them, and its temperature is fitted on a part of that sample that the
training did not see.  Whole texts are used everywhere.

Defined results: ``und`` with score 0 for a null text, a text without a letter
(of any script; numeric symbols are none), and for every text when nothing can
be learned; a null language is not learned from; copies of a text count once in
the sample; of classes of equal probability the first by name is taken; a
language is known however many there are; other columns are not read; very long
texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm import common

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Documents of each language in the training sample at most, those with the least hash; of all languages together, as
#: long as that leaves each LEAST; and bytes of their features, shared evenly, where each language has one at least.
SAMPLE, TOTAL, LEAST, SAMPLE_BYTES = 400, 102_400, 10, 64 << 20
#: Hashes of texts are compared within this range.
SPAN = 1 << 31
#: Every so many-th document of the sample fits the temperature instead of the weights.
CALIBRATION = 5
EPOCHS = 6
#: FTRL-proximal: step size, its smoothing, and the penalties.
STEP, SMOOTHING, L1, L2 = 0.8, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"\P{L}+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of a text; none for a text without a letter."""
    plain = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = np.zeros(BUCKETS, np.int64)
    for n in ORDERS:
        sums = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            sums = (sums ^ codes[k : k + len(sums)]) * np.uint64(0x9E3779B97F4A7C15)
            sums ^= sums >> np.uint64(29)
        found += np.bincount((sums % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    buckets = np.flatnonzero(found)
    return buckets, found[buckets]


def features(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped term frequencies times inverse document frequencies, of length one."""
    x = (1 + np.log(counts)) * idf[buckets]
    return x / max(np.linalg.norm(x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """FTRL-proximal for softmax regression with elastic-net penalties; weights are derived from its sums when they are used."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((SMOOTHING + np.sqrt(n)) / STEP + L2)

    def learn(self, buckets: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(buckets)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[buckets]
        self.z[buckets] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / STEP * w
        self.n[buckets] = n + g * g


def temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""
    if not logits:
        return 1.0
    table, right = np.stack(logits), np.array(labels)

    def loss(log_t: float) -> float:
        z = table / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(right)), right]))

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class _Frequencies:
    """The number of texts that hold each bucket, a row for each bucket and batch run."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                buckets, _ = grams(text.as_py())
                total[buckets] += 1
                texts += len(buckets) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), texts], pa.int64())], ["bucket", "n"])


class _Features:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array([b.astype(np.int16).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
                ["lang", "h", "buckets", "counts"],
            )


class _Predict:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, idf, heat = self.model.value
        for batch in batches:
            languages, scores = [], []
            for text in batch.column("text"):
                buckets, counts = grams(text.as_py())
                if len(buckets) and names:
                    p = softmax(features(buckets, counts, idf) @ weights[buckets] / heat)
                    languages.append(names[int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    languages.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def fitted(training: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights, inverse document frequencies and temperature, from ``training(text, lang, h)``."""
    rows = training.select("text").mapInArrow(_Frequencies(), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket at most
    found = {r.bucket: r.n for r in rows}
    texts = found.pop(-1, 0)
    seen = np.zeros(BUCKETS)
    if found:
        seen[list(found)] = list(found.values())
    idf = np.log((1 + texts) / (1 + seen)) + 1
    counted = training.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()  # a row for each class of the model
    if not counted:
        return [], np.zeros((BUCKETS, 1)), idf, 1.0
    sample = max(min(sample, TOTAL // len(counted)), min(sample, LEAST))
    # Texts under a cut of their hash, four times the sample in expectation, so that one pass
    # finds the sample and no language's rows meet in one task; copies of a text count once,
    # in the sample and in the number that the cut comes from.
    cuts = [(r.lang, min(SPAN, -(-SPAN * 4 * sample // max(r.texts, 1)))) for r in counted]
    cuts = F.broadcast(training.sparkSession.createDataFrame(cuts, "lang string, cut bigint"))
    few = training.join(cuts, "lang").filter(F.pmod("h", F.lit(SPAN)) < F.col("cut")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(SPAN)), "h")
    chosen = few.withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= sample).drop("k")
    docs = chosen.mapInArrow(_Features(), "lang string, h bigint, buckets binary, counts binary")
    upto = F.sum(F.octet_length("buckets") + F.octet_length("counts")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1))
    docs = docs.withColumn("upto", F.coalesce(upto, F.lit(0))).filter(F.col("upto") < SAMPLE_BYTES // len(counted)).drop("upto").collect()
    names = sorted(r.lang for r in counted)
    place = {n: k for k, n in enumerate(names)}
    known = []
    for r in sorted(docs, key=lambda r: (r.h, r.lang)):
        buckets, counts = np.frombuffer(r.buckets, np.int16).astype(np.int64), np.frombuffer(r.counts, np.int32)
        if len(buckets):
            known.append((buckets, features(buckets, counts, idf), place[r.lang]))
    model = Ftrl(len(names))
    for _ in range(EPOCHS):
        for k, (buckets, x, label) in enumerate(known):
            if k % CALIBRATION or len(known) < 2 * CALIBRATION:
                model.learn(buckets, x, label)
    weights = model.weights()
    held = [(x @ weights[b], label) for k, (b, x, label) in enumerate(known) if k % CALIBRATION == 0]
    return names, weights, idf, temperature([z for z, _ in held], [y for _, y in held])


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; learns from the documents that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", held_out.alias("held_out"))
    training = df.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    model = df.sparkSession.sparkContext.broadcast(fitted(training, sample))
    return df.select("doc_id", "held_out", "text").mapInArrow(_Predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identified(common.table(spark, sf_dir, "documents"))
