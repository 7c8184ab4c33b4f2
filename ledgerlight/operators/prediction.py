"""Expected amounts: medians, seasonal references, features and boosted trees."""

from __future__ import annotations

import pickle
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import fixed
from ledgerlight.operators.detection import SEASON_DAYS

#: Charges from which the model is asked, and confidence from which it is believed.
LEAST_CHARGES, LEAST_CONFIDENCE = 3, 0.50
FEATURES = ["last", "second_last", "median", "mean", "std", "cv", "last_delta", "slope", "n_obs", "cycle", "category_index", "days", "most", "least"]


def median_of_last(txns: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """The exact median of the last k charges of each key."""
    back = Window.partitionBy(*keys).orderBy(F.col("date").desc(), F.col("seq").desc())
    return txns.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= k).groupBy(*keys).agg(F.median("amount").alias("expected"))


def seasonal(txns: DataFrame, keys: list[str]) -> DataFrame:
    """For each charge the earlier ones of its key around the same day of the year before: their number and median.

    A range join inside a key.  Charges and references meet in buckets of a
    month, so that a key with a long history is not compared all against all.
    """
    a = txns.select(*keys, "transaction_id", "date", "seq").withColumn("aim", F.add_months("date", -12))
    month = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / 30)
    a = a.withColumn("bucket", F.explode(F.sequence(month(F.date_sub("aim", SEASON_DAYS)), month(F.date_add("aim", SEASON_DAYS)))))
    b = txns.select(*keys, F.col("date").alias("b_date"), F.col("seq").alias("b_seq"), F.col("amount").alias("b_amount")).withColumn("bucket", month(F.col("b_date")))
    near = a.join(b, [*keys, "bucket"]).filter((F.abs(F.datediff("b_date", "aim")) <= SEASON_DAYS) & (F.struct("b_date", "b_seq") < F.struct("date", "seq")))
    return near.groupBy(*keys, "transaction_id").agg(F.count("*").alias("n"), F.median("b_amount").alias("season"))


def fallback(amounts: Column) -> Column:
    """The median within 1.5 population deviations, from an array of amounts; of a single amount within 7.5 %."""
    ordered = F.array_sort(amounts)
    n = F.size(ordered)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    mean = F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean)
    spread = F.when(n > 1, F.coalesce(F.nanvl(spread, F.lit(0.0)), F.lit(0.0))).otherwise(middle * 0.05)
    return F.struct(
        F.round(middle, 2).alias("expected"),
        F.round(F.greatest(middle - spread * 1.5, F.lit(0.01)), 2).alias("lower_bound"),
        F.round(middle + spread * 1.5, 2).alias("upper_bound"),
        F.lit(0.0).alias("confidence"),
        F.lit("median").alias("method"),
    )


def features(txns: DataFrame, keys: list[str], cycle_days: Column | None = None, days: Column | None = None) -> DataFrame:
    """The fourteen features of each key's history, by grouped aggregates; ``category`` is one of the keys or absent."""
    back = Window.partitionBy(*keys).orderBy(F.col("date").desc(), F.col("seq").desc())
    rows = txns.withColumn("back", F.row_number().over(back))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("amount")))
    window = F.when(F.col("back") <= 6, F.col("amount"))
    df = rows.groupBy(*keys).agg(
        at(1).alias("last"), F.coalesce(at(2), at(1)).alias("second_last"), F.median("amount").alias("median"), F.avg("amount").alias("mean"),
        F.coalesce(F.stddev_pop("amount"), F.lit(0.0)).alias("std"), F.regr_slope(window, -F.col("back")).alias("raw_slope"),
        F.count("*").alias("n"), F.max("amount").alias("most"), F.min("amount").alias("least"),
    )
    nearest = cycle_days if cycle_days is not None else F.lit(30)
    distance = F.array(*[F.struct(F.abs(nearest - d).alias("off"), F.lit(k).alias("k")) for k, (*_, d) in enumerate(fixed.CYCLES)])
    category = F.col("category") if "category" in keys else F.lit("general")
    index = F.array_position(F.array(*map(F.lit, fixed.CATEGORIES)), category) - 1
    over_median = lambda x: F.when(F.col("median") > 0, x / F.col("median")).otherwise(0.0)
    return df.select(
        *keys, "n", "last", "second_last", "median", "mean", "std", F.least(over_median(F.col("std")), F.lit(5.0)).alias("cv"),
        F.when(F.col("second_last") > 0, (F.col("last") - F.col("second_last")) / F.col("second_last")).otherwise(0.0).alias("last_delta"),
        F.coalesce(over_median(F.col("raw_slope")), F.lit(0.0)).alias("slope"), F.least("n", F.lit(12)).cast("double").alias("n_obs"),
        F.array_min(distance)["k"].cast("double").alias("cycle"), F.when(index < 0, F.lit(len(fixed.CATEGORIES) - 1)).otherwise(index).cast("double").alias("category_index"),
        F.least(days if days is not None else F.lit(30), F.lit(400)).cast("double").alias("days"), "most", "least",
    )


# Training histories by kind: share, cycles, categories (none: all), least and most charges.
KINDS = {
    "steady": (0.40, [7, 14, 30, 91, 365], None, 3, 12),
    "creeping": (0.15, [30, 91, 365], ["streaming", "software", "music", "news"], 4, 12),
    "upgraded": (0.15, [30], ["software", "streaming", "gaming"], 3, 7),
    "discount over": (0.10, [30], ["streaming", "music", "software", "fitness"], 2, 6),
    "made annual": (0.05, [365], ["software", "streaming", "fitness"], 2, 5),
    "varying": (0.08, [30], ["telecom"], 3, 9),
    "seasonal": (0.07, [30], ["utilities"], 3, 9),
}
PRICES = [2.99, 4.99, 5.99, 6.99, 7.99, 9.99, 10.99, 11.99, 12.99, 14.99, 15.49, 17.99, 19.99, 24.99, 29.99, 34.99, 39.99, 49.99, 59.99, 79.99, 99.99, 119.99, 149.99, 199.99]
UPGRADES = [1.5, 2.0, 2.5, 3.0, 4.0]
WINTER, NEARLY = (11, 0, 1, 2), (3, 10)


def history(rng: np.random.Generator, kind: str) -> tuple[np.ndarray, int, str, int]:
    """Amounts of a history with the next one last, its cycle, category and the days since the last charge."""
    _, cycles, categories, least, most = KINDS[kind]
    n = int(rng.integers(least, most + 1))
    t = np.arange(n + 1)
    around = lambda width: 1 + rng.uniform(-width, width, n + 1)
    price = rng.choice(PRICES)
    if kind == "steady":
        amounts = price * around(0.015)
    elif kind == "creeping":
        rate = rng.uniform(0.002, 0.008)
        amounts = price * (1 + rate * t) + rng.uniform(-0.05, 0.05, n + 1)
        amounts[-1] = amounts[-2] * (1 + rate)
    elif kind == "upgraded":  # the last charge is at the new price already
        amounts = price * np.where(t >= n - 1, rng.choice(UPGRADES), 1.0) * np.where(t == n, around(0.01), np.where(t == n - 1, 1.0, around(0.02)))
    elif kind == "discount over":
        amounts = price * rng.uniform(0.5, 0.8) * np.where(t == n, around(0.01) / rng.uniform(0.5, 0.8), around(0.02))
    elif kind == "made annual":
        amounts = price * np.where(t == n, rng.uniform(9.0, 11.5), around(0.02))
    elif kind == "varying":
        amounts = rng.uniform(40, 180) * around(0.08)
    else:
        month = (rng.integers(0, 12) + t) % 12
        amounts = rng.uniform(60, 120) * np.where(np.isin(month, WINTER), rng.uniform(1.5, 2.5), np.where(np.isin(month, NEARLY), 1.1, 1.0)) * around(0.04)
    cycle = int(rng.choice(cycles))
    return np.round(amounts, 2), cycle, str(rng.choice(categories or fixed.CATEGORIES)), cycle + int(rng.integers(-3, 4))


def feature_row(amounts: np.ndarray, cycle: int, category: str, days: int) -> list[float]:
    """The features of one history; the twin of :func:`features`."""
    n, last, middle = len(amounts), amounts[-1], float(np.median(amounts))
    before = amounts[-2] if n > 1 else last
    recent = amounts[-6:]
    slope = np.polyfit(np.arange(len(recent)), recent, 1)[0] if len(recent) > 1 else 0.0
    over = lambda x: x / middle if middle > 0 else 0.0
    nearest = min(range(len(fixed.CYCLES)), key=lambda k: abs(fixed.CYCLES[k][-1] - cycle))
    index = fixed.CATEGORIES.index(category if category in fixed.CATEGORIES else "general")
    return [last, before, middle, amounts.mean(), amounts.std(), min(over(amounts.std()), 5.0), (last - before) / before if before > 0 else 0.0, over(slope), min(n, 12), nearest, index, min(days, 400), amounts.max(), amounts.min()]


def synthetic(n: int = 2000, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Features and next amounts of so many histories, the kinds in their shares."""
    rng, kinds = np.random.default_rng(seed), list(KINDS)
    counts = [int(n * KINDS[k][0]) for k in kinds]
    counts[-1] += n - sum(counts)
    drawn = [history(rng, kind) for kind, count in zip(kinds, counts, strict=True) for _ in range(count)]
    order = rng.permutation(n)
    return np.array([feature_row(a[:-1], *rest) for a, *rest in drawn])[order], np.array([a[-1] for a, *_ in drawn])[order]


#: Of each boosted model: trees, their depth, the step; and the bins that a feature is cut into to find splits.
TREES, DEPTH, STEP, BINS = 200, 4, 0.05, 128


class Boosted:
    """Boosted complete trees as arrays: squared loss, or with ``quantile`` the pinball loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, step: float = STEP, quantile: float | None = None):
        self.depth, inner, width = depth, (1 << depth) - 1, x.shape[1]
        self.feature, self.cut, self.leaf = np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        at = lambda v: float(np.mean(v)) if quantile is None else float(np.quantile(v, quantile))
        self.start = at(y)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # v <= cut goes left
        fit, rows = np.full(len(y), self.start), np.arange(len(y))
        for k in range(trees):
            pull = y - fit if quantile is None else np.where(y > fit, quantile, quantile - 1)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, size = (1 << level) - 1, 1 << level
                place = ((node - first)[:, None] * width + np.arange(width)) * BINS + bins
                total = np.bincount(place.ravel(), np.repeat(pull, width), size * width * BINS).reshape(size, width, BINS).cumsum(axis=2)
                count = np.bincount(place.ravel(), minlength=size * width * BINS).reshape(size, width, BINS).cumsum(axis=2)
                left, n, all_, m = total[..., :-1], count[..., :-1], total[..., -1:], count[..., -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n > 0) & (n < m), left**2 / n + (all_ - left) ** 2 / (m - n) - all_**2 / m, -1.0).reshape(size, -1)
                best = gain.argmax(axis=1)
                for j in np.flatnonzero(gain[np.arange(size), best] > 1e-12):
                    f, b = divmod(int(best[j]), BINS - 1)
                    if b < len(cuts[f]):
                        self.feature[k, first + j], self.cut[k, first + j] = f, cuts[f][b]
                node = 2 * node + 1 + (x[rows, self.feature[k, node]] > self.cut[k, node])
            node -= inner
            for j in np.unique(node):
                mine = node == j
                self.leaf[k, j] = step * at((y - fit)[mine])
            fit = fit + self.leaf[k, node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


@cache
def trained(n: int, trees: int) -> tuple[Boosted, Boosted, Boosted]:
    """The models of the next amount and of its tenth and ninetieth percentiles, trained once a process."""
    x, y = synthetic(n)
    return tuple(Boosted(x, y, trees, DEPTH, STEP, q) for q in (None, 0.10, 0.90))


class AmountModel:
    """Boosted trees for the next amount, with bounds from two models of its quantiles."""

    def __init__(self, spark, n: int = 2000, trees: int = TREES, models: tuple[Boosted, Boosted, Boosted] | None = None):
        self.models = models or trained(n, trees)
        self.shared = spark.sparkContext.broadcast(self.models)  # of fixed size

    def save(self, spark, path: str) -> None:
        """The models as one row of a table."""
        spark.createDataFrame([(bytearray(pickle.dumps([vars(m) for m in self.models])),)], "models binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> AmountModel:
        """The models of a table that :meth:`save` wrote; read tables of your own only."""
        models = []
        for state in pickle.loads(spark.read.parquet(path).first()[0]):  # noqa: S301
            models.append(Boosted.__new__(Boosted))
            vars(models[-1]).update(state)
        return cls(spark, models=tuple(models))

    def predict(self, histories: DataFrame) -> DataFrame:
        """``histories`` from :func:`features` to expected, lower_bound, upper_bound, confidence and method.

        Short histories and wide intervals fall back to the median.
        """
        shared = self.shared

        @F.pandas_udf("p double, low double, high double")
        def asked(*columns: pd.Series) -> pd.DataFrame:
            x = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
            return pd.DataFrame(dict(zip(("p", "low", "high"), (m.predict(x) for m in shared.value), strict=True)))

        df = histories.withColumn("asked", asked(*[F.col(c).cast("double") for c in FEATURES]))
        df = df.withColumns({"p": F.col("asked.p"), "low": F.least("asked.low", "asked.p"), "high": F.greatest("asked.high", "asked.p")})
        width = F.when(F.col("p") > 0, (F.col("high") - F.col("low")) / F.col("p")).otherwise(1.0)
        df = df.withColumn("sure", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - width)))
        ml = (F.col("n") >= LEAST_CHARGES) & (F.col("sure") >= LEAST_CONFIDENCE)
        spread = F.when(F.col("n") > 1, F.col("std")).otherwise(F.col("median") * 0.05) * 1.5
        return df.select(
            *[c for c in histories.columns if c not in FEATURES and c != "n"],
            F.round(F.when(ml, F.greatest("p", F.lit(0.01))).otherwise(F.col("median")), 2).alias("expected"),
            F.round(F.greatest(F.when(ml, F.col("low")).otherwise(F.col("median") - spread), F.lit(0.01)), 2).alias("lower_bound"),
            F.round(F.when(ml, F.col("high")).otherwise(F.col("median") + spread), 2).alias("upper_bound"),
            F.round(F.when(ml, F.col("sure")).otherwise(0.0), 3).alias("confidence"),
            F.when(ml, "ml").otherwise("median").alias("method"),
        )
