"""Unusual charges: amount tiers, billing cycles, expected amounts and scores.

A service's charges meet in one partition, ordered by date and input order, and
each charge from the third on is judged against those before it.  One shuffle,
on the service key; one pass over the charges in Arrow batches keeps the tiers
of a service up and hands on a short baseline for each charge; all else is
expressions.  Each step is a column of its own, since an expression inside a
lambda runs once for each element.

Rounding is half up.  A 29 February compares with 28 February a year before.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import fixed
from ledgerlight.functions.plan import fenced, quoted
from ledgerlight.functions.text import normalized

TOLERANCE = 0.30
#: Charges that make a pattern, and the share of gaps that have to fit its cycle.
LEAST, FIT = 2, 0.60
SEASON_DAYS = 30


def rules(spark) -> DataFrame:
    """The fourteen category rules."""
    return spark.createDataFrame(fixed.RULES, "category string, least_diff double, least_pct double, lookback int, seasonal boolean, split_tiers boolean, extra_checks array<string>")


def severity(score: Column) -> Column:
    return reduce(lambda out, band: out.when(score >= band[0], band[1]), fixed.SEVERITIES, F).otherwise("none")


def outlier_score(diff: Column, pct: Column, expected: Column) -> Column:
    return F.least(F.lit(1.0), pct) * 0.60 + F.least(F.lit(1.0), diff / F.greatest(expected, F.lit(1.0))) * 0.40


def universal_thresholds(expected: Column) -> tuple[Column, Column]:
    pick = lambda k: reduce(lambda out, row: out.when(expected < row[0], row[k]), fixed.UNIVERSAL[:-1], F).otherwise(fixed.UNIVERSAL[-1][k])
    return pick(1), pick(2)


def reasons(pct: Column, category: Column, checks: Column) -> Column:
    """What may explain an increase: by category, a doubled amount first, extra checks last."""
    own = F.create_map(*[x for k, v in fixed.CATEGORY_REASONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    labels = F.create_map(*[F.lit(x) for pair in fixed.CHECK_REASONS.items() for x in pair])
    base = F.coalesce(F.try_element_at(own, category), F.array(*map(F.lit, fixed.OTHER_REASONS)))
    more = F.filter(F.transform(F.coalesce(checks, F.array().cast("array<string>")), lambda c: F.try_element_at(labels, c)), lambda x: x.isNotNull())
    first = F.when(pct >= 1.0, F.array(F.lit(fixed.DOUBLED_REASON))).otherwise(F.array().cast("array<string>"))
    return F.concat(first, base, F.array_except(more, base))


def cents(value: Column) -> Column:
    """Half up; the first step takes off what binary fractions add or lack, so that every engine sees the same half."""
    return F.round(F.round(value, 4), 2)


def median(sorted_values: Column) -> Column:
    """Of an array in order."""
    n = F.size(sorted_values)
    low, high = F.get(sorted_values, F.floor((n - 1) / 2).cast("int")), F.get(sorted_values, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, high).otherwise((low + high) / 2)


def sorted_by(txns: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Each key's charges (keys, date, seq, amount, id and the other columns) in order in one partition; charges without date or amount are none."""
    rest = [c for c in txns.columns if c not in (*keys, "date", "seq", "amount", "transaction_id", "id")]
    df = txns.filter(F.col("date").isNotNull() & F.col("amount").isNotNull())
    df = df.select(*keys, "date", F.col("seq").cast("bigint").alias("seq"), F.col("amount").cast("double").alias("amount"), F.col("transaction_id").cast("string").alias("id"), *rest)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


class _Tier:
    """A column of tiers for rows in order of key and amount.  All that is kept is the key and the least amount of the open tier."""

    def __init__(self, keys: int, positive_only: bool):
        self.keys, self.positive_only = keys, positive_only

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tier, rep = None, 0, 0.0
        for batch in batches:
            out = []
            for *now, amount in zip(*(batch.column(k).to_pylist() for k in range(self.keys)), batch.column("amount").to_pylist(), strict=True):
                opened = rep > 0 if self.positive_only else rep != 0
                if now != key:
                    key, tier, rep = now, 0, amount
                elif not (opened and abs(amount - rep) / rep <= TOLERANCE):
                    tier, rep = tier + 1, amount
                out.append(tier)
            yield batch.append_column("tier", pa.array(out, pa.int32()))


def tiered(txns: DataFrame, keys: list[str], positive_only: bool = True) -> DataFrame:
    """The charges (keys, date, seq, amount, id) with their tier in order of amount, from 0.

    A charge joins the tier before it if it is within the tolerance of the
    tier's least amount.  With ``positive_only`` a charge of no positive amount
    is a tier of its own; else only a zero is, and a negative least amount takes
    all that follow.
    """
    df = sorted_by(txns, keys, "amount", "date", "seq", "id").select(*keys, "date", "seq", "amount", "id")
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema) + ", tier int"
    return df.mapInArrow(_Tier(len(keys), positive_only), schema)


class History:
    """The charges of one service so far, in tiers that are kept up charge by charge.

    Tiers are disjoint ranges of positive amounts, so the highest median is that
    of the last one.  A charge that is not in reach of the tier below it opens a
    tier, which may take over charges of the next ones; the rest stays as it is.
    """

    def __init__(self):
        self.rows: list[tuple] = []  # (day, seq, amount, id)
        self.days: list[int] = []
        self.reps: list[float] = []
        self.tiers: list[list] = []  # [places in rows, gaps that fit each cycle]

    def reach(self, amount: float, rep: float) -> bool:
        return abs(amount - rep) / rep <= TOLERANCE

    def grow(self, tier: list, place: int) -> None:
        if tier[0]:
            gap = self.days[place] - self.days[tier[0][-1]]
            for k, (_, low, high, _) in enumerate(fixed.CYCLES):
                tier[1][k] += low <= gap <= high
        tier[0].append(place)

    def add(self, row: tuple) -> None:
        place, amount = len(self.rows), row[2]
        self.rows.append(row)
        self.days.append(row[0])
        if amount <= 0:
            return
        k = bisect.bisect_right(self.reps, amount) - 1
        if k >= 0 and self.reach(amount, self.reps[k]):
            self.grow(self.tiers[k], place)
            return
        pool, reps, tiers, j = [place], [], [], k + 1
        while pool:
            rep = min(self.rows[p][2] for p in pool)
            while j < len(self.reps) and self.reach(self.reps[j], rep):
                pool += self.tiers[j][0]
                j += 1
            mine: list = [[], [0] * len(fixed.CYCLES)]
            rest = []
            for p in sorted(pool):
                if self.reach(self.rows[p][2], rep):
                    self.grow(mine, p)
                else:
                    rest.append(p)
            reps.append(rep)
            tiers.append(mine)
            pool = rest
        self.reps[k + 1 : j], self.tiers[k + 1 : j] = reps, tiers

    def recurs(self, tier: list) -> bool:
        n = len(tier[0])
        return n >= LEAST and max(tier[1]) / (n - 1) >= FIT

    def baseline(self, amount: float, lookback: int) -> list[tuple] | None:
        """The last charges of the tier in reach, if that recurs; without one, of the highest tier that does."""
        k = max(0, bisect.bisect_left(self.reps, amount / (1 + TOLERANCE)) - 1)
        while k < len(self.reps) and self.reps[k] <= amount / (1 - TOLERANCE) * 1.001:
            if self.reach(amount, self.reps[k]):
                return self.last(self.tiers[k], lookback) if self.recurs(self.tiers[k]) else None
            k += 1
        return next((self.last(t, lookback) for t in reversed(self.tiers) if self.recurs(t)), None)

    def last(self, tier: list, lookback: int) -> list[tuple]:
        return [self.rows[p] for p in tier[0][-lookback:]]

    def season(self, year_ago: int, base: list[tuple]) -> list[tuple]:
        """Charges around a day that are not in the baseline."""
        seen = {r[3] for r in base}
        low, high = bisect.bisect_left(self.days, year_ago - SEASON_DAYS), bisect.bisect_right(self.days, year_ago + SEASON_DAYS)
        return [r for r in self.rows[low:high] if r[3] is not None and r[3] not in seen]


class _Baselines:
    """Rows in order of key, date and seq with ``base``, the charges to compare each with; rows without one are left out."""

    def __init__(self, keys: int):
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, history = None, History()
        for batch in batches:
            names = ("days", "seq", "amount", "id", "lookback", "seasonal", "year_ago")
            values = zip(*(batch.column(k).to_pylist() for k in range(self.keys)), *(batch.column(c).to_pylist() for c in names), strict=True)
            places, bases = [], []
            for n, (*now, day, seq, amount, id_, lookback, seasonal, year_ago) in enumerate(values):
                if now != key:
                    key, history = now, History()
                base = history.baseline(amount, lookback) if len(history.rows) >= LEAST else None
                if base is not None:
                    places.append(n)
                    bases.append(base + history.season(year_ago, base) if seasonal else base)
                history.add((day, seq, amount, id_))
            flat = [r for b in bases for r in b]
            columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
            items = pa.StructArray.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.string()))], ["days", "seq", "amount", "id"])
            offsets = pa.array([0, *itertools.accumulate(map(len, bases))], pa.int32())
            yield batch.take(pa.array(places, pa.int64())).append_column("base", pa.ListArray.from_arrays(offsets, items))


def gaps(dates: Column) -> Column:
    """Days between successive dates of an array in order."""
    return F.transform(F.slice(dates, 2, F.greatest(F.size(dates) - 1, F.lit(0))), lambda d, i: F.datediff(d, F.get(dates, i)))


def cycle_fit(days: Column) -> Column:
    """struct(fit, nominal days) of the cycle that most gaps fit; the earlier of equals; none: 0 and 30."""
    share = lambda low, high: F.size(F.filter(days, lambda d: d.between(low, high))) / F.size(days)
    rated = F.array(*[F.struct(share(low, high).alias("fit"), F.lit(-k).alias("rank"), F.lit(nominal).alias("days")) for k, (_, low, high, nominal) in enumerate(fixed.CYCLES)])
    best = F.array_max(rated)
    return F.when((F.size(days) > 0) & (best["fit"] > 0), F.struct(best["fit"].alias("fit"), best["days"].alias("days"))).otherwise(F.struct(F.lit(0.0).alias("fit"), F.lit(30).alias("days")))


def charges(txns: DataFrame, keys: list[str]) -> DataFrame:
    """All charges of a service in one row, by date and input order."""
    item = F.struct(F.col("date"), F.col("seq").cast("bigint").alias("seq"), F.col("amount").cast("double").alias("amount"), F.col("transaction_id").cast("string").alias("id"))
    return txns.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))


def predictions(txns: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each charge that has a baseline: keys, the charge, and expected, lower, upper, cycle_days.

    ``txns``: keys (one of them ``category``), date, seq, amount, transaction_id.
    Every service is passed once, in order; a charge's baseline is at most the
    lookback and, for seasonal categories, the charges around the same day of
    the year before.
    """
    df = txns.join(F.broadcast(rules(txns.sparkSession).withColumnRenamed("category", "rule")), F.col("category") == F.col("rule"), "left").drop("rule")
    df = df.fillna({"least_diff": 5.0, "least_pct": 0.20, "lookback": 6, "seasonal": False})
    epoch = F.lit("1970-01-01").cast("date")
    df = df.select(
        *keys, "date", "seq", "amount", "transaction_id", "lookback", "seasonal", "least_diff", "least_pct", "extra_checks",
        F.datediff("date", epoch).alias("days"), F.datediff(F.add_months("date", -12), epoch).alias("year_ago"),
    )
    df = sorted_by(df, keys, "date", "seq", "amount", "id")
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema) + ", base array<struct<days:int,seq:bigint,amount:double,id:string>>"
    df = df.mapInArrow(_Baselines(len(keys)), schema)
    base = F.transform("base", lambda t: F.struct(F.date_add(epoch, t["days"]).alias("date"), t["seq"].alias("seq"), t["amount"].alias("amount"), t["id"].alias("id")))
    now = F.struct("date", "seq", "amount", "id").alias("now")
    df = df.select(*keys, now, base.alias("base"), "least_diff", "least_pct", "extra_checks")
    df = df.withColumn("middle", median(F.array_sort(F.transform("base", lambda t: t["amount"])))).withColumn("days", gaps(F.array_sort(F.transform("base", lambda t: t["date"]))))
    return fenced(df, "middle", "days").select(
        *keys, "now", "base", "least_diff", "least_pct", "extra_checks",
        cents(F.col("middle")).alias("expected"), cents(F.col("middle") * 0.90).alias("lower_bound"), cents(F.col("middle") * 1.10).alias("upper_bound"),
        cycle_fit(F.col("days"))["days"].alias("cycle_days"),
    )


def judged(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """The charges that rise over their expectation by both thresholds of their category, with score, severity and reasons."""
    df = predicted.withColumn("actual", F.col("now.amount")).withColumn("diff", F.col("actual") - F.col("expected"))
    df = df.filter((F.col("diff") > 0) & (F.col("expected") != 0)).withColumn("pct", F.col("diff") / F.col("expected"))
    df = df.filter((F.col("diff") >= F.col("least_diff")) & (F.col("pct") >= F.col("least_pct")))
    df = df.withColumn("score", outlier_score(F.col("diff"), F.col("pct"), F.col("expected")))
    return df.select(
        *keys, F.col("now.id").alias("transaction_id"), F.col("now.date").alias("date"), F.col("now.seq").alias("seq"), "expected",
        F.round("actual", 2).alias("actual"), F.round("diff", 2).alias("difference"), F.round(F.col("pct") * 100, 1).alias("percentage_change"),
        F.round("score", 3).alias("outlier_score"), severity(F.col("score")).alias("severity"),
        reasons(F.col("pct"), F.col("category"), F.col("extra_checks")).alias("possible_reasons"), "lower_bound", "upper_bound", "cycle_days",
    )


def alerts(txns: DataFrame, keys: list[str]) -> DataFrame:
    """Judged charges whose severity is not none."""
    return judged(predictions(txns, keys), keys).filter("severity <> 'none'")


def by_severity(found: DataFrame, *then: str) -> DataFrame:
    """High before warning before low, then as asked for."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return found.orderBy(rank, *then)


def recurring_patterns(txns: DataFrame, keys: list[str]) -> DataFrame:
    """Patterns of each key: tier (order of amount), charges, cycle_days and confidence."""
    tier = Window.partitionBy(*keys, "tier")
    df = tiered(txns, keys, positive_only=False)
    df = df.withColumn("gap", F.datediff("date", F.lag("date").over(tier.orderBy("date", "seq", "amount", "id")))).withColumn("middle", F.median("amount").over(tier))
    fits = [F.count_if(F.col("gap").between(low, high)).alias(f"c{k}") for k, (_, low, high, _) in enumerate(fixed.CYCLES)]
    df = df.groupBy(*keys, "tier").agg(
        F.count("*").alias("charges"), F.count("gap").alias("gaps"), F.first("middle").alias("middle"), *fits,
        F.avg(F.abs(F.col("amount") - F.col("middle")) / F.nullif(F.col("middle"), F.lit(0.0))).alias("spread"),
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"c{k}").alias("n"), F.lit(-k).alias("rank"), F.lit(days).alias("days")) for k, (*_, days) in enumerate(fixed.CYCLES)]))
    df = df.withColumn("best", best).withColumn("fit", F.col("best.n") / F.col("gaps")).filter((F.col("charges") >= LEAST) & (F.col("fit") >= FIT))
    steady = F.when(F.col("middle") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("spread")))
    confidence = F.col("fit") * 0.45 + steady * 0.35 + F.least(F.lit(1.0), F.col("charges") / 6) * 0.20
    return df.select(*keys, "tier", "charges", F.col("best.days").alias("cycle_days"), F.round(confidence, 3).alias("confidence"))


def recurring(txns: DataFrame) -> DataFrame:
    """Patterns of charges (merchant_raw, date, seq, amount, transaction_id) by the normalized name of their payee."""
    return recurring_patterns(txns.withColumn("merchant", normalized(F.col("merchant_raw"))), ["merchant"])
