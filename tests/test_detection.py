import datetime as dt
import random

import pytest

from ledgerlight.operators import detection

CYCLES = [(5, 9, 7), (12, 16, 14), (28, 35, 30), (85, 95, 91), (350, 380, 365)]


def fit(days):
    shares = [(sum(a <= d <= b for d in days) / len(days), -k) for k, (a, b, _) in enumerate(CYCLES)] if days else [(0, 0)]
    return max(shares)[0]


def recurs(tier):
    dates = sorted(t[0] for t in tier)
    return len(tier) >= 2 and fit([(b - a).days for a, b in zip(dates, dates[1:])]) >= 0.6


def middle(xs):
    xs = sorted(xs)
    return (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2


def brute(txns):
    """Alerts of one service; txns: (date, seq, amount)."""
    out, txns = [], sorted(txns)
    for k in range(2, len(txns)):
        tiers = []
        for t in sorted(txns[:k], key=lambda t: (t[2], t[0], t[1])):
            if tiers and tiers[-1][0][2] > 0 and abs(t[2] - tiers[-1][0][2]) / tiers[-1][0][2] <= 0.3:
                tiers[-1].append(t)
            else:
                tiers.append([t])
        now = txns[k][2]
        same = next((x for x in tiers if x[0][2] > 0 and abs(now - x[0][2]) / x[0][2] <= 0.3), None)
        base = (same if recurs(same) else None) if same else max((x for x in tiers if recurs(x)), key=lambda x: middle(t[2] for t in x), default=None)
        if base:
            expected = round(middle(t[2] for t in sorted(base)[-6:]) + 1e-9, 2)
            diff = now - expected
            if diff >= 5 and expected and diff / expected >= 0.2 and 0.6 * min(1, diff / expected) + 0.4 * min(1, diff / max(expected, 1)) >= 0.4:
                out.append((txns[k][1], expected))
    return out


def test_alerts_against_brute_force(spark):
    rnd = random.Random(12)
    rows, want = [], []
    for s in range(60):
        day, step, base = dt.date(2024, 1, 1), rnd.choice([7, 14, 30]), rnd.choice([10, 50, 200])
        own = []
        for _ in range(rnd.randint(1, 14)):
            own.append((day, len(rows) + len(own), rnd.choice([base, base, base * 1.2, base * 2, base * 4, 0, -base]) * 1.0))
            day += dt.timedelta(days=rnd.choice([step, step, step + 1, 3, 0]))
        rows += [(f"s{s}", "general", str(q), q, a, d) for d, q, a in own]
        want += brute(own)
    df = spark.createDataFrame(rows, "service string, category string, transaction_id string, seq long, amount double, date date")
    got = [(r.seq, r.expected) for r in detection.alerts(df, ["service", "category"]).collect()]
    assert len(want) > 8 and sorted(got) == sorted(want)


def test_seasonal_baseline_and_leap_day(spark):
    rows = [("p", "utilities", f"{y}-{m}", y * 12 + m, a, dt.date(y, m, 28 if m == 2 else 29)) for y, m, a in [(2023, 1, 185.0), (2023, 2, 90.0), (2023, 3, 90.0), (2023, 4, 90.0), (2023, 12, 92.0), (2024, 1, 95.0)]]
    rows.append(("p", "utilities", "x", 99999, 400.0, dt.date(2024, 2, 29)))
    df = spark.createDataFrame(rows, "service string, category string, transaction_id string, seq long, amount double, date date")
    assert [r.transaction_id for r in detection.alerts(df, ["service", "category"]).collect()] == ["x"]


def test_reasons_and_scores(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(
        detection.reasons(F.lit(1.2), F.lit("telecom"), F.array(F.lit("roaming"), F.lit("late_fee"), F.lit("unknown"))).alias("a"),
        detection.reasons(F.lit(0.3), F.lit("news"), F.lit(None).cast("array<string>")).alias("b"),
        detection.severity(F.lit(0.65)).alias("c"), detection.severity(F.lit(0.3999)).alias("d"), detection.outlier_score(F.lit(59.0), F.lit(0.686), F.lit(86.0)).alias("e"),
    ).first()
    assert r.a == ["Possible unauthorized charge", "Roaming charges", "New device installment", "Plan add-on", "Late fee", "International roaming", "Late payment fee"]
    assert r.b[0] == "Plan upgrade" and len(r.b) == 5 and (r.c, r.d) == ("warning", "none") and r.e == pytest.approx(0.686, abs=1e-3)


def test_stream_equals_batch(spark, tmp_path):
    from ledgerlight.streaming import alerts

    rows = [("n", "general", str(k), k, 10.0 if k < 5 else 40.0, dt.date(2024, 1 + k, 1)) for k in range(6)]
    df = spark.createDataFrame(rows, "service string, category string, transaction_id string, seq long, amount double, date date")
    source = str(tmp_path / "in")
    found = []
    for part in ("seq < 4", "seq >= 4"):
        df.filter(part).write.mode("append").parquet(source)
        charges = spark.readStream.schema(df.schema).parquet(source)
        alerts.stream(charges, str(tmp_path / "history"), str(tmp_path / "alerts"), str(tmp_path / "checkpoint")).awaitTermination()
        found.append([r.transaction_id for r in spark.read.parquet(str(tmp_path / "alerts")).collect()])
    assert found == [[], ["5"]]
    # a batch that runs again replaces itself, and an id that returns raises no alert of an earlier batch
    again = spark.createDataFrame([("n", "general", "5", 9, 10.0, dt.date(2025, 1, 1))], df.schema)
    for _ in range(2):
        alerts.judge_batch(again, 2, str(tmp_path / "history"), str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 7
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1


def test_query_trains_the_whole_model(spark, monkeypatch, tmp_path):
    from ledgerlight.operators import prediction
    from ledgerlight.queries import ml_predict

    seen = []

    class Seen(Exception):
        pass

    def fit(self, x, y, trees, depth, step, quantile):
        seen.append((len(x), x.shape[1], trees, depth, step, quantile))
        if len(seen) == 3:
            raise Seen

    monkeypatch.setattr(prediction.Boosted, "__init__", fit)
    prediction.trained.cache_clear()
    with pytest.raises(Seen):
        ml_predict(spark, str(tmp_path))
    assert seen == [(2000, 14, 200, 4, 0.05, q) for q in (None, 0.10, 0.90)]
    prediction.trained.cache_clear()


def test_splits_against_all_splits():
    import numpy as np

    from ledgerlight.operators import prediction

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, (60, 3)).astype(float), rng.normal(size=60)
    for quantile in (None, 0.3):
        model = prediction.Boosted(x, y, 1, 1, 1.0, quantile)
        start = y.mean() if quantile is None else np.quantile(y, quantile)
        pull = y - start if quantile is None else np.where(y > start, quantile, quantile - 1)
        worth = lambda m: pull[m].sum() ** 2 / m.sum() + pull[~m].sum() ** 2 / (~m).sum()  # noqa: E731, B023
        best = max(worth(x[:, f] <= c) for f in range(3) for c in range(8) if 0 < (x[:, f] <= c).sum() < 60)
        left = x[:, model.feature[0, 0]] <= model.cut[0, 0]
        assert worth(left) == pytest.approx(best)
        at = np.mean if quantile is None else lambda v: np.quantile(v, quantile)  # noqa: B023
        assert model.predict(x) == pytest.approx(np.where(left, start + at((y - start)[left]), start + at((y - start)[~left])))


def test_model_on_histories_that_it_has_not_seen(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from ledgerlight.operators import prediction

    x, y = prediction.synthetic(seed=7)
    middle, low, high = (m.predict(x) for m in prediction.trained(2000, 200))
    assert np.mean(np.abs(middle - y)) < 0.75 * np.mean(np.abs(x[:, 2] - y))
    assert 0.05 < np.mean(y < low) < 0.2 and 0.05 < np.mean(y > high) < 0.2
    rng = np.random.default_rng(3)
    drawn = [prediction.history(rng, kind) for kind in prediction.KINDS for _ in range(8)]
    rows = [(k, n, float(a), dt.date(2024, 1, 1) + dt.timedelta(days=n), category, cycle, days) for k, (amounts, cycle, category, days) in enumerate(drawn) for n, a in enumerate(amounts[:-1])]
    df = spark.createDataFrame(rows, "k long, seq long, amount double, date date, category string, every int, since int")
    found = prediction.features(df, ["k", "category", "every", "since"], F.col("every"), F.col("since"))
    model = prediction.AmountModel(spark)
    model.save(spark, str(tmp_path / "model"))
    again = {r.k: r for r in prediction.AmountModel.load(spark, str(tmp_path / "model")).predict(found).collect()}
    for r in model.predict(found).collect():
        amounts, *rest = drawn[r.k]
        want = np.array([prediction.feature_row(amounts[:-1], *rest)])
        p, a, b = (float(m.predict(want)[0]) for m in model.models)
        sure = 1 - (max(b, p) - min(a, p)) / p
        assert r.method == ("ml" if sure >= 0.5 and len(amounts) > 3 else "median") and again[r.k] == r
        assert r.expected == pytest.approx(p if r.method == "ml" else float(np.median(amounts[:-1])), abs=0.011)


def test_long_service_in_one_pass(spark):
    import time

    from pyspark.sql import functions as F

    df = spark.range(100_000).select(
        F.lit("s").alias("service"), F.lit("general").alias("category"), F.col("id").cast("string").alias("transaction_id"), F.col("id").alias("seq"),
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100 + 1).alias("amount"), F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
    )
    start = time.perf_counter()
    assert detection.predictions(df, ["service", "category"]).count() >= 0 and time.perf_counter() - start < 60


def test_tiers_kept_up_equal_tiers_made_anew():
    rnd = random.Random(16)
    for _ in range(300):
        history, rows = detection.History(), []
        for k in range(rnd.randint(1, 40)):
            row = (k * rnd.choice([1, 30]), k, rnd.choice([0.0, -5.0, rnd.uniform(1, 9), rnd.uniform(1, 500), 10.0, 13.0]), str(k))
            rows.append(row)
            history.add(row)
            tiers = []
            for r in sorted((r for r in rows if r[2] > 0), key=lambda r: (r[2], r[1])):
                if tiers and (r[2] - tiers[-1][0]) / tiers[-1][0] <= 0.3:
                    tiers[-1][1].append(r[1])
                else:
                    tiers.append((r[2], [r[1]]))
            assert history.reps == [t[0] for t in tiers] and [t[0] for t in history.tiers] == [sorted(t[1]) for t in tiers]
            for t in history.tiers:
                days = [history.days[p] for p in t[0]]
                assert t[1] == [sum(low <= b - a <= high for a, b in zip(days, days[1:])) for low, high, _ in CYCLES]
