from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerlight.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {n: mixing.WEIGHTS[k % 3] for k, n in enumerate(names)}
    target, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        level = rest / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > 3 * sizes[n]}
        if not over:
            return {**target, **{n: float(weight[n] * level) for n in free}}
        for n in over:
            target[n] = float(3 * sizes[n])
            rest -= 3 * sizes[n]
        free -= over
    return target


def rows_of(n):
    rows = [(k, " ".join(["w"] * (k * 7 % 50)), f"s{k % 5}") for k in range(n)]
    return rows + [(None, "a b c", None), (1, "a b", None), (1, "a b", None), (5, None, "s1"), (6, " ", "empty"), (7, "a b c d", "tiny"), (8, "x " * 4000, "Big")]


def test_targets_and_taken(spark):
    df = spark.createDataFrame(rows_of(300), "doc_id long, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in rows_of(300):
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    out, parts = mixing.mixed(df, block=64, carry=True)
    rows = out.select("row.source", "size", "taken", "target", "source_size").collect()
    assert len(rows) == len(rows_of(300))
    got = defaultdict(int)
    for r in rows:
        got[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    assert all(want[s] - 1 <= got[s] <= want[s] for s in sizes)
    # blocks do not overlap: a word is taken once an epoch
    assert parts.groupBy("sid", "start", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"), F.max("to_word").alias("m")).filter("n > m").count() == 0
    again, _ = mixing.mixed(df.repartition(3), block=64, carry=True)
    assert sorted(map(str, again.select("row.doc_id", "taken").collect())) == sorted(map(str, out.select("row.doc_id", "taken").collect()))


def test_schedule_spreads_sources(spark):
    per = mixing.targets(spark.createDataFrame([("a", 60000), ("b", 60000), ("c", 60000)], "source string, size long"))
    slots = [r.sid for r in mixing.schedule(per, 100).orderBy("slot").collect()]
    for n in range(100, len(slots), 100):
        assert all(abs(slots[:n].count(sid) - n * w / 6) <= 3 for sid, w in ((1, 1), (2, 2), (3, 3)))


def test_stage_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "k", 4)], "doc_id long, text string, source string, start string, Taken int")
    out = mixing.mix_stage(df)
    assert out.columns == ["doc_id", "text", "source", "start", "size", "source_size", "target", "taken"] and out.first().taken == 3
    assert mixing.mix_stage(df.limit(0)).count() == 0
