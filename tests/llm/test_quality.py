import random

import xxhash
from pyspark.sql import functions as F

from ledgerlight.llm import quality


def brute(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "one", "a b c d e f g h " * 3, "x y z", "l # |\nl # |\n\nm", "é ü " * 30]
    texts += [" ".join(rnd.choice("ab cd ef".split()) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.base_counts(df, "text").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_ratio_against_brute_force(spark):
    import math
    import regex

    texts = {0: "good fine text here", 1: "bad!! junk!! text", 2: "good text", 3: None, 4: "good good fine"}
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (4, 1, 1), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    size = 64

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def pair(a, b):  # Spark hashes a row of two longs by seeding the second with the first's hash
        h = xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), 42)
        return signed(xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), h))

    def grams(t):
        h = [signed(xxhash.xxh64_intdigest(w, 42)) for w in regex.findall(quality.TOKENS, t or "")]
        return [x % size for x in h] + [pair(a, b) % size for a, b in zip(h, h[1:])]

    raw, good = [0] * size, [0] * size
    for i, t in texts.items():
        for g in grams(t):
            raw[g] += 1
            good[g] += i in (0, 2)
    p = [(r + 1) / (sum(raw) + size) for r in raw]
    w = [math.log((g + quality.PRIOR * q) / (sum(good) + quality.PRIOR) / q) for g, q in zip(good, p)]
    got = {r.doc_id: r for r in quality.score(docs, labels, buckets=size).collect()}
    for i, t in texts.items():
        g = grams(t)
        assert abs(got[i].llr - (sum(w[x] for x in g) / len(g) if g else 0)) < 1e-9
        assert got[i].base_failed and not got[i].kept


def test_filters_clashes_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(0, "word " * 5 + " ".join(map(str, range(40))), "x", 1), (0, None, "y", 2)], "doc_id long, text string, KEPT string, row int")
    out = quality.score(docs, labels)
    assert "KEPT" not in out.columns and out.filter("kept").count() == 1
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.score(docs, labels.limit(0)).filter(F.col("llr") != 0).count() == 0


def test_very_long_and_repeated_rows(spark):
    import brute

    rows = [(k, " ".join(f"w{(j * 7 + k) % 900}" for j in range(40 + k))) for k in range(40)]
    rows += [(100, "long words here " * 60000), (101, "x" * 300000), (3, rows[3][1]), (None, rows[4][1]), (102, "!! ## " * 50), (103, None)]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_words int, b_grams string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, labels).collect()
    want = brute.quality_kept([t for _, t in rows], [i is not None and i < 40 and i % 2 == 0 for i, _ in rows])
    assert sorted((str(r.doc_id), r.kept) for r in out) == sorted((str(i), k) for (i, _), k in zip(rows, want))
    assert {r.b_grams for r in out} == {"y"} and len(out) == len(rows)


def test_windows_that_nearly_repeat(spark):
    four, seven, eight = "a b c d", "a b c d e f g", "a b c d e f g h"
    texts = [f"{four} x {four}", f"{seven} x {seven} y", f"x {eight} y {eight}", f"{eight} {eight}", f"{eight} a", "a " * 9, "a " * 8, seven, four, f"{eight}\t{eight} \n {seven}"]
    rows = quality.base_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    assert {r.text: r.n_repeat_words for r in rows}[texts[2]] == 16


def test_cost_a_word(spark):
    """No pass hashes a word more than twice or looks up each character, and the weights are computed once and not copied into rows."""
    import re

    docs = spark.createDataFrame([(k, f"some words of text {k} " * 6) for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, labels).drop("text")
    assert len(out.collect()) == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "translate(" not in plan
    assert max(len(x.split(",")) for x in re.findall(r"xxhash64\(([^()]*)\)", plan)) <= 3  # two hashes and the seed
    assert not re.search(r"ubquery#\d+(, \[id=#\d+\])? AS ", plan)
    assert "ReusedSubquery" in plan
