import random

import brute

import corpus_pipeline


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(13)
    vocabulary = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))
    rows = {k: prose(120) for k in range(200)}
    item = prose(30)
    junk = lambda: " ".join(rnd.choice(vocabulary).upper() + "!!" for _ in range(120))
    rows |= {k: junk() for k in range(300, 360)}
    rows |= {400: rows[5], 401: rows[5].replace(rows[5].split()[60], "changed", 1), 402: prose(60) + " " + item + " " + prose(60), 403: prose(100) + " call +1 (212) 555-0199", 407: "!" + rows[9][:500] + " 31/12/2024 and 4532015112830366", 408: prose(80) + " " + " ".join(item.split()[15:]) + " other " + " ".join(item.split()[:15]) + " " + prose(9), 404: "too short", 405: None, 406: "a b c d e f g h " * 20}
    spark.createDataFrame([(k, t, "xx", f"s{k % 3}", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 300), 0) for k in rows if k % 2 == 0 and k < 400], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[n] = {r.doc_id: r for r in docs.collect()}
        assert n == 4 or docs.columns == columns
    assert not any(k in kept[0] for k in (404, 405, 406, *range(300, 360))) and set(range(200)) <= set(kept[0])
    assert {400, 401} <= set(kept[0]) - set(kept[1]) and set(kept[1]) - set(kept[2]) == {402, 408}
    assert set(kept[3]) == set(kept[2]) and "555-0199" not in kept[3][403].text and kept[3][7].text == rows[7]
    # each stage against a plain version of it, on what the plain versions before it kept
    trusted = [k % 2 == 0 and k < 300 for k in rows]
    left = [(k, t) for (k, t), good in zip(rows.items(), brute.quality_kept(list(rows.values()), trusted)) if good]
    assert {k for k, _ in left} == set(kept[0])
    left = brute.near_copies(left)
    assert {k for k, _ in left} == set(kept[1])
    left = [(k, t) for k, t in left if not brute.holds(t, item)]
    assert {k for k, _ in left} == set(kept[2])
    left = [(k, brute.pseudonymised(t)[0]) for k, t in left]
    assert dict(left) == {k: r.text for k, r in kept[3].items()}
    taken = brute.mixed([(k, t, f"s{k % 3}") for k, t in left])
    assert {k: n for k, n in taken.items() if n} == {k: r.taken for k, r in kept[4].items()}
    total = sum(len(r.text.split()) for r in kept[3].values())
    assert abs(sum(r.taken for r in kept[4].values()) - total) <= 3 and all(0 < r.taken <= 3 * r.size for r in kept[4].values())
    whole = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: r.taken for k, r in kept[4].items()}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
