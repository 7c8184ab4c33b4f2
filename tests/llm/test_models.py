import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute

from ledgerlight.llm import language_id, language_model, suffix_dedup, tokens


def brute_clean(rows):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for i, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        kept = bytes(v for v, f in zip(b, mark) if not f)
        out.append((str(i), len(b), sum(mark), sum(mark[k] and not (k and mark[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2000, 3])
def test_repeated_strings(spark, crowd):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcd éf\n") for _ in range(n))
    base = text(600)
    rows = [(1, base), (2, text(90) + base[100:350] + text(50)), (3, base), (None, base), (4, None), (5, ""), (6, "ab" * 300), (7, "x" * 250), (8, base[:199]), (9, text(400)), (9, text(400)), (3, base)]
    rows += [(20 + k, text(220) + base[30 : 150 + 5 * k] + text(220)) for k in range(40)]
    rows += [(70, text(120000)), (71, "z" * 30000), (72, rows[-1][1] * 2)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, ctx string, spans int").repartition(4)
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in suffix_dedup.cleaned(df, crowd=crowd).collect())
    assert got == brute_clean(rows)
    assert suffix_dedup.cleaned(df.limit(0)).count() == 0


def test_language_model(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice("The cat sat on a mat É".split()) for _ in range(rnd.randint(0, 40)))) for k in range(120)] + [(None, "cat"), (500, None), (500, None), (501, "long " * 30000)]
    rows += [(1000 + k, " ".join(f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(rnd.randint(0, 30)))) for k in range(2500)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    model = brute.BloomScores([t for (_, t), h in zip(rows, held) if not h], len(rows))
    assert model.bits == 2
    want = sorted((str(i), h, model.total, *model.score(t)) for (i, t), h in zip(rows, held))
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, score string, words double").repartition(3)
    for size, bundle in ((1 << 30, 1), (10, 1 << 20), (10, 500)):
        got = sorted((str(r.doc_id), r.held_out, r.train_tokens, r.n_tokens, r.n_known, r.base_score, r.score) for r in language_model.scored(df, size, bundle).collect())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert language_model.scored(df.limit(0)).count() == 0


def bundles_of(texts, flags, most):
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "held_out": pa.array(flags, pa.bool_()), "text": pa.array(texts, pa.string())})
    return list(language_model._Bundles(most)([batch]))


def test_bundles_hold_every_token():
    rnd = random.Random(16)
    pieces = ["a", "É", "Ab", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "w1"]
    texts = [rnd.choice([None, "", " ", "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30)))]) for _ in range(2 * language_model.PIECE + 300)]
    for most in (1 << 20, 700, 1):
        got = []
        for row in bundles_of(texts, [False] * len(texts), most):
            bundle = language_model.Bundle(row.to_pylist()[0])
            got += zip(bundle.ids, np.split(bundle.one[bundle.word], np.cumsum(bundle.sizes)[:-1]), strict=True)
        assert [i for i, _ in got] == list(range(len(texts)))
        assert all(run.tolist() == language_model.tokens(text).tolist() for (_, run), text in zip(got, texts, strict=True))


def test_parts_are_probed_once_for_all_bundles(monkeypatch):
    """Work of a slice grows with its different n-grams, not with the bundles that ask for them."""
    import pyarrow as pa

    text, done = " ".join(f"w{k % 700}" for k in range(1000)), [0]
    monkeypatch.setattr(language_model, "mixed", lambda x, k=0, f=language_model.mixed: (done.append(np.size(x)), f(x, k))[1])
    work, read = [], []
    for copies in (1, 40):
        rows = bundles_of([text] * copies, [True] * copies, 1)
        asked = pa.Table.from_batches([r for row in rows for r in language_model._Ask(0)([row])])
        done.clear()
        answers = language_model._Answer(1, 0).answers(0, asked)
        work.append(sum(done))
        read.append(set(answers.column("pairs").to_pylist()))
    assert len(rows) == 40 and work[0] == work[1] > 0 and read[0] == read[1] and len(read[0]) == 1


def test_order_of_hashes():
    rnd = np.random.default_rng(17)
    for n, most, spare in ((0, 5, 0), (1, 5, 0), (2, 5, 0), (50000, 1 << 63, 0), (50000, 1000, 0), (100000, 1 << 40, 24), (3000, 1 << 30, 30), (200, 1 << 20, 40)):
        x = rnd.integers(0, most, n, dtype=np.uint64)
        order, out = language_model.ordered(x, spare)
        assert (out == np.sort(x)).all() and (x[order] == out).all() and (np.sort(order) == np.arange(n)).all()


def test_filter_reads_levels():
    import pyarrow as pa

    rnd = np.random.default_rng(9)
    keys, counts = np.unique(rnd.integers(0, 1 << 62, 5000, np.uint64)), None
    counts = rnd.zipf(1.6, len(keys)).clip(1, 1 << 20).astype(np.uint32)
    part = pa.table({"part": pa.array([0], pa.int32()), "kind": pa.array([1], pa.int32()), "hashes": [keys.tobytes()], "counts": [counts.tobytes()]})
    group = language_model.Group(63, language_model.model_part(part).to_pylist())
    assert (group.level(keys, 1) >= language_model.levels(counts)).all()
    assert (group.level(keys, 1) == language_model.levels(counts)).mean() > 0.97
    assert (group.level(rnd.integers(0, 1 << 62, 20000, np.uint64), 1) > 0).mean() < 0.03


def test_language_identification(spark):
    rnd = random.Random(10)
    alphabets = {"xx": "abcde", "yy": "efghij", "zz": "jklmna"}
    rows = [(k, "".join(rnd.choice(alphabets[lang] + " ") for _ in range(rnd.randint(30, 300))), lang) for k in range(300) for lang in [rnd.choice("xx yy zz".split())]]
    rows += [(1000, None, "xx"), (1001, "12 !?", "yy"), (1002, "", None), (None, "abcab", "xx"), (1003, "abc " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identified(df).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, t, lang in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identified(df.limit(0)).count() == 0


def test_language_against_brute_force(spark):
    rnd = random.Random(15)
    alphabets = {"xx": "abcdeé", "yy": "efghij", "zz": "jklmnaж", "ww": "abcdefghijklmn"}
    text = lambda letters: "".join(rnd.choice(letters + " 1½.") for _ in range(rnd.randint(1, 60)))
    rows = [(k, text(alphabets[lang]), lang) for k in range(140) for lang in [rnd.choice(sorted(alphabets))]]
    rows += [(200, "½ ² Ⅷ", "xx"), (201, None, "xx"), (202, "", "xx"), (203, "abc", None), (None, "abc", "xx"), (204, rows[0][1], rows[0][2]), (0, rows[0][1], "zz"), (205, "Ab " * 30000, None)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows]
    model = brute.Languages([(t, lang) for (_, t, lang), h in zip(rows, held) if not h and t is not None and lang is not None])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in language_id.identified(df).collect())
    want = sorted((str(i), h, *model.predict(t)) for (i, t, _), h in zip(rows, held))
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-6)
    assert ("200", held[140], "und", 0.0) in got


def test_every_language_is_learned(spark):
    rows = [(2000 * k + j, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} {chr(0x6E00 + (k * 7 + j) % 50)}", f"l{k:03d}") for k in range(300) for j in range(6)]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len({r.lang_pred for r in got}) > 290 and np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.95


def test_few_texts_among_many_rows_are_learned(spark):
    df = spark.range(60000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN concat('efgh hij ', chr(int(101 + id % 5))) ELSE concat('abcd ', conv(id, 10, 4)) END AS text", "CASE WHEN id % 3 > 0 THEN 'yy' ELSE 'xx' END AS lang")
    assert language_id.identified(df).filter("lang_pred <> CASE WHEN doc_id % 3 > 0 THEN 'yy' ELSE 'xx' END").count() == 0


def test_language_sample_counts_copies_once(spark):
    rnd = random.Random(12)
    word = lambda letters: "".join(rnd.choice(letters + " ") for _ in range(200))
    few, many = [word("efghij") for _ in range(10)], [word("abcd") for _ in range(100)]
    rows = [(k, few[k % 10] if k % 2 else many[k // 2 % 100], "yy" if k % 2 else "xx") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identified(df, sample=5).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")
def test_token_counts_equal_the_tokenizer(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(tokens.VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rnd = random.Random(11)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -rnd.randint(1, 64) / 8  # many ties, and sums that single precision holds
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    counts = tokens.Counts([(p.piece, p.score) for p in proto.pieces if p.type == 1], kept=50)
    whole = tokens.Counts([(p.piece, p.score) for p in proto.pieces if p.type == 1] + [("never\u2581here", -1000.0)])
    texts = ["".join(rnd.choice(["a", "th", "e ", "  ", "\n", "é", "😀", "ing ", "一", "x", "\t"]) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    for text in [*texts, "", " ", "word " * 500]:
        assert counts(text) == whole(text) == len(model.encode(text)), repr(text)
    assert counts("x" * 300000) > 0 and counts("一" * 1000) == len(model.encode("一" * 1000))
    df = spark.createDataFrame([(1, "the cat", 5), (2, None, 5), (None, "", 5), (1, "the cat", 6)], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(df, tokens.vocabulary()).collect())
    assert got[0] == got[1] and got[0][1] > 0 and got[2:] == [("2", 0), ("None", 0)]
    assert tokens.token_counts(df.limit(0), tokens.vocabulary()).count() == 0 and tokens.Counts([])("né") == 6
