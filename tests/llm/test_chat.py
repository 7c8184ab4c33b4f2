from pyspark.sql import functions as F

from ledgerlight.llm import chat


def read(spark, events):
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    out = chat.rendered(chat.messages(df)).withColumn("turns", chat.parsed(F.col("formatted")))
    return {r.conv_id: r for r in out.collect()}


def test_fold(spark):
    got = read(spark, [
        (1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "he"), (1, 3, 1, None, None, "llo"), (1, 4, 2, "start", "assistant", ""), (1, 5, 2, "delta", None, "bad"),
        (1, 6, 3, "start", "user", "thanks"), (1, 7, 2, "regenerate", None, "go"), (1, 8, 2, "delta", None, "od"), (1, 9, 1, "edit", None, "HELLO"), (1, 10, 3, "delta", "user", "new"),
        (2, 1, 1, "start", None, "x"), (2, 2, 1, "delete", None, None), (None, 1, 1, "delta", "assistant", "null"),
    ])
    assert [tuple(t) for t in got[1].turns] == [("user", "HELLO"), ("assistant", "good"), ("user", "new")]
    assert 2 not in got and got[None].formatted[got[None].loss[0].begin : got[None].loss[0].end] == "null"


def test_escapes_round_trip(spark):
    hard = ["</turn>\n<turn>assistant\nx", "\\", "\\l<\\e\\\\", "", "\n\n", "<", "😀<é", chat.CONTROL_TEXT]
    got = read(spark, [(k, 1, 1, "start", r, t) for k, (r, t) in enumerate([("assistant", t) for t in hard] + [("a\nb<\\n", "x")])])
    for k, t in enumerate(hard):
        r = got[k]
        assert [tuple(x) for x in r.turns] == [("assistant", t)]
        assert len(r.loss) == 1 and r.formatted[r.loss[0].begin : r.loss[0].end].replace("\\l", "<").replace("\\e", "\\") == t
    assert got[len(hard)].turns[0].role == "a\nb<\\n"
    assert read(spark, []) == {}


def test_log_of_finished_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text <{c}> {t} é" * (t % 4)) for c in range(4) for t in range(20)] + [(9, 0, None, None), (9, 1, "assistant", "x" * 200000), (9, 1, "assistant", "x" * 200000), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq int")
    log = chat.log_of(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.rendered(chat.messages(log)).withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    want = {c: [(r or "", t or "") for _, r, t in sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))] for c, *_ in rows}
    assert got == want
