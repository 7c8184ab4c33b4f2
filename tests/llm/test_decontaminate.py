import random

import numpy as np

from ledgerlight.llm import decontaminate as d


def brute_tiles(text, item, least):
    free_t, free_p, out = [x >= 0 for x in text], [x >= 0 for x in item], 0
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_p[p + n] and free_t[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, t)
        if best is None:
            return out
        n, p, t = best
        free_p[p : p + n] = free_t[t : t + n] = [False] * n
        out += n


def test_tiles_against_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 16))]
        text = [rnd.randrange(-1, 4) for _ in range(rnd.randint(1, 30))]
        found = d.tiles(np.array(text), np.array(item), 3)
        for p, t, n in found:
            assert n >= 3 and item[p : p + n] == text[t : t + n]
        assert sum(x[2] for x in found) == brute_tiles(text, item, 3)
        for at in (1, 2):
            used = [k for x in found for k in range(x[2 - at], x[2 - at] + x[2])]
            assert len(used) == len(set(used))


def test_planted_and_reordered(spark):
    rnd = random.Random(6)
    words = lambda n: [rnd.choice("kilo mega giga tera peta").strip() + str(rnd.randrange(900)) for _ in range(n)]
    item, other = words(40), words(40)
    moved = item[20:] + words(5) + item[:20]
    rows = [
        (1, " ".join(words(50) + item + words(30))), (2, " ".join(moved).upper().replace(" ", ", ")), (3, " ".join(words(200))), (4, " ".join(words(20) + item[:15] + words(9))),
        (5, None), (6, ""), (None, " ".join(other)), (7, " ".join(words(30000) + other)), (8, "yes no"), (9, "say yes no now"),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, ""), (5, "yes, NO!")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in d.contaminations(docs, bench).collect())
    assert got == [("1", 1), ("2", 1), ("7", 2), ("8", 5), ("9", 5), ("None", 2)]
    assert sorted((str(r.doc_id), r.item_id) for r in d.contaminations(docs, bench, chars=200).collect()) == got
    clean = d.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert d.decontaminated(docs, bench.limit(0)).count() == len(rows) and d.contaminations(docs.limit(0), bench).count() == 0
