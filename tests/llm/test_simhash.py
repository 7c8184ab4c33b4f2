import random

import numpy as np
import xxhash

from ledgerlight.llm import components, simhash


def test_over_radius_counts_exactly():
    rnd = np.random.default_rng(0)
    for radius in (0, 1, 3, 5, 12, 92):
        width = 1 if radius < 20 else 8
        base = rnd.integers(0, 2**63, (1, width), np.uint64)
        rows = np.repeat(base, 150, axis=0)
        for k in range(150):
            for b in rnd.integers(0, 64 * width, rnd.integers(0, 2 * radius + 3)):
                rows[k, b // 64] ^= np.uint64(1 << int(b % 64))
        exact = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2) <= radius
        assert (simhash.near(rows, simhash.bit_planes(rows), 150, radius) == exact).all()
        a, b = np.triu_indices(150, 1)
        assert (simhash.pairs_near(rows[a], rows[b], radius) == exact[a, b]).all()


def brute(rows):
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted((str(i), p, least.get(label[k])) for k, ((i, _), p) in enumerate(zip(rows, prints)))


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(2)
    base = [rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randint(0, 40)) for _ in range(400)]
    rows = [(None, "A b"), (7, None), (8, ""), (9, "one"), (9, "one"), (10, "ONE"), (11, "É é")]
    for k in range(60):
        words = list(base)
        for _ in range(k % 5):
            words[rnd.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), int.from_bytes(r.fp, "little"), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_blocks_lose_no_link(spark):
    rnd = np.random.default_rng(3)
    base = int(rnd.integers(0, 2**62))
    prints = sorted({base ^ sum(1 << int(b) for b in rnd.choice(64, 2, replace=False)) for _ in range(200)})
    parts = lambda links: sorted(sorted(bytes(r.node) for r in rows if bytes(r.root) == x) for rows in [components.components(links).collect()] for x in {bytes(r.root) for r in rows})
    rows = [(1, bytearray(p.to_bytes(8, "little")), p - (1 << 64) if p >> 63 else p) for p in prints]
    narrow = spark.createDataFrame(rows, "block long, fp binary, word long")
    want = parts(simhash.links(narrow.select("block", "fp"), 3, 1000))
    assert parts(simhash.links(narrow.select("block", "fp"), 3, 16)) == want
    assert parts(simhash.links(simhash.quartered(narrow, 16), 3, 16)) == want
    wide = rnd.integers(0, 2**63, (3, 8), np.uint64)[rnd.integers(0, 3, 200)]
    for r in wide:
        for b in rnd.integers(0, 512, 60):
            r[b // 64] ^= np.uint64(1 << int(b % 64))
    wide = spark.createDataFrame([(k % 2, bytearray(r.tobytes())) for k, r in enumerate(wide)] + [(7, bytearray(wide[0].tobytes()))], "block long, fp binary")
    want = parts(simhash.links(wide, 108, 1000))
    assert len(want) > 2 and parts(simhash.pivoted_links(wide, 108, 16)) == want == parts(simhash.pivoted_links(wide, 108))


def test_stage_keeps_one_row_of_each_group(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    base, lonely = text(300), text(80)
    near = base.split()
    near[40] = near[170] = "edited"
    rows = [(5, base, "x"), (3, " ".join(near), "y"), (9, base.upper(), "z"), (1, text(300), "w"), (2, text(30), None), (None, base, "n"), (6, None, "e"), (7, "", "e"), (7, "", "e")]
    rows += [(1, text(10), "one id, another text"), (8, lonely, "a"), (8, lonely, "b"), (8, lonely, "a"), (None, text(40), "null"), (3, base, "same id, near text")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    for given in (df, df.repartition(5)):
        out = simhash.deduplicated(given)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "6", "7", "7", "8", "None"]
        assert {r.gone for r in got if r.doc_id is None} == {"null"} and len({r.gone for r in got if r.doc_id == 8}) == 1
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_candidates_of_thousands_of_pairs():
    """Of pairs just above the similarity nearly all are proposed: they share a band and stand within the radius."""
    rnd = np.random.default_rng(6)
    stage = simhash._Fingerprint(5, simhash.STAGE_WIDTH, True)
    proposed = total = 0
    for n in (30, 100, 400, 1600):
        for _ in range(1000):
            shared = int(np.ceil(n * rnd.uniform(0.8, 0.82)))
            extra = rnd.integers(0, n - shared + 1)
            pool = rnd.integers(0, 2**64, n, np.uint64)
            a, b = np.unique(pool[: shared + extra]), np.unique(np.concatenate([pool[:shared], pool[shared + extra :]]))
            hashes, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
            assert simhash.similar(a, b)
            keys = stage.keys(hashes, sizes)
            fps = np.stack([simhash.majorities(simhash.remixed(hashes, k), sizes) for k in range(simhash.STAGE_WIDTH)], axis=1)
            proposed += (keys[0] == keys[1]).any() and np.bitwise_count(fps[0] ^ fps[1]).sum() <= simhash.STAGE_RADIUS
            total += 1
    assert total == 4000 and proposed / total > 0.99, proposed / total


def jaccard(a, b):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rnd, text, n):
    words = text.split()
    for k in rnd.sample(range(0, len(words), 5), n):
        words[k] = f"edit{rnd.randrange(10**6)}"
    return " ".join(words)


def test_stage_verdict_is_the_similarity(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = []
    for k in range(0, 40, 2):  # a line that repeats in one copy only
        base, line = text(300), text(14)
        rows += [(k, f"{base} {line}"), (k + 1, f"{base} {line}" + f" {line}" * 7)]
        assert jaccard(rows[-1][1], rows[-2][1]) > 0.9
    for k in range(100, 140, 2):  # distinct, but close
        base = text(300)
        rows += [(k, base), (k + 1, edited(rnd, base, 9))]
        assert 0.7 < jaccard(rows[-1][1], rows[-2][1]) < 0.78
    # over 24 in a block: copies, copies of a document that is close to them, and edits that are near to some only
    base = text(300)
    close = edited(rnd, base, 9)
    crowd = [(1000 + k, edited(rnd, (base, close)[k % 2], k % 7)) for k in range(80)]
    label = {k: k for k, _ in crowd}
    for k, a in crowd:
        for m, b in crowd:
            if label[k] != label[m] and jaccard(a, b) >= 0.8:
                low, high = sorted((label[k], label[m]))
                label = {n: low if x == high else x for n, x in label.items()}
    df = spark.createDataFrame(rows + crowd, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert kept == set(range(0, 40, 2)) | set(range(100, 140)) | set(label.values()) and len(set(label.values())) > 1
