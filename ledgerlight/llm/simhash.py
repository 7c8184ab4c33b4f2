r"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is 1 where over half of the shingle hashes have it.  Equal
fingerprints are collapsed first; the rest are dealt to blocks that any two
fingerprints within the radius must share (or, for wide fingerprints, almost
surely share), and within a block the fingerprints stand as bit planes: 64
comparisons a machine word, their distances kept in carry-save vertical
counters, and a block is left as soon as every comparison exceeds the radius.
A block hands on a spanning forest of its links, which has the same components.
A block of more than ``chunk`` fingerprints is parted by further bits (narrow
ones) or linked to one of its fingerprints first (wide ones); what is left of it
is compared as pairs of chunks, so that no task holds a block of unbounded size
and no link is lost.

Defined results: null and blank texts have the fingerprint zero and are linked
like any other; a null doc_id keeps its row and never names a component unless
all of it are null (then the component is null); repeated rows stay repeated;
texts of any length are read whole, a few at a time; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common
from ledgerlight.llm.components import components

SHINGLE = 3
RADIUS = 3
#: Widths of the parts of a 64-bit fingerprint; with 3 differing bits at least 2 of 5 parts are equal.
PARTS = (13, 13, 13, 13, 12)
#: Fingerprints that one block compares at once.
CHUNK = 2048
#: The stage: words in a shingle, fingerprint words of 64 bits, and differing bits of a candidate.  A Jaccard
#: similarity of 0.8 is a cosine of 0.889, at which 15.1 % of the bits differ, 78 of 512 with a deviation of 8;
#: the radius stands almost four deviations above, and candidates are held to the similarity itself.
STAGE_SHINGLE, STAGE_WIDTH, STAGE_RADIUS, SIMILAR = 5, 8, 108, 0.8
#: Bands of minima that deal wide fingerprints to blocks: at 0.8 all but 1 of 30,000 pairs share one.
BANDS, ROWS = 20, 4

#: Every fourth bit.
QUARTER = 0x1111111111111111

#: Byte to eight byte lanes, one for each bit.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the ASCII-lower-cased words, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of hashes; the 0-th is the hash itself."""
    if not k:
        return hashes
    x = (hashes + np.uint64(MIX * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint word for each run of hashes; empty runs give zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    parts = -(-sizes // 255)  # byte lanes hold 255 at most
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(full), 64), np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(LANES[octets[:, k]], begin).view(np.uint8).reshape(-1, 8)
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def over_radius(planes, radius: int, shape: tuple[int, ...]) -> tuple[np.ndarray, bool]:
    """Lanes (bits of words) whose count of set planes exceeds the radius, and whether all do.

    ``planes`` gives words with one comparison a bit.  Pairs of planes enter the
    vertical counters through a full adder; the counters start so that the
    radius is their largest value, and what is carried out of them sticks.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(shape, full if start >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros(shape, np.uint64)
    held = None
    for n, plane in enumerate(planes):
        if held is None:
            held = plane
            continue
        low = counter[0]
        either = held ^ plane
        carry = (held & plane) | (low & either)
        counter[0] = low ^ either
        held = None
        for k in range(1, width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if n % 16 == 15 and n > radius and (over == full).all():
            return over, True
    if held is not None:
        carry = held
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
    return over, bool((over == full).all())


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """Fingerprints (n, words) to planes (64 * words, ceil(n / 64)); the padding repeats nothing and is all ones."""
    n, pad = len(rows), -len(rows) % 64
    bits = np.unpackbits(rows.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.ones((pad, bits.shape[1]), np.uint8)]) if pad else bits
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Boolean (queries, n): which rows stand within the radius."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = np.unpackbits(queries.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").astype(bool)
    over, left = over_radius((planes[p][None, :] ^ np.where(bits[:, p], full, np.uint64(0))[:, None] for p in range(len(planes))), radius, (len(queries), planes.shape[1]))
    if left:
        return np.zeros((len(queries), n), bool)
    return ~np.unpackbits(over.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def forest(rows: np.ndarray, other: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what the links within ``rows`` (or between it and ``other``) connect, as positions in both."""
    target = rows if other is None else other
    shift = 0 if other is None else len(rows)
    label = np.arange(len(rows) + (0 if other is None else len(other)))
    planes = bit_planes(target)
    for at in range(0, len(rows), 64):
        hits = near(rows[at : at + 64], planes, len(target), radius)
        for q in np.flatnonzero(hits.any(axis=1)):
            found = np.flatnonzero(hits[q]) + shift
            mine = label[at + q]
            if (label[found] == mine).all():
                continue
            labels, first = np.unique(label[found], return_index=True)
            merged = np.isin(label, labels)
            for other_label, k in zip(labels, first, strict=True):
                if other_label != mine:
                    yield int(at + q), int(found[k])
            label[merged] = mine


def pairs_near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the aligned pairs stand within the radius; the planes are those of their differences."""
    planes = bit_planes(a ^ b)
    over, _ = over_radius(iter(planes), radius, (planes.shape[1],))
    return ~np.unpackbits(over.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


class _Fingerprint:
    """doc_id, text, h (in Arrow batches) to doc_id, fp and, with bands, the keys of the blocks and h; bands count each shingle once."""

    def __init__(self, shingle: int, width: int, bands: bool):
        self.shingle, self.width, self.bands = shingle, width, bands

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # whole texts, a few at a time
                part = batch.slice(at, 256)
                runs = [shingle_hashes(t, self.shingle) for t in part.column("text").to_pylist()]
                runs = list(map(np.unique, runs)) if self.bands else runs
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                hashes = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
                fps = np.stack([majorities(remixed(hashes, k), sizes) for k in range(self.width)], axis=1)
                columns = [part.column("doc_id"), pa.array([f.tobytes() for f in fps], pa.binary())]
                if self.bands:
                    columns += [pa.array(list(self.keys(hashes, sizes)), pa.list_(pa.int64())), part.column("h")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "keys", "h"][: len(columns)])

    def keys(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), BANDS), np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            begin = (np.cumsum(sizes) - sizes)[full]
            for band in range(BANDS):
                key = np.full(len(full), band + 1, np.uint64)
                for r in range(ROWS):
                    key = remixed(key ^ np.minimum.reduceat(remixed(hashes, 101 + band * ROWS + r), begin), 1)
                out[full, band] = key
        return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, width: int = 1, bands: bool = False) -> DataFrame:
    """``doc_id``, ``fp`` (little-endian bytes) and, with ``bands``, ``keys`` and ``h`` (of the text); kept in the shared folder."""
    schema = "doc_id bigint, fp binary" + ", keys array<bigint>, h bigint" * bands
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = narrow.withColumn("h", F.xxhash64("text")) if bands else narrow
    return common.checkpoint(narrow.mapInArrow(_Fingerprint(shingle, width, bands), schema))


def parts_of(word: Column) -> Column:
    """For each pair of parts the key of the block of fingerprints that agree on both."""
    keys, low = [], 0
    parts = []
    for width in PARTS:
        parts.append(F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1)))
        low += width
    for i in range(len(PARTS)):
        for j in range(i):
            keys.append(F.shiftleft(F.lit(i * 8 + j).cast("bigint"), 40).bitwiseOR(F.shiftleft(parts[i], 13)).bitwiseOR(parts[j]))
    return F.array(*keys)


class _Links:
    """Rows (block, i, j, side, fp) sorted by block, i, j to the links of each block."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[bytes, int]] = []
        key = None
        waiting: list[list[bytes]] = []
        held = 0
        for batch in batches:
            block, i, j, side, fp = (batch.column(k).to_pylist() for k in range(5))
            for n in range(batch.num_rows):
                now = (block[n], i[n], j[n])
                if now != key:
                    if group:
                        held += self.close(group, waiting)
                    if len(group) > 24 or held > 50_000:
                        yield from self.out(group, waiting, held > 50_000)
                        held = 0 if held > 50_000 else held
                    group, key = [], now
                group.append((fp[n], side[n]))
        if group:
            self.close(group, waiting)
        yield from self.out(group, waiting, True)

    def close(self, group, waiting) -> int:
        """Keeps a small block for later, with others; the number of its pairs."""
        if 1 < len(group) <= 24:
            waiting.append([f for f, _ in group])
            return len(group) * (len(group) - 1) // 2
        return 0

    def words(self, fps: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)

    def out(self, group, waiting, flush: bool) -> Iterator[pa.RecordBatch]:
        links = []
        if len(group) > 24:
            own, other = [f for f, s in group if not s], [f for f, s in group if s]
            both = own + other
            if own:
                links += [(both[a], both[b]) for a, b in forest(self.words(own), self.words(other) if other else None, self.radius)]
        if flush and waiting:
            a = [g[x] for g in waiting for x in range(len(g)) for _ in range(x)]
            b = [g[y] for g in waiting for x in range(len(g)) for y in range(x)]
            links += [(a[k], b[k]) for k in np.flatnonzero(pairs_near(self.words(a), self.words(b), self.radius))]
            waiting.clear()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], ["a", "b"])


def dealt(blocks: DataFrame, chunk: int) -> DataFrame:
    """``blocks(block, fp, ...)`` as pairs of chunks: block, i, j, side and the rest, sorted; blocks of one row are left out."""
    rest = [c for c in blocks.columns if c != "block"]
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    df = blocks.join(sizes, "block").withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    other = F.sequence(F.lit(0), F.col("c") - 1)
    df = df.select("block", *rest, "own", F.explode_outer(other).alias("other"))
    df = df.select("block", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), (F.col("own") < F.col("other")).cast("int").alias("side"), *rest)
    return df.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "fp")


def links(blocks: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """``blocks(block, fp)`` of distinct rows to links ``(a, b)`` that connect what all pairs within the radius in a block connect."""
    return dealt(blocks, chunk).mapInArrow(_Links(radius), "a binary, b binary").distinct()


def large(blocks: DataFrame, chunk: int) -> DataFrame:
    """The blocks of more than ``chunk`` rows, with their least fingerprint: few, as a block of that size has that many rows."""
    return common.checkpoint(blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).filter(F.col("n") > chunk).select(F.col("block").alias("l_block"), "pivot"))


def quartered(blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``blocks(block, fp, word)`` with the large ones parted: of four interleaved quarters of the bits, 3 differing ones leave one equal."""
    df = blocks.join(common.small(large(blocks, chunk)), F.col("block") == F.col("l_block"), "left")
    parts = [F.xxhash64("block", F.lit(k), F.col("word").bitwiseAND(F.lit(QUARTER << k if k < 3 else (QUARTER << 3) - (1 << 64)))) for k in range(4)]
    return df.select("fp", F.explode_outer(F.when(F.col("l_block").isNull(), F.array("block")).otherwise(F.array(*parts))).alias("block")).distinct()


class _NearPivot:
    """Rows (block, fp, pivot) with ``near``: whether the fingerprint stands within the radius of the pivot of its block."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("fp", "pivot"))
                yield batch.append_column("near", pa.array(pairs_near(a, b, self.radius)))


def pivoted_links(blocks: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """As :func:`links`, with a pass before it that links the rows of a large block to its least fingerprint.

    What stands within the radius of that needs no comparison with each other;
    the rest of the block is compared with all of it.
    """
    big = common.small(large(blocks, chunk))
    df = blocks.join(big, F.col("block") == F.col("l_block")).select("block", "fp", "pivot")
    df = common.checkpoint(df.mapInArrow(_NearPivot(radius), "block bigint, fp binary, pivot binary, near boolean"))
    small = blocks.join(big, F.col("block") == F.col("l_block"), "left_anti").select("block", "fp")
    found = dealt(small, chunk).unionByName(dealt_apart(df.select("block", "fp", "near"), chunk)).mapInArrow(_Links(radius), "a binary, b binary")
    return found.union(df.filter("near AND fp <> pivot").select("fp", "pivot")).distinct()


def dealt_apart(rows: DataFrame, chunk: int) -> DataFrame:
    """As :func:`dealt` for ``rows(block, fp, near)``, without the pairs of chunks whose rows are all near to their pivot."""
    sizes = rows.groupBy("block").agg(F.count_if(~F.col("near")).alias("far"), F.count_if("near").alias("close")).filter("far > 0")
    df = rows.join(sizes, "block").withColumn("c", F.ceil(F.col("far") / chunk).cast("int")).withColumn("d", F.ceil(F.col("close") / chunk).cast("int"))
    slot = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    df = df.withColumn("own", F.when(F.col("near"), F.col("c") + slot(F.col("d"))).otherwise(slot(F.col("c"))))
    df = df.select("block", "fp", "own", F.explode_outer(F.sequence(F.lit(0), F.when(F.col("near"), F.col("c")).otherwise(F.col("c") + F.col("d")) - 1)).alias("other"))
    df = df.select("block", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), (F.col("own") < F.col("other")).cast("int").alias("side"), "fp")
    return df.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "fp")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets (sorted arrays) is at least SIMILAR."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, STAGE_SHINGLE))


class _Similar:
    """Rows (a, b, text_a, text_b) to the pairs (a, b) whose texts are similar."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text_a"), batch.column("text_b"), strict=True)
            good = [similar(shingle_set(x.as_py()), shingle_set(y.as_py())) for x, y in texts]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


class _SimilarLinks:
    """Rows (block, i, j, side, fp, label, text) sorted by block, i, j, side to similar pairs of unlike labels, as many as connect them all."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[:3] != key:
                    yield from self.close(group)
                    group, key = [], row[:3]
                group.append((*row[3:6], shingle_set(row[6])))
        yield from self.close(group)

    def close(self, group: list[tuple[int, bytes, bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own = sum(not g[0] for g in group)
        if own and len({g[2] for g in group}) > 1:
            words = np.frombuffer(b"".join(g[1] for g in group), np.uint64).reshape(len(group), -1)
            shift = own if own < len(group) else 0
            label = np.unique([g[2].hex() for g in group], return_inverse=True)[1]
            planes, found = bit_planes(words[shift:]), []
            for at in range(0, own, 64):
                hits = near(words[at : min(at + 64, own)], planes, len(group) - shift, self.radius)
                for q in range(len(hits)):
                    for k in np.flatnonzero(hits[q]) + shift:
                        if label[k] != label[at + q] and similar(group[at + q][3], group[k][3]):
                            label[label == label[k]] = label[at + q]
                            found.append((group[at + q][1], group[k][1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def confirmed(docs: DataFrame, prints: DataFrame, blocks: DataFrame, found: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect what all similar pairs among the candidates connect.

    ``found`` connects the candidates within the radius.  Each candidate's text
    is first compared with that of the least of its component: where all are
    similar, as among near copies, and in components of two, that decides.  The
    other components are compared in their blocks once more, pair by pair with
    their texts, less those pairs that are connected already.
    """
    roots = components(found)
    stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    wanted = prints.join(roots.select(F.col("node").alias("fp")), "fp").groupBy("fp").agg(F.min("h").alias("h"))
    wanted = common.checkpoint(wanted)
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.join(common.small(wanted.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    texts = common.checkpoint(wanted.join(texts, "h").select("fp", "text"))
    of = lambda s: texts.select(F.col("fp").alias(s), F.col("text").alias(f"text_{s}"))
    good = common.checkpoint(stars.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_Similar(), "a binary, b binary"))
    sizes = stars.groupBy("b").agg(F.count("*").alias("n")).join(good.groupBy("b").agg(F.count("*").alias("good")), "b", "left")
    open_roots = sizes.filter((F.col("n") > 1) & (F.coalesce("good", F.lit(0)) < F.col("n"))).select(F.col("b").alias("root"))
    rest = roots.join(open_roots, "root").join(good.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left")
    rest = common.checkpoint(rest.select(F.col("node").alias("fp"), F.coalesce("label", "node").alias("label")).join(texts, "fp"))
    again = dealt(blocks.join(rest, "fp").select("block", "fp", "label", "text"), chunk).select("block", "i", "j", "side", "fp", "label", "text")
    return good.union(again.mapInArrow(_SimilarLinks(radius), "a binary, b binary"))


def component_ids(prints: DataFrame, found: DataFrame, name: Column | None = None) -> DataFrame:
    """``prints`` with component_id: the least ``name`` (the doc_id) reachable over the links."""
    roots = components(found)
    least = prints.groupBy("fp").agg(F.min(F.col("doc_id") if name is None else name).alias("least"))
    rooted = common.checkpoint(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # a component is known by the least name of all its fingerprints; written first, so that
    # the join reads two exchanges and a large component can be split over tasks
    named = common.checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fp and component_id, exact for radii up to 3."""
    if radius > 3:
        raise ValueError("five parts hold two equal ones up to 3 differing bits")
    prints = fingerprints(docs, shingle)
    distinct = prints.select("fp").distinct()
    word = F.conv(F.hex(reversed_bytes("fp")), 16, -10).cast("bigint")
    blocks = distinct.select("fp", word.alias("word")).select("fp", "word", F.explode_outer(parts_of(F.col("word"))).alias("block"))
    return component_ids(prints, links(quartered(blocks), radius))


def reversed_bytes(name: str) -> Column:
    return F.concat(*[F.substring(name, 8 - k, 1) for k in range(8)])


def deduplicated(docs: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """The documents less those that have a near copy before them in their group: one row of each group stays.

    A group is a component of the pairs whose sets of five-word shingles have a
    Jaccard similarity of at least 0.8.  Minima and fingerprints of 512 bits
    over the same sets propose the pairs; equal fingerprints are equal sets, as
    at a similarity of 0.8 all 512 bits agree less than once in 10^30 pairs.

    Rows are judged, not ids: of a group the row of the least doc_id stays, rows
    without one after all others, of equal ids that whose text has the least
    hash, and of rows that repeat id and text the one whose other columns have
    the least hash.  Rows of one id whose texts are unlike thus all stay.  Blank
    and null texts are copies of nothing and stay, however often they repeat.
    """
    body = docs.filter(F.size(common.words(F.col("text"))) > 0)
    prints = fingerprints(body, STAGE_SHINGLE, STAGE_WIDTH, bands=True)
    blocks = prints.groupBy("fp").agg(F.first("keys").alias("keys")).select("fp", F.explode_outer("keys").alias("block"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("h"))
    grouped = component_ids(prints.select("doc_id", "h", "fp"), confirmed(body, prints, blocks, pivoted_links(blocks, radius), radius), place)
    rows = grouped.groupBy("doc_id", "h").agg(F.count("*").alias("n"), (F.first("component_id") != F.first(place)).alias("gone"))
    # only what goes or repeats is joined; of the rest no text moves
    verdicts = common.small(common.checkpoint(rows.filter("gone OR n > 1").select(F.col("doc_id").alias("v_id"), F.col("h").alias("v_h"), "gone")))
    columns = [c for c, t in docs.dtypes if "map<" not in t]
    df = common.packed(docs, doc_id=F.col("doc_id").cast("bigint"), h=F.xxhash64(F.col("text").cast("string")), other=F.xxhash64(*map(common.quoted, columns)))
    df = df.join(verdicts, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("h") == F.col("v_h")), "left")
    repeated = df.filter("NOT gone").groupBy("doc_id", "h").agg(F.min_by("row", "other").alias("row"))
    return common.unpacked(df.filter("gone IS NULL").select("row").union(repeated.select("row")), docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents, at 3 or fewer differing bits."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex(reversed_bytes("fp"))).alias("fingerprint"), "component_id")
