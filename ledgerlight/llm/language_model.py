r"""Language-model scores from a log-frequency Bloom filter.

A training pass counts words, and pairs of neighbours, over the whole training
part of the corpus.  A count c is stored as its level 1 + floor(log_1.5 c): the
filter holds (n-gram, j) for every j up to the level, so that a count is read
by membership probes for j = 1, 2, ... until one fails.  The filter has a part
for each range of n-gram hashes, each with bits for its own entries, so it
grows with the corpus, while a part stays as it is.  Where the texts are so
short that the model can't exceed ``GROUP_BYTES``, it is broadcast and probed
where they are.  Else documents are gathered in bundles, which send their
distinct n-grams with their counts to slices of a few parts, once.  The task of
a slice makes its parts, probes each of the n-grams in them once for all
bundles, and what was read goes back to the bundles, which are scored.  Both
ways make the same filter and the same scores.

The score of a token after another is that of a Dirichlet-smoothed pair over a
smoothed word, all counts read from the filter; the base score takes exact word
counts.  Words are ASCII-lower-cased runs ``[^\x20\x09-\x0D]+``, and each text
ends with one end token.

Defined results: null and empty texts are one end token; a null doc_id counts
as training; repeated rows are counted and scored row by row; with no training
document every probability is 1 / (V + 1) = 1; texts of any length are read
whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common

ALPHA = 0.1
#: Pseudo-observations of the word distribution in the distribution after a word.
MU = 20.0
#: Base of the levels.
LOG_BASE = 1.5
#: Bits of the filter for an entry, and probes of a membership test: about one test in a hundred is wrongly positive.
ENTRY_BITS, PROBES = 10, 6
#: Documents for a part of the filter, on average, and parts that a task merges.
PART_DOCS, TASK_PARTS = 1024, 4
#: Bytes of model up to which it is broadcast; each Python worker holds a copy.
GROUP_BYTES = 384 << 20
#: Bytes of model for a token at most: an exact count, and two entries at most, since no level is above its count.
TOKEN_BYTES = 20
#: Tokens of a bundle, as long as no single text has more.
BUNDLE = 1 << 21
#: Documents that are split into words together.
PIECE = 1024
#: Tokens that a worker gathers before it sorts and hands on.
GATHER = 1 << 21
MASK = (1 << 64) - 1
#: Hashes of the end and of the start of a text; no word holds a space.
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")


def mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & MASK)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, then of the end."""
    words = text.encode().lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pairs(run: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Hash of each token with the one before it."""
    if before is None:
        before = np.concatenate([np.array([START], np.uint64), run[:-1]])
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + run, 7)


def counted(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes, kind="stable")
    hashes, weights = hashes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(weights, first) if len(first) else weights


class _Count:
    """Training texts to rows (part, kind, hashes, counts); kind 0 is words, 1 pairs."""

    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = [], 0
        for batch in batches:
            for text in batch.column("text"):
                runs.append(tokens(text.as_py()))
                held += len(runs[-1])
                if held >= GATHER:
                    yield self.rows(runs)
                    runs, held = [], 0
        if runs:
            yield self.rows(runs)

    def rows(self, runs: list[np.ndarray]) -> pa.RecordBatch:
        out = ([], [], [], [])
        for kind, hashes in enumerate((np.concatenate(runs), np.concatenate([pairs(r) for r in runs]))):
            keys, counts = counted(hashes)
            cuts = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
            for part in range(1 << self.bits):
                low, high = cuts[part], cuts[part + 1]
                if high > low:
                    for column, value in zip(out, (part, kind, keys[low:high].tobytes(), counts[low:high].astype(np.uint32).tobytes()), strict=True):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "kind", "hashes", "counts"])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts.astype(np.float64)) / math.log(LOG_BASE) + 1e-9).astype(np.int64)


#: The count that a level stands for: the middle of its range.
LEVEL_COUNT = np.concatenate([[0.0], [(math.ceil(LOG_BASE**k - 1e-9) + math.ceil(LOG_BASE ** (k + 1) - 1e-9) - 1) / 2 for k in range(255)]])


def probes(items: np.ndarray, sizes) -> Iterator[np.ndarray]:
    """The bits of a membership test."""
    step = mixed(items, 3) | np.uint64(1)
    for i in range(PROBES):
        yield ((items + np.uint64(i) * step) >> np.uint64(32)) * sizes >> np.uint64(32)


#: What a level adds to the hash of an entry.
ENTRY_LEVEL = mixed(np.arange(256, dtype=np.uint64), 13)


def gram_items(hashes: np.ndarray, kind: int) -> np.ndarray:
    return mixed(hashes ^ np.uint64(0x5851F42D4C957F2D * (kind + 1) & MASK), 11)


def entries(hashes: np.ndarray, kind: int, level) -> np.ndarray:
    return gram_items(hashes, kind) + ENTRY_LEVEL[level]


def model_part(table: pa.Table) -> pa.Table:
    """The rows of a part to one: exact word counts, and the bits of the filter."""
    both = []
    for kind in (0, 1):
        rows = [(h, c) for k, h, c in zip(table.column("kind").to_pylist(), table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True) if k == kind]
        hashes = np.frombuffer(b"".join(h for h, _ in rows), np.uint64)
        both.append(counted(hashes, np.frombuffer(b"".join(c for _, c in rows), np.uint32).astype(np.uint64)))
    steps = [(kind, h, levels(c)) for kind, (h, c) in enumerate(both)]
    size = max(64, ENTRY_BITS * sum(int(q.sum()) for *_, q in steps))
    bits = np.zeros(-(-size // 8), np.uint8)
    for kind, hashes, top in steps:
        for j in range(1, int(top.max(initial=0)) + 1):
            for bit in probes(entries(hashes[top >= j], kind, j), np.uint64(size)):
                np.bitwise_or.at(bits, (bit >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)))
    (words, counts), _ = both
    return pa.table(
        {
            "part": table.column("part")[:1].cast(pa.int32()),
            "size": pa.array([size], pa.int64()),
            "words": pa.array([words.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "bits": pa.array([bits.tobytes()], pa.binary()),
            "total": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([len(words)], pa.int64()),
        }
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part to the model of each part; one is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        for rows in (batch.slice(a, b - a) for a, b in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)])):
            if held and held[-1].column("part")[0] != rows.column("part")[0]:
                yield from model_part(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(rows)
    if held:
        yield from model_part(pa.Table.from_batches(held)).to_batches()


class Group:
    """Parts of the model that are in memory together, of a contiguous range of part numbers."""

    def __init__(self, shift: int, rows):
        rows = sorted(rows, key=lambda r: r["part"])
        self.shift, self.first = shift, rows[0]["part"] if rows else 0
        spread = rows[-1]["part"] - self.first + 1 if rows else 1
        self.offset = np.full(spread, -1, np.int64)  # bytes
        self.size = np.ones(spread, np.uint64)
        words, counts, bits, at = [], [], [], 0
        for row in rows:
            k = row["part"] - self.first
            self.offset[k], self.size[k] = at, row["size"]
            at += len(row["bits"])
            words.append(bytes(row["words"]))
            counts.append(bytes(row["counts"]))
            bits.append(bytes(row["bits"]))
        self.words, self.counts = np.frombuffer(b"".join(words), np.uint64), np.frombuffer(b"".join(counts), np.uint64)
        self.bits = np.frombuffer(b"".join(bits), np.uint8)

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], np.uint64(0))

    def level(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        """Levels read by repeated probes; 0 for what the group doesn't hold."""
        out = np.zeros(len(hashes), np.uint8)
        part = (hashes >> np.uint64(self.shift)).astype(np.int64) - self.first
        inside = (part >= 0) & (part < len(self.offset))
        part[~inside] = 0
        active = np.flatnonzero(inside & (self.offset[part] >= 0))
        for j in range(1, 255):
            if not len(active):
                break
            items, base, size = entries(hashes[active], kind, j), self.offset[part[active]], self.size[part[active]]
            yes = np.ones(len(active), bool)
            for bit in probes(items, size):
                yes &= (self.bits[base + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            active = active[yes]
            out[active] = j
        return out


class Scores:
    """Scores from what was read of each token: exact counts and levels of words, levels of pairs, and the level of the ends."""

    def __init__(self, total: int, types: int):
        self.total, self.below = total, total + ALPHA * (types + 1)

    def columns(self, sizes: np.ndarray, exact: np.ndarray, own: np.ndarray, pair: np.ndarray, ends: int) -> list[pa.Array]:
        begin = np.cumsum(sizes) - sizes
        base = np.log10((exact.astype(np.float64) + ALPHA) / self.below)
        count = LEVEL_COUNT[own]
        single = (count + ALPHA) / self.below
        # the count before a text's first token is that of its starts, which is that of the ends
        context = np.concatenate([[LEVEL_COUNT[ends]], count[:-1]]) if len(count) else count
        context[begin] = LEVEL_COUNT[ends]
        both = np.minimum(LEVEL_COUNT[pair], context)
        scores = np.log10((both + MU * single) / (context + MU))
        add = lambda x: np.add.reduceat(x, begin) if len(begin) else x
        known = add((exact > 0).astype(np.int64))
        return [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), self.total), pa.int64()), pa.array(add(base), pa.float64()), pa.array(add(scores), pa.float64())]


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


class _Local:
    """Documents scored by a model that each worker holds."""

    def __init__(self, group, scores: Scores):
        self.group, self.scores = group, scores

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = self.group.value
        ends = int(group.level(np.array([END], np.uint64), 0)[0])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                runs = [tokens(t.as_py()) for t in part.column("text")]
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                one, back = np.unique(np.concatenate(runs), return_inverse=True)
                two, pair_back = np.unique(np.concatenate([pairs(r) for r in runs]), return_inverse=True)
                columns = self.scores.columns(sizes, group.exact(one)[back], group.level(one, 0)[back], group.level(two, 1)[pair_back], ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *columns], RESULT)


def ordered(x: np.ndarray, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts hashes whose first ``spare`` bits are the same, and the sorted hashes.

    Plain numbers sort several times as fast as positions do, so the positions
    take the last bits of what is sorted.  The hashes that are then mixed up
    with others of the same first bits are sorted afterwards.
    """
    bits = np.uint64(max(1, (len(x) - 1).bit_length()))
    last = (np.uint64(1) << bits) - np.uint64(1)
    keys = (x << np.uint64(spare) >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    keys.sort()
    order = (keys & last).astype(np.int64)
    out = x[order]
    mixed_up = np.flatnonzero(out[1:] < out[:-1])
    if len(mixed_up) > 64:
        order = np.argsort(x)
        return order, x[order]
    for at in mixed_up:
        low, high = np.searchsorted(keys, keys[at] & ~last), np.searchsorted(keys, keys[at] | last, "right")
        order[low:high] = order[low:high][np.argsort(out[low:high])]
        out[low:high] = np.sort(out[low:high])
    return order, out


def firsts(x: np.ndarray) -> np.ndarray:
    """Which of sorted numbers are the first of their kind."""
    return np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, and how many each text has."""
    # a copy, since ascii_lower misreads strings whose first offset isn't zero, as those of a slice that was cast
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    true = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(true.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return words.filter(true), np.diff(upto[ends], prepend=0)


def narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest takes; that number of bytes comes first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return out.view("<u8").ravel()


class Bundle:
    """Documents that are scored together: their ids, flags and sizes, the hashes of their words and which word each token is."""

    SCHEMA = "bundle bigint, ids array<bigint>, flags array<boolean>, sizes array<bigint>, words binary, tokens binary, total bigint"

    def __init__(self, row: dict):
        self.ids, self.flags, self.sizes = row["ids"], row["flags"], np.array(row["sizes"], np.int64)
        n, words = int(self.sizes.sum()), np.frombuffer(row["words"], np.uint64)
        planes = np.frombuffer(pa.decompress(row["tokens"], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
        number = np.ascontiguousarray(planes.T).view("<u4").ravel()
        #: distinct word hashes in order, and where among them each token is
        self.one, back = np.unique(words, return_inverse=True)
        self.word = back[number]
        run, begin = words[number], np.cumsum(self.sizes) - self.sizes
        #: the hash of each token's pair
        self.pairs = pairs(run)
        self.pairs[begin] = pairs(run[begin], np.array([START], np.uint64))

    @staticmethod
    def row(ids: list, flags: list, words: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
        """sizes: without the ends."""
        coded = pa.concat_arrays(words).cast(pa.large_binary()).dictionary_encode()
        hashes = [END, *map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())]
        lengths = np.concatenate(sizes) + 1
        tokens = np.zeros(int(lengths.sum()), "<u4")
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(lengths) - 1] = False
        tokens[inner] = coded.indices.to_numpy() + 1
        planes = np.stack([tokens >> 8 * k & 255 for k in range(4)]).astype(np.uint8)
        number = int.from_bytes(os.urandom(8), "little", signed=True)
        columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([lengths.tolist()], pa.list_(pa.int64()))]
        columns += [pa.array([np.array(hashes, np.uint64).tobytes()], pa.binary()), pa.array([pa.compress(planes.tobytes(), "zstd", asbytes=True)], pa.binary())]
        columns += [pa.array([int(lengths[~np.array(flags, bool)].sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["bundle", "ids", "flags", "sizes", "words", "tokens", "total"])

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the training documents have each word; distinct pairs in order, and how often they have each. 0: in others only."""
        held = np.repeat(np.array(self.flags, bool), self.sizes)
        two, count = counted(self.pairs)
        others, less = counted(self.pairs[held])
        count[np.searchsorted(two, others)] -= less
        return np.bincount(self.word, ~held, len(self.one)).astype(np.uint64), two, count.astype(np.uint64)

    def pair(self) -> np.ndarray:
        """Where among the distinct pairs that of each token is."""
        order, found = ordered(self.pairs)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(firsts(found)) - 1
        return out


class _Bundles:
    """Documents to bundles of about so many tokens, each under a random number."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, words, sizes, held = [], [], [], [], 0
        for batch in batches:
            for part in (batch.slice(at, PIECE) for at in range(0, batch.num_rows, PIECE)):
                found, size = text_words(part.column("text"))
                doc_ids, held_out = part.column("doc_id").to_pylist(), part.column("held_out").to_pylist()
                done = 0
                while done < len(size):
                    upto = np.cumsum(size[done:] + 1)
                    take = min(int(np.searchsorted(upto, self.most - held)) + 1, len(upto))
                    ids += doc_ids[done : done + take]
                    flags += held_out[done : done + take]
                    used, first = int(size[done : done + take].sum()), int(size[:done].sum())
                    words.append(found.slice(first, used))
                    sizes.append(size[done : done + take])
                    held, done = held + used + take, done + take
                    if held >= self.most:
                        yield Bundle.row(ids, flags, words, sizes)
                        ids, flags, words, sizes, held = [], [], [], [], 0
        if ids:
            yield Bundle.row(ids, flags, words, sizes)


class _Ask:
    """Bundles to rows (slice, bundle, words, pairs, counts): hashes of the slice as steps in their order, counts of words, then of pairs."""

    def __init__(self, slice_bits: int):
        self.low = np.array([k << (64 - slice_bits) for k in range(1 << slice_bits)], np.uint64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield self.rows(row["bundle"], Bundle(row))

    def rows(self, number: int, bundle: Bundle) -> pa.RecordBatch:
        times, two, pair_times = bundle.counts()
        kinds = [(h, c, np.append(np.searchsorted(h, self.low), len(h))) for h, c in ((bundle.one, times), (two, pair_times))]
        out = ([], [], [], [])
        for k, low in enumerate(self.low):
            some = [(h[at[k] : at[k + 1]], c[at[k] : at[k + 1]]) for h, c, at in kinds]
            if len(some[0][0]) or len(some[1][0]):
                steps = [narrow(np.diff(h, prepend=low)) for h, _ in some]
                for column, value in zip(out, (k, *steps, narrow(np.concatenate([c for _, c in some]))), strict=True):
                    column.append(value)
        columns = [pa.array(out[0], pa.int32()), pa.array([number] * len(out[0]), pa.int64()), *[pa.array(c, pa.binary()) for c in out[1:]]]
        return pa.RecordBatch.from_arrays(columns, ["slice", "bundle", "words", "pairs", "counts"])


class _Answer:
    """The parts of a slice, made from all that bundles have of it, and what they read of each bundle's n-grams: (bundle, slice, words, pairs, exact, types).

    Of an n-gram the levels up to that of its count are in the filter, so only
    those above are probed for, once for all bundles.
    """

    SCHEMA = "bundle bigint, slice int, words binary, pairs binary, exact binary, types bigint"

    def __init__(self, bits: int, slice_bits: int):
        self.bits, self.slice_bits = bits, slice_bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            numbers = batch.column("slice").to_numpy()
            for number in np.unique(numbers).tolist():
                slices.setdefault(number, []).append(batch.filter(pa.array(numbers == number)))
        for number in list(slices):
            yield from self.answers(number, pa.Table.from_batches(slices.pop(number))).to_batches()

    def answers(self, number: int, asked: pa.Table) -> pa.Table:
        low = np.uint64(number << (64 - self.slice_bits))
        hashes = [[np.cumsum(widened(x.as_py())) + low for x in asked.column(c)] for c in ("words", "pairs")]
        lengths = [np.array(list(map(len, runs))) for runs in hashes]
        counts = [np.split(widened(x.as_py()), [n]) for x, n in zip(asked.column("counts"), lengths[0].tolist(), strict=True)]
        kinds = []
        for kind, runs in enumerate(hashes):
            both = np.concatenate(runs)
            order, both = ordered(both, self.slice_bits)
            fresh = firsts(both)
            back = np.empty(len(both), np.int64)
            back[order] = np.cumsum(fresh) - 1
            count = np.concatenate([c[kind] for c in counts])[order]
            kinds.append((both[fresh], np.add.reduceat(count, np.flatnonzero(fresh)) if len(both) else count, back))
        words, exact, back = kinds[0]
        cut = lambda kind, values: [x.tobytes() for x in np.split(values[kinds[kind][2]], np.cumsum(lengths[kind])[:-1])]
        read = self.levels(number, [(h, c) for h, c, _ in kinds])
        columns = [asked.column("bundle"), asked.column("slice").cast(pa.int32())]
        columns += [pa.array([zlib.compress(x, 1) for x in cut(kind, read[kind])], pa.binary()) for kind in (0, 1)]
        columns += [pa.array([narrow(x) for x in np.split(exact[back], np.cumsum(lengths[0])[:-1])], pa.binary())]
        columns += [pa.array([int((exact > 0).sum())] + [0] * (asked.num_rows - 1), pa.int64())]
        return pa.table(columns, ["bundle", "slice", "words", "pairs", "exact", "types"])

    def levels(self, number: int, kinds: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Levels of words and of pairs as the filter of their parts gives them; a bit of it is a byte here."""
        parts = 1 << (self.bits - self.slice_bits)
        grams = []
        for kind, (hashes, counts) in enumerate(kinds):
            top = np.zeros(len(hashes), np.uint8)
            top[counts > 0] = levels(counts[counts > 0])
            grams.append(((hashes >> np.uint64(64 - self.bits)).astype(np.int64) - number * parts, gram_items(hashes, kind), top))
        size = np.maximum(64, ENTRY_BITS * sum(np.bincount(part, top, parts) for part, _, top in grams)).astype(np.uint64)
        begin = np.cumsum(size) - size
        bits = np.zeros(int(size.sum()), bool)
        for part, item, top in grams:
            some = np.flatnonzero(top)
            for j in range(1, int(top.max(initial=0)) + 1):
                some = some[top[some] >= j]
                for bit in probes(item[some] + ENTRY_LEVEL[j], size[part[some]]):
                    bits[begin[part[some]] + bit] = True
        for part, item, top in grams:
            active = np.arange(len(item))
            while len(active):
                asked, own, at = item[active] + ENTRY_LEVEL[top[active].astype(np.int64) + 1], size[part[active]], begin[part[active]]
                step, yes = mixed(asked, 3) | np.uint64(1), np.arange(len(active))
                for i in range(PROBES):
                    bit = ((asked[yes] + np.uint64(i) * step[yes]) >> np.uint64(32)) * own[yes] >> np.uint64(32)
                    yes = yes[bits[at[yes] + bit]]
                active = active[yes]
                top[active] += 1
                active = active[top[active] < 254]
        return [top for *_, top in grams]


class _Gather:
    """A bundle and the answers to it to the scores of its documents."""

    def __init__(self, scores: Scores):
        self.scores = scores

    def __call__(self, bundles: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("slice").to_pydict()
        own, pair = (np.frombuffer(b"".join(map(zlib.decompress, answers[c])), np.uint8) for c in ("words", "pairs"))
        exact = np.concatenate(list(map(widened, answers["exact"])))
        out = []
        for row in bundles.to_pylist():
            bundle = Bundle(row)
            ends = int(own[np.searchsorted(bundle.one, np.uint64(END))])
            columns = self.scores.columns(bundle.sizes, exact[bundle.word], own[bundle.word], pair[bundle.pair()], ends)
            out.append(pa.table([pa.array(bundle.ids, pa.int64()), pa.array(bundle.flags, pa.bool_()), *columns], RESULT))
        return pa.concat_tables(out)


def scored(docs: DataFrame, group_bytes: int = GROUP_BYTES, bundle: int = BUNDLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)))
    n_docs, n_bytes = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    bits = max(1, (n_docs // PART_DOCS).bit_length())
    slice_bits = max(0, bits - (TASK_PARTS.bit_length() - 1))
    if TOKEN_BYTES * (n_bytes // 2 + 2 * n_docs) <= group_bytes:
        rows = df.filter(~F.col("held_out")).select("text").mapInArrow(_Count(bits), "part int, kind int, hashes binary, counts binary")
        rows = rows.repartitionById(1 << slice_bits, F.shiftright("part", bits - slice_bits)).sortWithinPartitions("part")
        parts = common.checkpoint(rows.mapInArrow(_parts, "part int, size bigint, words binary, counts binary, bits binary, total bigint, types bigint"))
        total, types = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "types")]).first()
        shared = spark.sparkContext.broadcast(Group(64 - bits, parts.toLocalIterator()))
        return df.select("doc_id", "held_out", "text").mapInArrow(_Local(shared, Scores(total, types)), SCHEMA)
    bundles = common.checkpoint(df.select("doc_id", "held_out", "text").mapInArrow(_Bundles(bundle), Bundle.SCHEMA))
    asked = bundles.drop("total").mapInArrow(_Ask(slice_bits), "slice int, bundle bigint, words binary, pairs binary, counts binary")
    # equally many parts for each task, at any size of the corpus
    answers = common.checkpoint(asked.repartitionById(1 << slice_bits, "slice").mapInArrow(_Answer(bits, slice_bits), _Answer.SCHEMA))
    total, types = bundles.agg(F.sum("total")).first()[0], answers.agg(F.sum("types")).first()[0]
    gather = _Gather(Scores(total, types))
    return bundles.drop("total").groupBy("bundle").cogroup(answers.drop("types").groupBy("bundle")).applyInArrow(lambda a, b: gather(a, b), SCHEMA)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of those that are not held out."""
    return scored(common.table(spark, sf_dir, "documents"))
