r"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Strings are dealt to collections so that equal ones meet: each has one
anchor, its least-hashed ``ANCHOR``-byte piece (the leftmost of equals), which
depends on the string alone.  Successive strings with one anchor form a
context.  Contexts that share an anchor are a group; equal contexts are
collapsed with their number, and a group of one distinct context needs no
index: each of its strings occurs as often as the context.

The other groups are indexed.  In a collection the contexts stand with their
anchors in one column, and one symbol of each is inserted a round, from the
last column to the first: the round sorts the inserted symbols stably within
the order of the round before, which is the order of all suffixes from this
column, and updates the common prefixes of neighbours by range minima.  Since
equal strings stand at equal distance from equal anchors, suffixes of different
columns need not be compared, and each round's slice of the transform goes to a
sequential file without touching the earlier ones; the files are then read in
sequence for common prefixes of ``LENGTH``.

A group of more than ``CROWD`` distinct contexts (a short frequent line among
ever different neighbours) would be a task of unbounded size; its contexts are
cut to their single strings, which are dealt and counted each by its own hash.

Defined results: a null text is empty; nothing is removed from texts of under
LENGTH bytes; a repeated row is a repetition of all its strings; null ids are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common

LENGTH, ANCHOR = 200, 50
#: Anchors that a string has to choose from.
CHOICE = LENGTH - ANCHOR + 1
#: Distinct contexts of a group that are indexed together.
CROWD = 2000
#: Bytes of contexts in a collection.
COLLECTION = 12 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ANCHOR-byte piece, from its Karp-Rabin sum."""
    n = len(data) - ANCHOR + 1
    up = np.full(len(data) + 1, BASE, np.uint64)
    up[0] = 1
    down = np.full(n, INVERSE, np.uint64)
    down[0] = 1
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)[:-1])])
    x = (running[ANCHOR:] - running[:-ANCHOR]) * np.multiply.accumulate(down)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For each run of CHOICE hashes the place of the least, the leftmost of equals."""
    least, place, span = hashes, np.arange(len(hashes), dtype=np.int32), 1

    def joined(step: int):
        later = least[step:] < least[:-step]
        return np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])

    while 2 * span <= CHOICE:
        least, place = joined(span)
        span *= 2
    if span < CHOICE:
        least, place = joined(CHOICE - span)
    return place


class _Contexts:
    """doc_id, h, text to the contexts of the text: doc_id, h, fp, ctx and where (start, n and lead in one number).

    A context is known by the hashes of its anchor and of itself, 128 bits together.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                    size += len(texts[end])
                    end += 1
                found = self.contexts(texts[at:end])
                if found is not None:
                    row, columns = found
                    rows = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("h").take(rows), *columns], ["doc_id", "h", "fp", "ctx", "at"])
                at = end

    def contexts(self, texts: list[bytes]):
        joined = b"".join(texts)
        if len(joined) < LENGTH:
            return None
        ends = np.cumsum([len(t) for t in texts])
        hashes = piece_hashes(np.frombuffer(joined, np.uint8))
        place = anchors(hashes)  # for each start of a string
        owner = np.searchsorted(ends, np.arange(len(place)), "right")
        inside = np.arange(len(place)) + LENGTH <= ends[owner]
        first = np.ones(len(place), bool)
        first[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(first & inside)
        if not len(starts):
            return None
        # a context ends before the next one, or with its text
        breaks = np.flatnonzero(first)
        stop = np.append(breaks[1:], len(place))[np.searchsorted(breaks, starts)]
        stop = np.minimum(stop, ends[owner[starts]] - LENGTH + 1)
        view = memoryview(joined)
        digests = np.fromiter((xxhash.xxh3_64_intdigest(view[s : e + LENGTH - 1]) for s, e in zip(starts.tolist(), stop.tolist(), strict=True)), np.uint64, len(starts))
        begin = np.append(0, ends[:-1])
        at = ((starts - begin[owner[starts]]) << 16) | ((stop - starts) << 8) | (place[starts] - starts)
        columns = [hashes[place[starts]].view(np.int64), digests.view(np.int64), at.astype(np.int64)]
        return owner[starts], [pa.array(c) for c in columns]


def repeated_starts(contexts: list[bytes], lead: np.ndarray, own: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Boolean (contexts, CHOICE): which strings of each context occur again in the collection.

    ``lead`` is the anchor's place in the context, ``own`` the number of its
    strings, ``times`` how often the context occurs.
    """
    m = len(contexts)
    first = CHOICE - 1 - lead
    sizes = np.fromiter(map(len, contexts), np.int64, m)
    last = first + sizes - 1
    symbols = np.zeros((int(last.max()) + 1, m), np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    who = np.repeat(np.arange(m), sizes)
    symbols[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[who], who] = flat
    entering = np.argsort(last, kind="stable")
    bounds = np.searchsorted(last[entering], np.arange(len(symbols) + 1))
    order, prefix = np.zeros(0, np.int32), np.zeros(0, np.int16)
    slices = []
    with tempfile.TemporaryFile() as order_file, tempfile.TemporaryFile() as prefix_file:
        for column in range(len(symbols) - 1, -1, -1):
            # contexts that end here come first: what follows them is empty
            fresh = entering[bounds[column] : bounds[column + 1]].astype(np.int32)
            if len(fresh):
                order, prefix = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.int16), prefix])
            if not len(order):
                continue
            left = np.flatnonzero(first[order] <= column)
            if not len(left):
                break
            if len(left) < len(order):
                # the common prefix over those that leave is the least on the way
                prefix = np.minimum.reduceat(prefix, np.append(0, left[:-1] + 1)) if len(left) > 1 else prefix[:1]
                order = order[left]
            inserted = symbols[column, order]
            turn = np.argsort(inserted, kind="stable")
            fresh_order, sorted_symbols = order[turn], inserted[turn]
            fresh_prefix = np.zeros(len(order), np.int16)
            same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
            if len(same):
                ranges = np.stack([turn[same - 1] + 1, turn[same] + 1], axis=1).ravel()
                fresh_prefix[same] = 1 + np.minimum.reduceat(np.append(prefix, 0), ranges)[::2]
            order, prefix = fresh_order, fresh_prefix
            if column < CHOICE:  # a string starts in the first columns only
                order_file.write(order.tobytes())
                prefix_file.write(prefix.tobytes())
                slices.append((column, len(order)))
        order_file.seek(0)
        prefix_file.seek(0)
        out = np.zeros((m, CHOICE), bool)
        for column, n in slices:
            order, prefix = np.frombuffer(order_file.read(4 * n), np.int32), np.frombuffer(prefix_file.read(2 * n), np.int16)
            again = np.zeros(n, bool)
            again[1:] = prefix[1:] >= LENGTH
            again[:-1] |= again[1:]
            again |= times[order] > 1
            mine = column - first[order]
            again &= mine < own[order]
            out[order[again], mine[again]] = True
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, length) of the runs of True."""
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return row, begin, end - begin


class _Index:
    """Distinct contexts sorted by anchor to the runs of their strings that occur again."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("fp", "ctx", "times", "n", "lead", "context")), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # the same context of a repeated row
                if held >= COLLECTION and row[0] != rows[-1][0]:
                    yield self.runs(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1])
        if rows:
            yield self.runs(rows)

    def runs(self, rows: list[tuple]) -> pa.RecordBatch:
        fp, ctx, times, own, lead, contexts = zip(*rows, strict=True)
        row, begin, length = runs_of(repeated_starts(list(contexts), np.array(lead), np.array(own), np.array(times)))
        columns = [np.array(c, np.int64)[row] for c in (fp, ctx)] + [begin.astype(np.int32), length.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "ctx", "off", "len"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are dealt: they are most of what moves."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [press.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(texts, pa.binary())], ["doc_id", "h", "z"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """z and wanted (contexts of the text) to the contexts' bytes."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            data = press.decompress(batch.column("z")[k].as_py())
            wanted = batch.column("wanted")[k].values
            at = wanted.field("at").to_numpy()
            start, own = (at >> 16).tolist(), (at >> 8 & 255).astype(np.int32)
            pieces = [data[a : a + n + LENGTH - 1] for a, n in zip(start, own.tolist(), strict=True)]
            columns = [wanted.field("fp"), wanted.field("ctx"), wanted.field("times"), pa.array(own), pa.array((at & 255).astype(np.int32)), wanted.field("crowd"), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["fp", "ctx", "times", "n", "lead", "crowd", "context"])


class _Remove:
    """doc_id, z and spans (start, strings) to what is left of the text."""

    def __init__(self, text: bool):
        self.text = text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [self.row(press.decompress(z), s) for z, s in zip(part.column("z").to_pylist(), part.column("spans").to_pylist(), strict=True)]
                kept, *counts = zip(*rows, strict=True)
                columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts)]
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
                if self.text:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    def row(self, data: bytes, spans) -> tuple[bytes, int, int, int]:
        kept, removed, number, at, end = [], 0, 0, 0, -1
        for span in sorted((s["s"], s["s"] + s["len"] + LENGTH - 1) for s in spans or ()):
            if span[0] > end:
                if end >= 0:
                    removed += end - begin
                begin = span[0]
                kept.append(data[at:begin])
                number += 1
            end = at = max(end, span[1])
        if end >= 0:
            removed += end - begin
        kept.append(data[at:])
        return b"".join(kept), len(data), removed, number


def cleaned(docs: DataFrame, keep_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes of every whole text."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = df.withColumn("h", F.xxhash64("doc_id", "text"))
    contexts = df.mapInArrow(_Contexts(), "doc_id bigint, h bigint, fp bigint, ctx bigint, at bigint")
    groups = contexts.groupBy("fp").agg(F.count("*").alias("members"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    # written first, so that the join reads two exchanges and a group of many members can be split over tasks
    groups = common.checkpoint(groups.filter("members > 1").select("fp", (F.col("low") == F.col("high")).alias("same")))
    members = common.checkpoint(contexts.join(groups, "fp"))
    start, own = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)).cast("int")
    # groups of equal contexts
    sure = members.filter("same").select("doc_id", "h", start.alias("s"), own.alias("len"))
    # the others: distinct contexts, with their number and one place to read them from
    mixed = members.filter("NOT same")
    key = ["fp", "ctx"]
    distinct = mixed.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "h", "at")).alias("one"))
    crowds = distinct.groupBy("fp").agg(F.count("*").alias("variants")).filter(F.col("variants") > crowd)
    distinct = distinct.join(crowds, "fp", "left").select(*key, "times", "one.at", F.col("one.doc_id").alias("a_id"), F.col("one.h").alias("a_h"), F.col("variants").isNotNull().alias("crowd"))
    # the texts, dealt once for the contexts and for the result
    packed = df.mapInArrow(_packed, "doc_id bigint, h bigint, z binary")
    wanted = distinct.groupBy("a_id", "a_h").agg(F.collect_list(F.struct("fp", "ctx", "times", "at", "crowd")).alias("wanted"))
    texts = packed.join(wanted, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))).select("z", "wanted")
    texts = texts.mapInArrow(_sliced, "fp bigint, ctx bigint, times bigint, n int, lead int, crowd boolean, context binary")
    indexed = texts.filter("NOT crowd").drop("crowd").repartition("fp").sortWithinPartitions("fp", "ctx").mapInArrow(_Index(), "fp bigint, ctx bigint, off int, len int")
    single = texts.filter("crowd").dropDuplicates(key).select(*key, "times", "context", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("off"))
    string = F.substring(F.col("context"), F.col("off") + 1, F.lit(LENGTH))
    single = single.select(*key, "times", "off", F.xxhash64(string).alias("s1"), F.xxhash64(F.lit(1), string).alias("s2"))
    again = single.groupBy("s1", "s2").agg(F.sum("times").alias("n")).filter("n > 1").select("s1", "s2")
    crowded = single.join(again, ["s1", "s2"]).select(*key, "off", F.lit(1).alias("len"))
    found = mixed.join(indexed.union(crowded), key).select("doc_id", "h", (start + F.col("off")).alias("s"), "len")
    spans = sure.union(found).groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "len")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "spans")
    joined = packed.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(_Remove(keep_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without the strings of 200 bytes that repeat."""
    return cleaned(common.table(spark, sf_dir, "documents"))
