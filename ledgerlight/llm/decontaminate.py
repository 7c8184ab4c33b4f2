"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are sequences of lower-cased runs of letters and
digits.  Windows of ``MIN_MATCH`` tokens that a document shares with an item
are the seeds of the join; for each joined pair the longest non-overlapping
matches are marked, longest first, where candidates are found by running
Karp-Rabin sums whose window shrinks from the item's length to ``MIN_MATCH``.
A document is contaminated by an item if its tiles cover at least
``COVERAGE`` of the item's tokens, in whatever order the tiles stand.

The benchmark is the stated query set: it is sent to the executors in blocks
of bounded size, and each block meets all documents.

Defined results: null and blank texts and items have no tokens and match
nothing; an item shorter than MIN_MATCH tokens is matched whole; of equally long
matches the first place in the item counts, then the first in the text; repeated
rows are judged one by one; a null item text or id is carried as any other;
very long texts are tiled whole, over their seeded stretches; other columns stay
as they are; empty tables give an empty result, and an empty benchmark removes
nothing.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import common

#: Tokens in a seed, and in the shortest tile.
MIN_MATCH = 5
#: Share of an item's tokens from which a document is contaminated.
COVERAGE = 0.5
#: Characters of benchmark text in a block: the bound of what is collected and broadcast at once.
BLOCK_CHARS = 32_000_000
TOKEN = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_sums(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin sums of the windows of so many ids at these starts, modulo 2^64, whatever stands before them."""
    powers = np.full(len(ids) + 1, BASE, np.uint64)
    powers[0] = 1
    inverse = np.full(len(ids) + 1, INVERSE, np.uint64)
    inverse[0] = 1
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids + 2).astype(np.uint64) * np.multiply.accumulate(powers)[: len(ids)])])
    return (running[starts + size] - running[starts]) * np.multiply.accumulate(inverse)[starts]


def free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that are wholly free."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the item, place in the text, length), longest matches first.

    Ids below zero match nothing.  Ties go to the first place in the item, then
    in the text.
    """
    free_t, free_p = text >= 0, item >= 0
    found = []
    size = min(len(item), len(text))
    while size >= least:
        p_at, t_at = free_windows(free_p, size), free_windows(free_t, size)
        matches = []
        if len(p_at) and len(t_at):
            own, theirs = window_sums(item, p_at, size), window_sums(text, t_at, size)
            order = np.argsort(theirs, kind="stable")
            low, high = np.searchsorted(theirs[order], own, "left"), np.searchsorted(theirs[order], own, "right")
            for k in np.flatnonzero(high > low).tolist():
                p = int(p_at[k])
                for t in t_at[order[low[k] : high[k]]].tolist():
                    if (item[p : p + size] != text[t : t + size]).any():
                        continue  # equal sums of unequal windows
                    n = size
                    while p + n < len(item) and t + n < len(text) and free_p[p + n] and free_t[t + n] and item[p + n] == text[t + n]:
                        n += 1
                    matches.append((-n, p, t))
        # longest first; what a longer tile cuts off at its end waits for its turn again
        heapq.heapify(matches)
        while matches:
            n, p, t = heapq.heappop(matches)
            taken = np.flatnonzero(~(free_p[p : p - n] & free_t[t : t - n]))
            if not len(taken):
                free_p[p : p - n] = free_t[t : t - n] = False
                found.append((p, t, -n))
            elif taken[0] >= size:
                heapq.heappush(matches, (-int(taken[0]), p, t))
        size = max(size // 2, least) if size > least else 0
    return found


class Benchmark:
    """A block of items with its vocabulary and the seeds of each length."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = MIN_MATCH, coverage: float = COVERAGE):
        self.coverage, self.vocabulary = coverage, {}
        self.items: list[tuple[int | None, np.ndarray, int]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in TOKEN.findall((text or "").lower())]
            if ids:
                self.items.append((item_id, np.array(ids, np.int64), min(least, len(ids))))
        self.seeds = []
        for size in sorted({k for *_, k in self.items}):
            sums, owners = [], []
            for n, (_, ids, k) in enumerate(self.items):
                if k == size:
                    sums.append(window_sums(ids, np.arange(len(ids) - size + 1), size))
                    owners.append(np.full(len(sums[-1]), n))
            sums, owners = np.concatenate(sums), np.concatenate(owners)
            order = np.argsort(sums, kind="stable")
            self.seeds.append((size, sums[order], owners[order]))

    def ids(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(t, -1) for t in TOKEN.findall((text or "").lower())], np.int64)

    def hits(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, item's tokens, tokens under tiles, tiles) of each item that the text contains."""
        out = []
        ids = self.ids(text)
        for size, sums, owners in self.seeds:
            at = free_windows(ids >= 0, size) if len(ids) >= size else np.zeros(0, np.int64)
            if not len(at):
                continue
            own = window_sums(ids, at, size)
            low = np.searchsorted(sums, own, "left")
            seeded = np.flatnonzero(sums[np.minimum(low, len(sums) - 1)] == own)
            if not len(seeded):
                continue
            high = np.searchsorted(sums, own[seeded], "right")
            counts = high - low[seeded]
            places = np.repeat(at[seeded], counts)
            which = owners[np.repeat(low[seeded], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            for n in np.unique(which).tolist():
                item_id, item, _ = self.items[n]
                mine = np.unique(places[which == n])
                if len(mine) + size - 1 < self.coverage * len(item) and len(mine) * size < self.coverage * len(item):
                    continue  # all seeds together cover too little
                # every tile consists of seeds, so only the seeded stretches are tiled
                covered = np.unique((mine[:, None] + np.arange(size)).ravel())
                breaks = np.flatnonzero(np.diff(covered) > 1) + 1
                stretch = np.insert(ids[covered], breaks, -1)
                found = tiles(stretch, item, size)
                matched = sum(t[2] for t in found)
                if matched >= self.coverage * len(item):
                    out.append((item_id, len(item), matched, len(found)))
        return out


class _Pairs:
    def __init__(self, block):
        self.block = block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows += [(doc_id, *x) for x in self.block.value.hits(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "item_tokens", "matched", "tiles"])


class _Clean:
    def __init__(self, block):
        self.block = block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not self.block.value.hits(text.as_py()) for text in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about so many characters; one is collected at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    n = -(-total // chars)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def contaminations(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, item_tokens, matched, tiles, coverage."""
    schema = "doc_id bigint, item_id bigint, item_tokens bigint, matched bigint, tiles bigint"
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = narrow.sparkSession.createDataFrame([], schema)
    for n, items in enumerate(blocks(benchmark, chars)):
        found = narrow.mapInArrow(_Pairs(narrow.sparkSession.sparkContext.broadcast(Benchmark(items))), schema)
        out = found if n == 0 else out.union(found)
    return out.withColumn("coverage", F.col("matched") / F.col("item_tokens"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    for items in blocks(benchmark, chars):
        docs = docs.mapInArrow(_Clean(docs.sparkSession.sparkContext.broadcast(Benchmark(items))), docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contaminations(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
