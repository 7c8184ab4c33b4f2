"""Similarities of short names: edit similarity on characters, and TF-IDF cosine on n-grams inside words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a canonical name weighs over an alias.
CANONICAL_BOOST = 1.05
GRAM_SIZES = (2, 3, 4)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine-integer row, a step for each character of b."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & masks.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def edit_similarity(a: str, b: str) -> float:
    """0 to 100 from insertions and deletions."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def token_similarity(a: str, b: str) -> float:
    """0 to 100 on sets of words: 100 where one holds the other and they share a word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_a or not only_b):
        return 100.0
    whole = lambda rest: f"{shared} {rest}".strip()
    best = edit_similarity(whole(only_a), whole(only_b))
    return max(best, edit_similarity(shared, whole(only_a)), edit_similarity(shared, whole(only_b))) if shared else best


def char_grams(text: str) -> list[str]:
    """n-grams inside words padded with a space on each side; a word shorter than n is one gram, once."""
    out = []
    for word in text.split():
        padded = f" {word} "
        for n in GRAM_SIZES:
            out += [padded[k : k + n] for k in range(max(1, len(padded) - n + 1))]
            if len(padded) <= n:
                break
    return out


def plain_name(name: str) -> str:
    return name.lower().strip()


def inverse_frequencies(found: dict[str, int], names: int) -> dict[str, float]:
    """Smoothed inverse document frequencies from the number of names that hold each gram."""
    return {g: math.log((1 + names) / (1 + n)) + 1 for g, n in found.items()}


class NameIndex:
    """The names of a registry, for scoring. ``rows``: (service, name, is canonical) in registration order.

    ``idf`` is that of the whole registry where the rows are a part of it.
    """

    def __init__(self, rows: list[tuple[int, str, bool]], idf: dict[str, float] | None = None):
        self.rows = [(s, plain_name(n), c) for s, n, c in rows if n and n.strip()]
        counts = [Counter(char_grams(n)) for _, n, _ in self.rows]
        self.idf = idf if idf is not None else inverse_frequencies(Counter(g for c in counts for g in c), len(self.rows))
        self.lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(counts):
            for g, w in self.vector(c).items():
                self.lists[g].append((k, w))

    def vector(self, counts: Counter) -> dict[str, float]:
        weights = {g: n * self.idf[g] for g, n in counts.items() if g in self.idf}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {g: w / norm for g, w in weights.items()}

    def fuzzy(self, name: str, n: int = 3) -> list[tuple[int, float]]:
        """The services of highest edit similarity (0 to 100); of equals the one registered first."""
        best: dict[int, float] = {}
        for service, other, canonical in self.rows:
            score = max(token_similarity(name, other), edit_similarity(name, other)) * (CANONICAL_BOOST if canonical else 1.0)
            best[service] = max(best.get(service, 0.0), min(score, 100.0))
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]

    def cosine(self, name: str, n: int = 3) -> list[tuple[int, float]]:
        """The services of highest cosine (0 to 1)."""
        sums: dict[int, float] = defaultdict(float)
        for g, w in self.vector(Counter(char_grams(name))).items():
            for k, v in self.lists[g]:
                sums[k] += w * v
        best: dict[int, float] = {s: 0.0 for s, *_ in self.rows}
        for k, s in sums.items():
            best[self.rows[k][0]] = max(best[self.rows[k][0]], s)
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]


def grams(text: Column) -> Column:
    """The same n-grams as an expression."""
    padded = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    sizes = F.array(*map(F.lit, GRAM_SIZES))
    usable = lambda w, n: (n == GRAM_SIZES[0]) | (F.length(w) >= n)
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(F.filter(sizes, lambda n: usable(w, n)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda k: F.substring(w, k, n))))))


def tfidf(names: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, gram and weight: raw frequency times smoothed inverse document frequency, of length one for each key."""
    tf = names.select(key, F.explode_outer(grams(F.lower(F.trim(F.col(text))))).alias("gram")).filter(F.col("gram").isNotNull()).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    n = names.select(F.count("*").alias("n"))
    weighted = tf.join(df, "gram").select(key, "gram", (F.col("tf") * (F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(vectors: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs a < b whose cosine is at least so much, by an equi-join on grams."""
    a, b = (vectors.select(F.col(key).alias(s), "gram", F.col("weight").alias(f"w_{s}")) for s in ("a", "b"))
    return a.join(b, "gram").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("cosine")).filter(F.col("cosine") >= least)
