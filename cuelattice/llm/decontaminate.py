"""Benchmark passages in documents, by pigeonhole pieces and Myers' bit-parallel distance.

A test item may occur with up to ``rate`` edits per character. Split into one piece more than that budget, at least one
piece must occur unchanged; an Aho-Corasick automaton finds the pieces of all items in one scan of a text, and the
surroundings of each hit are verified with the bit-parallel edit distance. Documents are scanned where they lie:
nothing is shuffled, and the items travel in shards of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import small_batches

# Edits allowed for each character; items so short that none is allowed are searched exactly, as whole words.
RATE = 0.10
SHARD_CHARS = 4_000_000
GRAM = 4
LEAKS = "array<struct<item_id:long,distance:int,end:int>>"


def normalise(text: str) -> str:
    """Lower case, each run of white space one space, trimmed."""
    return " ".join(text.lower().split())


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces of nearly equal length, with their offsets."""
    n, k = len(item), budget + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def alphabet_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(smallest distance of the pattern to any substring of ``text``, first end of one), if within ``budget``.

    Myers' recurrence: the vertical differences of one column of the distance matrix are two bit vectors, and a
    character of the text moves all rows at once.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    found: tuple[int, int] | None = None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = eq | minus
        carry = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(carry | plus))
        down = plus & carry
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score <= budget and (found is None or score < found[0]):
                found = (score, at + 1)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return found


class Matcher:
    """All items of one shard, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = {}
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normalise(text or "")
            if not norm:
                continue
            k = int(rate * len(norm))
            key = len(self.items)
            grams = {norm[i : i + GRAM] for i in range(len(norm) - GRAM + 1)}
            self.items[key] = (item_id, len(norm), k, alphabet_masks(norm), grams, k == 0)
            for offset, piece in pieces_of(norm, k):
                at.setdefault(piece, []).append((key, offset))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item found, by item."""
        if self.empty or not text:
            return []
        low = normalise(text)
        hits: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(low):
            start = end - n + 1
            for key, offset in where:
                hits.setdefault(key, set()).add(start - offset)
        out = []
        for key, diagonals in hits.items():
            item_id, n, k, masks, grams, short = self.items[key]
            if short:
                at = min((d for d in diagonals if not low[d - 1 : d].isalnum() and not low[d + n : d + n + 1].isalnum()), default=None)
                if at is not None:
                    out.append((item_id, 0, at + n))
                continue
            best: tuple[int, int] | None = None
            for lo, hi in merged(diagonals, n, k, len(low)):
                window = low[lo:hi]
                here = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
                # Each edit spoils at most GRAM of an item's grams.
                if len(grams - here) > k * GRAM:
                    continue
                got = best_end(masks, n, window, k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda x: (x[0] is None, x))


def merged(diagonals: set[int], n: int, k: int, total: int) -> list[tuple[int, int]]:
    """Stretches of the text in which an item that starts near one of ``diagonals`` must lie."""
    out: list[tuple[int, int]] = []
    for d in sorted(diagonals):
        lo, hi = max(0, d - k), min(total, d + n + k)
        if out and lo <= out[-1][0] + 2 * k:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        elif hi > lo:
            out.append((lo, hi))
    return out


def shards(benchmark: DataFrame, most_chars: int = SHARD_CHARS) -> list[list[tuple[int, str]]]:
    """Items in lists of about ``most_chars`` characters each, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // most_chars))
    for i in range(n):
        part = items.where(F.coalesce(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)), F.lit(0)) == i)
        yield [(r["item_id"], r["text"]) for r in part.distinct().orderBy("item_id", "text").collect()]


def _leaks_of(spark, items: list[tuple[int, str]], rate: float):
    small_batches(spark)
    held = spark.sparkContext.broadcast(items)

    @F.pandas_udf(LEAKS)
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(held.value, rate)
        for s in texts:
            yield pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.leaks(t or "")] for t in s])

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, end`` for every item found in every document; one pass for each shard of items.

    ``distance`` is the fewest edits between the item and any stretch of the text (both normalised), ``end`` where the
    first such stretch ends. Null and empty texts and items hold nothing. Items too short for an edit (under 10 characters at
    the default rate) are found between characters that are neither letters nor digits; items without an id are found too, with a null id.
    Repeated documents are reported each, repeated items once.
    """
    out = None
    for items in shards(benchmark):
        leaks = _leaks_of(docs.sparkSession, items, rate)
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks(F.coalesce("text", F.lit("")))).alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    for items in shards(benchmark):
        docs = docs.where(F.size(_leaks_of(docs.sparkSession, items, rate)(F.coalesce("text", F.lit("")))) == 0)
    return docs
