"""Runs of repeated words, by a dictionary of basic factors.

The factors of a text are its blocks of 1, 2, 4, ... words; the dictionary gives equal blocks of one length one number,
made from the numbers of their halves. In a stretch with smallest period q, blocks of at least q words stand again
first q words later. So, for each length, the distance from every block to its successor is taken where it is at most
twice the length, and places in a row with one distance form an arithmetic progression that proposes that period. A
proposal is extended as far as words q apart are equal. Blocks that stand once only leave the dictionary, so that in
ordinary texts little is left after the first lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import small_batches

RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    of = dict(zip(words, count()))
    return np.fromiter(map(of.__getitem__, words), dtype=np.int64, count=len(words))


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``keys`` by value, then place; and in that order true where the value is that of the one before."""
    order = np.argsort(keys, kind="stable")
    return order, np.concatenate([[False], keys[order][1:] == keys[order][:-1]])


def proposals(ids: np.ndarray, copies: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of progressions of successors that reach over enough words, for every length of block a run can need.

    At the first length not under its period a run's blocks are one unbroken progression, so that each run is proposed
    whole there. (Under that length a block may stand again within a period; such progressions break once a period and
    are too short.)
    """
    n, size = len(ids), 1
    places, keys = np.arange(n), ids
    while size == 1 or copies * (size // 2 + 1) <= n:
        order, same = _numbers(keys)
        at, before = places[order], np.flatnonzero(same) - 1
        gaps = at[before + 1] - at[before]
        near = gaps <= 2 * size
        starts, gaps = at[before[near]], gaps[near]
        by = np.argsort(starts, kind="stable")
        starts, gaps = starts[by], gaps[by]
        if len(starts):
            cuts = np.flatnonzero((np.diff(starts) != 1) | (np.diff(gaps) != 0))
            firsts, lasts = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(starts) - 1]])
            start, q = starts[firsts], gaps[firsts]
            end = starts[lasts] + q + size
            reach = end - start >= np.maximum(least, copies * q)
            yield from zip(start[reach].tolist(), end[reach].tolist(), q[reach].tolist(), strict=True)
        # Blocks of twice the length: the halves' numbers side by side, for places where both halves stand more than once.
        repeated = same | np.concatenate([same[1:], [False]])
        number = np.full(n + size, -1, dtype=np.int64)
        number[at[repeated]] = (np.cumsum(~same) - 1)[repeated]
        places = np.flatnonzero(number[:n] >= 0)
        places = places[number[places + size] >= 0]
        if not len(places):
            return
        keys = number[places] * np.int64(n + 1) + number[places + size]
        size *= 2


def runs(ids: np.ndarray, copies: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period), by start and period, of all longest stretches of ``least`` words and ``copies`` smallest periods."""
    if copies < 3:
        raise ValueError("progressions of successors need runs of three periods or more")
    n, found = len(ids), set()
    for start, end, q in proposals(ids, copies, least) if n >= least else ():
        while start and ids[start - 1] == ids[start - 1 + q]:
            start -= 1
        while end < n and ids[end] == ids[end - q]:
            end += 1
        found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist())


def find_runs(docs: DataFrame, copies: int = 4, least: int = 6) -> DataFrame:
    """``docs`` (text, any other columns) with ``runs`` (start, length, period in words, from word 0) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a stretch of at least ``copies`` times its smallest
    period, and ``least`` words, that can't be made longer; ``runs`` is ordered by start, then period. ``collapsed`` has
    the words that no run holds after its first period, joined by one space. A null or empty text has no runs and an
    empty ``collapsed``. Columns of these two names are replaced; every row is returned, repeated ones too.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed", "text")]

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = runs(numbered(words), copies, least)
                out.append(([{"start": s, "length": n, "period": q} for s, n, q in found], collapsed(words, found).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["runs", "collapsed"])

    return docs.select(*[docs[c] for c in kept], docs["text"], told(docs["text"]).alias("__found")).select(*kept, "text", "__found.*")
