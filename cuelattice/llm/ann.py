"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. The index is split by document: each block of vectors
holds inverted files, for each pivot the rows that name it and at which position; blocks are built and written once.
A query reads the files of its own nearest pivots alone and adds up how far positions agree (the induced footrule
distance); the nearest share of a block is reranked by the true inner product, and the blocks' best are merged. Largest inner product becomes nearest direction by giving
vectors one more component that brings all to the largest norm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved

# Pivots, how many of them a vector names, and of how many a query reads the inverted files.
PIVOTS, PREFIX, LISTS = 256, 64, 40
# The share of each block that is reranked, and the fewest rows.
SHARE, LEAST = 0.15, 256
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
# Pivots are chosen among this many vectors with the smallest hashed ids: the bounded sample the index is fitted on.
PIVOT_SAMPLE = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of doubles): one row per id, without vectors that can take no part.

    Left out are null ids, vectors that are null, zero or hold null or non-finite components, and vectors of
    another length than most have; of different vectors under one id the smallest counts.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    )
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.where(F.size("v") == (common["d"] if common else 0))
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def choose_pivots(v: DataFrame, most: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Unlike vectors of a bounded sample: near copies of a pivot already chosen come last."""
    rows = v.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).collect()
    x = np.array([r["v"] for r in rows], dtype=float)
    if not len(x):
        return np.zeros((0, 0))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    kept: list[int] = []
    for i in range(len(x)):
        if len(kept) < most and (not kept or (unit[kept] @ unit[i]).max() < 0.95):
            kept.append(i)
    return x[kept]


def permutations(x: np.ndarray, pivots: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """The nearest ``PREFIX`` pivots of each row, nearest first."""
    closeness = x @ pivots.T
    if not query:
        rest = lambda a: np.sqrt(np.maximum(largest**2 - (a**2).sum(axis=1), 0.0))
        closeness = closeness + rest(x)[:, None] * rest(pivots)[None, :]
    return np.argsort(-closeness, axis=1, kind="stable")[:, :PREFIX].astype(np.int16)


def inverted_files(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a block: rows and positions, by pivot, and where each pivot's begin (one more for the end)."""
    flat = perm.ravel()
    by = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[by], np.arange(pivots + 1))
    width = max(perm.shape[1], 1)
    return (by // width).astype(np.int32), (by % width).astype(np.int16), cuts.astype(np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], query_ids: np.ndarray, q: np.ndarray, query_perm: np.ndarray, k: int):
    """The best ``k`` rows of one block for each query: rank by footrule distance, then rerank the nearest share."""
    rows, positions, cuts = postings
    width = query_perm.shape[1]
    agree = [(width - np.abs(np.arange(width) - i)).astype(np.int16) for i in range(width)]
    keep = min(len(ids), max(LEAST, k + 1, int(SHARE * len(ids))))
    for query_id, vector, order in zip(query_ids, q, query_perm, strict=True):
        at = np.arange(len(ids))
        if keep < len(ids):
            near = np.zeros(len(ids), dtype=np.int16)
            for i, p in enumerate(order[:LISTS].tolist()):
                a, b = cuts[p], cuts[p + 1]
                near[rows[a:b]] += agree[i][positions[a:b]]
            at = np.argpartition(near, len(ids) - keep)[len(ids) - keep :]
        at = at[ids[at] != query_id]
        score = (x[at] * vector).sum(axis=1)
        best = np.lexsort((ids[at], -score))[:k]
        yield query_id, ids[at][best], score[best]


def nearest(vectors: DataFrame, k: int = 20, queries_every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries whose id is divisible by ``queries_every``, against all other rows.

    ``score`` is the inner product in double precision; equal scores go to the smaller id. An empty table, or one
    without usable vectors, has no result.
    """
    spark = vectors.sparkSession
    v = saved(usable(vectors), "vectors")
    shape = v.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % queries_every == 0).cast("long")).alias("nq"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("norm2")).first()
    n, nq, largest = shape["n"], shape["nq"] or 0, float(shape["norm2"] or 0.0) ** 0.5
    pivots = spark.sparkContext.broadcast(choose_pivots(v))
    count = len(pivots.value)

    def index(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), dtype=float)
                data, query = permutations(x, pivots.value, largest, False), permutations(x, pivots.value, largest, True)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "x": [r.tobytes() for r in x], "perm": [r.tobytes() for r in data], "query_perm": [r.tobytes() for r in query]})

    indexed = saved(v.mapInPandas(index, "vec_id long, x binary, perm binary, query_perm binary"), "permutations")
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-nq // QUERY_ROWS))
    part = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    def arrays(pdf: pd.DataFrame):
        raw = lambda c, t: np.frombuffer(b"".join(pdf[c]), dtype=t).reshape(len(pdf), -1)
        return pdf["vec_id"].to_numpy(), raw("x", float), raw("perm", np.int16)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, perm = arrays(pdf)
        rows, positions, cuts = inverted_files(perm, count)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [ids.astype(np.int64).tobytes()], "x": [x.tobytes()], "rows": [rows.tobytes()], "positions": [positions.tobytes()], "cuts": [cuts.tobytes()]})

    dealt = indexed.select("vec_id", "x", "perm", part(blocks, 1).alias("block"))
    index_blocks = saved(dealt.groupBy("block").applyInPandas(build, "block int, ids binary, x binary, rows binary, positions binary, cuts binary"), "inverted-files")
    data = index_blocks.withColumn("grp", every(groups))
    asked = indexed.where(F.col("vec_id") % queries_every == 0).select("vec_id", "x", F.col("query_perm").alias("perm"), part(groups, 2).alias("grp"), every(blocks).alias("block"))

    def meet(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(data) or not len(asked):
            return empty
        b = data.iloc[0]
        ids = np.frombuffer(b["ids"], dtype=np.int64)
        postings = tuple(np.frombuffer(b[c], dtype=t) for c, t in (("rows", np.int32), ("positions", np.int16), ("cuts", np.int64)))
        found = search_block(ids, np.frombuffer(b["x"], dtype=float).reshape(len(ids), -1), postings, *arrays(asked), k)
        return pd.concat([empty, *(pd.DataFrame({"query_id": i, "vec_id": v, "score": s}) for i, v, s in found)], ignore_index=True)

    found = data.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
