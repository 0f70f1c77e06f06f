"""Hard-negative mining with bounds along a spanning tree of anchors.

Anchors are dealt into groups of near ones, and each group gets a minimum spanning tree. Candidates come in blocks.
Where a group meets a block, the root scores every candidate; a child's score of a candidate lies within its parent's
plus or minus edge length times the candidate's norm (Cauchy-Schwarz), so a child computes only the candidates whose
interval overlaps what it looks for, and hands tightened intervals to its own children. What is computed decides; the
bounds only leave out what can't matter, so results are exact.

Vectors are whole numbers: scores are exact, and equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved

# Rows of a block of candidates and of a group of anchors; fewer where vectors are long, so that neither passes BYTES.
BLOCK_ROWS, GROUP_ROWS, BYTES = 8192, 2048, 1 << 23
# Landmarks by which near anchors come into one group: never more than these are collected.
LANDMARKS = 256
# Norms from this on would give scores that are no long; sums below EXACT are exact in double precision.
LARGEST_NORM2, EXACT = float(1 << 62), float(1 << 53)


class Block(NamedTuple):
    """Candidates: their ids, labels, vectors (whole numbers) and norms."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray


class Group(NamedTuple):
    """Anchors in the order of the walk, each after its parent (-1: the root), with the length of the edge between them."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    parents: np.ndarray
    edges: np.ndarray


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: one row per id, components as floor(scale * x).

    Left out are rows with a null id, label or vector, with a null or non-finite component, of another length than most
    have, or with a norm of 2^31 or more after scaling, whose scores would be no long. Of several rows under one id the
    smallest (label, vector) counts.
    """
    e = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.where("vec_id is not null and label is not null").where(F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    v = e.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    v = v.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < LARGEST_NORM2)
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.where(F.size("v") == (common["d"] if common else 0))
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree by Prim's method: an order of walking, and each row's parent and edge in that order.

    Children with few below them come first, so that few bounds are held at any time of the walk: no more than the
    logarithm of the number of rows.
    """
    n, points = len(x), x.astype(float)
    parent, reach, out = np.full(n, -1), np.full(n, np.inf), np.zeros(n, dtype=bool)
    at, joined = 0, []
    for _ in range(n):
        out[at] = True
        joined.append(at)
        d = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        nearer = ~out & (d < reach)
        parent[nearer], reach[nearer] = at, d[nearer]
        at = int(np.where(out, np.inf, reach).argmin())
    below, children = np.ones(n, dtype=int), [[] for _ in range(n)]
    for i in reversed(joined[1:]):
        below[parent[i]] += below[i]
        children[parent[i]].append(i)
    order, stack = [], [0]
    while stack:
        order.append(i := stack.pop())
        stack += sorted(children[i], key=lambda c: -below[c])
    order = np.array(order)
    place = np.empty(n, dtype=int)
    place[order] = np.arange(n)
    return order, np.where(parent[order] < 0, -1, place[parent[order]]), np.where(parent[order] < 0, 0.0, reach[order])


def scored(group: Group, block: Block, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor (by its place in the walk) the rows of the block that ``wanted`` asks for, and their scores.

    ``wanted(i, low, high)`` marks the candidates that matter to anchor i, given bounds of their scores.
    """
    of = norms(group.x)
    exact = max(of.max(initial=0.0), block.norms.max(initial=0.0)) ** 2 < EXACT
    x = block.x.astype(float) if exact else block.x
    waiting = np.bincount(group.parents[group.parents >= 0], minlength=len(group.ids))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    every = np.arange(len(block.ids))

    def scores(i: int, at: np.ndarray) -> np.ndarray:
        rows = x if len(at) == len(x) else x[at]
        return (rows @ group.x[i].astype(float)).astype(np.int64) if exact else (rows * group.x[i]).sum(axis=1)

    for i, p in enumerate(group.parents.tolist()):
        slack = 0.0 if exact else of[i] * block.norms * 1e-12 + 1
        if p < 0:
            s = scores(i, every)
            low, high = s - slack, s + slack
            at = np.flatnonzero(wanted(i, low, high))
            found = s[at]
        else:
            reach = group.edges[i] * block.norms * (1 + 1e-9) + slack
            low, high = bounds[p][0] - reach, bounds[p][1] + reach
            at = np.flatnonzero(wanted(i, low, high))
            found = scores(i, every)[at] if 2 * len(at) > len(every) else scores(i, at)
            some = slack if exact else slack[at]
            low[at], high[at] = found - some, found + some
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
        if waiting[i]:
            bounds[i] = (low, high)
        yield i, at, found


def _largest(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k > 0 else -np.inf


def _first(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    near = np.flatnonzero(s >= _largest(s, k))
    return near[np.lexsort((ids[near], -s[near]))[:k]]


def own_label(group: Group, block: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each anchor's id with the ids and scores of its ``k`` best other rows of the same label in the block."""

    def fits(i: int) -> np.ndarray:
        return (block.labels == group.labels[i]) & (block.ids != group.ids[i])

    def wanted(i, low, high):
        mine = fits(i)
        return mine & (high >= _largest(low[mine], k))

    for i, at, s in scored(group, block, wanted):
        best = _first(block.ids[at], s, k)
        yield group.ids[i], block.ids[at][best], s[best]


def in_windows(group: Group, block: Block, windows: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each anchor's id and number of a window with the ids and scores of its ``k`` best rows of other labels inside.

    ``windows`` has the smallest and largest score of each window, by anchor. A row that certainly lies below ``k``
    others of the window is left out with those that certainly lie outside.
    """

    def wanted(i, low, high):
        other, any_ = block.labels != group.labels[i], np.zeros(len(block.ids), dtype=bool)
        for least, most in set(windows[i]):
            sure = other & (low >= least) & (high <= most)
            any_ |= other & (high >= max(least, _largest(low[sure], k))) & (low <= most)
        return any_

    for i, at, s in scored(group, block, wanted):
        for w, (least, most) in enumerate(windows[i]):
            held = np.flatnonzero((s >= least) & (s <= most))
            best = held[_first(block.ids[at][held], s[held], k)]
            yield group.ids[i], w, block.ids[at][best], s[best]


def _arrays(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["x"]), dtype=np.int64).reshape(len(pdf), d)


def _block(row: pd.Series, d: int) -> Block:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    x = np.frombuffer(row["x"], dtype=np.int64).reshape(len(ids), d)
    return Block(ids, np.frombuffer(row["labels"], dtype=np.int64), x, norms(x))


def _group(pdf: pd.DataFrame, d: int) -> Group:
    pdf = pdf.sort_values("place")
    return Group(*(pdf[c].to_numpy() for c in ("anchor_id", "label")), _arrays(pdf, d), pdf["parent"].to_numpy(), pdf["edge"].to_numpy())


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows (vec_id, label, embedding).

    ``is_anchor`` tells anchors by ``vec_id``. An anchor's positives are its ``positives`` best other rows of the same
    label; for each, the negatives are the best ``negatives`` rows of other labels with ``least_percent`` * positive
    <= 100 * negative <= ``most_percent`` * positive. Higher scores come first, ties by smaller id. Which rows take
    part is told at ``whole_vectors``. No anchors, or no rows in a window, give no result. Other columns are ignored.
    """
    spark = rows.sparkSession

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "d": pdf["v"].map(len), "x": [np.asarray(v, dtype=np.int64).tobytes() for v in pdf["v"]]})

    vectors = saved(whole_vectors(rows, scale).mapInPandas(pack, "vec_id long, label long, d int, x binary"), "whole-vectors")
    shape = vectors.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max("d").alias("d")).first()
    n, count, d = shape["n"], shape["anchors"], shape["d"] or 0
    fit = lambda most: max(1, min(most, BYTES // (8 * max(d, 1))))
    blocks = max(1, -(-n // fit(BLOCK_ROWS)))
    spread = lambda seed, of: F.pmod(F.xxhash64("vec_id", F.lit(seed)), of).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        as_bytes = lambda c: pdf[c].to_numpy(dtype=np.int64).tobytes()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [as_bytes("vec_id")], "labels": [as_bytes("label")], "x": [b"".join(pdf["x"])]})

    dealt = vectors.select("vec_id", "label", "x", spread(1, F.lit(blocks)).alias("block"))
    data = saved(dealt.groupBy("block").applyInPandas(build, "block int, ids binary, labels binary, x binary"), "candidate-blocks")

    # Anchors go to the nearest of a bounded number of landmarks; those of one landmark that are too many for a group are dealt on.
    own = vectors.where(is_anchor)
    some = own.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(min(LANDMARKS, max(1, -(-count // fit(GROUP_ROWS))))).collect()
    marks = np.frombuffer(b"".join(bytes(r["x"]) for r in some), dtype=np.int64).reshape(len(some), d).astype(float)

    def nearest_mark(batches):
        for pdf in batches:
            x = _arrays(pdf, d).astype(float)
            yield pdf.assign(mark=((marks**2).sum(axis=1) - 2 * (x @ marks.T)).argmin(axis=1).astype(np.int32) if len(pdf) else np.zeros(0, dtype=np.int32))

    marked = own.select("vec_id", "label", "x").mapInPandas(nearest_mark, "vec_id long, label long, x binary, mark int")
    held = {r["mark"]: -(-r["count"] // fit(GROUP_ROWS)) for r in marked.groupBy("mark").count().collect()}  # never more rows than landmarks
    firsts = dict(zip(held, np.cumsum([0, *held.values()]).tolist(), strict=False))
    groups = max(1, sum(held.values()))
    numbers = spark.createDataFrame([(m, firsts[m], held[m]) for m in held], "mark int, first int, shares int")
    marked = marked.join(F.broadcast(numbers), "mark").withColumn("grp", F.col("first") + spread(2, F.col("shares")))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        order, parents, edges = spanning_tree(_arrays(pdf, d))
        pdf = pdf.iloc[order]
        return pd.DataFrame({"grp": pdf["grp"], "place": np.arange(len(pdf)), "anchor_id": pdf["vec_id"], "label": pdf["label"], "x": pdf["x"], "parent": parents, "edge": edges})

    trees = saved(marked.groupBy("grp").applyInPandas(plant, "grp int, place long, anchor_id long, label long, x binary, parent long, edge double"), "anchor-trees")
    every = lambda of, name: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)

    def meet(anchors: DataFrame, find: Callable, schema: str) -> DataFrame:
        """What ``find(group of anchors, block)`` gives for every group and every block."""
        names = [c.split()[0] for c in schema.split(", ")]

        def both(blocks_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame(dict(zip(names, row, strict=True))) for row in find(asked, _block(blocks_.iloc[0], d))] if len(blocks_) and len(asked) else []
            found = [f for f in found if len(f)]
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in names})

        return data.select("*", every(groups, "grp")).groupBy("block", "grp").cogroup(anchors.select("*", every(blocks, "block")).groupBy("block", "grp")).applyInPandas(both, schema)

    def best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        return df.withColumn("rank", rank).where(F.col("rank") <= k)

    alike = meet(trees, lambda asked, block: own_label(_group(asked, d), block, positives), "anchor_id long, vec_id long, score long")
    chosen = saved(best(alike, ["anchor_id"], positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")), "positives")

    def windows_of(asked: pd.DataFrame, block: Block):
        asked = asked.sort_values("place")
        windows = [[(-(-least_percent * int(p) // 100), most_percent * int(p) // 100) for p in scores] for scores in asked["scores"]]
        return in_windows(_group(asked, d), block, windows, negatives)

    # Anchors without positives stay in their tree, with no window.
    scores = F.coalesce(F.transform("positives", lambda p: p["score"]), F.array().cast("array<long>"))
    ready = trees.join(chosen, "anchor_id", "left").select(*trees.columns, scores.alias("scores"))
    found = best(meet(ready, windows_of, "anchor_id long, w long, vec_id long, score long"), ["anchor_id", "w"], negatives)
    told = chosen.select("anchor_id", F.posexplode("positives").alias("w", "p"))
    out = found.join(told.select("anchor_id", F.col("w").cast("long").alias("w"), "p"), ["anchor_id", "w"])
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
