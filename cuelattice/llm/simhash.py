"""Near-duplicate documents by 64-bit SimHash fingerprints and a self-join of their binary trie.

Distinct fingerprints are the leaves of a binary trie. Two nodes of one depth are traversed together while their
prefixes differ in no more bits than the budget, each pair handing the bits it has used to its children: (0,0) and
(1,1) for nothing, (0,1) and (1,0) for one. Pairs that pass the budget are pruned with all that hangs below them.

The upper part of the trie is a table. A node holding more than ``LEAF`` fingerprints is parted by ``STEP`` bits more, so a dense
region gets a deep trie whatever its share of all rows, and pairs of nodes come down level by level as joins of the
pairs with the children of either side. A task takes whole pairs of subtrees, with their fingerprints as sorted
arrays, and goes on in memory; of the links it finds it returns a spanning forest, so that dense groups never emit all
their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import saved, small_batches
from cuelattice.llm.near_dup import connected_components

BITS, SEED = 64, 42
# Fingerprints of one subtree that a task takes as one array, and bits by which a larger one is parted.
LEAF, STEP = 1 << 15, 4
# Pairs of nodes that are held at once in memory, and of fingerprints under them that are compared outright.
FRONTIER, OUTRIGHT = 1 << 18, 16
# A fingerprint shared by more than this part of all rows is joined by broadcast: there are never more of them than its inverse.
HOT_PART = 1000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the runs of ``size`` words, repeats included: a bit is set where over half of their hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    width = min(size, len(words))
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, print`` of every row; a null text is an empty one."""
    small_batches(docs.sparkSession)

    def describe(batches):
        for pdf in batches:
            prints = np.array([fingerprint(t, size) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "print": prints})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(describe, "doc_id long, print long")


def _prefix(of, depth: int):
    """The first ``depth`` bits of a fingerprint, as a number."""
    return F.shiftrightunsigned(of, BITS - depth) if depth else F.lit(0).cast("long")


def trie(prints: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, prefix, final) of the upper trie of distinct ``prints`` (print, rep), and ``prints`` with their final node.

    Only fingerprints of nodes that are still too large are counted again, one level of ``STEP`` bits deeper.
    """
    open_, nodes, placed = prints, None, None
    for depth in range(0, BITS + 1, STEP):
        counts = open_.groupBy(_prefix(F.col("print"), depth).alias("prefix")).agg((F.count("*") <= leaf).alias("final"))
        level = saved(counts.select(F.lit(depth).alias("depth"), "prefix", F.col("final") | F.lit(depth == BITS)), "trie-level").toDF("depth", "prefix", "final")
        nodes = level if nodes is None else nodes.unionByName(level)
        rows = open_.withColumn("prefix", _prefix(F.col("print"), depth)).join(level, "prefix")
        done = rows.where("final").select("print", "rep", "depth", "prefix")
        placed = done if placed is None else placed.unionByName(done)
        if level.where("not final").isEmpty():
            break
        open_ = saved(rows.where("not final").select("print", "rep"), "trie-rows")
    return nodes, placed


def node_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """Pairs of final nodes whose prefixes differ in at most ``budget`` bits as far as both go: ``a_depth, a, b_depth, b, used``.

    Starts with the root beside itself. At each level nodes that are not final give way to their children; a node that is
    final waits, at its own depth. A pair of different nodes comes once.
    """
    level = nodes.where("depth = 0").select(
        F.lit(0).alias("a_depth"), F.col("prefix").alias("a"), F.col("final").alias("a_final"), F.lit(0).alias("b_depth"), F.col("prefix").alias("b"), F.col("final").alias("b_final")
    )
    ready = None
    for depth in range(0, BITS + 1, STEP):
        over = level.where("a_final and b_final")
        ready = over if ready is None else ready.unionByName(over)
        rest = level.where("not (a_final and b_final)")
        if depth == BITS or rest.isEmpty():
            break
        children = nodes.where(F.col("depth") == depth + STEP).select(F.shiftrightunsigned("prefix", STEP).alias("parent"), F.col("prefix").alias("child"), F.col("final").alias("child_final"))
        for side in ("a", "b"):
            goes, stays = rest.where(f"not {side}_final"), rest.where(f"{side}_final")
            down = goes.join(children, F.col(side) == F.col("parent")).withColumns({side: F.col("child"), f"{side}_final": F.col("child_final"), f"{side}_depth": F.lit(depth + STEP)})
            rest = stays.unionByName(down.select(*stays.columns))
        cut = lambda x: F.expr(f"shiftrightunsigned({x}, {x}_depth - least({'a_depth, b_depth'}))")
        rest = rest.where(F.bit_count(cut("a").bitwiseXOR(cut("b"))) <= budget)
        # A node beside itself gives each pair of its children twice.
        rest = rest.where((F.col("a_depth") != F.col("b_depth")) | (F.col("a") <= F.col("b")))
        level = saved(rest, "node-pairs")
    return ready.select("a_depth", "a", "b_depth", "b")


def _traversed(a: np.ndarray, b: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints of two sorted arrays that differ in at most ``budget`` bits, some at a time.

    A node is a range of its array. ``same`` says that both arrays are one; then each pair comes once, with i < j.
    """
    ones: dict[tuple[bool, int], np.ndarray] = {}

    def middle(of: np.ndarray, right: bool, level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the ones of bit ``level`` begin in each range."""
        key = (right and not same, level)
        if key not in ones:
            ones[key] = np.concatenate([[0], np.cumsum((of >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)])
        return high - (ones[key][high] - ones[key][low])

    stack = [(0, *(np.array([v]) for v in (0, len(a), 0, len(b), 0)))]
    while stack:
        level, al, ah, bl, bh, used = stack.pop()
        few = (ah - al) * (bh - bl) <= OUTRIGHT
        if few.any():
            n, width = ((ah - al) * (bh - bl))[few], (bh - bl)[few]
            node = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
            i, j = al[few][node] + at // width[node], bl[few][node] + at % width[node]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
        al, ah, bl, bh, used = (v[~few] for v in (al, ah, bl, bh, used))
        if not len(al):
            continue
        am, bm = middle(a, False, level, al, ah), middle(b, True, level, bl, bh)
        twice = (al == bl) if same else np.zeros(len(al), dtype=bool)
        children = [(al, am, bl, bm, used), (am, ah, bm, bh, used), (al, am, bm, bh, used + 1), (am, ah, bl, bm, np.where(twice, budget + 1, used + 1))]
        nodes = [np.concatenate(v) for v in zip(*children, strict=True)]
        ok = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= budget)
        nodes = [v[ok] for v in nodes]
        stack += [(level + 1, *(v[k : k + FRONTIER] for v in nodes)) for k in range(0, len(nodes[0]), FRONTIER)]


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (for each place the smallest known to be linked with it) with links i, j added."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above


def linked(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as places (member, smallest of its tree), of the links inside ``a``, or between ``a`` and ``b`` (placed after it)."""
    n = len(a)
    root = np.arange(n + (0 if b is None else len(b)))
    for i, j in _traversed(a, a if b is None else b, b is None, budget):
        root = _united(root, i, j if b is None else j + n)
    members = np.flatnonzero(root != np.arange(len(root)))
    return members, root[members]


def trie_links(prints: DataFrame, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """Pairs (a, b) of the ``rep`` of distinct ``prints`` (print, rep) that join all those within ``budget`` bits, directly or through others."""
    small_batches(prints.sparkSession)
    nodes, placed = trie(prints, leaf)

    def array(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, reps = pdf["print"].to_numpy(dtype=np.int64).view(np.uint64), pdf["rep"].to_numpy(dtype=np.int64)
        by = np.argsort(prints)
        return pd.DataFrame({"depth": [pdf["depth"].iloc[0]], "prefix": [pdf["prefix"].iloc[0]], "prints": [prints[by].tobytes()], "reps": [reps[by].tobytes()]})

    arrays = saved(placed.groupBy("depth", "prefix").applyInPandas(array, "depth int, prefix long, prints binary, reps binary"), "subtrees")
    pairs = saved(node_pairs(nodes, budget), "subtree-pairs")
    side = lambda s: arrays.select(F.col("depth").alias(f"{s}_depth"), F.col("prefix").alias(s), F.col("prints").alias(f"{s}_prints"), F.col("reps").alias(f"{s}_reps"))
    met = pairs.join(side("a"), ["a_depth", "a"]).join(side("b"), ["b_depth", "b"])

    def links(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = (r.a_depth, r.a) == (r.b_depth, r.b)
                a, b = (np.frombuffer(x, dtype=np.uint64) for x in (r.a_prints, r.b_prints))
                reps = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in ([r.a_reps] if same else [r.a_reps, r.b_reps])])
                member, root = linked(a, None if same else b, budget)
                yield pd.DataFrame({"a": reps[member], "b": reps[root]})

    return met.mapInPandas(links, "a long, b long")


def simhash_groups(docs: DataFrame, size: int = 3, budget: int = 2) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as ``doc_id, fingerprint, component_id``.

    Rows are linked where their fingerprints differ in at most ``budget`` bits; ``component_id`` is the smallest doc_id
    that can be reached. Rows without words have fingerprint zero and are linked like any other; repeated rows are each returned, rows with one
    id and different texts each by their own text; rows without an id have a fingerprint, no component, and link
    nothing. Other columns are ignored; an empty table has no result.
    """
    spark = docs.sparkSession
    base = saved(fingerprints(docs, size), "fingerprints")
    classes = saved(base.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    links = saved(trie_links(classes.select("print", "rep"), budget), "links").where("a <> b")
    components = connected_components(links) if not links.isEmpty() else spark.createDataFrame([], "node long, root long")
    roots = saved(classes.join(components, F.col("rep") == F.col("node"), "left").select(F.col("print").alias("own"), "n", F.coalesce("root", "rep").alias("component_id")), "roots")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / HOT_PART
    # Few fingerprints can be that common; all others have a bounded share of the rows and meet by a shuffle.
    common = base.join(F.broadcast(roots.where(hot)), F.col("print") == F.col("own"), "left")
    rest = common.where("component_id is null and doc_id is not null").select("doc_id", "print").join(roots.where(~hot), F.col("print") == F.col("own"))
    found = common.where("component_id is not null or doc_id is null").unionByName(rest.select("doc_id", "print", "own", "n", "component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
