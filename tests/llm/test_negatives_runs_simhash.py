"""Hard negatives, runs of words and SimHash groups against plain versions, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuelattice.llm import hard_negatives, periodic, simhash
from cuelattice.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- hard negatives -------------------------------------------------------------------------------------------------


def plain_negatives(rows, every, positives=5, negatives=10):
    """rows: id -> (label, vector of whole numbers)."""
    out = []
    for a in (i for i in rows if i % every == 0):
        score = {i: sum(int(x) * int(y) for x, y in zip(rows[a][1], v, strict=True)) for i, (_, v) in rows.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if rows[i][0] == rows[a][0]][:positives]:
            held = [i for i in best if rows[i][0] != rows[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(held[:negatives])]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_hard_negatives_of_the_query_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = sorted(con.sql(f"select {columns} from ({ORACLE_SQL['op11_hard_negatives']})").fetchall())
    got = QUERIES["op11_hard_negatives"](spark, SF)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert told(got) == want


@pytest.mark.parametrize("large", [1, 1_000_000])
def test_hard_negatives_in_blocks_and_groups(spark, monkeypatch, large):
    """Clusters, equal vectors and many blocks and groups; with large numbers sums pass what doubles hold exactly."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, i % 4 if i % 9 else None, [float(x) * large for x in centres[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(30)] + [(2000, 1, None), (2005, 1, [1.0, None] + [0.0] * 6), (2010, 1, [float("nan")] * 8), (2015, 2, [float("inf")] * 8)]
    rows += [(2020, 1, [1e300] * 8), (2025, 1, [1.0]), (None, 1, [1.0] * 8), (2030, 3, [0.0] * 8), rows[7], rows[10]]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("own") for c in ("score", "rank", "x", "d", "block", "place")})
    ok = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e299}
    got = told(hard_negatives.mine(table, F.col("vec_id") % 5 == 0))
    assert got == plain_negatives(ok, 5) and len(got) > 1000


def test_hard_negatives_without_rows(spark):
    table = spark.createDataFrame([(5, 1, [1.0, 2.0]), (6, 1, []), (0, None, None)], "vec_id long, label int, embedding array<double>")
    anchors = F.col("vec_id") % 5 == 0
    for some in (table, table.limit(0), table.where("vec_id = 6"), table.where("vec_id = 0")):
        out = hard_negatives.mine(some, anchors)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not out.collect()


def test_bounds_leave_most_candidates_out_where_anchors_are_near():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(1, 32)) + 0.01 * rng.normal(size=(40, 32)))).astype(np.int64)
    order, parents, edges = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and (parents < np.arange(40)).all() and parents[0] == -1
    far = ((x[order][1:, None, :] - x[order][None, :, :]).astype(float) ** 2).sum(axis=2) ** 0.5
    assert all(abs(far[i - 1, parents[i]] - edges[i]) < 1e-6 and edges[i] <= min(far[i - 1, j] for j in range(40) if j != i and parents[j] != i) + 1e-6 for i in range(1, 40) if i not in parents)
    v = np.floor(256 * rng.normal(size=(2000, 32))).astype(np.int64)
    block = hard_negatives.Block(np.arange(2000), np.arange(2000) % 3, v, hard_negatives.norms(v))
    group = hard_negatives.Group(np.arange(40) + 5000, np.zeros(40, dtype=int), x[order], parents, edges)
    asked = [len(at) for _, at, _ in hard_negatives.scored(group, block, lambda i, low, high: high >= np.partition(low, -10)[-10])]
    assert sum(asked[1:]) < 0.2 * 39 * 2000
    for (i, ids, s), row in zip(hard_negatives.own_label(group, block, 5), x[order], strict=True):
        mine = [int(k) for k in range(2000) if k % 3 == 0]
        assert ids.tolist() == sorted(mine, key=lambda k: (-int(v[k] @ row), k))[:5] and s.tolist() == [int(v[k] @ row) for k in ids]


# --- runs -----------------------------------------------------------------------------------------------------------


def plain_runs(w, copies=4, least=6):
    """Every stretch in which words q apart are equal, for every q, if none shorter is a period of it too."""
    _, ids = np.unique(np.array(w, dtype=object), return_inverse=True) if len(w) else (None, np.zeros(0, int))
    found = []
    for q in range(1, len(ids) // copies + 1):
        equal = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1), strict=True):
            part = ids[a : b + q]
            if len(part) >= max(least, copies * q) and not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                found.append((int(a), len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(800):
        w = [str(rng.randrange(rng.choice([1, 2, 3]))) for _ in range(rng.randrange(40))]
        while rng.random() < 0.6 and len(w) < 200:
            unit = [str(rng.randrange(3)) for _ in range(rng.randrange(1, 14))]
            w += [unit[i % len(unit)] for i in range(rng.randrange(len(unit) * 3, len(unit) * 8))] + [str(rng.randrange(5)) for _ in range(rng.randrange(4))]
        for copies, least in ((4, 6), (3, 2)):
            found = periodic.runs(periodic.numbered([x.encode() for x in w]), copies, least)
            assert found == plain_runs(w, copies, least)
        assert periodic.collapsed([x.encode() for x in w], found).decode().split() == plain_collapse(w, found)
    with pytest.raises(ValueError, match="three"):
        periodic.runs(np.zeros(9, dtype=int), copies=2)


def test_runs_of_the_query(spark, documents):
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(documents)
    planted = 0
    for i, text in documents.items():
        w, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = plain_runs(w)
        planted += bool(found) and h % 10 == 0
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert got[i] == {
            "doc_id": i, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(plain_collapse(w, found))).hexdigest(),
        }
    assert planted >= 3


def test_runs_of_awkward_rows(spark):
    long = "na " * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a\x0ba\ra\n\na a a"), (5, "a\x0ba\ra\n\na a a"), (6, long), (7, "é é é é " * 3), (None, "x y " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("runs", "collapsed", "told", "length", "start")})
    got = {(r["doc_id"], r["text"]): (sorted(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.find_runs(docs).collect()}
    assert got[1, None] == got[2, ""] == got[3, " \n\t"] == ([], "")
    assert got[4, "a a a a a"] == ([], "a a a a a") and got[rows[4]] == ([(0, 6, 1)], "a") and got[6, long] == ([(0, 50_000, 1)], "na")
    assert got[rows[7]] == ([(0, 6, 1)], "é é") and got[None, "x y " * 5] == ([(0, 10, 2)], "x y")
    assert periodic.find_runs(docs).count() == len(rows) and not periodic.find_runs(docs.limit(0)).collect()


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, budget=2):
    """prints: (id, fingerprint) rows; for each its smallest id reachable."""
    ids, root = defaultdict(list), {}
    for i, p in prints:
        ids[p].append(i)
    values = np.array(sorted(ids), dtype=np.uint64)
    root = {int(v): int(v) for v in values}

    def up(v):
        while root[v] != v:
            v = root[v]
        return v

    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= budget]:
            root[up(int(v))] = up(int(w))
    least = defaultdict(lambda: 1 << 62)
    for v in ids:
        least[up(v)] = min(least[up(v)], *ids[v])
    return {(i, p): least[up(p)] for i, p in prints}


def test_simhash_of_the_query(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op13_simhash"](spark, SF).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in documents.items()]
    of = plain_components(prints)
    assert got == {i: (f"{p:016x}", of[i, p]) for i, p in prints}


@pytest.mark.parametrize("leaf", [4, 50, 1 << 15])
def test_trie_join_of_dense_fingerprints(spark, leaf):
    """Balls of near fingerprints, chains, and scattered ones, with tries that are deep where they are dense."""
    rng = random.Random(leaf)
    prints = {0, (1 << 64) - 1, 1 << 63, 7}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(4)) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(40):
        prints.add(at := at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(300)}
    rows = list(enumerate(prints))
    rng.shuffle(rows)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    links = simhash.trie_links(spark.createDataFrame(signed, "rep long, print long"), 2, leaf).collect()
    root = {i: i for i, _ in rows}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    by = dict(rows)
    for r in links:
        a, b = sorted((up(r["a"]), up(r["b"])))
        root[b] = a
    want = plain_components(rows)
    assert {i: up(i) for i in root} == {i: want[i, by[i]] for i in root}
    assert len(links) < 40 * len(rows)


def test_traversal_gives_each_link_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    a = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(3 << 20)]))
    b = np.unique(np.concatenate([base ^ np.uint64(1), base ^ np.uint64(1 << 63)]))
    for left, right, same in ((a, a, True), (a, b, False)):
        got = [(int(i), int(j)) for x in simhash._traversed(left, right, same, 2) for i, j in zip(*x, strict=True)]
        want = [(i, j) for i in range(len(left)) for j in range(len(right)) if (not same or i < j) and int(left[i] ^ right[j]).bit_count() <= 2]
        assert sorted(got) == want


def test_simhash_of_awkward_rows(spark):
    long = "The quick brown fox " * 30_000
    rows = [(3, None), (4, ""), (9, " \n"), (5, "One two"), (6, "one TWO"), (6, "one TWO"), (2, long), (8, long + "end"), (None, "one two"), (7, "É X"), (7, "é x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("print", "rep", "n", "own", "component_id", "fingerprint")})
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    of = plain_components([r for r in prints if r[0] is not None])
    assert sorted(got, key=str) == sorted(((i, f"{p:016x}", of.get((i, p))) for i, p in prints), key=str)
    assert not simhash.simhash_groups(docs.limit(0)).collect()
