"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles. Its sketch has ``SIZE`` coordinates: in round i every
shingle is thrown into a random bin with a value that starts with i, and each bin keeps its smallest value; from round
``SIZE`` on round i fills bin i - SIZE for certain. Equal coordinates of two sketches estimate the Jaccard similarity
with the concentration of independent minimum hashes, at a cost of about SIZE * log(SIZE) throws rather than
SIZE * set size. Bands are made of two bytes each of the first ``BANDED`` coordinates, so that of many billions of unlike
documents few share one; of the other coordinates one byte is kept. Documents that agree in all rows of a band become
candidates if their whole sketches are alike, and full sets decide.

Which documents share a band is worked out on ids and keys alone. Sketches join only the members of buckets that still
hold different components, and texts only the pairs to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm import words
from cuelattice.llm.common import saved, small_batches

SIZE, ROWS, BANDS = 512, 4, 32
BANDED = ROWS * BANDS
# Bytes of a kept sketch: two for each banded coordinate, one for each other.
WIDTH = 2 * BANDED + SIZE - BANDED
# Sketches of documents at the threshold of 0.75 agree in 384 of 512 places give or take 10: fewer than 335 is 5 of these.
LEAST_AGREEING = 335
# Bytes of coordinates that no band uses, from which the middle of a bucket is told.
PROBES = tuple(range(2 * BANDED, WIDTH, 16))
# Bits of the filter of wanted ids that goes to all executors: 1,024 rows of 4 KB at most, however many ids there are.
FILTER_BITS = 1 << 25
# Rows of one bucket that one side of a group of a task may hold, and members of one centre whose texts follow each other.
BLOCK, CENTRE_ROWS = 2048, 512
STAR_ROWS, CHUNK_ROWS = 4096, 1024
# Bands of the first round of stars: a few are enough to join most of a group, and fewer sketches travel.
FIRST_BANDS = 6
# A set that more than this part of all rows share is joined by broadcast: there are never more of them than its inverse.
HOT_PART = 1000

_SEEDS = words.mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes: for each bin the round and 32 bits of the value."""
    out = np.full(SIZE, _EMPTY)
    first = 0
    while first < SIZE:
        n = int(min(SIZE - first, max(1, 800 // len(elements))))
        thrown = words.mix(elements[None, :] ^ _SEEDS[first : first + n, None])
        values = (thrown >> np.uint64(32)) | (np.arange(first, first + n, dtype=np.uint64) << np.uint64(32))[:, None]
        np.minimum.at(out, (thrown & np.uint64(SIZE - 1)).astype(np.int64).ravel(), values.ravel())
        first += n
        if out.max() != _EMPTY:
            return out
    for b in np.flatnonzero(out == _EMPTY):
        thrown = words.mix(elements ^ _SEEDS[SIZE + b])
        out[b] = (thrown >> np.uint64(32)).min() | np.uint64((SIZE + int(b)) << 32)
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """The bytes kept of a sketch's (mixed) coordinates."""
    return np.concatenate([values[:BANDED].astype("<u2").view(np.uint8), values[BANDED:].astype(np.uint8)])


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band: hashed bytes of its rows above, the number of the band in the lowest bits.

    Sketches that agree in a band have one key for it, and others but once in 2^59.
    """
    rows = np.ascontiguousarray(low[: 2 * BANDED]).view("<u8").astype(np.uint64)
    band = np.arange(BANDS, dtype=np.uint64)
    return (words.mix(rows ^ words.mix(band)) & ~np.uint64(BANDS - 1) | band).view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For kept sketches side by side, how many coordinates agree, and in which bands all rows do."""
    same = a == b
    wide = same[:, : 2 * BANDED].reshape(len(same), BANDED, 2).all(axis=2)
    return wide.sum(axis=1) + same[:, 2 * BANDED :].sum(axis=1), wide.reshape(len(same), BANDS, ROWS).all(axis=2)


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            s = words.shingles(words.ascii_words(text or ""))
            if not len(s):
                out.append((doc_id, 0, None, None, None, None))
                continue
            sig = sketch(s)
            low = packed(words.mix(sig))
            print_a, print_b = words.mix(s ^ _SEEDS[0]).sum(), np.bitwise_xor.reduce(words.mix(s ^ _SEEDS[1]))
            out.append((doc_id, len(s), int(print_a.view(np.int64)), int(print_b.view(np.int64)), band_keys(low), low.tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "n", "print_a", "print_b", "bands", "low"]).astype({"print_a": "Int64", "print_b": "Int64"})


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id``, set size ``n``, fingerprint of the set, keys of its bands and the kept bytes of its sketch."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _describe, "doc_id long, n long, print_a long, print_b long, bands array<long>, low binary"
    )


def shared_bands(reps: DataFrame) -> DataFrame:
    """``key, rep`` of every band that at least two of ``reps`` (rep, bands) have; most keys have one and go no further."""
    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = saved(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "keys")
    return rows.join(shared, "key")


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, comp, ...) of keys with several components, with the key's ``size``, its commonest component and that one's rows."""
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    of = each.groupBy("key").agg(F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("top_rows"), F.count("*").alias("comps"))
    return rows.join(saved(of.where("comps > 1").drop("comps"), "mixed"), "key")


def mixed_buckets(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members (key, rep) of buckets that lie in different components so far, with ``comp`` and what ``_mixed`` adds."""
    rows = members.join(components, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    return _mixed(rows)


def _middle(low: np.ndarray) -> int:
    """The row that agrees most with the commonest values: near copies of one text are all near that text."""
    probes = low[:, PROBES]
    common = np.array([np.bincount(c, minlength=256).argmax() for c in probes.T], dtype=np.uint8)
    return int((probes == common).sum(axis=1).argmax())


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of each (key, block) group with its middle, where components differ and sketches are alike."""
    for pdf in _whole_groups(batches, ["key", "block"]):
        key, block = pdf["key"].to_numpy(), pdf["block"].to_numpy()
        rep, comp, n = pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), pdf["n"].to_numpy()
        low = np.frombuffer(b"".join(pdf["low"]), dtype=np.uint8).reshape(-1, WIDTH)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        middle = first.copy()
        for g in np.flatnonzero(sizes > 2):
            middle[g] += _middle(low[first[g] : first[g] + sizes[g]])
        to, at = np.repeat(middle, sizes), np.arange(len(key))
        ok = (comp != comp[to]) & (np.minimum(n, n[to]) * 100 >= np.maximum(n, n[to]) * 75)
        at, to = at[ok], to[ok]
        equal = agreeing(low[at], low[to])[0]
        like = equal >= LEAST_AGREEING
        at, to = at[like], to[like]
        yield pd.DataFrame({"a": rep[at], "b": rep[to], "equal": equal[like]})


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``by``, cut so that no group is parted."""
    kept: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
        if len(pdf):
            end = (pdf[by] == pdf[by].iloc[-1]).all(axis=1)
            kept = pdf[end]
            if not end.all():
                yield pdf[~end].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept.reset_index(drop=True)


def star_candidates(mixed: DataFrame, lows: DataFrame) -> DataFrame:
    """Alike pairs of the members of each bucket with its middle in another component; of its middles each keeps the likeliest.

    A bucket of over ``STAR_ROWS`` rows has a star for each of its blocks.
    """
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / STAR_ROWS)).cast("int"))
    grouped = dealt.join(lows, "rep").select("key", "block", "rep", "comp", "n", "low").repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    found = grouped.mapInPandas(_stars, "a long, b long, equal int")
    return found.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within_buckets(batches: Iterator[pd.DataFrame], best_only: bool) -> Iterator[pd.DataFrame]:
    """Alike pairs of different components in each (key, part, other) group; rows come sorted by group.

    A pair is given by the first band in which it agrees only, so no pair comes twice. Keys of buckets are made of the
    same bytes that are compared here, so that band is always one in which the two meet.
    """
    def alike(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf[["key", "part", "other"]].to_numpy()
        rep, comp, n = pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), pdf["n"].to_numpy()
        side, cross = pdf["block"].to_numpy(), group[:, 1] != group[:, 2]
        low = np.frombuffer(b"".join(pdf["low"]), dtype=np.uint8).reshape(-1, WIDTH)
        band = pdf["key"].to_numpy() & (BANDS - 1)
        found = [np.zeros((0, 3), dtype=np.int64)]
        at = np.arange(len(pdf))
        d = 1
        while True:
            at = at[at + d < len(pdf)]
            at = at[(group[at] == group[at + d]).all(axis=1)]
            if not len(at):
                break
            to = at + d
            ok = (comp[at] != comp[to]) & (np.minimum(n[at], n[to]) * 100 >= np.maximum(n[at], n[to]) * 75) & (~cross[at] | (side[at] != side[to]))
            i, j = at[ok], to[ok]
            if len(i):
                equal, shared = agreeing(low[i], low[j])
                like = (equal >= LEAST_AGREEING) & (shared.argmax(axis=1) == band[i]) & shared[np.arange(len(i)), band[i]]
                found.append(np.stack([rep[i[like]], rep[j[like]], equal[like]], axis=1))
            d += 1
        out = pd.DataFrame(np.concatenate(found), columns=["a", "b", "equal"])
        if best_only:
            both = pd.concat([out, out[["b", "a", "equal"]].set_axis(["a", "b", "equal"], axis=1)])
            out = both.sort_values(["equal", "b"], ascending=False).drop_duplicates("a")
        return out

    for pdf in _whole_groups(batches, ["key", "part", "other"]):
        yield alike(pdf)


def cross_candidates(mixed: DataFrame, lows: DataFrame, best_only: bool) -> DataFrame:
    """Alike pairs of a bucket (rows of ``mixed_buckets``) that lie in different components, so that no link is missed.

    Rows of a bucket's commonest component, if there are over ``BLOCK`` of them, need to meet the others only: they are
    dealt into chunks, the others into blocks, and every block meets every block and every chunk in a group of its
    own. So tasks stay bounded, and a large component with a few strangers costs no more than its rows. With
    ``best_only`` each document keeps its likeliest partner alone.
    """
    large = F.col("top_rows") > BLOCK
    members = mixed.withColumn("chunks", F.when(large, F.ceil(F.col("top_rows") / CHUNK_ROWS)).otherwise(0).cast("int"))
    members = members.withColumn("blocks", F.ceil(F.when(large, F.col("size") - F.col("top_rows")).otherwise(F.col("size")) / BLOCK).cast("int"))
    inside = large & (F.col("comp") == F.col("top"))
    at = F.pmod(F.xxhash64("rep"), F.when(inside, F.col("chunks")).otherwise(F.col("blocks"))).cast("int")
    members = members.withColumn("block", F.when(inside, F.col("blocks") + at).otherwise(at))
    group = lambda part, other: F.struct(part.alias("part"), other.alias("other"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda w: F.when(inside, group(w, F.col("block"))).otherwise(group(F.least(F.col("block"), w), F.greatest(F.col("block"), w))))
    none = F.filter(blocks, lambda g: F.lit(False))
    chunks = F.when(~inside & (F.col("chunks") > 0), F.transform(F.sequence(F.lit(0), F.greatest(F.col("chunks") - 1, F.lit(0))), lambda c: group(F.col("block"), F.col("blocks") + c))).otherwise(none)
    met = members.join(lows, "rep").withColumn("group", F.explode(F.concat(blocks, chunks))).select("key", "group.part", "group.other", "block", "rep", "comp", "n", "low")
    grouped = met.repartition("key", "part", "other").sortWithinPartitions("key", "part", "other", "rep")
    pairs = grouped.mapInPandas(lambda batches: _within_buckets(batches, best_only), "a long, b long, equal long")
    if best_only:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from rows sorted by (centre, salt, kind): the centre's text (kind 0), then its members' (kind 1)."""
    at, centres = None, []
    for pdf in batches:
        out = []
        for a, salt, kind, b, text in zip(pdf["a"], pdf["salt"], pdf["kind"], pdf["id"], pdf["text"], strict=True):
            if (a, salt) != at:
                at, centres = (a, salt), []
            s = words.shingles(words.ascii_words(text or ""))
            if kind == 0:
                centres.append(s)
                continue
            for c in centres:
                shared = len(np.intersect1d(c, s, assume_unique=True))
                if 100 * shared >= 75 * (len(c) + len(s) - shared) and len(s):
                    out.append((a, b))
                    break
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def marked_rows(rows: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` (id, ...) with ``wanted``: true for every id among ``ids``, and for few others while ids are fewer than ``bits``.

    A bitmap of ``bits`` bits, in rows of 4 KB, is all that goes to the executors, whatever the number of ids; where it
    fills up, more rows are marked, and the join that follows decides as it always does.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap"))
    placed = rows.withColumn("bucket", F.bitmap_bucket_number(spot)).withColumn("at", F.bitmap_bit_position(spot))
    byte = "cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    wanted = F.coalesce(F.expr(f"shiftright({byte}, cast(at % 8 as int)) % 2 = 1"), F.lit(False))
    return placed.join(F.broadcast(maps), "bucket", "left").select(*rows.columns, wanted.alias("wanted"))


def wanted_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return marked_rows(rows, ids).where("wanted").drop("wanted")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets have 100 * intersection >= 75 * union."""
    shares = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_ROWS).cast("int").alias("salts")), "shares")
    dealt = pairs.join(shares, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    wanted = dealt.select("a", "salt", F.lit(1).alias("kind"), F.col("b").alias("id")).unionByName(
        shares.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    )
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = wanted_rows(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null"), ids)
    rows = wanted.join(texts, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return rows.select("a", "salt", "kind", "id", "text").mapInPandas(_verified, "a long, b long").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest id reachable over ``edges`` (a, b), for every node that has an edge.

    Each round points every node at its smallest neighbour, follows pointers twice and contracts the edges, so that
    long chains shrink fast. Rounds are written to the shared checkpoint folder.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    for _ in range(most_rounds):
        if edges.isEmpty():
            return nodes
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            up = up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"))
        up = saved(up, "pointers")
        nodes = saved(nodes.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "nodes")
        edges = edges.join(up.toDF("a", "up_a"), "a").join(up.toDF("b", "up_b"), "b").where("up_a <> up_b")
        edges = saved(edges.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
    raise RuntimeError("edges still join different components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as ``doc_id, n_shingles, component_id, kept``.

    Equal sets fall together by fingerprint first. Each bucket then links its members to a centre; members of one
    bucket that are still in different components are compared two by two. Rows without words, and rows without an
    id, are linked with nothing; repeated rows are each returned; rows with one id and different texts are each linked
    by their own text, under that id. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = saved(describe(docs), "sketches")
    usable = base.where("n > 0 and doc_id is not null")
    classes = saved(usable.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    firsts = classes.select("print_a", "print_b", F.col("rep").alias("doc_id"))
    reps = usable.select("doc_id", "print_a", "print_b", "bands").join(firsts, ["doc_id", "print_a", "print_b"]).select(F.col("doc_id").alias("rep"), "bands")
    members = saved(shared_bands(reps).distinct(), "buckets")
    busy = saved(members.select(F.col("rep").alias("id")).distinct(), "busy")
    lows = saved(wanted_rows(usable.select(F.col("doc_id").alias("id"), "n", "low"), busy).join(busy, "id").select(F.col("id").alias("rep"), "n", "low").distinct(), "lows")
    components = spark.createDataFrame([], "node long, root long")
    links = tested = spark.createDataFrame([], "a long, b long")
    # Stars around the middles of buckets join most of each group; then nearest partners; then every pair still apart.
    few = members.where(F.col("key").bitwiseAND(F.lit(BANDS - 1)) < FIRST_BANDS)
    for step, among in (("star", few), ("star", members), ("nearest", members), ("all", members)):
        mixed = mixed_buckets(among, components)
        pairs = star_candidates(mixed, lows) if step == "star" else cross_candidates(mixed, lows, step == "nearest")
        pairs = saved(pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        fresh = saved(verify(pairs, docs), "links")
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            components = connected_components(links)
    roots = saved(classes.join(components, F.col("rep") == F.col("node"), "left").select("print_a", "print_b", "rows", F.coalesce("root", "rep").alias("component_id")), "roots")
    # Few sets can be that common; all others have a bounded share of the rows and meet by a shuffle.
    hot = F.col("rows") > (classes.agg(F.sum("rows")).first()[0] or 0) / HOT_PART
    common = usable.select("doc_id", "n", "print_a", "print_b").join(F.broadcast(roots.where(hot)), ["print_a", "print_b"], "left")
    rest = common.where("component_id is null").select("doc_id", "n", "print_a", "print_b").join(roots.where(~hot), ["print_a", "print_b"])
    found = common.where("component_id is not null").unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = base.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id, all its columns untouched.

    Of repeated rows (one id and one text) one stays; rows without an id stay all. Only rows that are dropped or
    repeated, and the few that the filter of their ids lets pass, are shuffled.
    """
    told = near_duplicates(docs).where("doc_id is not null")
    odd = saved(told.groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1").select("id", "kept"), "dropped")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    marked = marked_rows(rows, odd)
    met = marked.where("wanted").join(odd, "id", "left")
    once = met.where("kept").withColumn("text", F.col("row.text")).dropDuplicates(["id", "text"]).select("row")
    return marked.where("not wanted").select("row").unionByName(met.where("kept is null").select("row")).unionByName(once).select("row.*")
