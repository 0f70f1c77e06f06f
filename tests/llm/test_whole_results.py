"""Whole results of the training-data queries against plain versions, and their stages on awkward tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelattice.llm import ann, decontaminate, html_text, near_dup, packing, quality, token_files, toxicity, url_lists, warc, words
from cuelattice.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def awkward(spark, tmp_path):
    """Tables with nulls, empty and very long texts, ties, repeated rows, and columns named like results."""
    long = "The harbour of the town was quiet and the boats were in for the night, as they had been. " * 3000
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, "one two three", "en", "s", 13), (4, "one two three", "en", "s", 13),
        (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)), (7, "A" * 200_000, "en", "s", 200_000), (None, "no id here at all", None, None, None), (8, "x", "en", None, -1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(f"own {c}") for c in ("score", "predicted", "id", "row", "wanted", "kept", "label", "words", "length", "piece")}
    docs = docs.withColumns(extra)
    folder = tmp_path / "sf"
    spark.createDataFrame([(4, 1, 0), (5, None, 1), (5, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, "a sentence that stands in none of these documents"), (None, "x")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return docs, str(folder)


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, tmp_path, name):
    docs, folder = awkward(spark, tmp_path)
    stage = dict(corpus_pipeline.STAGES)[name]
    for df in (docs, docs.limit(0)):
        got = stage(spark, df, folder)
        rows = got.collect()
        assert len(rows) <= 1000
        if name != "packing":
            assert got.columns == docs.columns and all(r["score"] == "own score" for r in rows)
        if name == "near_duplicates" and rows:
            # Of the repeated row, and of the two equal texts, one stays each; what has no words or no id stays.
            assert sorted((r["doc_id"] for r in rows), key=str) == [1, 2, 3, 4, 5, 7, 8, None]
        if name == "decontamination" and rows:
            # The item without an id is found too, as a word.
            assert 8 not in {r["doc_id"] for r in rows} and len(rows) == 9
        if name == "packing" and rows:
            held = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
            assert held == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}


def test_toxicity_scores_equal_trying_all_readings(spark):
    bad = ["vilebeast", "nastyword"]
    rng = np.random.default_rng(2)
    filler = lambda: " ".join("".join(rng.choice(list("aeioumnrst"), 6)) for _ in range(20))
    rows = [(i, filler() + (f" {bad[i % 8 // 4]} vile sty" if i % 4 == 0 else " calm sea")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))

    def readings(token):
        ends: dict = {}

        def go(arcs, text, score, state):
            if not arcs:
                ends[state] = max(ends.get(state, (-1e9, "")), (score, text))
                return
            for written, weight in arcs[0]:
                s, (a, b) = score + weight, state
                for c in written:
                    k = toxicity._code(c)
                    if k or b:
                        s += model.characters.after(a, b, k)
                        a, b = b, k
                go(arcs[1:], text + written, s, (a, b))

        go(toxicity.lattice(token), "", 0.0, (0, 0))
        last = sorted(((s + (model.characters.after(a, b, 0) if b else 0.0), t) for (a, b), (s, t) in ends.items()), reverse=True)[:4]
        return [t for _, t in last]

    weight = lambda w: max((model.weights.get(f, 0.0) for f in toxicity.features(w)), default=0.0)

    def plain(text):
        total = model.bias
        for w in set(text.lower().split()):
            core, own = toxicity.suspicious(w), w.strip(toxicity.EDGES)
            parts = [own] if own else []
            parts += [p for t in readings(core) for p in t.split()] if core else []
            total += max((weight(p) for p in parts), default=0.0)
        for run in toxicity.SPACED.findall(text.lower()):
            total += max((weight(p) for t in readings(run) for p in (*t.split(), t.replace(" ", ""))), default=0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    said = ["v1leb3ast", "n@5ty word", "calm, sea!", "v i l e b", "naaastyword.", "a.b", "", "plain VILEBEAST!", "nas-ty"]
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), model).collect()
    for r in got:
        assert abs(r["score"] - plain(r["text"])) < 1e-4, r["text"]
    assert max(r["score"] for r in got) > 0.5 > min(r["score"] for r in got)


def test_toxicity_learns_from_unlike_rows(spark):
    """Copies of one clean row don't outweigh unlike ones, and unlike rows are all counted."""
    sets = [set(f"w{i}x{j}" for j in range(40)) for i in range(50)]
    marks = [tuple(toxicity._marks(s)) for s in [*sets, sets[0], set()]]
    assert len(set(marks)) == 51 and marks[50] == marks[0]


def test_quality_scores_equal_the_sum_over_pairs(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert set(got) == set(documents)
    for i in sorted(documents)[::9]:
        ids, x = quality.vector(documents[i]["text"] or "", documents[i]["n_chars"])
        v = model.factors[ids]
        z = model.bias + model.linear[ids] @ x + sum((v[a] @ v[a + 1 :].T) @ x[a + 1 :] * x[a] for a in range(len(ids)))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-6


def test_nearest_recall_of_the_query(spark):
    v = ann.usable(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    ids, x = np.array([r["vec_id"] for r in v]), np.array([r["v"] for r in v], dtype=float)
    got: dict = {}
    for r in QUERIES["op3_nearest"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == sorted(ids[ids % 20 == 0].tolist())
    hits = want = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits, want = hits + len({i for i, _ in found} & set(order)), want + len(order)
        assert len(found) == len(order) and all(abs(score - float(s[ids == i][0])) < 1e-9 for i, score in found)
    assert hits / want >= 0.9


def test_nearest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 400)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    got: dict = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(f) & {int(i) for i in np.argsort(-(x @ x[q])) if i != q and i in set(np.argsort(-np.where(np.arange(1200) == q, -np.inf, x @ x[q]))[:10].tolist())}) for q, f in got.items())
    assert len(got) == 60 and hits / 600 >= 0.9


def test_no_vectors_no_neighbours(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def scanned(items, documents):
    """Every item over every whole text, without pieces: the plain version of the search."""
    out = {}
    low = {d: decontaminate.normalise(r["text"] or "") for d, r in documents.items()}
    for i, text in items:
        norm = decontaminate.normalise(text or "")
        masks, k = decontaminate.alphabet_masks(norm), int(decontaminate.RATE * len(norm))
        for d, t in low.items():
            if norm and (got := decontaminate.best_end(masks, len(norm), t, k)):
                out[d, i] = got[0]
    return out


def test_leaks_of_the_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    few = dict(sorted(documents.items())[::3])
    want = scanned(items, few)
    assert {k: v for k, v in got.items() if k[0] in few} == want


def test_short_items_are_found_as_words(spark):
    items = [(1, "tea?"), (2, "Red  Kite"), (3, "exactly nineteen xx"), (4, "a"), (5, "c++")]
    texts = ["steam and teas", "Tea? Yes.", "a red\nkite, flying", "redkite red kites", "exactly nineteen xx.", "exactly nineteen xy", "in c++ or d", "c++x", None]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (2, 4, 0), (4, 3, 0), (6, 5, 0)}


def test_components_of_the_query(spark, documents):
    import re

    sets = {}
    for i, r in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op6_near_duplicates"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_links_between_the_threshold_and_085_are_found(spark):
    """5,000 documents in pairs of a similarity from 0.75 to 0.85; a pair's link is the only one it has."""
    rng = np.random.default_rng(12)
    texts, wanted = [], 0
    for i in range(2500):
        n = int(rng.integers(60, 200))
        a = [f"d{i}w{j}" for j in range(n)]
        # One changed word in the middle spoils five shingles: s = (k - 5 m) / (k + 5 m) for m changes far apart.
        k, b = n - 4, list(a)
        most = int(k * 0.25 / (5 * 1.75))
        least = max(1, math.ceil(k * 0.15 / (5 * 1.85)))
        m = int(rng.integers(least, max(most, least) + 1))
        for at in np.linspace(5, n - 6, m).astype(int):
            b[at] = f"x{i}y{at}"
        texts += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (a, b))
        wanted += 100 * len(x & y) >= 75 * len(x | y)
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).where("not kept").collect()
    assert all(r["component_id"] == r["doc_id"] - 1 for r in got)
    assert wanted > 2000 and len(got) >= 0.999 * wanted


def test_a_hot_group_of_unlike_copies(spark):
    """A base text, copies of it that are like it but not like each other, and many documents that share one passage."""
    rng = np.random.default_rng(5)
    base = [f"b{j}" for j in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, 300):
        t = list(base)
        for at in rng.choice(np.arange(3, 117, 6), 2, replace=False):
            t[at] = f"c{i}a{at}"
        texts.append((i, " ".join(t)))
    passage = [f"p{j}" for j in range(60)]
    texts += [(1000 + i, " ".join(passage + [f"own{i}n{j}" for j in range(100)])) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in texts}


@pytest.mark.parametrize("block", [2048, 16])
def test_strangers_of_a_large_component_are_found(spark, monkeypatch, block):
    """A large component, alike strangers to it, and unlike rows of one bucket: every alike pair of different components is told."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "CHUNK_ROWS", 2 * block)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, near_dup.SIZE, dtype=np.uint64)
    rows = []
    for i in range(300):
        own = base.copy()
        at = rng.choice(np.arange(4, near_dup.SIZE), 150 if i % 50 == 7 else 60 if i < 200 else 330, replace=False)
        own[at] = rng.integers(0, 256, len(at), dtype=np.uint64)
        rows.append((i, 0 if i < 150 else i, own))
    lows = spark.createDataFrame([(i, 100, near_dup.packed(own).tobytes()) for i, _, own in rows], "rep long, n long, low binary")
    members = spark.createDataFrame([(int(k), i) for i, _, own in rows for k in near_dup.band_keys(near_dup.packed(own))], "key long, rep long")
    components = spark.createDataFrame([(i, c) for i, c, _ in rows if c != i], "node long, root long")
    sketch = np.array([own for _, _, own in rows])
    bands = sketch[:, : near_dup.BANDED].reshape(300, near_dup.BANDS, near_dup.ROWS)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if rows[i][1] != rows[j][1] and (sketch[i] == sketch[j]).sum() >= near_dup.LEAST_AGREEING and (bands[i] == bands[j]).all(axis=1).any()}
    mixed = near_dup.mixed_buckets(members, components)
    got = {tuple(r) for r in near_dup.cross_candidates(mixed, lows, False).collect()}
    assert got == want and len(want) > 1000
    best = {tuple(r) for r in near_dup.cross_candidates(mixed, lows, True).collect()}
    assert best <= want and {i for p in best for i in p} == {i for p in want for i in p}


def test_alike_pairs_of_a_bucket_of_many_strangers(spark):
    """Over 4,096 unlike sketches share one band, and sixty alike ones share that band alone: all their pairs are told."""
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 63, near_dup.SIZE, dtype=np.uint64)
    rows = []
    for i in range(4300):
        own = rng.integers(0, 1 << 63, near_dup.SIZE, dtype=np.uint64)
        own[:4] = base[:4]
        if i >= 4240:
            own[near_dup.BANDED :] = base[near_dup.BANDED :]
        rows.append((i, near_dup.packed(own)))
    lows = spark.createDataFrame([(i, 100, low.tobytes()) for i, low in rows], "rep long, n long, low binary")
    members = near_dup.shared_bands(spark.createDataFrame([(i, near_dup.band_keys(low).tolist()) for i, low in rows], "rep long, bands array<long>"))
    mixed = near_dup.mixed_buckets(members, spark.createDataFrame([], "node long, root long"))
    got = {tuple(r) for r in near_dup.cross_candidates(mixed, lows, False).collect()}
    assert got == {(i, j) for i in range(4240, 4300) for j in range(i + 1, 4300)}


def test_bitmap_of_wanted_ids(spark):
    rows = spark.range(5000).withColumnRenamed("id", "id")
    ids = spark.range(0, 5000, 7)
    few = near_dup.marked_rows(rows, ids).where("wanted").collect()
    assert {r["id"] for r in ids.collect()} <= {r["id"] for r in few} and len(few) < 800
    # A filter that has filled up lets rows pass; none that is wanted is lost.
    full = near_dup.marked_rows(rows, ids, 64).where("wanted").collect()
    assert {r["id"] for r in ids.collect()} <= {r["id"] for r in full}
    assert near_dup.marked_rows(rows, ids.limit(0)).where("wanted").count() == 0


def test_places_of_the_query(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = QUERIES["op7_packing"](spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    want = set()
    for i, r in documents.items():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 if len(ids) > 2048 else 0
        starts = ([0] if first else []) + list(range(first, len(ids), 2048))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.add((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert set(zip(got["doc_id"], got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want and len(got) == len(want)
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1


def test_both_engines_give_the_same_ids():
    t = packing.tokenizer_at(tokenizer_path())
    assert t.latin
    said = ["", " ", "a　b 日本語 ０１ ٠\U0001f600\U0001f600", " \n \n\n x \t", "word " * 5000, "ßİǅ don't I'LL", "​­﻿", "<|endoftext|> x", "z" * 50_000]
    assert all(np.array_equal(t.ids(x), t._exact(x)) for x in said)
    rng = np.random.default_rng(1)
    pool = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x400), *range(0x5D0, 0x5EA), *range(0x900, 0x940), *range(0x2000, 0x2070), *range(0x3040, 0x30A0))]
    for _ in range(300):
        x = "".join(rng.choice(pool, 60)) + "  \n" + "".join(rng.choice(pool, 20))
        assert np.array_equal(t.ids(x), t._exact(x))


def test_two_for_one_tries_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = Counter(rng.integers(1, 60, 40).tolist())
        left = Counter(counts)
        for bin_, times in packing.best_two_fit(dict(counts), 64):
            left.subtract({k: v * times for k, v in Counter(bin_).items()})
            assert sum(bin_) <= 64
        assert not +left and not -left


def test_token_files_of_a_prime_count(spark, tmp_path):
    t = np.random.default_rng(4).integers(0, 9, 10_007).astype("<u2")
    t.tofile(tmp_path / "prime.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_files.read_blocks(spark, str(tmp_path), block_bytes=1000, range_bytes=3000).orderBy("block").collect()
    assert len(blocks) == 21 and b"".join(bytes(b["payload"]) for b in blocks) == t.tobytes()
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        token_files.read_blocks(spark, str(tmp_path)).collect()
    null = spark.createDataFrame([("f", 0, None), ("f", 1, np.array([1, 5, 2], dtype="<u2").tobytes())], "file string, block long, payload binary")
    assert [(r["doc"], r["start"], r["tokens"]) for r in token_files.documents_of(null, 5).orderBy("doc").collect()] == [(0, 0, 1), (1, 2, 1)]


def test_warc_of_the_query(spark):
    pages = {f"<urn:page:{r['page_id']}>": r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op8_warc"](spark, SF).collect()
    assert Counter(r["record_type"] for r in rows) == {"metadata": len(pages), "conversion": sum(bool(p["html"]) for p in pages.values())}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in rows:
        page = pages[r["refers_to"]]
        assert r["target_uri"] == (page["url"] or "") and r["source_payload_digest"] == sha((page["html"] or "").encode())
    made = warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{SF}/pages.parquet"))).collect()
    for r in made:
        block = bytes(r["block"])
        assert r["block_digest"] == sha(block) == r["headers"]["WARC-Payload-Digest"] and r["content_length"] == len(block)
        if r["record_type"] == "conversion":
            seen = Seen(pages[r["refers_to"]]["html"])
            assert set(block.decode().split("\n")) <= seen.chunks
        else:
            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
            assert fields["http-status"] == "200" and fields["source-payload-length"] == str(len(pages[r["refers_to"]]["html"].encode()))


def test_encoded_payloads_are_decoded(spark):
    page = "<p>Schöne Grüße aus dem Hafen</p>".encode()
    packed = gzip.compress(page)
    chunks = b"".join(f"{len(packed[i : i + 9]):x};x=1\r\n".encode() + packed[i : i + 9] + b"\r\n" for i in range(0, len(packed), 9)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    cases = {
        "chunked gzip": head + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks,
        "deflate": head + b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(page),
        "cut": head + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(page * 50)[:-12],
        "unknown": head + b"Content-Encoding: br\r\n\r\n" + page,
        "no type": b"HTTP/1.1 200 OK\r\n\r\n" + page,
        "binary": b"HTTP/1.1 200 OK\r\n\r\n\x00\x01" + page,
        "bare": page,
        "long": head + b"\r\n" + page * 20_000,
    }
    rows = [(k, "u", "d", v) for k, v in cases.items()] + [("null", None, None, None), ("bare", "u", "d", page), (None, "u", "d", page)]
    got = warc.derivatives(spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block binary")).collect()
    text = {r["refers_to"]: bytes(r["block"]).decode() for r in got if r["record_type"] == "conversion"}
    assert all(text[k].split("\n")[0] == "Schöne Grüße aus dem Hafen" for k in ("chunked gzip", "deflate", "cut", "no type", "bare"))
    assert set(text) == {"chunked gzip", "deflate", "cut", "no type", "bare", "long"} and text["long"].count("\n") == 19_999
    assert Counter(r["refers_to"] for r in got)["bare"] == 4 and Counter(r["refers_to"] for r in got)["null"] == 1


def test_url_lists_of_empty_tables(spark):
    entries = spark.createDataFrame([("l", "bad.com", "add", "2024-01-01")], "list_name string, pattern string, action string, entry_ts string")
    captures = spark.createDataFrame([(1, "http://bad.com/", "2024-02-01", "x")], "capture_id long, url string, fetch_ts string, blocked string")
    assert url_lists.evaluate(captures.drop("blocked"), entries.limit(0)).select("n_active", "blocked").collect() == [(0, False)]
    assert url_lists.evaluate(captures.drop("blocked").limit(0), entries).count() == 0


class Seen(HTMLParser):
    """The visible pieces between block elements, read by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.chunks, self.buffer, self.unseen = set(), [], 0
        self.feed(page or "")
        self.close()
        self.cut()

    def cut(self):
        self.chunks.add(" ".join("".join(self.buffer).split()))
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.UNSEEN:
            self.unseen += 1
        elif tag == "br":
            self.buffer.append(" ")
        elif tag in html_text.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in html_text.UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag in html_text.BLOCKS:
            self.cut()

    def handle_data(self, data):
        if not self.unseen:
            self.buffer.append(data)


def test_texts_of_the_query_are_whole_blocks_of_their_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_html_text"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        assert not r["text"] or set(r["text"].split("\n\n")) <= Seen(pages[r["page_id"]]).chunks


def test_pages_in_other_languages(spark):
    body = "Latarnik liczył statki, zanim mgła nadeszła z zachodu i zakryła port. Nikt nie wiedział, ile ich było tej nocy. " * 3
    menu = "<ul>" + "<li><a href='/a'>Strona główna portu i jego okolic</a></li>" * 8 + "</ul>"
    japanese = "灯台守は霧が西から来る前に四十隻の船を数えた。その夜、港に何隻いたのかを知る者はいなかった。" * 5
    page = f"<body>{menu}<div><p>{body}</p><p>{body}</p></div><div>{menu}</div></body>"
    assert html_text.main_text(page) == "\n\n".join([" ".join(body.split())] * 2)
    assert html_text.main_text(f"<div><p>{japanese}</p></div>{menu}") == japanese
    rows = [(1, "u", page)] * 2
    assert [r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [html_text.main_text(page)] * 2


def test_pipeline_equals_its_stages_read_in_order(spark, documents):
    got = corpus_pipeline.run(spark, SF).toPandas()
    docs, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, lab)
    mild = [i for i, r in sorted(documents.items()) if model.score(r["text"] or "") < 0.5]
    left = docs.where(F.col("doc_id").isin(mild))
    fm = quality.fit_quality(left, lab)
    good = []
    for i in mild:
        ids, x = quality.vector(documents[i]["text"] or "", documents[i]["n_chars"])
        if 1 / (1 + math.exp(-max(-30, min(30, float(fm.logits(ids, x, np.array([0]))[0]))))) >= 0.3:
            good.append(i)
    sets = {i: words.shingles(words.ascii_words(documents[i]["text"] or "")) for i in good}
    up = {i: i for i in good}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if len(sets[i]) and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    kept = [i for i in good if root(i) == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in scanned(items, {i: documents[i] for i in kept})}
    assert set(got["doc_id"]) == set(kept) - leaked
