"""The training-data operators against plain versions, on small and awkward inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import ann, decontaminate, html_text, near_dup, packing, quality, token_files, toxicity, url_lists, warc, words
from cuelattice.llm.common import held_out
from cuelattice.llm.queries import END_OF_TEXT, OP10_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = "word " * 30_000
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, "   \n ", "en", "s", 4, None, None), (4, "one two three", "en", "s", 13, "a", "b"), (4, "one two three", "en", "s", 13, "a", "b"), (5, long, "en", "s", len(long), "a", "b"), (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)] + [(4, None, None)], "doc_id long, quality int, toxic int")


def lines(spark, n=300):
    """Labelled texts in which some words, or signs, decide."""
    bad = ["vilebeast", "grotescum", "nastyword"]
    rng = np.random.default_rng(1)
    rows, lab = [], []
    for i in range(n):
        text = " ".join("".join(rng.choice(list("aeioumnrst"), 6)) for _ in range(30))
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        rows.append((i, text + (" " + " ".join(rng.permutation(bad)[:2]) if toxic else "") + ("" if good else "\n" + "JUNK!! " * 20), "en", "s", 200))
        lab.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, lab = lines(spark)
    model = toxicity.fit_toxicity(docs, lab)
    out = toxicity.score_toxicity(docs, model).join(lab, "doc_id")
    assert out.where("predicted <> toxic").count() == 0
    for said in ("v1lebeast!", "n a s t y w o r d", "grrrrotescum", "v.i.l.e.b.e.a.s.t", "n@5tyw0rd"):
        assert model.score(said) >= 0.5, said
    assert model.score("mensa tiresou") < 0.5
    got = toxicity.score_toxicity(awkward(spark), model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_without_rows(spark):
    docs, lab = lines(spark, 5)
    model = toxicity.fit_toxicity(docs.limit(0), lab.limit(0))
    assert 0 <= model.score("") <= 1 and toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_viterbi_is_the_best_reading(spark):
    counts = Counter()
    for w in ["stupid", "moron", "stone", "print"]:
        c = [0, 0, *(toxicity._code(x) for x in w), 0]
        counts.update(zip(c, c[1:], c[2:], strict=False))
    grams, n = zip(*[(a * 64 * 64 + b * 64 + c, 50 * k) for (a, b, c), k in counts.items()], strict=True)
    model = toxicity.CharacterModel(grams, n)
    assert toxicity.decode("m0r0n", model)[0][0] == "moron"
    assert toxicity.decode("5tuuup1d", model)[0][0] == "stupid"

    def readings(arcs, text="", score=0.0, state=(0, 0)):
        if not arcs:
            yield score + (model.after(*state, 0) if state[1] else 0.0), text
            return
        for written, weight in arcs[0]:
            s, (a, b) = score + weight, state
            for c in written:
                k = toxicity._code(c)
                if k or b:
                    s += model.after(a, b, k)
                    a, b = b, k
            yield from readings(arcs[1:], text + written, s, (a, b))

    for token in ("m0r0n", "5t.up1d", "pr11nt"):
        assert abs(max(readings(toxicity.lattice(token)))[0] - toxicity.decode(token, model)[0][1]) < 1e-4


def test_quality(spark):
    docs, lab = lines(spark)
    model = quality.fit_quality(docs, lab)
    out = quality.score_quality(docs, model).join(lab, "doc_id")
    assert out.where("predicted <> quality").count() == 0
    got = quality.score_quality(awkward(spark), model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.score_quality(docs.drop("n_chars").limit(0), quality.fit_quality(docs.limit(0), lab)).count() == 0


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(fm.factors[ids[i]] @ fm.factors[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(fm.logits(ids, x, np.array([0]))[0], 0.3 + fm.linear[ids] @ x + pairs)


def test_held_out_rows(spark):
    got = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def plain_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 150))))
        for _ in range(12):
            t = list(base)
            for _ in range(int(rng.integers(0, 8))):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
            texts.append((len(texts) * 3 + 1, " ".join(t)))
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One TWO"), (1004, "one two"), (1005, "one two ")]
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_awkward(spark):
    got = near_dup.near_duplicates(awkward(spark)).collect()
    assert len(got) == 7
    assert all(r["kept"] for r in got)
    assert near_dup.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_pairs_meet_in_the_first_band_whose_bytes_agree(spark):
    """Coordinates that agree in their kept bytes only, by chance, in a band before the first in which they agree."""
    rng = np.random.default_rng(39)
    a = rng.integers(0, 1 << 63, near_dup.SIZE, dtype=np.uint64)
    b = a.copy()
    b[:8] ^= np.uint64(1 << 20)  # bands 0 and 1 agree in the kept bytes alone
    b[rng.choice(np.arange(0, 60, 4)[2:], 5, replace=False)] ^= np.uint64(1)
    low = [near_dup.packed(x) for x in (a, b)]
    equal, shared = near_dup.agreeing(*(x[None, :] for x in low))
    assert len(low[0]) == near_dup.WIDTH and equal[0] == near_dup.SIZE - 5 and shared[0].argmax() == 0
    keys = [near_dup.band_keys(x) for x in low]
    assert ((keys[0] == keys[1]) == shared[0]).all() and (keys[0] & (near_dup.BANDS - 1)).tolist() == list(range(near_dup.BANDS))
    lows = spark.createDataFrame([(i, 100, x.tobytes()) for i, x in enumerate(low)], "rep long, n long, low binary")
    reps = spark.createDataFrame([(i, k.tolist()) for i, k in enumerate(keys)], "rep long, bands array<long>")
    mixed = near_dup.mixed_buckets(near_dup.shared_bands(reps), spark.createDataFrame([], "node long, root long"))
    for best_only in (True, False):
        assert [tuple(x) for x in near_dup.cross_candidates(mixed, lows, best_only).collect()] == [(0, 1)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert near_dup.sketch(a).max() < near_dup._EMPTY
        b = np.concatenate([a[: n * 4 // 5], rng.integers(0, 1 << 63, n - n * 4 // 5, dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dup.sketch(a) == near_dup.sketch(b)).mean() - true) < 0.12


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in near_dup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def plain_distance(p, s):
    row = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(s, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_and_leaks(spark):
    rng = np.random.default_rng(6)
    for _ in range(200):
        p, s = ("".join(rng.choice(list("abc"), int(n))) for n in (rng.integers(1, 25), rng.integers(0, 50)))
        got = decontaminate.best_end(decontaminate.alphabet_masks(p), len(p), s, len(p))
        assert (got[0] if got else len(p)) == plain_distance(p, s)
    letters = list("abcdefghij ")
    items = [(i, "".join(rng.choice(letters, 60))) for i in range(6)] + [(98, "short"), (99, None)] + [(90 + n, "".join(rng.choice(letters, 10 + n))) for n in range(6)]
    docs = []
    for n in range(60):
        body = list("".join(rng.choice(letters, 150)))
        if n % 2:
            t = list(items[n % 6][1])
            small = list(items[8 + n % 6][1].strip() or "x")
            small[len(small) // 2] = "z" if n % 3 else small[len(small) // 2]
            body[20:20] = small
            for _ in range(n % 9):
                t[int(rng.integers(len(t)))] = "z"
            body[70:70] = t
        docs.append((n, "".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1].upper())]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            norm = decontaminate.normalise(x or "")
            if int(decontaminate.RATE * len(norm)) and t:
                k = plain_distance(norm, decontaminate.normalise(t))
                if k <= int(decontaminate.RATE * len(norm)):
                    want[d, i] = k
    assert got == want and sum(1 for d, i in want if i >= 90 and want[d, i] == 1) > 5
    said = [(1, "so THE  brawn foxes ran"), (2, "a cat, sat"), (3, "the cats at"), (4, "the brown foxes"), (5, "the  brwn fxes")]
    few = decontaminate.find_leaks(spark.createDataFrame(said, "doc_id long, text string"), spark.createDataFrame([(1, "the brown foxes"), (2, "cat")], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in few.collect()) == [(1, 1, 1), (2, 2, 0), (4, 1, 0)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_leaks(awkward(spark), none).count() == 7 and decontaminate.find_leaks(awkward(spark), none).count() == 0


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "x <|endoftext|> y"), (10_003, "a  b \n \n c "), (10_004, "w, " * 9000), (10_004, "w, " * 9000)], "doc_id long, text string")
    got = packing.pack_documents(docs.unionByName(more), tokenizer_path()).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in docs.unionByName(more).collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter(zip(got["doc_id"], got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) * 1.02 + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_two_for_one_fills_tighter():
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert bins[0] == ((6, 2, 2), 1)
    used = Counter()
    for b, n in bins:
        assert sum(b) <= 10
        used.update({k: v * n for k, v in Counter(b).items()})
    assert used == {6: 1, 3: 1, 2: 2}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- c --><div class="ad">Buy now</div><div id="main-content"><h1>The title</h1><p>It was the best of the times and it was in the house that they had for the year,
and all of it was more than the man could say to them when he was out with the others on the road to the town.<br>It was the age of the wise and of the rest, and that is all that there is to it for now and for the rest of us.</p>
<p>Short &amp; sweet&nbsp;one.</p><form><p>Your name</p></form><p>They were in the house and it was the same as it had been when they left it for the town, and there was no more of it than that which they had with them on the way to the
old place that was on the hill by the road, so they went out of it and to the next one.</div><div class="comments"><p>I think that it is the best that I have read of all of the things that are on this site, and so it is.</p></div>
<aside>More</aside><footer>&copy; us</footer>"""


def test_html(spark):
    text = html_text.main_text(PAGE)
    assert text.split("\n\n")[0] == "The title" and "Short & sweet one." in text.split("\n\n")
    assert not re.search(r"Buy|Home|think|More|©|name|var|T$", text)
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<p>a<b>b</b>c<br>d", "x"), (4, "u", "a < b", "x"), (5, "u", "<article>" + "<p>x y" * 20_000, "x")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1] == got[2] == ("", 0) and got[3] == ("abc d", 5) and got[4] == ("a < b", 5) and got[5][1] == 20_000 * 3 + 19_999 * 2


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x *= rng.uniform(0.5, 2, size=(3000, 1))
    x[7] = x[6]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    bad = [(20_000, None, "c"), (20_020, [0.0] * 24, "c"), (20_040, [float("nan")] * 24, "c"), (20_060, [None] * 24, "c"), (20_080, [1.0] * 3, "c"), (None, [1.0] * 24, "c"), rows[0]]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, rank string")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda z: (-z[1], z[0])) and all(abs(v - x[i] @ x[q]) < 1e-9 for i, v in found)
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(spark.createDataFrame(bad[:5], "vec_id long, embedding array<double>, rank string")).count() == 0


def test_token_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    for f in range(3):
        rng.integers(0, 12, 5000 + 7 * f).astype("<u2").tofile(tmp_path / f"{f}.bin")
    np.array([3, 3, 0], dtype="<u2").tofile(tmp_path / "9.bin")
    want = set()
    for p in tmp_path.glob("*.bin"):
        t, start, doc = np.fromfile(p, dtype="<u2"), 0, 0
        for at in [*np.flatnonzero(t == 3).tolist(), len(t)]:
            if at < len(t) or start < len(t):
                want.add((p.name, doc, start, at - start))
            start, doc = at + 1, doc + 1
    blocks = token_files.read_blocks(spark, str(tmp_path / "*.bin"), block_bytes=256)
    got = [(r["file"].rsplit("/", 1)[1], r["doc"], r["start"], r["tokens"]) for r in token_files.documents_of(blocks, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert token_files.documents_of(blocks.limit(0), 3).count() == 0


def test_separators_of_documents(spark):
    got = sorted(r["tokens"] for r in QUERIES["op2_separators"](spark, SF).collect())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert got == sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts) and END_OF_TEXT == tokenizer.token_to_id("<|endoftext|>")


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>Grüße <b>all</b></p><nav>Menu</nav>"), (2, None, None), (3, "http://c/", "")], "page_id long, url string, html string")
    responses = warc.responses_of_pages(pages)
    made = warc.derivatives(responses)
    warc.write_warc(made.coalesce(1), str(tmp_path / "out"))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "out")).collect()}
    rows = made.collect()
    assert {r["record_id"] for r in rows} == set(back) and len(rows) == 4
    for r in rows:
        b = back[r["record_id"]]
        assert b["whole"] and bytes(b["block"]) == bytes(r["block"]) and b["refers_to"] == r["refers_to"] and r["block_digest"] == warc.digest(bytes(r["block"]))
    text = next(r for r in rows if r["record_type"] == "conversion")
    assert bytes(text["block"]).decode() == "Grüße all\nMenu"
    raw = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Target-URI", "http://z/")], b"HTTP/1.1 404 Not\r\nX-A: 1\r\n\r\nhi")
    (tmp_path / "one.warc").write_bytes(raw * 2)
    read = warc.read_warc(spark, str(tmp_path / "one.warc"))
    assert read.count() == 2 and warc.split_http(bytes(read.first()["block"])) == (404, {"x-a": "1"}, b"hi")
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_warc_versions_and_version_lines_in_blocks(spark, tmp_path):
    blocks = [b"a page on\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nand WARC/1.WARC/1.1\r\n its end", b"", b"plain", b"WARC/1.1\r\n"]
    raw = [warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b) for i, b in enumerate(blocks)]
    newer = [x.replace(b"WARC/1.0", b"WARC/1.1", 1) for x in raw]
    cut = raw[2].replace(b"Content-Length: 5", b"Content-Length: 50")
    for name, data, wanted in (("old", raw, blocks), ("new", newer, blocks), ("mixed", [raw[0], newer[2]], [blocks[0], blocks[2]])):
        (tmp_path / name).write_bytes(b"".join(data))
        got = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert [bytes(r["block"]) for r in got] == wanted and all(r["whole"] for r in got)
    (tmp_path / "cut").write_bytes(cut + raw[3] + cut)
    assert [r["whole"] for r in warc.read_warc(spark, str(tmp_path / "cut")).collect()] == [False, True, False]


def test_url_lists(spark):
    import duckdb

    entries = spark.createDataFrame(
        [("l", "*.Bad.com", "add", "2024-01-01"), ("l", "bad.com", "add", "2024-01-05"), ("l", "bad.com", "remove", "2024-02-01"), ("m", "x.bad.com", "add", "2024-01-10"), ("l", "bad.com", "add", "2024-03-01"), ("l", "bad.com", "remove", "2024-03-01"), (None, "bad.com", "add", "2024-01-01"), ("l", "", "add", "2024-01-01")],
        "list_name string, pattern string, action string, entry_ts string",
    )
    captures = [(1, "http://u@X.Bad.com.:80/p", "2024-01-15"), (2, "http://bad.com", "2024-02-01"), (3, "http://notbad.com", "2024-01-15"), (4, None, "2024-01-15"), (5, "http://bad.com", None), (6, "http://bad.com/", "2024-01-01"), (7, "http://bad.com/", "2024-03-02"), (1, "http://u@X.Bad.com.:80/p", "2024-01-15")]
    got = {r["capture_id"]: (r["n_active"], r["lists"], r["longest"], r["blocked"]) for r in url_lists.evaluate(spark.createDataFrame(captures, "capture_id long, url string, fetch_ts string"), entries).collect()}
    none = (0, "", None, False)
    assert got == {1: (2, "l,m", "x.bad.com", True), 2: none, 3: none, 4: none, 5: none, 6: (1, "l", "bad.com", True), 7: none}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = {tuple(map(str, r)) for r in con.sql(f"select page_id, host, fetch_s, n_active, lists, longest, blocked from ({OP10_SQL})").fetchall()}
    have = {tuple(str(r[c]) for c in ("page_id", "host", "fetch_s", "n_active", "lists", "longest", "blocked")) for r in QUERIES["op10_url_lists"](spark, SF).collect()}
    assert have == want


def test_word_hashes_tell_words_apart():
    a, b = words.ascii_words("The QUICK\tbrown 😀 fox"), words.ascii_words(" the quick  brown 😀\nfox ")
    assert (a == b).all() and len(set(a.tolist())) == 5
    assert (words.ascii_words("É") != words.ascii_words("é")).all()


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_quality", "op5_decontamination", "op9_html_text", "op8_warc", "op3_nearest"])
def test_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
