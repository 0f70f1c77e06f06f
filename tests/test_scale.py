"""Plans and batches that must not grow with the input: what once failed on larger tables."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.functions.text import clean_markup
from cuelattice.operators import align, docs, reconcile
from cuelattice.plans import q_align, q_docs
from cuelattice.sources import files, named_files
from cuelattice.sources.named_files import write_named

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def timeline(spark, tmp_path):
    """Characters and pairs that a generator makes of a small file, so that Spark takes them for small."""
    spark.createDataFrame([(0, "ab cd"), (1, "ef")], "track_id long, text string").write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t")).select("track_id", F.posexplode(F.split("text", "")).alias("idx", "ch"))
    chars = lambda: read().select("track_id", F.col("idx").cast("long").alias("idx"), "ch", (F.col("idx") * 80).cast("long").alias("start_ms"), (F.col("idx") * 80 + 80).cast("long").alias("end_ms"), F.lit(0).cast("long").alias("seg_pos"), F.col("idx").cast("long").alias("word_idx"))
    return chars(), chars(), read().where("idx % 2 = 0").select("track_id", F.col("idx").cast("long").alias("p"), F.col("idx").cast("long").alias("c"))


def test_characters_are_never_broadcast(timeline):
    chars, caption, pairs = timeline
    for df in (align.local_coverage(chars, pairs, 1), align.word_to_caption_range(chars, caption, pairs)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert align.local_coverage(chars, pairs, 1).count() == 7


def test_no_frame_is_open_at_its_end(timeline):
    """Spark reads such a frame anew for each row, which is quadratic in a track's characters."""
    chars, caption, pairs = timeline
    for df in (align.word_to_caption_range(chars, caption, pairs), align.segment_alignment(chars, caption, pairs)):
        assert "unboundedfollowing" not in plan(df).lower()


def test_segments_say_what_each_word_is(spark):
    """What captions say of each word is returned, not worked out and dropped (F7)."""
    got = q_align.QUERIES["segment_alignment"](spark, "/root/testdata/sf0.001").select("caption_text", "word_captions").collect()
    assert all("".join(json.loads(r["word_captions"]).values()) == r["caption_text"] for r in got) and any(r["caption_text"] for r in got)


def test_lengths_count_what_is_written(spark):
    """Folding makes two letters of ß; a paragraph one letter short stays short."""
    short, long = "Stra\u00dfe " + "x" * 153, "Stra\u00dfe " + "x" * 154
    d = spark.createDataFrame([(1, "t", short, short), (2, "t", long, long)], "doc_id long, title string, body string, source_body string")
    assert {r["doc_id"]: r["warnings"] for r in docs.validate_documents(d).collect()} == {1: [], 2: ["SOURCE_BLOCK_COPIED"]}
    s = d.select(F.col("doc_id").alias("source_id"), F.col("source_body").alias("text"))
    assert [(r["doc_id"], r["source_id"]) for r in docs.copied_blocks(d, s).collect()] == [(2, 2)]


def test_copied_lines_are_those_of_the_sql(spark, tmp_path):
    """ß is no ss, wide spaces are signs, Σ has one small letter, and U+0001 parts nothing (F4)."""
    long = "x" * 40 + "gro\u00dfe stra\u00dfe \u03a3\u03a3 \u0130z" + "y" * 40
    wide = "a\u00a0b" * 30
    said = [long, long.upper(), long.replace("\u00df", "ss"), "s" + "y" * 60, wide, wide.replace("\u00a0", ""), "q" * 35 + "\x01" + "q" * 35, "q" * 70, "\x0bv" * 30, "v" * 60, long[:-30], None]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, long), (1, wide), (2, "\u00df" + "y" * 60), (3, said[6] + "\nz"), (4, said[8])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path / t}.parquet/*.parquet'")
    got = q_docs.QUERIES["copied_blocks"](spark, str(tmp_path))
    want = con.sql(q_docs.ORACLE_SQL["copied_blocks"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {0, 4, 6, 8, 10} <= {r[0] for r in want} and not {2, 3, 5, 7, 9} & {r[0] for r in want}


@pytest.mark.parametrize("ask", [
    lambda d, _: docs.drop_repeated_paragraphs(d), lambda d, _: docs.chunk_documents(d, 10), lambda d, _: docs.validate_documents(d), lambda d, _: d.select(clean_markup(F.col("body"))),
    lambda d, path: write_named(d.select(F.col("doc_id").cast("string").alias("name"), F.col("doc_id").cast("string").alias("key"), F.col("body").alias("value")), path),
])
def test_whole_texts_go_in_small_batches(spark, tmp_path, ask):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    d = spark.createDataFrame([(1, "t", "a b", "a b")], "doc_id long, title string, body string, source_body string")
    try:
        spark.conf.set(name, "10000")
        ask(d, str(tmp_path / "named"))
        assert 0 < int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)


def test_files_are_read_by_their_bytes(spark, tmp_path, monkeypatch):
    """However long files are, few bytes are held at once (F13); names hold what they may."""
    given = [(f"a\u2028\x85{i}.txt", f"k{i}", "é" * n) for i, n in enumerate((50, 50, 50, 400, 10, 0, 10))]
    named_files.write_named(spark.createDataFrame([*given, ("b.srt", "b", "")], "name string, key string, value string").coalesce(1), str(tmp_path / "f"))
    monkeypatch.setattr(named_files, "READ_AT_ONCE", 250)
    reader = named_files.NamedFilesReader(str(tmp_path / "f"), ".txt")
    batches = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert [len(b) for b in batches] == [2, 1, 1, 3] and [tuple(r.values()) for b in batches for r in b] == given


def test_exports_without_titles_need_no_python(spark):
    t = spark.createDataFrame([(k, i, i * 10, i * 10 + 5, f"said {i}") for k in (1, 2) for i in range(3)], "track_id long, seg_pos long, start_ms long, end_ms long, text string")
    bare = files.export_transcripts(t)
    assert "EvalPython" not in plan(bare)
    assert sorted(bare.collect()) == sorted(files.export_transcripts(t.withColumn("title", F.lit(None).cast("string"))).collect())


def test_anchors_of_words_are_those_of_their_characters(spark, monkeypatch):
    """Words cross the shuffle, once, not their characters; blocks come merged from the task that finds them (F10)."""
    rng = np.random.default_rng(10)
    said = lambda t, i: None if rng.random() < 0.03 else int(i * 900 + rng.integers(0, 4000)) if t else int(i * 400)
    make = lambda: [(f"t{t}", i // 9, i % 9, s, None if s is None or rng.random() < 0.03 else s + int(rng.integers(0, 3000)), "".join(rng.choice(list("abü"), rng.integers(0, 5)))) for t in range(3) for i in range(250) for s in [said(t, i)]]
    p, c = (spark.createDataFrame(make(), "track_id string, seg_pos int, word_idx long, start_ms long, end_ms long, text string") for _ in range(2))
    rows = lambda df: sorted(map(tuple, df.collect()))
    chars = [align.character_timeline(x, None) for x in (p, c)]
    want = rows(align.anchor_blocks(*chars))
    blocks = align.anchor_blocks(p, c)
    assert rows(blocks) == want and len(want) > 1000 and rows(align.anchor_blocks(p, chars[1])) == want
    merged = rows(align.anchor_blocks(p, c, merged=True))
    assert merged == rows(align.merge_diagonal_blocks(blocks)) and len(merged) < len(want)
    monkeypatch.setattr(align, "HITS_AT_ONCE", 100)
    monkeypatch.setattr(align, "ROWS_AT_ONCE", 300)
    found = align.anchor_blocks(p, c, merged=True)
    assert plan(found).count("Exchange ") == 1 and "Generate" not in plan(found)
    assert rows(found) == merged


@pytest.fixture
def said(spark):
    """Words of two random timelines, some empty, some without an end; of a third track the caption has none."""
    rng = np.random.default_rng(6)
    make = lambda: [(f"t{t}", i // 9, i % 9, i * 400 + int(rng.integers(0, 900)), None if rng.random() < 0.03 else i * 400 + int(rng.integers(100, 3000)), "".join(rng.choice(list("abü\U00020000"), rng.integers(0, 6)))) for t in range(3) for i in range(200)]
    p, c = (spark.createDataFrame(x, "track_id string, seg_pos int, word_idx long, start_ms long, end_ms long, text string") for x in (make(), [r for r in make() if r[0] != "t2"]))
    return p, c


def _pairs_of(p, c):
    return align.aligned_pairs(align.monotonic_chain(align.anchor_blocks(p, c, merged=True)))


def test_words_are_placed_without_dealing_characters(said, monkeypatch):
    """Words cross one shuffle, and places, coverage and matches are those of characters and pairs (F6)."""
    p, c = said
    chars, pairs = [align.character_timeline(x, None) for x in said], _pairs_of(p, c)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(align.word_to_caption_range(*chars, pairs))
    monkeypatch.setattr(align, "ROWS_AT_ONCE", 300)
    placed = align.word_to_caption_range(p, c)
    assert plan(placed).count("Exchange ") == 1 and "Generate" not in plan(placed) and "Join" not in plan(placed)
    assert rows(placed) == want and len(want) > 100
    assert rows(align.word_to_caption_range(*chars)) == want
    words = align.aligned_words(p, c)
    assert rows(words.select("track_id", "seg_pos", "word_idx", "coverage")) == rows(align.local_coverage(chars[0], pairs))
    assert rows(words.groupBy("track_id").agg((F.sum("matched") / F.sum("n")).alias("x"))) == rows(align.track_coverage(pairs, chars[0]))


def test_segments_are_aligned_without_dealing_words_again(said, monkeypatch):
    """A segment's row comes from the task that has its track, and is the one that characters and pairs give (F5)."""
    p, c = said
    monkeypatch.setattr(align, "ROWS_AT_ONCE", 300)
    near = lambda df: sorted(map(tuple, df.select("track_id", "seg_pos", "matched", F.round("coverage", 9), F.round("temporal_overlap", 7), "caption_text", F.to_json("word_captions")).collect()))
    got = align.segment_alignment(p, c)
    assert plan(got).count("Exchange ") == 1 and "Generate" not in plan(got) and "Join" not in plan(got)
    assert near(got) == near(align.segment_alignment(*[align.character_timeline(x, None) for x in said], _pairs_of(p, c)))


def test_evidence_of_words_is_that_of_their_characters(spark, said, monkeypatch):
    """Windows may cut words; a timeline by word says the same as by character, and no character is dealt or staged (F1, F2, F3)."""
    p, c = said
    w = [(t, k, k * 9_000 + 130, k * 9_000 + 8_130, [k * 25 + i for i in range(25)], k % 4 < 3) for t in ("t0", "t1", "t2") for k in range(9)]
    windows = spark.createDataFrame(w, "track_id string, win int, start_ms long, end_ms long, span_ids array<bigint>, selected boolean")
    spans = p.where("end_ms is not null").withColumn("span_id", F.col("seg_pos").cast("long") * 9 + F.col("word_idx")).drop("text")
    kept = windows.where("win <> 1").select("track_id", "win", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    heard = align.overlapping(c.where("end_ms is not null"), kept).drop("from_ms", "to_ms").withColumn("probability", F.col("word_idx") / 10)
    rows = lambda primary: sorted(map(str, reconcile.secondary_evidence(spans, windows, primary, heard, None).collect()))
    got = rows(p)
    assert got == rows(align.character_timeline(p, None)) and sum("partial_word" in r for r in got) > 5 and sum("secondary_words=[" in r for r in got) > 5
    kept, seen = reconcile.staged, []
    monkeypatch.setattr(reconcile, "staged", lambda df, name: seen.append(df.columns) or kept(df, name))
    segments = p.groupBy("track_id", "seg_pos").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    out = reconcile.reconcile(p.withColumn("probability", F.lit(0.5)), c, lambda _: heard, segments, "ko")
    assert out["segments"].count() == segments.count() and seen and not any("ch" in x or "p" in x for x in seen)


def test_merged_blocks_over_batches(spark):
    """Runs of blocks that go on in the next batch are one; a null track is a track."""
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = spark.createDataFrame([(t, p, p + d, 6, float(p % 7)) for t in (None, 1, 2) for d in (-3, 0, 4) for p in [*range(10, 200, 5), *range(300, 400, 6), 500, 507]], "track_id long, p0 long, c0 long, size long, dist double")
    want = sorted((str(t), p, p + d, n, 0.0 if n > 7 else float(p % 7)) for t in (None, 1, 2) for d in (-3, 0, 4) for p, n in ((10, 191), (300, 102), (500, 6), (507, 6)))
    try:
        spark.conf.set(name, "4")
        assert sorted((str(r[0]), *r[1:]) for r in align.merge_diagonal_blocks(blocks).collect()) == want
    finally:
        spark.conf.set(name, before)


def test_choosing_asks_for_lengths_alone(spark):
    d = spark.createDataFrame([(1, "t", "a b https://x.example", "a b"), (2, "t", "ab", "ab"), (3, "t", "ab", None), (4, "", "a", "abcdef")], "doc_id long, title string, body string, source_body string")
    rule = ("SOURCE_EMPTY", "OUTPUT_TOO_SHORT", "OUTPUT_TOO_LONG")
    want = {r["doc_id"]: [e for e in r["errors"] if e in rule] for r in docs.validate_documents(d).collect()}
    assert {r["doc_id"]: r["errors"] for r in docs.validate_lengths(d).collect()} == want


def test_runs_stay_within_their_group():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = [(int(x), int(y)) for x, y in rng.integers(0, 25, (6, 2))]
        a, b = (np.concatenate([rng.integers(0, 3, n[side]) for n in sizes]).astype(np.uint32) for side in (0, 1))
        of_a, of_b = (np.repeat(np.arange(6), [n[side] for n in sizes]) for side in (0, 1))
        want = set()
        for g in range(6):
            i, j, n = align.common_runs(a[of_a == g], b[of_b == g], 4)
            want |= {(int(x) + sum(s[0] for s in sizes[:g]), int(y) + sum(s[1] for s in sizes[:g]), int(z)) for x, y, z in zip(i, j, n, strict=True)}
        assert {tuple(map(int, r)) for r in zip(*align.common_runs(a, b, 4, of_a, of_b), strict=True)} == want


def test_windows_that_batches_part_are_whole(spark, monkeypatch):
    """Windows over many small batches, searched a few at a time; no group of a track and window is a call of its own."""
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", [(t, i, "abcdefghij"[(i * 7 + t) % 10], i * 500, i * 500 + 500) for t in range(4) for i in range(300)]
    chars = spark.createDataFrame(rows, "track_id long, idx long, ch string, start_ms long, end_ms long")
    blocks = align.anchor_blocks(chars, chars)
    assert "CoGroup" not in plan(blocks)
    want = sorted(map(tuple, blocks.collect()))
    before = spark.conf.get(name)
    monkeypatch.setattr(align, "ROWS_AT_ONCE", 50)
    try:
        spark.conf.set(name, "37")
        assert sorted(map(tuple, align.anchor_blocks(chars, chars).collect())) == want and len(want) > 100
    finally:
        spark.conf.set(name, before)


def test_artifacts_with_a_manifest_are_read_as_folders_are(spark, tmp_path):
    texts = ['{"language": "en", "source": "audio", "segments": []}', '{{"language": "en"}', '{"source": "audio", "segments": []}', '{"language": "en",\n "source": "tape", "segments": []}']
    (tmp_path / "plain").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / "plain" / f"{i}.json").write_text(t)
    write_named(spark.createDataFrame([(f"{i}.json", str(i), t) for i, t in enumerate(texts)], "name string, key string, value string"), str(tmp_path / "named"))
    got = [[sorted(map(str, x.collect())) for x in files.read_transcript_artifacts(spark, str(tmp_path / d), m)] for d, m in (("plain", False), ("named", True))]
    assert got[0] == got[1] and [len(x) for x in got[0]] == [1, 3]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_short_tracks_share_batches(spark, batch):
    """One message a track was most of the time; tracks that go over several batches are swept whole."""
    rows = [(t, p, p + d, 3, 0.0) for t in range(7) for p in range(0, 5 * t + 5, 5) for d in (0, 1)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        df = align.monotonic_chain(spark.createDataFrame(rows, "track_id long, p0 long, c0 long, size long, dist double"))
        assert "FlatMapGroupsInPandas" not in plan(df)
        assert {(r["track_id"], r["p0"], r["c0"]) for r in df.collect()} == {(t, p, p) for t, p, c, _, _ in rows if p == c}
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_words_are_placed_many_tracks_at_once(spark, batch):
    """No group a track; a character outside words bounds gaps too, and of equal texts the nearest in time counts."""
    word = [0, 0, None, 1, 1, 2, 2, 3, 4]
    primary = [(t, i, ch, 100 * i, 100 * i + 100, 0, w) for t in range(5) for i, (ch, w) in enumerate(zip("ab\U00020000cdxyef", word, strict=True))]
    caption = [(t, i, ch, 100 * i, 100 * i + 100) for t in range(5) for i, ch in enumerate("ab\U00020000cdcdcdz")]
    pairs = [(t, p, c) for t in range(4) for p, c in ((2, 2), (7, 9))]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        df = align.word_to_caption_range(
            spark.createDataFrame(primary, "track_id long, idx long, ch string, start_ms long, end_ms long, seg_pos long, word_idx long"),
            spark.createDataFrame(caption, "track_id long, idx long, ch string, start_ms long, end_ms long"), spark.createDataFrame(pairs, "track_id long, p long, c long"),
        )
        assert "InPandas" in plan(df) and "Groups" not in plan(df)
        got = {(r["track_id"], r["word_idx"]): (r["c_from"], r["c_to"], r["caption_text"]) for r in df.collect()}
    finally:
        spark.conf.set(name, before)
    assert {w: v for (t, w), v in got.items() if t == 0} == {0: (0, 2, "ab"), 1: (3, 5, "cd"), 2: (3, 9, "cdcdcd"), 3: (3, 4, "c")}
    assert all(got.get((t, w)) == got.get((0, w)) for t in range(4) for w in range(5))
    # Without a pair the whole caption is searched, else what overlaps in time.
    assert {w: v for (t, w), v in got.items() if t == 4} == {0: (0, 2, "ab"), 1: (3, 5, "cd"), 2: (5, 7, "cd"), 3: (7, 8, "c"), 4: (8, 9, "d")}


def test_documents_are_worked_out_once(spark, tmp_path):
    """Files and refusals come from one export: neither the filter by code nor the refused rows normalise texts again."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(x):
        runs.add(1)
        return x

    d = spark.createDataFrame([(1, "a", "x"), (2, "b", ""), (3, "", "y")], "doc_id long, title string, body string")
    refused = files.write_documents(files.export_documents(d.withColumn("body", body("body"))), str(tmp_path / "docs"))
    assert {(r["doc_id"], r["code"]) for r in refused.collect()} == {(2, "BODY_EMPTY"), (3, "TITLE_EMPTY")}
    assert [(r["doc_id"], r["content"]) for r in files.read_documents(spark, str(tmp_path / "docs")).collect()] == [("1", "Title: a\n\nx\n")]
    assert runs.value == 3
