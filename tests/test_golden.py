"""Small cases with expected values written by hand."""

from __future__ import annotations

import hashlib
import json
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.functions.text import borders, clean_markup, code_points, gram_hashes, length_bounds, normalize_alignment_text, text_similarity, window_minima
from cuelattice.operators import align, captions, docs, reconcile, tracks
from cuelattice.plans import q_align, registry
from cuelattice.sources import files
from cuelattice.sources.named_files import committed, file_name, read_named, write_named

CUE = "track_id string, cue_ord long, start_ms long, end_ms long, text string, lines array<string>, inline boolean"


def cue(n, start, end, *lines, inline=False, track="t"):
    return (track, n, start, end, " ".join(lines), list(lines), inline)


def segments(df):
    return [(r["start_ms"], r["end_ms"], r["text"]) for r in df.orderBy("seg_pos").collect()]


def test_repeats_merge_and_gaps_part(spark):
    df = spark.createDataFrame([cue(1, 250, 1300, "tide tables"), cue(2, 1700, 2600, "tide tables"), cue(3, 2400, 3900, "low water")], CUE)
    assert segments(captions.merge_repeated_cues(df)) == [(250, 2600, "tide tables"), (2600, 3900, "low water")]
    far = spark.createDataFrame([cue(1, 100, 700, "echo"), cue(2, 1701, 2500, "echo")], CUE)
    assert len(segments(captions.merge_repeated_cues(far))) == 2


def test_merge_equals_reading_in_order(spark):
    random.seed(3)
    rows, want = [], {}
    for t in range(60):
        done, at = [], 0
        for n in range(25):
            at += random.randint(-300, 900)
            start, end, text = max(0, at), max(0, at) + random.randint(0, 1500), random.choice("ab")
            rows.append(cue(n, start, end, text, track=f"t{t}"))
            if done and text == done[-1][2] and start <= done[-1][1] + 1000:
                done[-1][1] = max(done[-1][1], end)
                continue
            begin = max(start, done[-1][1]) if done else start
            if end > begin:
                done.append([begin, end, text])
        want[f"t{t}"] = [tuple(d) for d in done]
    got = {}
    for r in captions.merge_repeated_cues(spark.createDataFrame(rows, CUE)).orderBy("track_id", "seg_pos").collect():
        got.setdefault(r["track_id"], []).append((r["start_ms"], r["end_ms"], r["text"]))
    assert got == want


def test_rolling_lines_come_once(spark):
    df = spark.createDataFrame(
        [cue(1, 40, 1900, "the ferry leaves", inline=True), cue(2, 1900, 1912, "the ferry leaves"), cue(3, 1912, 4050, "the ferry leaves", "at seven sharp"), cue(4, 4050, 4061, "at seven sharp"), cue(5, 4061, 7007, "at seven sharp", "from pier nine")], CUE
    )
    got, empty = captions.route_and_number(df)
    assert [x[2] for x in segments(got)] == ["the ferry leaves", "at seven sharp", "from pier nine"]
    assert empty.count() == 0


def test_islands_equal_reading_whole_tracks(spark):
    """Rolling cues with pauses, cues of no length and repeats of long ago, against one fold over each whole track."""
    random.seed(8)
    phrases = ["red sail", "red sails at dusk", "grey gull", "gull over water", "low tide", "tide"]
    rows, tracks = [], {}
    for t in range(80):
        at, shown = 0, []
        for n in range(30):
            at += random.choice([0, 200, 500, 900, 5000])
            shown = (shown + [random.choice(phrases)])[-random.randint(1, 3) :] if random.random() < 0.7 else shown[-1:] or ["tide"]
            rows.append(cue(n, at, at + random.choice([0, 0, 300, 1200]), *shown, track=f"t{t}"))
            tracks.setdefault(f"t{t}", []).append((at, rows[-1][3], shown))

    def whole(cues):
        done, previous, ended = [], (), None
        rel = lambda a, b: captions._related(a, b, 4)
        for start, end, lines in cues:
            near = previous if ended is not None and start <= ended + 1000 else ()
            fresh = [x for x in lines if not any(rel(p, x) for p in near)]
            for x in lines:
                old = next((p for p in near if rel(p, x)), None)
                if old is not None and old != x:
                    seg = next((s for s in reversed(done) if s[2] == old), None)
                    if seg and x.startswith(old):
                        seg[2] = x
                    elif seg and rel(old, x) > 0:
                        seg[2] = old + x[rel(old, x) :]
            carried = None if fresh else next((s for s in reversed(done) if any(rel(s[2], x) for x in lines)), None)
            if carried:
                carried[1] = max(carried[1], end)
            else:
                begin = max(start, done[-1][1]) if done else start
                if end > begin:
                    done.append([begin, end, " ".join(fresh or lines)])
            previous, ended = lines, end
        return [tuple(x) for x in done]

    got = {}
    for r in captions.collapse_rolling_cues(spark.createDataFrame(rows, CUE)).orderBy("track_id", "seg_pos").collect():
        got.setdefault(r["track_id"], []).append((r["start_ms"], r["end_ms"], r["text"]))
    assert got == {k: v for k, c in tracks.items() if (v := whole(c))}


def test_caption_lines_equal_reading_in_order(spark):
    import re

    random.seed(5)
    kinds = ["00:00:0{}.000 --> 00:00:0{}.000", "", "text {}", "7"]
    names, want = [], {}
    for f in range(150):
        lines = [random.choice(kinds).format(random.randint(0, 4), random.randint(5, 9)) for _ in range(random.randint(0, 14))]
        names.append((f"f{f:03d}", "\n".join(lines)))
        timing = [bool(re.match(r"^\d\d:.*-->", x)) for x in lines]
        i, out = 0, []
        while i < len(lines):
            if not timing[i]:
                i += 1
                continue
            head = i
            i += 1
            while i < len(lines) and not lines[i]:
                i += 1
            if i < len(lines) and timing[i]:
                continue
            text = []
            while i < len(lines) and lines[i]:
                text.append(lines[i].replace("-->", "-->"))
                i += 1
            if text:
                out.append((head, text))
        want[f"f{f:03d}"] = out
    got = {}
    for r in files.ingest_caption_lines(spark.createDataFrame(names, "path string, value string")).orderBy("path", "cue_ord").collect():
        got.setdefault(r["path"], []).append((r["cue_ord"], list(r["lines"])))
    assert got == {k: [(n, [" ".join(x.split()) for x in t]) for n, t in v] for k, v in want.items() if v}


def test_text_rules(spark):
    df = spark.createDataFrame([("［音楽］カタカナ、ＡＢＣ♪", "&lt;b&gt;x&lt;/b&gt; <i>a &amp;  b</i>")], "ja string, m string")
    row = df.select(normalize_alignment_text(F.col("ja")).alias("n"), clean_markup(F.col("m")).alias("m"), length_bounds(F.lit(101)).alias("b"), text_similarity(F.lit("abcd"), F.lit("bcde")).alias("s"), text_similarity(F.lit(""), F.lit("x")).alias("z")).first()
    assert (row["n"], row["m"], tuple(row["b"]), row["s"], row["z"]) == ("かたかなabc", "x a & b", (101, 111, 131), 0.75, 0.0)


def test_budget_skips_and_goes_on(spark):
    w = spark.createDataFrame([("t", 0, 0, 7000, [1], 1, 0.1), ("t", 1, 8000, 12000, [2], 1, 0.2), ("t", 2, 13000, 16000, [3], 1, 0.3)], "track_id string, win int, start_ms long, end_ms long, span_ids array<bigint>, tier int, score double")
    kept = {r["win"] for r in reconcile.budgeted_top_k(w, 60, 10_000).where("selected").collect()}
    assert kept == {0, 2}


def test_decision_consensus(spark):
    schema = "primary_text string, caption_text string, secondary_text string, issue string, coverage double, secondary_coverage double, overlap double, secondary_overlap double, mean_probability double, min_probability double, tier int, language string"
    rows = [("目", "め", "め", None, 1.0, 1.0, 1.0, 1.0, 0.9, 0.9, 1, "ja"), ("目", "め", None, None, 1.0, 1.0, 1.0, 1.0, 0.9, 0.9, 1, "ja"), ("x", "め", "x", None, 1.0, 1.0, 1.0, 1.0, 0.9, 0.9, 1, "ja"), ("目", "め", "め", None, 1.0, 1.0, 0.695, 1.0, 0.9, 0.9, 1, "ko")]
    got = [(r["decision"], r["reason"]) for r in reconcile.decide(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("corrected", "caption_secondary_consensus"), ("unresolved", "secondary_missing"), ("kept_primary", "primary_consensus"), ("corrected", "caption_secondary_consensus")]


def test_surface_keeps_spaces(spark):
    said = [("t", 0, ["물길", "은", "깊다"]), ("t", 1, ["a", "", "b"]), ("t", 2, ["x", "y"]), ("u", 0, ["only"])]
    words = spark.createDataFrame([(t, s, i, w) for t, s, ws in said for i, w in enumerate(ws)], "track_id string, seg_pos int, word_idx int, text string")
    seg = spark.createDataFrame([("t", 0, "  물길 은\u3000깊다 "), ("t", 1, "a b"), ("t", 2, "x z"), ("u", 0, "only"), ("v", 0, "no words")], "track_id string, seg_pos int, text string")
    new = spark.createDataFrame([("t", 0, 1, 3, " 이 얕다 "), ("t", 1, 0, 1, "A"), ("u", 0, 0, 1, "ONE")], "track_id string, seg_pos int, word_start int, word_end int, new_text string")
    got = {(r["track_id"], r["seg_pos"]): r["text"] for r in reconcile.splice_surface(seg, reconcile.surface_spans(words, seg), new).collect()}
    assert got == {("t", 0): "  물길 이 얕다 ", ("t", 1): "a b", ("t", 2): "x z", ("u", 0): "ONE", ("v", 0): "no words"}


def test_spans_without_evidence_stay(spark):
    timed = "track_id string, seg_pos int, word_idx long, start_ms long, end_ms long, text string"
    said = ["wide", "river", "mouth", "opens", "slowly"]
    p = align.character_timeline(spark.createDataFrame([("t", 0, i, i * 500, i * 500 + 400, w) for i, w in enumerate(said)], timed), None)
    heard = spark.createDataFrame([("t", 0, 0, i, i * 500, i * 500 + 400, w, 0.9) for i, w in enumerate(["wide", "rivet", "mouth", "opens", "slowly"])], "track_id string, win int, seg_pos int, word_idx long, start_ms long, end_ms long, text string, probability double")
    spans = spark.createDataFrame([("t", 0, 0, 1, 500, 900), ("t", 1, 0, 4, 2000, 2400), ("t", 2, 0, 3, 1500, 1900)], "track_id string, span_id long, seg_pos int, word_idx long, start_ms long, end_ms long")
    windows = spark.createDataFrame([("t", 0, 0, 2000, [0], True), ("t", 1, 2000, 2400, [1], True), ("t", 2, 1500, 1900, [2], False)], "track_id string, win int, start_ms long, end_ms long, span_ids array<bigint>, selected boolean")
    got = {r["span_id"]: r for r in reconcile.secondary_evidence(spans, windows, p, heard, None).collect()}
    assert (got[0]["secondary_text"], got[0]["processed"], got[0]["issue"], got[0]["secondary_words"]) == ("rivet", True, None, ["rivet"])
    assert got[0]["secondary_coverage"] == 1.0 and got[0]["secondary_overlap"] == 1.0 and got[0]["mean_probability"] == 0.9
    assert (got[1]["secondary_text"], got[1]["selected"], got[1]["processed"]) == (None, True, False)
    assert (got[2]["secondary_text"], got[2]["selected"], got[2]["processed"]) == (None, False, False)


def test_reconciliation_from_words_to_text(spark):
    """Two tracks: a word that caption and second model correct, one they confirm, one nobody heard again, one over budget."""
    timed = "track_id string, seg_pos int, word_idx long, start_ms long, end_ms long, text string, probability double"
    right = ["".join(chr(0x4E00 + 3 * i + k) for k in range(3)) for i in range(40)]
    at = lambda t, i, text, p: (t, i // 4, i % 4, i * 1000, i * 1000 + 900, text, p)
    said = [at("t", i, "誤聞違" if i == 7 else w, 0.3 if i in (7, 12) else 0.9) for i, w in enumerate(right)]
    said += [at("u", i, w, 0.2 if i == 30 else 0.9) for i, w in enumerate(right)]
    captions_of = [at(t, i, w, None) for t in "tu" for i, w in enumerate(right)]
    words, caps = spark.createDataFrame(said, timed), spark.createDataFrame(captions_of, timed)
    segs = words.groupBy("track_id", "seg_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x.text), "").alias("text"))

    def heard(windows):
        w = caps.drop("probability").withColumn("probability", F.lit(0.95)).where("track_id = 't'")
        kept = windows.select("track_id", "win", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
        return w.join(kept, "track_id").where("start_ms < b and end_ms > a").select("track_id", "win", "seg_pos", "word_idx", "start_ms", "end_ms", "text", "probability")

    out = reconcile.reconcile(words, caps, heard, segs)
    items = {(r["track_id"], r["seg_pos"], r["word_idx"]): (r["decision"], r["reason"], r["final_text"], r["tier"]) for r in out["items"].collect()}
    assert items == {
        ("t", 1, 3): ("corrected", "caption_secondary_consensus", right[7], 1),
        ("t", 3, 0): ("kept_primary", "primary_consensus", right[12], 2),
        ("u", 7, 2): ("unresolved", "secondary_missing", right[30], 2),
    }
    texts = {(r["track_id"], r["seg_pos"]): r["text"] for r in out["segments"].collect()}
    assert texts == {(t, s): "".join(right[4 * s : 4 * s + 4]) for t in "tu" for s in range(10)}
    total = {r["track_id"]: r for r in out["summary"].collect()}
    assert (total["t"]["suspicious"], total["t"]["corrected_words"], total["t"]["corrected_segments"], total["t"]["processed"], total["t"]["warnings"]) == (2, 1, 1, 2, ["JAPANESE_RECONCILED"])
    assert abs(total["t"]["coverage"] - 117 / 120) < 1e-9 and total["u"]["coverage"] == 1.0 and total["u"]["processed"] == 0 and total["u"]["secondary_windows"] == 0
    none = reconcile.reconcile(words, caps, heard, segs, most=0)
    assert {r["decision"] for r in none["items"].collect()} == {"skipped"} and none["summary"].where("skipped_windows > 0 and windows = 0").count() == 2


def test_alignment_of_altered_text(spark):
    text = "".join(chr(0x4E00 + i) for i in range(100))
    other = text[:30] + "zz" + text[32:]
    make = lambda t: spark.createDataFrame([("t", 0, i, i * 1000, i * 1000 + 900, c) for i, c in enumerate(t)], "track_id string, seg_pos int, word_idx long, start_ms long, end_ms long, text string")
    p, c = align.character_timeline(make(text), None), align.character_timeline(make(other), None)
    pairs = align.aligned_pairs(align.monotonic_chain(align.merge_diagonal_blocks(align.anchor_blocks(p, c))))
    assert pairs.count() == 98
    assert pairs.where("p <> c").count() == 0
    ranges = {r["word_idx"]: r["caption_text"] for r in align.word_to_caption_range(p, c, pairs).collect()}
    assert ranges[10] == text[10] and ranges[30] == "zz"


def test_documents(spark):
    d = spark.createDataFrame([(1, "12\n00:07:03.250 --> 00:07:05,000 align:start\nsalt <07:04.100>marsh\u3000\n\u3000\n\n\nheron \t nest\u00a0"), (2, "40\npairs of boots\r41\r\n9:00,500 --> 9:01,500\nend")], "doc_id long, body string")
    got = {r["doc_id"]: r["body"] for r in docs.normalise_bodies(d).collect()}
    assert got == {1: "salt marsh\n\nheron nest", 2: "40\npairs of boots\nend"}
    assert docs.split_text("い" * 46, 20) == ["い" * 20, "い" * 20, "い" * 6]
    assert docs.split_text('one. two." three four', 14) == ['one. two." ', "three four"]
    assert docs.split_text("aaaaaa\n\n\nbb cc", 10) == ["aaaaaa\n\n\n", "bb cc"]
    rep = spark.createDataFrame([(1, "Wind from the north all day.\n \t\nWIND  from the North all day.\n\nthe north ALL day. Rain later.\n\n\nRain later")], "doc_id long, body string")
    assert docs.drop_repeated_paragraphs(rep, least=10).first()["body"] == "Wind from the north all day.\n\nRain later.\n\nRain later"


def test_rules_hold_for_what_would_be_published(spark):
    said = "The lighthouse keeper counted forty ships before the fog came in from the west and hid the harbour. " * 2
    same = "灯台守は霧が西から来て港を隠すまでに四十隻の船を数えた。" * 8
    rows = [
        (1, "Two\nlines", said + "\n\n" + said + "\n\n[Laughter] see WWW.example.org 🎉\nBody : x", said),
        (2, "Title: 港 ", "はじめに\n\n" + same.replace("。", "。\n"), same),
        (3, "t" * 101, "short", said),
        (4, "", " \u3000\n", None),
        (5, "ok", "# Head\n" + said, said),
    ]
    got = {r["doc_id"]: (r["title"], set(r["errors"]), r["warnings"]) for r in docs.validate_documents(spark.createDataFrame(rows, "doc_id long, title string, body string, source_body string")).collect()}
    assert got[1] == ("Two\nlines", {"TITLE_MULTILINE", "BODY_HAS_URL", "BODY_HAS_STAGE_DIRECTION", "BODY_HAS_EMOJI", "BODY_HAS_OUTPUT_MARKER"}, ["SOURCE_BLOCK_COPIED"])
    assert got[2] == ("港", set(), ["SOURCE_BLOCK_COPIED"])
    assert got[3][1:] == ({"TITLE_TOO_LONG", "OUTPUT_TOO_SHORT"}, []) and got[4][1:] == ({"TITLE_EMPTY", "BODY_EMPTY", "SOURCE_EMPTY"}, [])
    assert got[5][1:] == ({"BODY_HAS_MARKDOWN"}, [])


def test_copies_are_told_without_case_and_space(spark):
    line = "港の灯りは夜ごとに数を減らし、漁師たちは静かに網を繕っていた。"
    outputs = spark.createDataFrame([(1, line * 3 + "\n\nother"), (2, "Quiet Harbour Lights AND nets that nobody mends"), (3, "nothing of the kind is in any of these sources"), (4, None)], "doc_id long, body string")
    sources = spark.createDataFrame([(7, "前書き " + (line * 4).replace("、", "、\n")), (8, "so: quiet harbour\nlights and  nets that nobody MENDS, ever"), (9, None), (10, "x")], "source_id long, text string")
    assert {(r["doc_id"], r["source_id"], r["n_blocks"]) for r in docs.copied_blocks(outputs, sources, 36).collect()} == {(1, 7, 1), (2, 8, 1)}


def test_repeated_beginnings_equal_trying_all_lengths():
    r = random.Random(11)
    for _ in range(3000):
        a, b = ("".join(r.choice("aAb \n") for _ in range(r.randrange(0, 14))) for _ in range(2))
        least = r.randrange(1, 5)
        want = next((n for n in range(min(len(a), len(b)), least - 1, -1) if docs._compact(a[len(a) - n :]) == docs._compact(b[:n])), 0)
        assert docs.repeated_chars(a, b, least) == want, (a, b, least)
        assert borders(a, b) == [n for n in range(min(len(a), len(b)), 0, -1) if a[len(a) - n :] == b[:n]]


def test_replies(spark):
    rows = [
        ("a", 'As asked: {"body": "Grüße", "n": 3, "none": null} bye', ["body"]),
        ("b", "<<<TITLE>>>old<<<BODY>>> text \n<<<TITLE>>>new", ["title", "body"]),
        ("c", "no structure", ["body"]),
        ("d", '{"body": ""}', ["body"]),
        ("e", '[1] {"body": "x"}', ["body"]),
        ("f", '```json\n{"body": "fenced"}\n```  ', ["body"]),
        ("g", "[see note] {broken <<<BODY>>>kept", ["body"]),
        ("h", None, ["body"]),
    ]
    r = spark.createDataFrame(rows, "request_id string, response string, required array<string>")
    got = {x["request_id"]: (x["fields"], x["code"]) for x in docs.extract_structured_replies(r).collect()}
    assert got == {
        "a": ({"body": "Grüße", "n": "3"}, None), "b": ({"title": "new", "body": "text"}, None), "c": (None, "NO_STRUCTURE"), "d": ({"body": ""}, "FIELD_MISSING"),
        "e": (None, "NOT_OBJECT"), "f": ({"body": "fenced"}, None), "g": ({"body": "kept"}, None), "h": (None, "NO_STRUCTURE"),
    }


def test_plain_objects_are_read_without_python(spark):
    r = random.Random(23)
    values = ['"x"', '"é\\n\\u00e9 \\"q\\" {[}"', "true", "12", "-0", "null", "1.5", "1e2", "99999999999999999999", '{"a": "b"}', '[1, "z"]', "NaN", "{", '"open']
    texts = ["", "no bracket", "[1] then", '{"a": 1, "a": 2}', '{"a": "x"} tail }', '{"a": 1}{"b": 2}', "[note] {", '[[1] {"a": "b"}', "{'a': 1}", '{"a": "line\nend"}', '{"": "e"}', '{"a": "x",}', None]
    for _ in range(400):
        body = ", ".join(f'"k{i}": {r.choice(values)}' for i in range(r.randrange(4)))
        texts.append(r.choice(["", "as asked: ", "[see] "]) + "{" + body + r.choice(["}", "} bye", "} {", ""]))

    def want(text):
        for i, c in enumerate(text or ""):
            if c in "{[":
                try:
                    value, _ = json.JSONDecoder().raw_decode(text, i)
                except ValueError:
                    continue
                return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items() if v is not None} if isinstance(value, dict) else "list"
        return None

    rows = spark.createDataFrame([(str(i), t, []) for i, t in enumerate(texts)], "request_id string, response string, required array<string>")
    got = {int(x["request_id"]): "list" if x["code"] == "NOT_OBJECT" else x["fields"] for x in docs.extract_structured_replies(rows).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}
    # What needs no Python: objects of plain values, and lists, that begin at the first bracket.
    read = {int(x["request_id"]) for x in rows.where(docs.json_fields(F.col("response")).isNotNull()).select("request_id").collect()}
    assert all(want(texts[i]) is not None for i in read)

    def plain(text):
        at = next((i for i, c in enumerate(text or "") if c in "{["), None)
        try:
            pairs, _ = json.JSONDecoder(object_pairs_hook=tuple).raw_decode(text, at) if at is not None else (None, 0)
        except ValueError:
            return False
        return isinstance(pairs, tuple) and len(dict(pairs)) == len(pairs) and all(v is None or isinstance(v, str) or (isinstance(v, int) and abs(v) < 1 << 63) for _, v in pairs)

    easy = {i for i, t in enumerate(texts) if plain(t)}
    assert {i for i in read if want(texts[i]) != "list"} == easy and len(easy) > 50


def test_urls_and_tracks(spark):
    good = ["https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "https://youtu.be/dQw4w9WgXcQ", "https://m.youtube.com/shorts/dQw4w9WgXcQ", "https://www.youtube.com/embed/dQw4w9WgXcQ", "http://youtube.com/live/dQw4w9WgXcQ"]
    bad = {"https://evil.example/watch?v=dQw4w9WgXcQ": "INVALID_YOUTUBE_URL", "https://www.youtube.com/playlist?list=PL1": "PLAYLIST_NOT_SUPPORTED", "https://youtu.be/short": "INVALID_YOUTUBE_URL", "nonsense": "INVALID_YOUTUBE_URL"}
    df = spark.createDataFrame([(u,) for u in [*good, *bad]], "url string")
    got = {r["url"]: (r["video_id"], r["code"]) for r in tracks.canonicalise_urls(df).collect()}
    assert got == {**{u: ("dQw4w9WgXcQ", None) for u in good}, **{u: (None, c) for u, c in bad.items()}}
    t = spark.createDataFrame([("a", "manual", "en", 0), ("a", "automatic", "en", 1), ("a", "automatic", "vi", 2), ("b", "automatic", "ko", 0), ("b", "automatic", "ko-orig", 1), ("c", "manual", "en", 0), ("c", "manual", "de", 1)], "video_id string, source string, provider_language string, ord int")
    v = spark.createDataFrame([("a", "en-US", None), ("b", "ko", None), ("c", None, None), ("d", None, None)], "video_id string, requested_language string, original_language string")
    got = {r["video_id"]: (r["source"], r["provider_language"], r["code"]) for r in tracks.select_track(t, v).collect()}
    assert got == {"a": ("manual", "en", None), "b": ("automatic", "ko-orig", None), "c": (None, None, "LANGUAGE_AMBIGUOUS"), "d": (None, None, "NO_CAPTIONS")}


def test_export_stamps(spark):
    s = spark.createDataFrame([("t", 0, 7_384_005, 7_385_999, "Guten Tag", "Hafen / Ebbe?")], "track_id string, seg_pos int, start_ms long, end_ms long, text string, title string")
    row = files.export_transcripts(s).first()
    assert row["txt"] == "Title: Hafen / Ebbe?\n\nGuten Tag\n"
    odd = files.export_transcripts(spark.createDataFrame([("t", 0, 0, 1, " a", "　"), ("t", 1, 1, 2, "b　", "　"), ("u", 0, 0, 1, "x", "Ａ　 b")], s.schema)).select("track_id", "txt").collect()
    assert {r["track_id"]: r["txt"] for r in odd} == {"t": "a b\n", "u": "Title: A b\n\nx\n"}
    assert row["srt"] == "Title: Hafen / Ebbe?\n\n1\n02:03:04,005 --> 02:03:05,999\nGuten Tag\n"
    assert s.select(file_name(F.col("title"), F.lit("v")).alias("n")).first()["n"] == "Hafen _ Ebbe_.v"


def conversations(spark, path, texts):
    """A folder whose table of conversations has one conversation of ``texts``."""
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


def test_whole_turns_are_trimmed(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(900))]
    for n in (0, 7, 300, 450, 900):
        texts.append(texts[-1][len(texts[-1]) - n :] + "".join(r.choice("ab") for _ in range(950 - n)))
    rows = spark.createDataFrame([("t", i, 1000 * i, 1000 * i + 1000, t) for i, t in enumerate(texts)], "track_id string, seg_pos int, start_ms long, end_ms long, text string")
    got = {x["seg_pos"]: (x["trimmed"], x["text"]) for x in captions.trim_rolling_prefix(rows).collect()}
    best = [0] + [max((k for k in range(4, min(len(a), len(b)) + 1) if a.endswith(b[:k])), default=0) for a, b in zip(texts, texts[1:], strict=False)]
    assert max(best) == 900 and got == {i: (k, texts[i][k:]) for i, k in enumerate(best)}


def test_whole_replies_are_extracted(spark, tmp_path):
    texts = [f"{i} " + "many words of a turn " * 40 + "its end" for i in range(10)]
    got = registry.QUERIES["extract_structured_replies"](spark, conversations(spark, tmp_path, texts)).where("code is null").collect()
    assert got and all(x["body"] == texts[int(x["request_id"].split("-")[1])] for x in got)


def test_alignment_queries_take_the_defaults(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randrange(2, 7))) for _ in range(25)) for _ in range(3)]
    pool = ["".join(r.choice("abcd") for _ in range(5)) for _ in range(400)]
    altered = [w for w in pool if int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 100 < 10 and w[0] != w[-1]]
    fine = next(w for w in pool if int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 100 >= 10)
    texts[1] = f"{altered[0]} {fine} {altered[1]} {texts[1]}"
    sf_dir = conversations(spark, tmp_path, texts)
    p, c = ("".join(x["ch"] for x in t.orderBy("idx").collect()) for t in q_align._chars(spark, sf_dir))
    assert p != c
    runs = set()
    for i in range(len(p)):
        for j in range(len(c)):
            if p[i] == c[j] and not (i and j and p[i - 1] == c[j - 1]):
                n = next((k for k in range(min(len(p) - i, len(c) - j)) if p[i + k] != c[j + k]), min(len(p) - i, len(c) - j))
                runs |= {(i, j, n)} if n >= 4 else set()
    got = {(x["p0"], x["c0"], x["size"]) for x in registry.QUERIES["anchor_blocks"](spark, sf_dir).collect()}
    assert got == runs and {(x["p0"], x["c0"], x["size"]) for x in registry.QUERIES["merge_diagonal_blocks"](spark, sf_dir).collect()} == runs
    chain = [(x["p0"], x["c0"], x["size"]) for x in registry.QUERIES["monotonic_chain"](spark, sf_dir).orderBy("p0").collect()]
    assert set(chain) <= runs and any(n < 8 for _, _, n in chain)

    heard = spark.createDataFrame([("t", 0, i, w) for i, w in enumerate(["stone", "stoke", "stores", "", "rests"])], "track_id string, seg_pos int, word_idx long, caption_text string")
    said = spark.createDataFrame([("t", 0, i, i, i + 1, w, p) for i, (w, p) in enumerate([("stone", 0.5), ("stone", 0.9), ("Stone!", 0.8), ("x", 0.9), ("stone", None)])], "track_id string, seg_pos int, word_idx long, start_ms long, end_ms long, text string, probability double")
    got = {x["word_idx"]: (x["similarity"], x["tier"]) for x in reconcile.suspicious_words(said, heard, language="de").collect()}
    like = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert got == {0: (1.0, 2), 4: (like("stone", "rests"), 3)} and like("stone", "stores") > 0.72


def test_copied_blocks_equal_containment_on_random_texts(spark):
    rng = np.random.default_rng(11)
    say = lambda n: "".join(rng.choice(list("ab cdé"), n))
    sources = [(i, say(int(rng.integers(0, 900)))) for i in range(60)] + [(60, "a" * 500), (61, "ab" * 300), (62, None)]
    bodies = []
    for i in range(80):
        s, n = sources[int(rng.integers(0, 62))][1], int(rng.integers(10, 260))
        a = int(rng.integers(0, max(1, len(s) - n)))
        bodies.append((i, s[a : a + n].upper() + "\n\n" + say(int(rng.integers(0, 200)))))
    bodies += [(100, "A a " * 80), (100, "A a " * 80), (101, None), (102, "")]
    flat = lambda t: "".join((t or "").casefold().split())
    for least in (40, 160):
        want = {}
        for i, body in bodies:
            for p in {flat(x) for x in (body or "").split("\n\n")}:
                for j, s in sources:
                    if len(p) >= least and p in flat(s):
                        want.setdefault((i, j), set()).add(p)
        got = docs.copied_blocks(spark.createDataFrame(bodies, "doc_id int, body string"), spark.createDataFrame(sources, "source_id int, text string"), least).collect()
        assert {(r["doc_id"], r["source_id"]): r["n_blocks"] for r in got} == {k: len(v) for k, v in want.items()} and want


def test_winnowing_keeps_few_hashes_and_one_of_every_window():
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("abcdefgh"), 20_000))
    kept = set(window_minima(gram_hashes(code_points(text), 32), 129).tolist())
    assert len(kept) < 0.03 * len(text)
    for a in range(0, 19_000, 97):
        (key,) = window_minima(gram_hashes(code_points(text[a : a + 160]), 32), 129)
        assert int(key) in kept
    for n, size in ((40, 7), (9, 9), (5, 6), (12, 1)):
        t = "".join(rng.choice(list("aé😀"), n))
        h = gram_hashes(code_points(t), size)
        assert len(h) == max(0, n - size + 1) and all((h[i] == h[j]) == (t[i : i + size] == t[j : j + size]) for i in range(len(h)) for j in range(i))


def test_common_runs_equal_trying_all_places():
    rng = np.random.default_rng(13)
    for _ in range(400):
        a, b = (rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)).astype(np.uint32) for _ in range(2))
        for least in (1, 2, 4, 5, 8):
            want = set()
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                        n = next((n for n in range(1, 99) if i + n >= len(a) or j + n >= len(b) or a[i + n] != b[j + n]), 0)
                        if n >= least:
                            want.add((i, j, n))
            got = list(zip(*(x.tolist() for x in align.common_runs(a, b, least)), strict=True))
            assert len(got) == len(want) and set(got) == want


def test_anchor_blocks_of_timelines_with_gaps(spark):
    """Segments that overlap in time leave gaps in the numbers of a window's characters; blocks end there."""
    rng = np.random.default_rng(14)
    rows = lambda seed: [(1, i, str(rng.choice(list("abc"))), int(t), int(t) + 300) for i, t in enumerate(np.random.default_rng(seed).permutation(240) * 500)]
    schema = "track_id int, idx long, ch string, start_ms long, end_ms long"
    p, c = rows(1), rows(2)
    got = {(r["p0"], r["c0"], r["size"]): r["dist"] for r in align.anchor_blocks(spark.createDataFrame(p, schema), spark.createDataFrame(c, schema)).collect()}
    want, origin = {}, min(r[3] for r in p + c)
    for win in range(4):
        a, b = ([r for r in x if r[3] < origin + win * 55_000 + 60_000 and r[4] > origin + win * 55_000] for x in (p, c))
        hits = {(a[i][1], b[j][1]): (i, j) for i in range(len(a) - 3) for j in range(len(b) - 3) if [r[2] for r in a[i : i + 4]] == [r[2] for r in b[j : j + 4]]}
        for (x, y), (i, j) in hits.items():
            if (x - 1, y - 1) not in hits:
                n = next(n for n in range(1, 999) if (x + n, y + n) not in hits)
                mid = lambda r, k: (min(s[3] for s in r[k : k + n]) + max(s[4] for s in r[k : k + n + 3])) / 2
                d = abs(mid(a, i) - mid(b, j))
                want[x, y, n + 3] = min(d, want.get((x, y, n + 3), d))
    assert got == want and want


def test_best_chain_equals_trying_all_blocks_before():
    rng = np.random.default_rng(15)
    for _ in range(300):
        blocks = sorted(tuple(map(int, (rng.integers(30), rng.integers(30), rng.integers(1, 6)))) for _ in range(rng.integers(0, 40)))
        p, c, n = ([b[k] for b in blocks] for k in range(3))
        own = [x - float(rng.choice([0, 0, 0.1, 0.05])) for x in n]
        score, before = list(own), [-1] * len(p)
        for i in range(len(p)):
            fits = [j for j in range(i) if p[j] + n[j] <= p[i] and c[j] + n[j] <= c[i]]
            j = max(fits, key=lambda j: (score[j], -j), default=-1)
            if j >= 0 and score[j] + own[i] > score[i]:
                score[i], before[i] = score[j] + own[i], j
        at, kept = max(range(len(p)), key=score.__getitem__, default=-1), []
        while at >= 0:
            kept.append(at)
            at = before[at]
        assert align.best_chain(p, c, n, own) == kept[::-1]


def test_white_space_of_all_kinds(spark):
    """U+3000 and U+00A0 are white space to sources, hashes, replies and addresses; null texts are empty ones."""
    cap = spark.createDataFrame([("f", "WEBVTT\r\n　\r\n00:01.000 --> 00:02.000　\r\n \r\nbye\r\n　\r\nnote\r\n")], "path string, value string")
    assert [(r["start_ms"], r["lines"]) for r in files.ingest_caption_lines(cap).collect()] == [(1000, ["bye"])]
    word = "struct<start:double,end:double,word:string,probability:string>"
    asr = spark.createDataFrame([("t", 1, 0.0, 1.0, "　hi\n", [(0.0, 0.5, " hi ", "0.5"), (0.5, 0.6, "　", None)]), ("t", 2, 1.0, 2.0, "\n　", []), ("t", 3, 2.0, 3.0, "x", [(2.0, 2.1, " ", "1")])], f"track_id string, ord int, start double, end double, text string, words array<{word}>")
    got = [(r["index"], r["text"], r["words"] and [(w["text"], w["probability"]) for w in r["words"]]) for r in files.ingest_asr_segments(asr).orderBy("index").collect()]
    assert got == [(1, "hi", [("hi", 0.5)]), (2, "x", None)]
    out = spark.createDataFrame([("a", None, "b"), ("b", "T", None), ("c", "　", "b"), ("d", "x\n", "　b "), ("e", "a\nb", "c"), ("f", "Title: x" * 30, "c"), ("g", "T", "1\n00:00:01,000 --> 00:00:02,000\nhé  said")], "doc_id string, title string, body string")
    assert {r["doc_id"]: (r["content"], r["code"]) for r in files.export_documents(out).collect()} == {
        "a": (None, "TITLE_EMPTY"), "b": (None, "BODY_EMPTY"), "c": (None, "TITLE_EMPTY"), "d": ("Title: x\n\nb\n", None), "e": (None, "TITLE_MULTILINE"), "f": (None, "TITLE_TOO_LONG"), "g": ("Title: T\n\nhé said\n", None),
    }
    said = spark.createDataFrame([(1, "﻿Title:　A  b\r\n1\r\n00:01.000 --> 00:02.000\r\nx\r\r\ry　"), (2, "Title: 　\nx"), (3, "Title: x"), (4, None), (5, " Title: x\ny")], "doc_id int, content string")
    assert {r["doc_id"]: (r["title"], r["body"], r["code"]) for r in files.read_text_documents(said).collect()} == {1: ("A b", "x\n\ny", None), 2: (None, None, "SOURCE_TITLE_MISSING"), 3: (None, None, "SOURCE_EMPTY"), 4: (None, None, "SOURCE_TITLE_MISSING"), 5: (None, None, "SOURCE_TITLE_MISSING")}
    t = spark.createDataFrame([("x\n　", "x", " Yes　", "　https://youtu.be/dQw4w9WgXcQ\n"), ("x", "x", "no", "https://youtube.com/watch?v=dQw4w9WgXc%51"), ("x", "x", "no", "https://youtube.com/watch?v=dQw4w9Wg%ZZ")], "a string, b string, v string, url string")
    assert t.where(docs.content_hash(F.col("a")) != docs.content_hash(F.col("b"))).count() == 0
    assert [r[0] for r in t.select(docs.as_bool(F.col("v"))).collect()] == [True, False, False]
    assert [r["video_id"] for r in tracks.canonicalise_urls(t.select("url")).collect()] == ["dQw4w9WgXcQ", "dQw4w9WgXcQ", None]


def test_named_files(spark, tmp_path):
    path = f"{tmp_path}/out folder"
    titles = {"Demo: Video?": "Demo_ Video_", " . ": "untitled", "con": "_con", "a　 b ": "a b", "ＡＢ": "AB", "x" * 99 + " . y": "x" * 99, None: "untitled", "a/\\|b": "a_b"}
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, id int")
    assert [r[0] for r in rows.orderBy("id").select(file_name(F.col("title"), F.lit("7"), F.lit("vi"))).collect()] == [f"{t}.7.vi" for t in titles.values()]
    docs_ = spark.createDataFrame([("007", "T", "one"), ("7", "T", "two\n\nzwei"), ("a/b", "T", "x"), ("a:b", "T", "y"), ("あ", "u/v", "z"), ("n", None, "z")], "doc_id string, title string, body string")
    refused = files.write_documents(files.export_documents(docs_), path)
    assert [tuple(r) for r in refused.collect()] == [("n", "TITLE_EMPTY")]
    back = files.read_text_documents(files.read_documents(spark, path))
    assert {r["doc_id"]: (r["title"], r["body"]) for r in back.collect()} == {"007": ("T", "one"), "7": ("T", "two\n\nzwei"), "a/b": ("T", "x"), "a:b": ("T", "y"), "あ": ("u/v", "z")}
    assert (tmp_path / "out folder" / "T.007.txt").read_text() == "Title: T\n\none\n" and not [p for p in (tmp_path / "out folder").rglob("_part-*")]
    # A second write adds; files that no commit names, and attempts that Spark dropped, aren't read.
    (tmp_path / "out folder" / "stray.txt").write_text("x")
    parts = committed(path)
    write_named(spark.createDataFrame([("sub/new.txt", "k", None)], "name string, key string, value string"), path)
    assert set(parts) < set(committed(path)) and [(r["name"], r["key"], r["value"]) for r in read_named(spark, path).where("key = 'k'").collect()] == [("sub/new.txt", "k", "")]
    assert read_named(spark, path).count() == 6 and read_named(spark, path, ".srt").count() == 0 and read_named(spark, f"{tmp_path}/none").count() == 0
    for bad in ("../x.txt", "/../x", ""):
        with pytest.raises(Exception, match="named"):
            write_named(spark.createDataFrame([(bad, "k", "v")], "name string, key string, value string"), path)
    assert read_named(spark, path).count() == 6


def test_named_transcripts(spark, tmp_path):
    s = spark.createDataFrame([("007", 0, 0, 1234, "Xin chào", "Demo: Video?"), ("7", 0, 0, 900, "a", None)], "track_id string, seg_pos int, start_ms long, end_ms long, text string, title string")
    e = files.export_transcripts(s).join(s.select("track_id", "title"), "track_id").withColumn("language", F.lit("vi"))
    files.write_transcripts(e, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").glob("*.*")} == {f"{stem}.{k}" for stem in ("Demo_ Video_.007.vi", "untitled.7.vi") for k in ("srt", "txt", "json")}
    assert {(r["track_id"], r["value"]) for r in files.read_transcripts(spark, str(tmp_path / "t")).collect()} == {("007", "Title: Demo: Video?\n\n1\n00:00:00,000 --> 00:00:01,234\nXin chào\n"), ("7", "1\n00:00:00,000 --> 00:00:00,900\na\n")}
