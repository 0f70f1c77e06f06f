"""Reconciling transcripts: what looks wrong, what to verify under a budget, what to decide, and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions.text import SPACE, normalize_alignment_text, primary_coverage, strip, temporal_overlap, text_similarity
from cuelattice.operators import align
from cuelattice.operators.align import dealt
from cuelattice.sources.files import staged

LOW = 0.72
COVERAGE, OVERLAP, MEAN, LEAST = 0.80, 0.70, 0.85, 0.50
KOREAN_TOLERANCE = 0.01
PADDING_MS, MERGE_GAP_MS, LONGEST_MS = 2_000, 1_500, 20_000
WINDOWS = {"ja": 60, "ko": 100}
TOTAL_MS = 600_000


def suspicious_words(words: DataFrame, ranges: DataFrame, similarity: Column | None = None, low: float = LOW, language: str = "ja", also: tuple[str, ...] = ()) -> DataFrame:
    """Words (``track_id, seg_pos, word_idx, start_ms, end_ms, text, probability``) that look wrong, as spans.

    Low confidence and disagreement with the caption give tier 1, either alone 2 and 3; the score is the probability if
    low, else the similarity; ``span_id`` counts a track's spans in order. Columns of ``ranges`` in ``also`` stay.
    """
    w = words.join(dealt(ranges.select("track_id", "seg_pos", "word_idx", "caption_text", *also)), ["track_id", "seg_pos", "word_idx"], "left")
    like = text_similarity(normalize_alignment_text(F.col("text"), language), F.col("caption_text")) if similarity is None else similarity
    w = w.withColumn("similarity", F.when(F.col("caption_text") != "", like))
    unsure, differs = F.coalesce(F.col("probability") < low, F.lit(False)), F.coalesce(F.col("similarity") < low, F.lit(False))
    s = w.where(unsure | differs)
    tier = F.when(unsure & differs, 1).when(unsure, 2).otherwise(3)
    score = F.when(unsure, F.col("probability")).otherwise(F.coalesce("similarity", F.lit(1.0)))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_pos", "word_idx")) - 1
    return s.select("track_id", number.alias("span_id"), "seg_pos", "word_idx", "start_ms", "end_ms", "text", "caption_text", "similarity", tier.alias("tier"), score.alias("score"), *also)


def pad_and_merge_windows(spans: DataFrame, padding: int = PADDING_MS, gap: int = MERGE_GAP_MS, longest: int = LONGEST_MS) -> DataFrame:
    """Windows around spans: ``track_id, win, start_ms, end_ms, span_ids``; spans that are empty or too long have none.

    Padding stays within ``longest``; a window joins the one before if the gap is small and the joint one not too long.
    Each depends on the last, so a track's spans are folded in order inside the aggregation.
    """
    length = F.col("end_ms") - F.col("start_ms")
    s = spans.where((length > 0) & (length <= longest)).withColumn("spare", longest - length)
    s = s.withColumn("left", F.least(F.lit(padding), F.col("start_ms"), F.floor(F.col("spare") / 2))).withColumn("right", F.least(F.lit(padding), F.col("spare") - F.col("left")))
    s = s.select("track_id", F.struct("start_ms", "end_ms", "span_id", (F.col("start_ms") - F.col("left")).alias("a"), (F.col("end_ms") + F.col("right")).alias("b")).alias("s"))
    kind = "array<struct<at:int,a:bigint,b:bigint>>"
    none = F.expr(f"cast(array() as {kind})")
    # Open window (a, b), the place where it began, and the windows closed before; only a closed window is appended.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), none.alias("closed"))

    def step(acc, x):
        joint = F.greatest(acc.b, x.b)
        fits = F.coalesce((x.a <= acc.b + gap) & (joint - acc.a <= longest), F.lit(False))
        closes = ~fits & acc.a.isNotNull()
        closed = F.when(closes, F.array_append(acc.closed, F.struct(acc.at.alias("at"), acc.a.alias("a"), acc.b.alias("b")))).otherwise(acc.closed)
        return F.struct(F.when(fits, acc.at).otherwise(acc.n).alias("at"), (acc.n + 1).alias("n"), F.when(fits, acc.a).otherwise(x.a).cast("long").alias("a"), F.when(fits, joint).otherwise(x.b).cast("long").alias("b"), closed.cast(kind).alias("closed"))

    def finish(acc):
        return F.array_append(acc.closed, F.struct(acc.at.alias("at"), acc.a.alias("a"), acc.b.alias("b"))).cast(kind)

    folded = s.groupBy("track_id").agg(F.array_sort(F.collect_list("s")).alias("s")).withColumn("w", F.aggregate("s", start, step, finish))
    until = F.coalesce(F.get(F.col("w.at"), F.col("win") + 1), F.size("s"))
    out = folded.select("track_id", "s", "w", F.posexplode("w").alias("win", "x")).select("track_id", "win", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"), F.slice(F.col("s.span_id"), F.col("x.at") + 1, until - F.col("x.at")).alias("span_ids"))
    return out.withColumn("span_ids", F.col("span_ids").cast("array<bigint>"))


def window_priority(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Windows with ``tier`` and ``score`` of their most urgent span."""
    each = windows.select("track_id", "win", F.explode("span_ids").alias("span_id")).join(dealt(spans.select("track_id", "span_id", "tier", "score", "start_ms")), ["track_id", "span_id"])
    best = each.groupBy("track_id", "win").agg(F.min(F.struct("tier", "score", "start_ms")).alias("b"))
    return windows.join(dealt(best), ["track_id", "win"]).select(windows["*"], F.col("b.tier").alias("tier"), F.col("b.score").alias("score"))


def budgeted_top_k(windows: DataFrame, most: Column | int = 60, total_ms: int = TOTAL_MS) -> DataFrame:
    """Windows with ``selected``: taken by urgency while number and total time allow; later, shorter ones still may fit."""
    most = F.lit(most) if isinstance(most, int) else most
    w = windows.withColumn("limit", most)
    order = F.struct("tier", "score", "start_ms", "end_ms", "span_ids", "win", "limit")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("ms"), F.array().cast("array<int>").alias("kept"))

    def step(acc, x):
        d = x.end_ms - x.start_ms
        take = (acc.n < x.limit) & (acc.ms + d <= total_ms)
        # Only what is taken is appended, and never more than the limit.
        return F.struct((acc.n + take.cast("int")).alias("n"), F.when(take, acc.ms + d).otherwise(acc.ms).alias("ms"), F.when(take, F.array_append(acc.kept, x.win.cast("int"))).otherwise(acc.kept).alias("kept"))

    kept = w.groupBy("track_id").agg(F.array_sort(F.collect_list(order)).alias("s")).select("track_id", F.explode(F.aggregate("s", start, step, lambda acc: acc.kept)).alias("win"))
    taken = kept.withColumn("selected", F.lit(True))
    return windows.join(dealt(taken), ["track_id", "win"], "left").withColumn("selected", F.coalesce("selected", F.lit(False))).select(*windows.columns, "selected")


def decide(items: DataFrame, normalised: bool = False, language: str = "ja") -> DataFrame:
    """Adds ``decision`` and ``reason`` to spans with their evidence, by gates in order.

    Needs ``primary_text, caption_text, secondary_text`` (null: no second pass), ``issue``, the pairs of
    ``coverage``/``secondary_coverage`` and ``overlap``/``secondary_overlap``, ``mean_probability, min_probability,
    tier, language``.
    """
    norm = (lambda c: F.coalesce(F.col(c), F.lit(""))) if normalised else (lambda c: F.coalesce(normalize_alignment_text(F.col(c), language), F.lit("")))
    p, c, s = norm("primary_text"), norm("caption_text"), norm("secondary_text")
    tolerance = F.when((F.substring_index("language", "-", 1) == "ko") & (F.col("tier") == 1) & (c == s), KOREAN_TOLERANCE).otherwise(0.0)
    say = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    low = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))
    ladder = (
        F.when(F.col("secondary_text").isNull() & F.col("issue").isNull(), say("unresolved", "secondary_missing"))
        .when(F.col("issue").isNotNull(), F.struct(F.lit("unresolved").alias("decision"), F.col("issue").alias("reason")))
        .when(F.least("coverage", "secondary_coverage") < COVERAGE, say("unresolved", "alignment_coverage_low"))
        .when((p == "") | (c == "") | (s == ""), say("unresolved", "evidence_empty"))
        .when(F.least("overlap", "secondary_overlap") + tolerance < OVERLAP, say("unresolved", "temporal_overlap_low"))
        .when(low("mean_probability", MEAN), say("unresolved", "secondary_mean_probability_low"))
        .when(low("min_probability", LEAST), say("unresolved", "secondary_min_probability_low"))
        .when((p == s) | (p == c), say("kept_primary", "primary_consensus"))
        .when(c == s, say("corrected", "caption_secondary_consensus"))
        .otherwise(say("unresolved", "consensus_missing"))
    )
    return items.withColumn("_d", ladder).select(*[F.col(x) for x in items.columns], "_d.decision", "_d.reason")


def finalise_decisions(decided: DataFrame) -> DataFrame:
    """Decisions after budget and rebuilding: needs ``skipped, rebuildable, surface_mapped`` besides ``decide``'s columns."""
    surface = (F.substring_index("language", "-", 1) == "ko") & (F.col("tier") == 1) & F.col("surface_mapped")
    stuck = (F.col("decision") == "corrected") & ~F.col("rebuildable") & ~surface
    d = F.when(F.col("skipped"), "skipped").when(stuck, "unresolved").otherwise(F.col("decision"))
    r = F.when(F.col("skipped"), "budget_limit").when(stuck, "segment_words_not_reconstructable").otherwise(F.col("reason"))
    out = decided.withColumn("_d", d).withColumn("reason", r).withColumn("decision", F.col("_d")).drop("_d")
    right = F.col("decision") == "corrected"
    return out.withColumn("final_text", F.when(right, F.col("secondary_text")).otherwise(F.col("primary_text"))).withColumn("corrected_words", right.cast("int"))


def rebuildable(words: DataFrame, segments: DataFrame) -> DataFrame:
    """``track_id, seg_pos, rebuildable``: whether a segment's words, put together, are its text."""
    joined = words.groupBy("track_id", "seg_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x.text), "").alias("t"))
    return segments.join(dealt(joined), ["track_id", "seg_pos"], "left").select("track_id", "seg_pos", F.coalesce(F.col("t") == F.col("text"), F.lit(False)).alias("rebuildable"))


def apply_replacements(words: DataFrame, replacements: DataFrame) -> DataFrame:
    """Segments rebuilt from words, ranges of them replaced: ``track_id, seg_pos, text, n_words``.

    ``replacements``: ``track_id, seg_pos, word_start, word_end, texts`` (in place of words start to end - 1).
    """
    r = replacements.select("track_id", "seg_pos", "word_start", "word_end", "texts")
    gone = r.select("track_id", "seg_pos", F.explode(F.sequence(F.col("word_start"), F.col("word_end") - 1)).alias("word_idx"))
    kept = words.join(dealt(gone), ["track_id", "seg_pos", "word_idx"], "left_anti").select("track_id", "seg_pos", "word_idx", F.lit(0).alias("sub"), "text")
    fresh = r.select("track_id", "seg_pos", F.col("word_start").alias("word_idx"), F.posexplode("texts").alias("sub", "text"))
    both = kept.unionByName(fresh).groupBy("track_id", "seg_pos").agg(F.array_sort(F.collect_list(F.struct("word_idx", "sub", "text"))).alias("s"))
    return both.select("track_id", "seg_pos", F.array_join(F.transform("s", lambda x: x.text), "").alias("text"), F.size("s").alias("n_words"))


def surface_spans(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Where each word stands in its segment's text when they differ in white space only: ``seg_pos, word_idx, s_from, s_to``.

    Words claim characters by running sums of their lengths without white space; the white space before a word belongs
    to it, and that at the end of the text to the last. A segment has no rows if its words say anything else than its
    text, or if one of them has no character.
    """
    bare = lambda c: F.regexp_replace(c, rf"{SPACE}+", "")
    before = Window.partitionBy("track_id", "seg_pos").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(bare("text"))
    w = words.withColumn("bare", bare("text")).withColumn("w0", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn("w1", F.col("w0") + n)
    whole = w.groupBy("track_id", "seg_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "bare"))), lambda x: x.bare), "").alias("t"), F.min(n).alias("shortest"), F.max("word_idx").alias("last"))
    good = segments.join(dealt(whole), ["track_id", "seg_pos"]).where((F.col("t") == bare("text")) & (F.col("shortest") > 0))
    # Places of the characters that aren't white space, in order.
    signs = F.split("text", "")
    filled = F.filter(F.transform(signs, lambda c, i: F.when(~c.rlike(rf"^{SPACE}$") & (c != ""), i)), lambda i: i.isNotNull())
    places = good.select("track_id", "seg_pos", "last", F.length("text").alias("length"), filled.alias("at"))
    placed = w.select("track_id", "seg_pos", "word_idx", "w0", "w1").join(dealt(places), ["track_id", "seg_pos"])
    s_from = F.when(F.col("w0") == 0, 0).otherwise(F.get("at", F.col("w0").cast("int") - 1) + 1)
    s_to = F.when(F.col("word_idx") == F.col("last"), F.col("length")).otherwise(F.get("at", F.col("w1").cast("int") - 1) + 1)
    return placed.select("track_id", "seg_pos", "word_idx", s_from.alias("s_from"), s_to.alias("s_to"))


def splice_surface(segments: DataFrame, spans: DataFrame, replacements: DataFrame) -> DataFrame:
    """Segment texts with ranges of words replaced in place, white space around them kept: ``track_id, seg_pos, text``.

    ``replacements``: ``track_id, seg_pos, word_start, word_end, new_text`` (in place of words start to end - 1).
    Segments without spans keep their text.
    """
    ends = replacements.join(dealt(spans.select("track_id", "seg_pos", F.col("word_idx").alias("word_start"), "s_from")), ["track_id", "seg_pos", "word_start"])
    ends = ends.join(dealt(spans.select("track_id", "seg_pos", (F.col("word_idx") + 1).alias("word_end"), "s_to")), ["track_id", "seg_pos", "word_end"])
    r = ends.groupBy("track_id", "seg_pos").agg(F.array_sort(F.collect_list(F.struct("s_from", "s_to", strip(F.col("new_text")).alias("t")))).alias("r"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda a, b: F.substring("text", a + 1, b - a)
    old = lambda x: cut(x.s_from, x.s_to)
    lead = lambda x: F.regexp_extract(old(x), rf"^{SPACE}*", 0)
    trail = lambda x: F.when(old(x).rlike(rf"^{SPACE}*\z"), "").otherwise(F.regexp_extract(old(x), rf"{SPACE}*\z", 0))
    s = segments.join(dealt(r), ["track_id", "seg_pos"], "left")
    done = F.aggregate("r", start, lambda acc, x: F.struct(x.s_to.alias("at"), F.concat(acc.out, cut(acc.at, x.s_from), lead(x), x.t, trail(x)).alias("out")), lambda acc: F.concat(acc.out, cut(acc.at, F.length("text"))))
    return s.select("track_id", "seg_pos", F.coalesce(done, F.col("text")).alias("text"))


def reconciliation_summary(items: DataFrame, windows: DataFrame, coverage: DataFrame | None = None, prefix: str = "JAPANESE") -> DataFrame:
    """Counts of each track's items (``track_id, seg_pos, decision, selected, processed, corrected_words``) and windows.

    Windows (``selected``, and ``processed`` where known) count if selected, those left out as ``skipped_windows``;
    those the second model has read are ``secondary_windows``. Tracks that have windows or ``coverage`` but no item
    are there too.
    """
    i = items.groupBy("track_id").agg(
        F.count("*").alias("suspicious"), F.count_if("selected").alias("selected"), F.count_if("processed").alias("processed"), F.sum("corrected_words").alias("corrected_words"),
        F.count_distinct(F.when(F.col("decision") == "corrected", F.col("seg_pos"))).alias("corrected_segments"), F.count_if(F.col("decision") == "unresolved").alias("unresolved"), F.count_if(F.col("decision") == "skipped").alias("skipped"),
    )
    length, read = F.col("end_ms") - F.col("start_ms"), (F.col("processed") if "processed" in windows.columns else F.col("selected"))
    w = windows.groupBy("track_id").agg(
        F.count_if("selected").alias("windows"), F.sum(F.when(F.col("selected"), length)).alias("duration_ms"), F.count_if(~F.col("selected")).alias("skipped_windows"),
        F.count_if(read & F.col("selected")).alias("secondary_windows"), F.sum(F.when(read & F.col("selected"), length)).alias("secondary_duration_ms"),
    )
    out = i.join(w, "track_id", "full")
    out = out.join(coverage.select("track_id", "coverage"), "track_id", "full") if coverage is not None else out
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in out.columns if c not in ("track_id", "coverage")})
    warn = lambda c, name: F.when(F.col(c) > 0, f"{prefix}_{name}")
    return out.withColumn("warnings", F.array_compact(F.array(warn("corrected_segments", "RECONCILED"), warn("unresolved", "RECONCILIATION_UNRESOLVED"), warn("skipped", "RECONCILIATION_LIMIT_REACHED"))))


def unresolved_reasons(items: DataFrame) -> DataFrame:
    return items.where("decision = 'unresolved'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("reason"))


def published_corrections(items: DataFrame) -> DataFrame:
    return items.where((F.col("decision") == "corrected") | (F.col("corrected_words") > 0))


def transcript_quality(segments: DataFrame) -> DataFrame:
    """Per document (``doc_id, words`` array): segments, words, and segments that have words."""
    n = F.coalesce(F.size("words"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return segments.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(n).alias("words"), F.count_if(n > 0).alias("segments_with_words"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``track_id`` replaced by a key of track and window, so that aligning works window by window."""
    return rows.withColumn("track_id", F.to_json(F.struct("track_id", "win")))


def secondary_evidence(spans: DataFrame, windows: DataFrame, primary: DataFrame, heard: DataFrame, language: str | None = "ja", least: int = align.LEAST_ANCHOR) -> DataFrame:
    """What the second model says of each span, and whether it was asked.

    ``heard``: the second model's words by window (``track_id, win, seg_pos, word_idx, start_ms, end_ms, text,
    probability``); ``windows`` have ``selected`` and ``span_ids``; ``primary`` is the first model's timeline, by character or
    by the words it consists of. Each window's part of it is aligned with the words heard there. A second model's word that is
    covered only in part makes ``secondary_range_partial_word``. Every span has a row: without evidence ``secondary_text`` is
    null; ``processed`` says if its window is selected and was heard.
    """
    told = _with_evidence(spans, windows, primary, heard, language, least)
    return told.select("track_id", "span_id", "win", "processed", "secondary_text", "secondary_words", "issue", "secondary_coverage", "secondary_overlap", "mean_probability", "min_probability", "selected")


def _with_evidence(spans: DataFrame, windows: DataFrame, primary: DataFrame, heard: DataFrame, language: str | None, least: int = align.LEAST_ANCHOR) -> DataFrame:
    """``spans`` with the columns of ``secondary_evidence``; words of both models cross the shuffle, their characters don't."""
    kept = windows.where("selected").select("track_id", "win", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"), "span_ids")
    asked = kept.select("track_id", "win", F.explode("span_ids").alias("span_id"))
    here = heard.select("track_id", "win").distinct().withColumn("processed", F.lit(True))
    # A word's last character may end a millisecond after it; which characters lie in a window is told where they are made.
    end = F.col("end_ms") if "ch" in primary.columns else F.greatest(F.col("start_ms") + 1, "end_ms") + 1
    part = align.overlapping(primary.withColumns({"own_end": F.col("end_ms"), "end_ms": end}), kept.drop("span_ids"))
    part = _keyed(part.drop("end_ms").withColumnRenamed("own_end", "end_ms"))
    norm = F.col("text") if language is None else normalize_alignment_text(F.col("text"), language)
    words = _keyed(heard.join(dealt(kept.select("track_id", "win")), ["track_id", "win"])).select("track_id", "seg_pos", "word_idx", "start_ms", "end_ms", F.col("text").alias("said"), "probability", norm.alias("text"))
    found = align.aligned_words(part, words, least).select(
        F.col("track_id").alias("_key"), "seg_pos", "word_idx", F.col("coverage").alias("secondary_coverage"), "partial", F.col("texts").alias("secondary_words"), "mean_probability", "min_probability", "w0", "w1",
    )
    every = spans.join(dealt(asked), ["track_id", "span_id"], "left").join(dealt(here), ["track_id", "win"], "left")
    every = every.withColumn("_key", F.to_json(F.struct("track_id", "win"))).join(dealt(found), ["_key", "seg_pos", "word_idx"], "left")
    overlap = F.when(~F.col("partial"), temporal_overlap(F.col("start_ms"), F.col("end_ms"), F.col("w0"), F.col("w1")))
    known = lambda c: F.when(F.col("win").isNotNull(), F.coalesce(c, F.lit(0.0)))
    return every.select(
        *spans.columns, "win", F.coalesce("processed", F.lit(False)).alias("processed"), F.when(F.col("partial"), "").otherwise(F.array_join("secondary_words", "")).alias("secondary_text"), "secondary_words",
        F.when(F.col("partial"), "secondary_range_partial_word").alias("issue"), known(F.col("secondary_coverage")).alias("secondary_coverage"), known(overlap).alias("secondary_overlap"),
        "mean_probability", "min_probability", F.col("win").isNotNull().alias("selected"),
    )


def reconcile(words: DataFrame, captions: DataFrame, heard, segments: DataFrame, language: str = "ja", most: int | None = None) -> dict[str, DataFrame]:
    """The whole chain over a corpus: ``items`` with their decisions, corrected ``segments``, and the ``summary``.

    ``words`` and ``captions`` are timed words of both sources; ``heard`` gives the second model's words for the
    windows it is handed (a function from windows to words with ``win``); ``segments`` hold the surface texts.
    """
    words = staged(words.withColumn("norm", normalize_alignment_text(F.col("text"), language)), "words")
    p = words.select("track_id", "seg_pos", "word_idx", "start_ms", "end_ms", F.col("norm").alias("text"))
    aligned = staged(align.aligned_words(p, captions.withColumn("text", normalize_alignment_text(F.col("text"), language))), "aligned")
    like = text_similarity(F.col("norm"), F.col("caption_text"))
    spans = staged(suspicious_words(words, aligned, like, also=("coverage", "c_start_ms", "c_end_ms")), "spans")
    windows = staged(budgeted_top_k(window_priority(pad_and_merge_windows(spans), spans), WINDOWS.get(language, 60) if most is None else most), "windows")
    second = staged(heard(windows.where("selected")), "heard")
    seen = F.when(F.col("c_start_ms").isNotNull(), primary_coverage(F.col("start_ms"), F.col("end_ms"), F.col("c_start_ms"), F.col("c_end_ms")))
    items = _with_evidence(spans, windows, p, second, language).withColumns({"overlap": F.coalesce(seen, F.lit(0.0)), "coverage": F.coalesce("coverage", F.lit(0.0)), "language": F.lit(language)})
    items = items.drop("win", "c_start_ms", "c_end_ms").withColumnRenamed("text", "primary_text")
    map_of = staged(surface_spans(words, segments), "surface")
    mapped = map_of.select("track_id", "seg_pos").distinct().withColumn("surface_mapped", F.lit(True))
    items = items.join(dealt(rebuildable(words, segments)), ["track_id", "seg_pos"], "left").join(dealt(mapped), ["track_id", "seg_pos"], "left")
    items = items.withColumns({"skipped": ~F.col("selected"), "rebuildable": F.coalesce("rebuildable", F.lit(False)), "surface_mapped": F.coalesce("surface_mapped", F.lit(False))})
    final = staged(finalise_decisions(decide(items, language=language)), "items")
    right = final.where("decision = 'corrected'").select("track_id", "seg_pos", F.col("word_idx").alias("word_start"), (F.col("word_idx") + 1).alias("word_end"), F.col("secondary_words").alias("texts"), F.col("secondary_text").alias("new_text"), "rebuildable")
    spliced = splice_surface(segments, map_of, right.where("not rebuildable").drop("texts", "rebuildable"))
    anew = right.where("rebuildable").drop("new_text", "rebuildable")
    rebuilt = apply_replacements(words.join(dealt(anew.select("track_id", "seg_pos").distinct()), ["track_id", "seg_pos"], "left_semi"), anew)
    texts = spliced.join(dealt(rebuilt.select("track_id", "seg_pos", F.col("text").alias("rebuilt"))), ["track_id", "seg_pos"], "left").select("track_id", "seg_pos", F.coalesce("rebuilt", "text").alias("text"))
    asked = windows.join(dealt(second.select("track_id", "win").distinct().withColumn("processed", F.lit(True))), ["track_id", "win"], "left").withColumn("processed", F.coalesce("processed", F.lit(False)))
    coverage = aligned.groupBy("track_id").agg((F.sum("matched") / F.sum("n")).alias("coverage"))
    return {"items": final, "segments": texts, "summary": reconciliation_summary(final, asked, coverage, {"ko": "KOREAN"}.get(language, "JAPANESE"))}
