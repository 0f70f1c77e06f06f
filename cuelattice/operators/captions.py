"""Caption cues: joining repeats, telling rolling tracks, collapsing them, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions.text import suffix_prefix_overlap
from cuelattice.sources.files import staged

GAP_MS = 1000
LEAST_OVERLAP = 4
ROLLING_PREFIX_GAP_MS = 1500


def merge_repeated_cues(cues: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Segments ``track_id, seg_pos, start_ms, end_ms, text, n_cues``.

    A cue that repeats the last kept text within ``gap_ms`` extends it; any other begins where the last ended at the
    earliest and is dropped when nothing of it is left. With M the largest end before a cue, only cues that end
    after M matter, and one opens a segment unless it repeats the text of the previous such cue in time, so windows do
    the whole scan.
    """
    track = Window.partitionBy("track_id").orderBy("cue_ord")
    m = F.max("end_ms").over(track.rowsBetween(Window.unboundedPreceding, -1))
    kept = cues.withColumn("m", m).where(F.col("m").isNull() | (F.col("end_ms") > F.col("m")))
    last = F.lag("text").over(track)
    opens = last.isNull() | (last != F.col("text")) | (F.col("start_ms") > F.col("m") + gap_ms)
    runs = kept.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(track.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(F.when(F.col("opens") == 1, F.greatest("start_ms", F.coalesce("m", "start_ms"))))
    return runs.groupBy("track_id", F.col("run").alias("seg_pos")).agg(start.alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("text").alias("text"), F.count("*").alias("n_cues"))


def rolling_tracks(cues: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """``track_id, rolling``: inline time stamps, or neighbours in time that share a line, one of them of several lines."""
    track = Window.partitionBy("track_id").orderBy("cue_ord")
    before, ended = F.lag("lines").over(track), F.lag("end_ms").over(track)
    shares = (F.col("start_ms") <= ended + gap_ms) & ((F.size("lines") > 1) | (F.size(before) > 1)) & F.arrays_overlap("lines", before)
    return cues.withColumn("roll", F.col("inline") | F.coalesce(shares, F.lit(False))).groupBy("track_id").agg(F.bool_or("roll").alias("rolling"))


def _related(a: str, b: str, least: int) -> int:
    """How a line continues another: -1 equal or one begins the other, else the overlap, 0 if unrelated."""
    if a == b or a.startswith(b) or b.startswith(a):
        return -1
    return next((n for n in range(min(len(a), len(b)), least - 1, -1) if a.endswith(b[:n])), 0)


_FOLDED = "island long, n long, start_ms long, end_ms long, text string, reaches_back boolean"


def _fold(batches: Iterator[pd.DataFrame], gap_ms: int, least: int) -> Iterator[pd.DataFrame]:
    """Segments of each (track, island), whose cues come in order; an island may go on in the next batch."""
    at, done, previous, ended = None, [], (), None  # done: start, end, text, whether it may belong to an earlier island
    columns = ["track_id", "island", "n", "start_ms", "end_ms", "text", "reaches_back"]

    def rows():
        return [(*at, n, *x) for n, x in enumerate(done)]

    for pdf in batches:
        out = []
        for track, island, begin, end, lines in zip(pdf["track_id"], pdf["island"], pdf["start_ms"], pdf["end_ms"], pdf["lines"], strict=True):
            if (track, island) != at:
                out += rows() if at is not None else []
                at, done, previous, ended = (track, island), [], (), None
            near = previous if ended is not None and begin <= ended + gap_ms else ()
            fresh = []
            for line in lines:
                old = next((p for p in near if _related(p, line, least)), None)
                if old is None:
                    fresh.append(line)
                    continue
                kin = _related(old, line, least)
                segment = next((s for s in reversed(done) if s[2] == old), None) if old != line else None
                if segment is not None:
                    if line.startswith(old):
                        segment[2] = line
                    elif kin > 0:
                        segment[2] = old + line[kin:]
            carried = None if fresh else next((s for s in reversed(done) if s[2] is not None and any(_related(s[2], x, least) for x in lines)), None)
            if carried is not None:
                carried[1] = max(carried[1], end)
            else:
                kept = next((s for s in reversed(done) if s[2] is not None), None)
                start = max(begin, kept[1]) if kept else begin
                if end > start:
                    done.append([start, end, " ".join(fresh or lines), not fresh])
                elif not fresh:
                    done.append([None, None, None, True])
            previous, ended = tuple(lines), end
        yield pd.DataFrame(out, columns=columns).astype({"start_ms": "Int64", "end_ms": "Int64"})
    if at is not None:
        yield pd.DataFrame(rows(), columns=columns).astype({"start_ms": "Int64", "end_ms": "Int64"})


def collapse_rolling_cues(cues: DataFrame, gap_ms: int = GAP_MS, least: int = LEAST_OVERLAP) -> DataFrame:
    """Rolling tracks as segments ``track_id, seg_pos, start_ms, end_ms, text``: each line once.

    Lines that continue a line of the previous cue in time rewrite or lengthen the segment of that line; a cue of
    carried lines alone prolongs the latest segment they belong to. A cue that begins more than ``gap_ms`` after all
    earlier ends carries nothing, so windows cut tracks into islands there, and islands, not tracks, are folded in
    order. Only where a carried line has no segment in its island might it belong to an earlier one; such tracks, which
    are few, are folded whole.
    """
    track = Window.partitionBy("track_id").orderBy("cue_ord")
    apart = F.coalesce((F.col("start_ms") > F.max("end_ms").over(track.rowsBetween(Window.unboundedPreceding, -1)) + gap_ms).cast("long"), F.lit(0).cast("long"))
    dealt = cues.select("track_id", "cue_ord", "start_ms", "end_ms", "lines").withColumn("apart", apart)
    dealt = dealt.withColumn("island", F.sum("apart").over(track.rowsBetween(Window.unboundedPreceding, 0))).drop("apart")
    schema = f"track_id {dict(cues.dtypes)['track_id']}, {_FOLDED}"

    def folded(df: DataFrame) -> DataFrame:
        ordered = df.repartition("track_id", "island").sortWithinPartitions("track_id", "island", "cue_ord")
        return ordered.select("track_id", "island", "start_ms", "end_ms", "lines").mapInPandas(lambda batches: _fold(batches, gap_ms, least), schema)

    first = staged(folded(dealt), "islands")
    again = first.where("reaches_back and island > 0").select("track_id").distinct()
    whole = folded(dealt.join(again, "track_id", "left_semi").withColumn("island", F.lit(0).cast("long")))
    both = first.join(again, "track_id", "left_anti").unionByName(whole).where("text is not null")
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("island", "n")).cast("long")
    return both.select("track_id", number.alias("seg_pos"), "start_ms", "end_ms", "text")


def route_and_number(cues: DataFrame, gap_ms: int = GAP_MS) -> tuple[DataFrame, DataFrame]:
    """Segments of all tracks, rolling ones collapsed and others merged, and tracks left without text (with the code)."""
    rolling = rolling_tracks(cues, gap_ms)
    flagged = cues.join(rolling, "track_id")
    columns = ["track_id", "seg_pos", "start_ms", "end_ms", "text"]
    both = merge_repeated_cues(flagged.where("not rolling"), gap_ms).select(columns).unionByName(collapse_rolling_cues(flagged.where("rolling"), gap_ms))
    numbered = both.withColumn("index", F.row_number().over(Window.partitionBy("track_id").orderBy("seg_pos")))
    empty = cues.select("track_id").distinct().join(both.select("track_id").distinct(), "track_id", "left_anti").withColumn("code", F.lit("NO_CAPTION_TEXT"))
    return numbered, empty


def trim_rolling_prefix(segments: DataFrame, gap_ms: int = ROLLING_PREFIX_GAP_MS, least: int = LEAST_OVERLAP) -> DataFrame:
    """Segments without the beginning that repeats the end of the segment before; ``trimmed`` counts its characters.

    Only segments that start within ``gap_ms`` of the end of the last non-empty one are trimmed, against its whole text.
    """
    track = Window.partitionBy("track_id").orderBy("seg_pos")
    s = segments.where("text <> ''").withColumn("before", F.lag("text").over(track)).withColumn("ended", F.lag("end_ms").over(track))
    n = F.when(F.col("start_ms") - F.col("ended") <= gap_ms, suffix_prefix_overlap(F.col("before"), F.col("text"), least)).otherwise(0)
    s = s.withColumn("trimmed", F.coalesce(n, F.lit(0)).cast("int"))
    return s.withColumn("text", F.expr("substring(text, trimmed + 1)")).drop("before", "ended")
