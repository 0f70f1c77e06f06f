"""Alignment and reconciliation queries: conversation turns as one timeline, the same with altered words as the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions.text import normalize_alignment_text
from cuelattice.operators import align, reconcile
from cuelattice.plans.views import SPANS, TURNS, WORDS, spans, table, turns, words

ANCHOR = align.LEAST_ANCHOR


def _altered(spark, sf_dir):
    """The words as another source heard them: one of ten is reversed, all a little later."""
    w = words(spark, sf_dir)
    return w.withColumn("text", F.when(F.col("probability") < 0.1, F.reverse("text")).otherwise(F.col("text"))).withColumn("start_ms", F.col("start_ms") + 20).withColumn("end_ms", F.col("end_ms") + 20)


def _chars(spark, sf_dir):
    return align.character_timeline(words(spark, sf_dir), None), align.character_timeline(_altered(spark, sf_dir), None)


def _blocks(spark, sf_dir, merged=False):
    return align.anchor_blocks(words(spark, sf_dir), _altered(spark, sf_dir), merged=merged)


def _chain(spark, sf_dir):
    return align.monotonic_chain(_blocks(spark, sf_dir, True))


def _given(spark, sf_dir):
    """A chain that is known: the words that weren't altered stand at the same places in both timelines."""
    w = _chars(spark, sf_dir)[0].groupBy("track_id", "seg_pos", "word_idx").agg(F.min("idx").alias("p0"), F.count("*").alias("size"))
    same = words(spark, sf_dir).where("probability >= 0.1").select("track_id", "seg_pos", "word_idx")
    return w.join(align.dealt(same), ["track_id", "seg_pos", "word_idx"]).select("track_id", "p0", F.col("p0").alias("c0"), "size", F.lit(20.0).alias("dist"))


def _ranges(spark, sf_dir):
    return align.word_to_caption_range(words(spark, sf_dir), _altered(spark, sf_dir))


def _chars_sql(name, source, shift=0):
    return f"""{name}_w as (select *, length(text) as n, coalesce(sum(length(text)) over (partition by track_id order by seg_pos, word_idx rows between unbounded preceding and 1 preceding), 0)::bigint as base from {source}),
{name}_e as (select *, unnest(range(n)) as o from {name}_w),
{name} as (select track_id, base + o as idx, substr(text, o + 1, 1) as ch, start_ms + round_even(greatest(1, end_ms - start_ms) * o / n, 0)::bigint as start_ms,
  greatest(start_ms + round_even(greatest(1, end_ms - start_ms) * o / n, 0)::bigint + 1, start_ms + round_even(greatest(1, end_ms - start_ms) * (o + 1) / n, 0)::bigint) as end_ms, seg_pos, word_idx from {name}_e)"""


_BOTH = f"""with {WORDS}, altered as (select track_id, seg_pos, word_idx, start_ms + 20 as start_ms, end_ms + 20 as end_ms, case when probability < 0.1 then reverse(text) else text end as text from words),
{_chars_sql("p", "words")}, {_chars_sql("c", "altered")},
origin as (select track_id, min(start_ms) as origin from (select track_id, start_ms from p union all select track_id, start_ms from c) group by track_id)"""
_WIN = "unnest(range(greatest(0, floor((start_ms - origin - 60000) / 55000)::bigint + 1), greatest(greatest(0, floor((start_ms - origin - 60000) / 55000)::bigint + 1), floor((end_ms - 1 - origin) / 55000)::bigint) + 1))"


def _grams(name):
    return f"""{name}_win as (select {name}.*, {_WIN} as win from {name} join origin using (track_id)),
{name}_g as (select * from (select track_id, win, idx, start_ms, max(end_ms) over w as to_ms, string_agg(ch, '') over w as gram from {name}_win window w as (partition by track_id, win order by idx rows between current row and {ANCHOR - 1} following)) where length(gram) = {ANCHOR})"""


_BLOCKS = f"""{_BOTH}, {_grams("p")}, {_grams("c")},
met as (select a.track_id, a.win, a.idx as p, b.idx as c, a.start_ms as ps, a.to_ms as pe, b.start_ms as cs, b.to_ms as ce, a.idx - row_number() over (partition by a.track_id, a.win, b.idx - a.idx order by a.idx) as run
  from p_g a join c_g b on a.track_id = b.track_id and a.win = b.win and a.gram = b.gram),
runs as (select track_id, win, c - p as d, run, min(p) as p0, min(c) as c0, count(*) + {ANCHOR - 1} as size, abs((min(ps) + max(pe)) / 2 - (min(cs) + max(ce)) / 2) as dist from met group by all),
blocks as (select track_id, p0, c0, size, min(dist) as dist from runs group by all)"""
_MERGED = f"""{_BLOCKS}, ends as (select *, max(p0 + size) over (partition by track_id, c0 - p0 order by p0, size rows between unbounded preceding and 1 preceding) as before from blocks),
opened as (select *, sum(case when before is null or p0 > before then 1 else 0 end) over (partition by track_id, c0 - p0 order by p0, size rows between unbounded preceding and current row) as run from ends),
merged as (select track_id, min(p0) as p0, min(c0) as c0, max(p0 + size) - min(p0) as size, min(dist) as dist from opened group by track_id, c0 - p0, run)"""

# The best chain before each block in turn, with the scores so far as a list; then back from the best of all.
_CHAIN = f"""{_MERGED.replace('with ', 'with recursive ', 1)},
blocked as (select track_id, list(p0 order by p0, c0, size) as ps, list(c0 order by p0, c0, size) as cs, list(size order by p0, c0, size) as ns, list(dist order by p0, c0, size) as ds,
  list(size - least(dist, 60000) / 600000 order by p0, c0, size) as own, count(*) as m from merged group by track_id),
dp using key (track_id) as (select track_id, 1::bigint as i, [own[1]] as score, [0::bigint] as back from blocked
  union select track_id, i, list_append(score, own + case when best > 0 and best + own > own then best else 0 end), list_append(back, case when best > 0 and best + own > own then list_position(fits, best) else 0 end)
  from (select *, list_max(fits) as best from (select d.track_id, d.i + 1 as i, d.score, d.back, b.own[d.i + 1] as own,
    list_transform(range(1, d.i + 1), lambda j: case when b.ps[j] + b.ns[j] <= b.ps[d.i + 1] and b.cs[j] + b.ns[j] <= b.cs[d.i + 1] then d.score[j] else -1.0::double end) as fits
    from dp d join blocked b using (track_id) where d.i < b.m))),
walked as (select track_id, list_position(score, list_max(score))::bigint as spot, back from dp union all select track_id, back[spot] as spot, back from walked where back[spot] > 0),
chain as (select w.track_id, b.ps[spot] as p0, b.cs[spot] as c0, b.ns[spot] as size, b.ds[spot] as dist from walked w join blocked b using (track_id))"""
_RANGES = f"""{_CHAIN},
pairs as (select track_id, p0 + o as pi, c0 + o as ci from (select *, unnest(range(size)) as o from chain)),
keyed as (select p.*, ci, last_value(ci ignore nulls) over (w rows between unbounded preceding and 1 preceding) as prev_c, first_value(ci ignore nulls) over (w rows between 1 following and unbounded following) as next_c
  from p left join pairs on p.track_id = pairs.track_id and p.idx = pairs.pi window w as (partition by p.track_id order by p.idx)),
cap as (select track_id, string_agg(ch, '' order by idx) as whole, list(start_ms order by idx) as starts, list(end_ms order by idx) as ends, count(*) as length from c group by track_id),
asked as (select track_id, seg_pos, word_idx, list(prev_c order by idx)[1] as prev_c, list(next_c order by idx desc)[1] as next_c, min(start_ms) as w0, max(end_ms) as w1, string_agg(ch, '' order by idx) as said, count(*) as n from keyed group by all),
bound as (select asked.*, cap.*, coalesce(prev_c + 1, 0) as low, coalesce(next_c, length) as high from asked join cap using (track_id)),
parted as (select *, string_split(substr(whole, low + 1, high - low), said) as parts from bound where high > low),
found as (select *, list_min(list_transform(range(1, len(parts)), lambda k: row(abs((starts[low + list_sum(list_transform(parts[1:k], lambda x: length(x)))::bigint + (k - 1) * n + 1] + ends[low + list_sum(list_transform(parts[1:k], lambda x: length(x)))::bigint + k * n]) / 2 - (w0 + w1) / 2),
    low + list_sum(list_transform(parts[1:k], lambda x: length(x)))::bigint + (k - 1) * n)))[2]::bigint as spot from parted),
placed as (select *, case when spot is not null then spot when prev_c is not null then low when next_c is not null then greatest(low, high - n) else list_min(list_filter(range(length), lambda i: ends[i + 1] > w0 and starts[i + 1] < w1)) end as c_from,
    case when spot is not null then spot + n when next_c is not null then high when prev_c is not null then least(high, low + n) else list_max(list_filter(range(length), lambda i: ends[i + 1] > w0 and starts[i + 1] < w1)) + 1 end as c_to from found),
ranges as (select track_id, seg_pos, word_idx, c_from, c_to, substr(whole, c_from + 1, c_to - c_from) as caption_text, starts[c_from + 1] as c_start_ms, ends[c_to] as c_end_ms from placed where c_to > c_from and c_to - c_from <= greatest(4, 3 * n))"""


def _windows(spark, sf_dir):
    return reconcile.pad_and_merge_windows(spans(spark, sf_dir))


def _budget(spark, sf_dir):
    w = reconcile.window_priority(_windows(spark, sf_dir), spans(spark, sf_dir))
    return reconcile.budgeted_top_k(w, 20, 150_000)


_WINDOWS = f"""with recursive {SPANS},
s as (select *, 20000 - (end_ms - start_ms) as spare from spans where end_ms - start_ms between 1 and 20000),
l as (select *, least(2000, start_ms, spare // 2) as lp from s),
o as (select track_id, span_id, start_ms - lp as a, end_ms + least(2000, spare - lp) as b, row_number() over (partition by track_id order by start_ms, end_ms, span_id) as n from l),
walk as (select track_id, span_id, n, 0 as win, a as wa, b as wb from o where n = 1
  union all select o.track_id, o.span_id, o.n, case when o.a <= w.wb + 1500 and greatest(w.wb, o.b) - w.wa <= 20000 then w.win else w.win + 1 end,
    case when o.a <= w.wb + 1500 and greatest(w.wb, o.b) - w.wa <= 20000 then w.wa else o.a end, case when o.a <= w.wb + 1500 and greatest(w.wb, o.b) - w.wa <= 20000 then greatest(w.wb, o.b) else o.b end
  from walk w join o on o.track_id = w.track_id and o.n = w.n + 1),
windows as (select track_id, win, min(wa) as start_ms, max(wb) as end_ms, list(span_id order by n) as span_ids from walk group by track_id, win)"""
_PRIORITY = f"""{_WINDOWS}, best as (select w.track_id, w.win, min(row(s.tier, s.score, s.start_ms)) as b from walk w join spans s on w.track_id = s.track_id and w.span_id = s.span_id group by all),
ranked as (select windows.*, b[1] as tier, b[2] as score from windows join best using (track_id, win))"""


def _items(spark, sf_dir):
    """Line items as spans with all evidence."""
    li = table(spark, sf_dir, "lineitem")
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("seg_pos"), F.col("l_returnflag").alias("primary_text"),
        F.when(s % 5 == 0, "").when(s % 2 == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("caption_text"),
        F.when(k % 7 == 0, None).when(k % 3 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("secondary_text"),
        F.when(k % 11 == 0, "secondary_range_partial_word").alias("issue"), (1 - F.col("l_discount") * 3).alias("coverage"), (1 - F.col("l_tax")).alias("secondary_coverage"),
        (F.lit(0.6) + F.col("l_quantity") / 100).alias("overlap"), (F.lit(0.69) + F.col("l_tax")).alias("secondary_overlap"),
        F.when(k % 13 != 0, F.lit(0.8) + F.col("l_tax") * 2).alias("mean_probability"), (F.lit(0.45) + F.col("l_discount")).alias("min_probability"),
        (1 + F.col("l_linenumber") % 3).alias("tier"), F.when(s % 4 == 0, "ko-KR").otherwise("ja").alias("language"),
        (k % 17 == 0).alias("skipped"), (s % 3 != 0).alias("rebuildable"), (s % 6 == 0).alias("surface_mapped"), (k % 17 != 0).alias("selected"), (k % 7 != 0).alias("processed"),
    )


_ITEMS = """
items as (select l_orderkey as track_id, l_linenumber as seg_pos, l_partkey as k, l_suppkey as s, l_returnflag as p, case when l_suppkey % 5 = 0 then '' when l_suppkey % 2 = 0 then l_returnflag else l_linestatus end as c,
  case when l_partkey % 7 = 0 then null when l_partkey % 3 = 0 then l_linestatus else l_returnflag end as x, case when l_partkey % 11 = 0 then 'secondary_range_partial_word' end as issue,
  1 - l_discount * 3 as cov, 1 - l_tax as cov2, 0.6::double + l_quantity / 100 as ov, 0.69::double + l_tax as ov2, case when l_partkey % 13 <> 0 then 0.8::double + l_tax * 2 end as mp, 0.45::double + l_discount as np,
  1 + l_linenumber % 3 as tier, case when l_suppkey % 4 = 0 then 'ko-KR' else 'ja' end as language from lineitem),
gated as (select *, case when x is null and issue is null then 'secondary_missing' when issue is not null then issue when least(cov, cov2) < 0.8::double then 'alignment_coverage_low' when p = '' or c = '' or x = '' then 'evidence_empty'
  when least(ov, ov2) + case when language = 'ko-KR' and tier = 1 and c = x then 0.01::double else 0.0::double end < 0.7::double then 'temporal_overlap_low' when mp is null or mp < 0.85::double then 'secondary_mean_probability_low'
  when np is null or np < 0.5::double then 'secondary_min_probability_low' when p = x or p = c then 'primary_consensus' when c = x then 'caption_secondary_consensus' else 'consensus_missing' end as r from items),
decided as (select *, case r when 'primary_consensus' then 'kept_primary' when 'caption_secondary_consensus' then 'corrected' else 'unresolved' end as d from gated),
final as (select *, case when k % 17 = 0 then 'skipped' when d = 'corrected' and s % 3 = 0 and not (language = 'ko-KR' and tier = 1 and s % 6 = 0) then 'unresolved' else d end as decision,
  case when k % 17 = 0 then 'budget_limit' when d = 'corrected' and s % 3 = 0 and not (language = 'ko-KR' and tier = 1 and s % 6 = 0) then 'segment_words_not_reconstructable' else r end as reason from decided),
done as (select *, case when decision = 'corrected' then x else p end as final_text, case when decision = 'corrected' then 1 else 0 end as corrected_words from final)
"""


def _final(spark, sf_dir):
    return reconcile.finalise_decisions(reconcile.decide(_items(spark, sf_dir), normalised=True))


def _heard(spark, sf_dir):
    """Caption texts of most words, as they are compared; of every tenth the first half alone."""
    w = words(spark, sf_dir).withColumn("n", normalize_alignment_text(F.col("text")))
    half = F.left("n", F.floor((F.length("n") + 1) / 2).cast("int"))
    return w.where("word_idx % 9 <> 4").select("track_id", "seg_pos", "word_idx", F.when(F.col("probability") < 0.1, half).when(F.col("probability") > 0.9, half).otherwise(F.col("n")).alias("caption_text"))


def _suspicious(spark, sf_dir):
    return reconcile.suspicious_words(words(spark, sf_dir), _heard(spark, sf_dir))


def _reconciled(spark, sf_dir):
    """Turns against the altered words as captions; a second model that mostly hears what the captions say."""
    said, other = words(spark, sf_dir), _altered(spark, sf_dir)

    def heard(windows):
        w = other.select("track_id", "seg_pos", "word_idx", F.col("text").alias("other")).join(align.dealt(said), ["track_id", "seg_pos", "word_idx"]).withColumn("text", F.when(F.col("probability") < 0.07, F.col("other")).otherwise(F.col("text")))
        kept = windows.select("track_id", "win", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
        return align.overlapping(w, kept).select("track_id", "win", "seg_pos", "word_idx", "start_ms", "end_ms", "text", F.lit(0.95).alias("probability"))

    return reconcile.reconcile(said, other, heard, turns(spark, sf_dir).select("track_id", "seg_pos", "text"), "ko")


def _replaced(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("text", F.concat(F.col("text"), F.lit(" ")))
    r = w.where("probability < 0.1").select("track_id", "seg_pos", F.col("word_idx").alias("word_start"), (F.col("word_idx") + 1).alias("word_end"), F.array(F.concat(F.lit("*"), "text"), F.lit("! ")).alias("texts"))
    return reconcile.apply_replacements(w, r)


def _surface(spark, sf_dir):
    w, t = words(spark, sf_dir), turns(spark, sf_dir).select("track_id", "seg_pos", "text")
    new = w.where("probability < 0.1").select("track_id", "seg_pos", F.col("word_idx").alias("word_start"), (F.col("word_idx") + 1).alias("word_end"), F.concat(F.lit(" <"), "text", F.lit("> ")).alias("new_text"))
    return reconcile.splice_surface(t, reconcile.surface_spans(w, t), new)


def _by_user(spark, sf_dir):
    """Items of line items under the keys of events' users, so that windows and items meet."""
    return _final(spark, sf_dir).withColumn("track_id", F.col("track_id") % 150)


def _secondary(spark, sf_dir):
    return _reconciled(spark, sf_dir)["items"].select("track_id", "span_id", "seg_pos", "word_idx", "secondary_text", "issue", "secondary_coverage", "secondary_overlap", "decision", "reason", "final_text")


def _quality(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return reconcile.transcript_quality(lines.select("doc_id", F.filter(F.split("t", r"\s+"), lambda x: x != "").alias("words")))


QUERIES = {
    "character_timeline": lambda s, d: _chars(s, d)[0],
    "interval_candidates": lambda s, d: align.interval_candidates(turns(s, d), turns(s, d).withColumn("start_ms", F.col("start_ms") + 700)),
    "hopping_windows": lambda s, d: align.hopping_windows(_chars(s, d)[0], align.origins(*_chars(s, d))).groupBy("track_id", "win").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")),
    "anchor_blocks": _blocks,
    "merge_diagonal_blocks": lambda s, d: _blocks(s, d, True),
    "monotonic_chain": _chain,
    "aligned_pairs": lambda s, d: align.aligned_pairs(_given(s, d)),
    "track_coverage": lambda s, d: align.track_coverage(align.aligned_pairs(_given(s, d)), _chars(s, d)[0]),
    "word_to_caption_range": _ranges,
    "local_coverage": lambda s, d: align.local_coverage(_chars(s, d)[0], align.aligned_pairs(_given(s, d))),
    "segment_alignment": lambda s, d: align.segment_alignment(words(s, d), _altered(s, d)).withColumn("word_captions", F.to_json("word_captions")),
    "suspicious_words": _suspicious,
    "pad_and_merge_windows": lambda s, d: _windows(s, d).withColumn("span_ids", F.array_join(F.transform("span_ids", lambda x: x.cast("string")), ",")),
    "window_priority": lambda s, d: reconcile.window_priority(_windows(s, d), spans(s, d)).drop("span_ids"),
    "budgeted_top_k": lambda s, d: _budget(s, d).drop("span_ids"),
    "secondary_evidence": _secondary,
    "reconcile_texts": lambda s, d: _reconciled(s, d)["segments"],
    "reconcile_totals": lambda s, d: _reconciled(s, d)["summary"].withColumn("warnings", F.array_join("warnings", ",")),
    "decide": lambda s, d: reconcile.decide(_items(s, d), normalised=True).select("track_id", "seg_pos", "decision", "reason"),
    "finalise_decisions": lambda s, d: _final(s, d).select("track_id", "seg_pos", "decision", "reason", "final_text", "corrected_words"),
    "apply_replacements": _replaced,
    "splice_surface": _surface,
    "reconciliation_summary": lambda s, d: reconcile.reconciliation_summary(_by_user(s, d), _budget(s, d)).withColumn("warnings", F.array_join("warnings", ",")),
    "unresolved_reasons": lambda s, d: reconcile.unresolved_reasons(_final(s, d)),
    "published_corrections": lambda s, d: reconcile.published_corrections(_final(s, d)).select("track_id", "seg_pos", "final_text"),
    "transcript_quality": _quality,
}

_KEPT = f"""{_PRIORITY}, q as (select *, row_number() over (partition by track_id order by tier, score, start_ms, end_ms, span_ids) as n from ranked),
g as (select track_id, win, n, (end_ms - start_ms) <= 150000 as take, case when end_ms - start_ms <= 150000 then 1 else 0 end as cnt, case when end_ms - start_ms <= 150000 then end_ms - start_ms else 0 end as ms from q where n = 1
  union all select q.track_id, q.win, q.n, g.cnt < 20 and g.ms + q.end_ms - q.start_ms <= 150000, case when g.cnt < 20 and g.ms + q.end_ms - q.start_ms <= 150000 then g.cnt + 1 else g.cnt end,
    case when g.cnt < 20 and g.ms + q.end_ms - q.start_ms <= 150000 then g.ms + q.end_ms - q.start_ms else g.ms end from g join q on q.track_id = g.track_id and q.n = g.n + 1),
budget as (select ranked.*, g.take as selected from ranked join g using (track_id, win))"""

ORACLE_SQL = {
    "character_timeline": f"{_BOTH} select * from p",
    "interval_candidates": f"with {TURNS} select s.track_id, s.seg_pos, c.seg_pos as cap_pos from turns s join (select track_id, seg_pos, start_ms + 700 as start_ms, end_ms from turns) c on s.track_id = c.track_id and c.end_ms > s.start_ms - 5000 and c.start_ms < s.end_ms + 5000",
    "hopping_windows": f"{_BOTH}, w as (select p.*, {_WIN} as win from p join origin using (track_id)) select track_id, win, count(*) as n, min(idx) as first_idx from w group by all",
    "anchor_blocks": f"{_BLOCKS} select * from blocks",
    "merge_diagonal_blocks": f"{_MERGED} select * from merged",
    "monotonic_chain": f"{_CHAIN} select * from chain",
    "word_to_caption_range": f"{_RANGES} select * from ranges",
    "aligned_pairs": f"{_BOTH} select track_id, base + o as p, base + o as c from p_e where probability >= 0.1",
    "track_coverage": f"{_BOTH} select track_id, coalesce(sum(n) filter (probability >= 0.1), 0)::double / sum(n) as coverage from p_w group by track_id",
    "local_coverage": f"""{_BOTH}, h as (select p_e.*, base + o as idx, (probability >= 0.1)::int as hit from p_e),
      k as (select *, coalesce(sum(hit) over l, 0) as lh, count(*) over l as ln, coalesce(sum(hit) over r, 0) as rh, count(*) over r as rn from h
        window l as (partition by track_id order by idx rows between {ANCHOR} preceding and 1 preceding), r as (partition by track_id order by idx rows between 1 following and {ANCHOR} following)),
      g as (select track_id, seg_pos, word_idx, sum(hit) as own, count(*) as n, arg_min(lh, idx) + arg_max(rh, idx) as near, arg_min(ln, idx) + arg_max(rn, idx) as near_n from k group by all)
      select track_id, seg_pos, word_idx, greatest(case when own >= {ANCHOR} then own::double / n else 0.0 end, case when near >= {ANCHOR} then near::double / near_n else 0.0 end) as coverage from g""",
    "splice_surface": """with t as (select conv_id as track_id, turn as seg_pos, text, regexp_extract_all(text, '\\s*\\S+') as ps, case when regexp_matches(text, '^\\s') then 1 else 0 end as skip from conversations),
      e as (select track_id, seg_pos, i, regexp_extract(x, '^\\s*') as gap, regexp_replace(x, '^\\s+', '') as w from (select *, unnest(ps) as x, generate_subscripts(ps, 1) as i from t)),
      j as (select track_id, seg_pos, string_agg(gap || case when ('0x' || substr(md5(w), 1, 4))::bigint % 100 / 100.0::double < 0.1 then '<' || w || '>' else w end, '' order by i) as s from e group by all)
      select track_id, seg_pos, case when text = '' then text else coalesce(s, '') || regexp_extract(text, '\\s*$') end as text from t left join j using (track_id, seg_pos)""",
    "suspicious_words": f"""with {WORDS}, a as (select *, replace(lower(regexp_replace(text, '[\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '', 'g')), 'ß', 'ss') as n, case when probability < 0.1 or probability > 0.9 then (length(n) + 1) // 2 else length(n) end as k from words),
      m as (select *, case when word_idx % 9 <> 4 then left(n, k) end as caption_text, case when word_idx % 9 <> 4 and n <> '' then 2.0::double * k / (length(n) + k) end as similarity from a),
      s as (select *, probability < 0.72 as unsure, coalesce(similarity < 0.72, false) as differs from m)
      select track_id, row_number() over (partition by track_id order by seg_pos, word_idx) - 1 as span_id, seg_pos, word_idx, start_ms, end_ms, text, caption_text, similarity,
        case when unsure and differs then 1 when unsure then 2 else 3 end as tier, case when unsure then probability else coalesce(similarity, 1.0) end as score from s where unsure or differs""",
    "pad_and_merge_windows": f"{_WINDOWS} select track_id, win, start_ms, end_ms, array_to_string(span_ids, ',') as span_ids from windows",
    "window_priority": f"{_PRIORITY} select track_id, win, start_ms, end_ms, tier, score from ranked",
    "budgeted_top_k": f"{_KEPT} select track_id, win, start_ms, end_ms, tier, score, selected from budget",
    "decide": f"with {_ITEMS} select track_id, seg_pos, d as decision, r as reason from decided",
    "finalise_decisions": f"with {_ITEMS} select track_id, seg_pos, decision, reason, final_text, corrected_words from done",
    "apply_replacements": f"""with {WORDS} select track_id, seg_pos, string_agg(case when probability < 0.1 then '*' || text || ' ! ' else text || ' ' end, '' order by word_idx) as text,
      (count(*) + sum(case when probability < 0.1 then 1 else 0 end))::int as n_words from words group by all""",
    "reconciliation_summary": f"""{_KEPT}, {_ITEMS}, i as (select track_id % 150 as track_id, count(*) as suspicious, count(*) filter (k % 17 <> 0) as selected, count(*) filter (k % 7 <> 0) as processed, sum(corrected_words)::bigint as corrected_words,
      count(distinct seg_pos) filter (decision = 'corrected') as corrected_segments, count(*) filter (decision = 'unresolved') as unresolved, count(*) filter (decision = 'skipped') as skipped from done group by all),
      w as (select track_id, count(*) filter (selected) as windows, sum(end_ms - start_ms) filter (selected) as duration_ms, count(*) filter (not selected) as skipped_windows from budget group by track_id)
      select track_id, coalesce(suspicious, 0) as suspicious, coalesce(i.selected, 0) as selected, coalesce(processed, 0) as processed, coalesce(corrected_words, 0) as corrected_words, coalesce(corrected_segments, 0) as corrected_segments, coalesce(unresolved, 0) as unresolved, coalesce(skipped, 0) as skipped,
        coalesce(w.windows, 0) as windows, coalesce(w.duration_ms, 0)::bigint as duration_ms, coalesce(w.skipped_windows, 0) as skipped_windows, coalesce(w.windows, 0) as secondary_windows, coalesce(w.duration_ms, 0)::bigint as secondary_duration_ms,
        array_to_string(list_filter([case when corrected_segments > 0 then 'JAPANESE_RECONCILED' end, case when unresolved > 0 then 'JAPANESE_RECONCILIATION_UNRESOLVED' end, case when skipped > 0 then 'JAPANESE_RECONCILIATION_LIMIT_REACHED' end], lambda x: x is not null), ',') as warnings
      from i full join w using (track_id)""",
    "unresolved_reasons": f"with {_ITEMS} select reason, count(*) as n from done where decision = 'unresolved' group by reason",
    "published_corrections": f"with {_ITEMS} select track_id, seg_pos, final_text from done where decision = 'corrected'",
    "transcript_quality": """with l as (select doc_id, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) as n from (select doc_id, unnest(string_split(text, chr(10))) as t from documents))
      select doc_id, count(*) as segments, sum(n)::bigint as words, count(*) filter (n > 0) as segments_with_words from l group by doc_id""",
}
