"""Caption queries over the events-as-cues view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.operators import captions
from cuelattice.plans.views import CUE_GAP_MS, CUES, ROLLED, cues, rolled

_MERGED = f"""
m as (select *, max(end_ms) over (partition by track_id order by cue_ord rows between unbounded preceding and 1 preceding) as m from cues),
kept as (select *, lag(text) over (partition by track_id order by cue_ord) as before from m where m is null or end_ms > m),
marked as (select *, case when before is null or before <> text or start_ms > m + {CUE_GAP_MS} then 1 else 0 end as opens from kept),
runs as (select *, sum(opens) over (partition by track_id order by cue_ord rows between unbounded preceding and current row) as seg_pos from marked),
merged as (select track_id, seg_pos::bigint as seg_pos, min(case when opens = 1 then greatest(start_ms, coalesce(m, start_ms)) end) as start_ms,
  max(end_ms) as end_ms, min(text) as text, count(*) as n_cues from runs group by track_id, seg_pos)
"""
_ROLLING = f"""
pairs as (select *, lag(lines) over w as before, lag(end_ms) over w as ended from cues window w as (partition by track_id order by cue_ord)),
rolling as (select track_id, bool_or(inline or coalesce(start_ms <= ended + {CUE_GAP_MS} and (len(lines) > 1 or len(before) > 1) and list_has_any(lines, before), false)) as rolling
  from pairs group by track_id)
"""

QUERIES = {
    "merge_repeated_cues": lambda s, d: captions.merge_repeated_cues(cues(s, d), CUE_GAP_MS),
    "detect_rolling_tracks": lambda s, d: captions.rolling_tracks(cues(s, d), CUE_GAP_MS),
    "collapse_rolling_cues": lambda s, d: captions.collapse_rolling_cues(cues(s, d), CUE_GAP_MS),
    "route_and_number": lambda s, d: captions.route_and_number(cues(s, d).withColumn("inline", F.lit(False)), 0)[0],
    "trim_rolling_prefix": lambda s, d: captions.trim_rolling_prefix(rolled(s, d)).select("track_id", "seg_pos", "text", "trimmed"),
}

ORACLE_SQL = {
    "merge_repeated_cues": f"with {CUES}, {_MERGED} select * from merged",
    "detect_rolling_tracks": f"with {CUES}, {_ROLLING} select * from rolling",
    "trim_rolling_prefix": f"""with {ROLLED}, p as (select *, lag(text) over w as before, lag(end_ms) over w as ended from rolled where text <> '' window w as (partition by track_id order by seg_pos)),
n as (select *, case when start_ms - ended <= 1500 then
   coalesce(list_max(list_filter(range(4, least(length(before), length(text)) + 1), lambda k: right(before, k) = left(text, k))), 0) else 0 end as k from p)
select track_id, seg_pos, substr(text, k::bigint + 1) as text, k::int as trimmed from n""",
}
