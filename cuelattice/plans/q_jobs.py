"""Catalogue queries: orders as transcript jobs, line items as their rewrites, events as change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions.text import content_hash, rewrite_cache_key, transcript_cache_key
from cuelattice.operators import jobs as op
from cuelattice.plans.views import JOBS, REWRITES, jobs, rewrites, table


def _artifacts(spark, sf_dir):
    """Rewrites whose file exists: two of three."""
    return rewrites(spark, sf_dir).where("id % 3 <> 0").select(F.col("id").alias("rewrite_id"))


def _content(spark, sf_dir):
    """What each job's text is; every eleventh has none."""
    return jobs(spark, sf_dir).where("id % 11 <> 0").select(F.col("id").alias("job_id"), ((F.col("id") * 7) % 1000).alias("content_key"))


def _workspaces(spark, sf_dir):
    return op.workspace_view(jobs(spark, sf_dir), rewrites(spark, sf_dir), _artifacts(spark, sf_dir), _content(spark, sf_dir))


def _attention(spark, sf_dir):
    k = F.col("id") % 6
    w = F.when(k == 0, F.array(F.lit("JAPANESE_RECONCILIATION_UNAVAILABLE"))).when(k == 1, F.array(F.lit("NOTE"), F.lit("KOREAN_RECONCILIATION_LIMIT_REACHED"))).when(k == 2, F.array(F.lit("GPU_TO_CPU_FALLBACK_USED"))).when(k == 3, F.array(F.lit("NOTE"))).otherwise(F.array().cast("array<string>"))
    j = jobs(spark, sf_dir).select("id", w.alias("warnings"), F.when(F.col("id") % 5 != 0, (F.col("id") % 10) / 10).alias("language_confidence"))
    return op.attention_flags(j).withColumn("warnings", F.array_join("warnings", ","))


_WORKSPACE = ["id", "rewrite_id", "workspace_status", "phase", "progress", "action_code", "cache_hit", "updated_ms"]

_DIRECT = """
artifacts as (select id as rewrite_id from rewrites where id % 3 <> 0),
content as (select id as job_id, (id * 7) % 1000 as content_key from jobs where id % 11 <> 0),
direct as (select * from (select *, row_number() over (partition by transcript_job_id order by created_ms desc, id desc) as rn from rewrites) where rn = 1),
cached as (select * from (select *, row_number() over (partition by cache_key order by updated_ms desc, id desc) as rn from rewrites where status = 'completed') where rn = 1 and id in (select rewrite_id from artifacts)),
active as (select * from (select *, row_number() over (partition by cache_key order by updated_ms desc, id desc) as rn from rewrites where status in ('queued', 'running')) where rn = 1)
"""
_VIEW = f"""
{_DIRECT},
resolved as (
  select j.*, case when d.id is not null then d.id when c.id is not null then c.id else a.id end as rewrite_id,
    case when d.id is not null then d.status when c.id is not null then c.status else a.status end as r_status,
    case when d.id is not null then d.progress when c.id is not null then c.progress else a.progress end as r_progress,
    case when d.id is not null then d.error_code when c.id is not null then c.error_code else a.error_code end as r_code,
    case when d.id is not null then d.error_retryable when c.id is not null then c.error_retryable else a.error_retryable end as r_retry,
    case when d.id is not null then d.updated_ms when c.id is not null then c.updated_ms else a.updated_ms end as r_updated,
    case when d.id is not null then false when c.id is not null then c.transcript_job_id <> j.id when a.id is not null then a.transcript_job_id <> j.id else false end as cache_hit
  from jobs j left join content t on j.id = t.job_id left join direct d on d.transcript_job_id = j.id
  left join cached c on j.auto_rewrite_requested = 1 and j.force_refresh = 0 and j.status = 'completed' and c.cache_key = t.content_key
  left join active a on j.auto_rewrite_requested = 1 and j.force_refresh = 0 and j.status = 'completed' and a.cache_key = t.content_key),
mend as (select *, coalesce(r_code in ('GPT_LOGIN_REQUIRED', 'GPT_PROFILE_LOCKED') or (starts_with(r_code, 'GPT_') and r_retry), false) as mend from resolved),
workspaces as (
  select id, rewrite_id,
    case when status = 'failed' then 'failed' when status in ('queued', 'running') then status when rewrite_id is null and auto_rewrite_requested = 0 then 'completed'
      when rewrite_id is null then 'queued' when r_status = 'failed' then case when mend then 'waiting_for_user' else 'failed' end when r_status = 'completed' then 'completed' else r_status end as workspace_status,
    case when status in ('failed', 'queued', 'running') then 'transcript' when rewrite_id is null and auto_rewrite_requested = 0 then 'completed' when rewrite_id is null then 'rewrite'
      when r_status = 'completed' then 'completed' else 'rewrite' end as phase,
    (case when status = 'failed' then progress when status in ('queued', 'running') then case when auto_rewrite_requested = 1 then progress // 2 else progress end
      when rewrite_id is null and auto_rewrite_requested = 0 then 100 when rewrite_id is null then 50 when r_status = 'completed' then 100 else 50 + r_progress // 2 end)::int as progress,
    case when status not in ('failed', 'queued', 'running') and r_status = 'failed' and mend then r_code end as action_code,
    cache_hit, greatest(updated_ms, coalesce(r_updated, updated_ms)) as updated_ms, request_url, created_ms
  from mend)
"""
_JR = f"with {JOBS}, {REWRITES}"
_IDS = "id % 50 = 3 and status <> 'running'"


def _delete(spark, sf_dir):
    """Delete those of every fiftieth job that nothing stands against."""
    j, r = jobs(spark, sf_dir), rewrites(spark, sf_dir)
    busy = r.where("status = 'running'").select(F.col("transcript_job_id").alias("id"))
    ids = j.where(_IDS).select("id").join(busy, "id", "left_anti")
    left, left_rewrites, problems = op.guarded_delete(j, r, ids)
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))
    return count(left, "jobs").unionByName(count(left_rewrites, "rewrites")).unionByName(count(problems, "problems"))


def _refused(spark, sf_dir):
    """What stands against deleting every fiftieth job and an id that isn't there."""
    ids = jobs(spark, sf_dir).where("id % 50 = 3").select("id").unionByName(jobs(spark, sf_dir).agg((F.max("id") + 1).alias("id")))
    return op.guarded_delete(jobs(spark, sf_dir), rewrites(spark, sf_dir), ids)[2]


def changes(spark, sf_dir):
    """Events as a change log: the type selects which columns a change carries, some with an explicit null."""
    e = table(spark, sf_dir, "events")
    v = F.floor("value").cast("int").cast("string")
    m = (
        F.when(F.col("event_type") == "click", F.create_map(F.lit("progress"), v))
        .when(F.col("event_type") == "view", F.create_map(F.lit("status"), F.lit("running"), F.lit("stage"), F.concat(F.lit("s"), v)))
        .when(F.col("event_type") == "error", F.create_map(F.lit("status"), F.lit("failed"), F.lit("error"), F.concat(F.lit("E"), v)))
        .when(F.col("event_type") == "purchase", F.create_map(F.lit("error"), F.lit(None).cast("string"), F.lit("auto_rewrite_requested"), (F.col("event_id") % 2).cast("string")))
        .otherwise(F.create_map(F.lit("note"), v))
    )
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), m.alias("set"))


_LATEST = """(select {value} from e x where x.job_id = g.job_id and x.event_type in ({types}) order by ts_ms desc, seq desc limit 1)"""
_CHANGES_SQL = """
with e as (select user_id as job_id, event_id as seq, epoch_us(ts) // 1000 as ts_ms, event_type, floor(value)::int as v from events where event_type in ('click', 'view', 'error', 'purchase'))
select job_id,
  arg_max(case event_type when 'view' then 'running' else 'failed' end, row(ts_ms, seq)) filter (event_type in ('view', 'error')) as status,
  arg_max('s' || v, row(ts_ms, seq)) filter (event_type = 'view') as stage,
  greatest(0, least(100, arg_max(v, row(ts_ms, seq)) filter (event_type = 'click'))) as progress,
  nullif(arg_max(case event_type when 'error' then 'E' || v else '' end, row(ts_ms, seq)) filter (event_type in ('error', 'purchase')), '') as error,
  coalesce(bool_or(event_type = 'purchase' and seq % 2 = 1), false) as auto_rewrite_requested, max(ts_ms) as updated_ms
from e group by job_id
"""


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("cache_key"), (F.col("c_custkey") % 13 == 0).alias("force_refresh"))


def _keyed_requests(spark, sf_dir):
    """Requests and jobs that meet by keys made of a video, a language and versions."""
    key = lambda video, language: transcript_cache_key(video.cast("string"), language, "3", "turbo", "large")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), key(F.col("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "en")).alias("cache_key"), (F.col("c_custkey") % 13 == 0).alias("force_refresh"))
    known = jobs(spark, sf_dir).withColumn("cache_key", key(F.col("cache_key"), F.when(F.col("id") % 2 == 1, "en")))
    return op.cache_outcome(asked, known, _complete(spark, sf_dir))


def _rewrite_keys(spark, sf_dir):
    """Rewrites of documents by key: how many documents share each."""
    d = table(spark, sf_dir, "documents").select(rewrite_cache_key(content_hash(F.coalesce("text", F.lit(""))), "2", "5", "default").alias("cache_key"))
    return d.groupBy("cache_key").agg(F.count("*").alias("n"))


def _complete(spark, sf_dir):
    return jobs(spark, sf_dir).where("id % 4 <> 0").select(F.col("id").alias("job_id"))


def _guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.lit("Title: x\n \n")).otherwise(F.concat(F.lit("Title: x\n"), F.col("text")))
    return op.source_guard(d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "running").otherwise("completed").alias("status"), F.when(F.col("doc_id") % 7 != 0, "p").alias("text_path"), text.alias("text")))


QUERIES = {
    "keyed_requests": _keyed_requests,
    "rewrite_keys": _rewrite_keys,
    "latest_by_key": lambda s, d: op.latest_by_key(jobs(s, d)).select("cache_key", "id", "updated_ms"),
    "latest_for_source": lambda s, d: op.latest_for_source(rewrites(s, d)),
    "unfinished_jobs": lambda s, d: op.unfinished_jobs(jobs(s, d)).select("id", "status", "created_ms"),
    "auto_candidates": lambda s, d: op.auto_candidates(jobs(s, d)).select("id", "updated_ms"),
    "search_jobs": lambda s, d: op.search_jobs(jobs(s, d), "order 1%7", ("completed", "failed"), 40, 20).select("id", "status", "created_ms"),
    "count_jobs": lambda s, d: op.count_jobs(jobs(s, d), "order 1_7", ("completed", "failed")),
    "workspace_view": lambda s, d: _workspaces(s, d).select(*_WORKSPACE),
    "list_workspaces": lambda s, d: op.list_workspaces(_workspaces(s, d), "order 2", ("waiting_for_user", "failed", "queued"), 30, 10).select(*_WORKSPACE, "total"),
    "guarded_delete": _delete,
    "guarded_delete_refused": _refused,
    "apply_changes": lambda s, d: op.apply_changes(changes(s, d))[0],
    "apply_changes_rejected": lambda s, d: op.apply_changes(changes(s, d))[1].select("job_id", "seq", F.array_join("unknown", ",").alias("unknown")),
    "auto_rewrite_plan": lambda s, d: op.auto_rewrite_plan(jobs(s, d), rewrites(s, d), _artifacts(s, d), _content(s, d)),
    "cache_outcome": lambda s, d: op.cache_outcome(_requests(s, d), jobs(s, d), _complete(s, d), join_active=True),
    "source_guard": _guard,
    "job_health": lambda s, d: op.job_health(jobs(s, d)),
    "attention_flags": _attention,
}

ORACLE_SQL = {
    "keyed_requests": f"""with {JOBS}, k as (select * replace ('v3:' || cache_key || ':' || case when id % 2 = 1 then 'en' else '__auto__' end || ':turbo:large' as cache_key) from jobs),
      done as (select * from (select *, row_number() over (partition by cache_key order by updated_ms desc, id desc) as rn from k where status = 'completed') where rn = 1 and id % 4 <> 0),
      r as (select c_custkey as request_id, 'v3:' || c_custkey || ':' || case when c_custkey % 3 = 1 then 'en' else '__auto__' end || ':turbo:large' as cache_key, c_custkey % 13 = 0 as forced from customer)
      select request_id, cache_key, case when not forced and id is not null then 'cached' else 'new' end as outcome, case when not forced then id end as job_id from r left join done using (cache_key)""",
    "rewrite_keys": "select 'v2:p5:default:1.1:1:1.3:' || sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as cache_key, count(*) as n from documents group by 1",
    "latest_by_key": f"with {JOBS} select cache_key, id, updated_ms from (select *, row_number() over (partition by cache_key order by updated_ms desc, id desc) as rn from jobs where status = 'completed') where rn = 1",
    "latest_for_source": f"with {REWRITES} select * exclude (rn) from (select *, row_number() over (partition by transcript_job_id order by created_ms desc, id desc) as rn from rewrites) where rn = 1",
    "unfinished_jobs": f"with {JOBS} select id, status, created_ms from jobs where status in ('queued', 'running')",
    "auto_candidates": f"with {JOBS} select id, updated_ms from jobs where status = 'completed' and auto_rewrite_requested = 1",
    "search_jobs": f"with {JOBS} select id, status, created_ms from jobs where (request_url ilike '%order 1%7%' or actual_language ilike '%order 1%7%' or video_json ilike '%order 1%7%') and status in ('completed', 'failed') order by created_ms desc, id desc limit 40 offset 20",
    "count_jobs": f"with {JOBS} select count(*) as n from jobs where (request_url ilike '%order 1_7%' or actual_language ilike '%order 1_7%' or video_json ilike '%order 1_7%') and status in ('completed', 'failed')",
    "workspace_view": f"{_JR}, {_VIEW} select {', '.join(_WORKSPACE)} from workspaces",
    "list_workspaces": f"""{_JR}, {_VIEW}, picked as (select * from workspaces w join (select id as vid, video_json from jobs) v on w.id = v.vid where (request_url ilike '%order 2%' or video_json ilike '%order 2%') and workspace_status in ('waiting_for_user', 'failed', 'queued'))
      select {', '.join(_WORKSPACE)}, (select count(*) from picked) as total from picked order by created_ms desc, id desc limit 30 offset 10""",
    "guarded_delete": f"""{_JR}, gone as (select id from jobs where {_IDS} and id not in (select transcript_job_id from rewrites where status = 'running'))
      select 'jobs' as what, count(*) as n, coalesce(sum(id), 0)::bigint as ids from jobs where id not in (select id from gone)
      union all select 'rewrites', count(*), coalesce(sum(id), 0)::bigint from rewrites where transcript_job_id not in (select id from gone)
      union all select 'problems', 0, 0""",
    "guarded_delete_refused": f"""{_JR}, ids as (select id from jobs where id % 50 = 3 union all select max(id) + 1 from jobs)
      select 'missing' as problem, id from ids where id not in (select id from jobs)
      union all select 'busy_job', id from jobs where status in ('queued', 'running') and id in (select id from ids)
      union all select 'busy_rewrite', id from rewrites where status in ('queued', 'running') and transcript_job_id in (select id from ids)""",
    "apply_changes": _CHANGES_SQL,
    "apply_changes_rejected": "select user_id as job_id, event_id as seq, 'note' as unknown from events where event_type not in ('click', 'view', 'error', 'purchase')",
    "auto_rewrite_plan": f"""{_JR}, {_DIRECT}, base as (
      select j.id as job_id, j.updated_ms, j.force_refresh = 1 as forced, t.content_key, d.id as d_id, d.id is not null and (d.status <> 'completed' or d.id in (select rewrite_id from artifacts)) as usable, c.id as c_id, a.id as a_id
      from jobs j left join content t on j.id = t.job_id left join direct d on d.transcript_job_id = j.id
      left join cached c on j.force_refresh = 0 and c.cache_key = t.content_key left join active a on j.force_refresh = 0 and a.cache_key = t.content_key
      where j.status = 'completed' and j.auto_rewrite_requested = 1),
      acted as (select *, case when usable then 'reuse_direct' when content_key is null then 'source_failure' when c_id is not null then 'reuse_cached' when a_id is not null then 'reuse_active' else 'create' end as act from base),
      ranked as (select *, row_number() over (partition by content_key, act = 'create' and not forced order by updated_ms, job_id) as rn from acted)
      select job_id, case when act = 'create' and not forced and rn > 1 then 'join_new' else act end as action,
        case act when 'reuse_direct' then d_id when 'reuse_cached' then c_id when 'reuse_active' then a_id end as rewrite_id, content_key from ranked""",
    "cache_outcome": f"""with {JOBS}, done as (select * from (select *, row_number() over (partition by cache_key order by updated_ms desc, id desc) as rn from jobs where status = 'completed') where rn = 1 and id % 4 <> 0),
      busy as (select * from (select *, row_number() over (partition by cache_key order by updated_ms desc, id desc) as rn from jobs where status in ('queued', 'running')) where rn = 1)
      select c_custkey as request_id, c_custkey as cache_key,
        case when c_custkey % 13 = 0 then 'new' when d.id is not null then 'cached' when b.id is not null then 'joined' else 'new' end as outcome,
        case when c_custkey % 13 = 0 then null when d.id is not null then d.id else b.id end as job_id
      from customer left join done d on d.cache_key = c_custkey left join busy b on b.cache_key = c_custkey""",
    "source_guard": """select doc_id as id, case when doc_id % 5 = 0 then 'TRANSCRIPT_NOT_COMPLETED' when doc_id % 7 = 0 then 'SOURCE_NOT_AVAILABLE' when doc_id % 9 = 0 or trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 'SOURCE_EMPTY' end as code from documents""",
    "job_health": f"with {JOBS} select status, stage, error_code, count(*) as n, avg(progress) as mean_progress from jobs group by all",
    "attention_flags": """with j as (select o_orderkey as id, case o_orderkey % 6 when 0 then ['JAPANESE_RECONCILIATION_UNAVAILABLE'] when 1 then ['NOTE', 'KOREAN_RECONCILIATION_LIMIT_REACHED'] when 2 then ['GPU_TO_CPU_FALLBACK_USED'] when 3 then ['NOTE'] else []::varchar[] end as w,
      o_orderkey % 5 <> 0 and o_orderkey % 10 < 5 as unsure from orders)
      select id, array_to_string(list_concat(w, case when unsure then ['LOW_LANGUAGE_CONFIDENCE'] else [] end), ',') as warnings, unsure or id % 6 < 3 as attention from j""",
}
