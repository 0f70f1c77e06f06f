"""The job catalogue: latest rows, search, derived workspaces, deletion, change logs and rewrite planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.text import needs_attention, recoverable_error, with_low_confidence

ACTIVE = ("queued", "running")


def latest_by_key(jobs: DataFrame, statuses: tuple[str, ...] = ("completed",), key: str = "cache_key") -> DataFrame:
    """The newest row of each key among those with one of ``statuses``; ties on time go to the larger id.

    A maximum by a struct combines on the map side, so a key with very many rows costs no more than others.
    """
    rows = jobs.where(F.col("status").isin(*statuses) & F.col(key).isNotNull())
    whole = F.struct(*[F.col(c) for c in jobs.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct("updated_ms", "id")).alias("row")).select("row.*")


def latest_for_source(rewrites: DataFrame) -> DataFrame:
    """The newest rewrite of each transcript, by creation and id."""
    whole = F.struct(*[F.col(c) for c in rewrites.columns])
    return rewrites.groupBy("transcript_job_id").agg(F.max_by(whole, F.struct("created_ms", "id")).alias("row")).select("row.*")


def unfinished_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that wait or run, oldest first."""
    return jobs.where(F.col("status").isin(*ACTIVE)).orderBy("created_ms", "id")


def auto_candidates(jobs: DataFrame) -> DataFrame:
    """Completed transcripts that asked for a rewrite, longest unchanged first."""
    return jobs.where((F.col("status") == "completed") & (F.col("auto_rewrite_requested") == 1)).orderBy("updated_ms", "id")


def matches(query: str | None, statuses: tuple[str, ...] | None, columns: tuple[str, ...] = ("request_url", "actual_language", "video_json")) -> Column:
    """The search predicate: a case-insensitive LIKE in any of ``columns``, and one of ``statuses``."""
    found = F.lit(True)
    if query:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return found & (F.col("status").isin(*statuses) if statuses else F.lit(True))


def search_jobs(jobs: DataFrame, query: str | None = None, statuses: tuple[str, ...] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the jobs that match, newest first."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return jobs.where(matches(query, statuses)).orderBy(F.desc("created_ms"), F.desc("id")).offset(offset).limit(limit)


def count_jobs(jobs: DataFrame, query: str | None = None, statuses: tuple[str, ...] | None = None) -> DataFrame:
    return jobs.where(matches(query, statuses)).agg(F.count("*").alias("n"))


def workspace_view(jobs: DataFrame, rewrites: DataFrame, artifacts: DataFrame, content: DataFrame) -> DataFrame:
    """Each transcript job with its rewrite and the state derived from both.

    The rewrite is the latest direct one; failing that, for a completed automatic job that isn't forced and has
    content, the latest completed rewrite of the same content whose artifact exists, or else an active one.
    ``artifacts`` (rewrite_id) lists rewrites whose file exists, ``content`` (job_id, content_key) what a job's text is.
    """
    pick = lambda df, p, key: df.select(F.col(key).alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "transcript_job_id", "status", "progress", "error_code", "error_retryable", "updated_ms")])
    direct = pick(latest_for_source(rewrites), "d", "transcript_job_id")
    cached = pick(latest_by_key(rewrites, ("completed",)).join(artifacts, F.col("id") == F.col("rewrite_id"), "left_semi"), "c", "cache_key")
    active = pick(latest_by_key(rewrites, ACTIVE), "a", "cache_key")
    reuse = (F.col("auto_rewrite_requested") == 1) & (F.col("force_refresh") == 0) & (F.col("status") == "completed")
    j = jobs.join(content, F.col("id") == F.col("job_id"), "left").withColumn("wanted", F.when(reuse, F.col("content_key")))
    j = j.join(direct, F.col("id") == F.col("d_key"), "left").join(cached, F.col("wanted") == F.col("c_key"), "left").join(active, F.col("wanted") == F.col("a_key"), "left")
    chosen = lambda c: F.when(F.col("d_id").isNotNull(), F.col(f"d_{c}")).when(F.col("c_id").isNotNull(), F.col(f"c_{c}")).otherwise(F.col(f"a_{c}"))
    for c in ("id", "transcript_job_id", "status", "progress", "error_code", "error_retryable", "updated_ms"):
        j = j.withColumn(f"rewrite_{c}", chosen(c))
    hit = F.col("d_id").isNull() & F.col("rewrite_id").isNotNull() & (F.col("rewrite_transcript_job_id") != F.col("id"))
    auto, none, half = F.col("auto_rewrite_requested") == 1, F.col("rewrite_id").isNull(), lambda c: F.floor(F.col(c) / 2).cast("int")
    mend = recoverable_error(F.col("rewrite_error_code"), F.col("rewrite_error_retryable"))
    early, failed = F.col("status").isin(*ACTIVE), F.col("status") == "failed"
    ladder = lambda f, e, plain, wait, bad, done, go: F.when(failed, f).when(early, e).when(none & ~auto, plain).when(none, wait).when(F.col("rewrite_status") == "failed", bad).when(F.col("rewrite_status") == "completed", done).otherwise(go)
    text = F.lit
    return j.select(
        "id",
        "rewrite_id",
        ladder(text("failed"), F.col("status"), text("completed"), text("queued"), F.when(mend, "waiting_for_user").otherwise("failed"), text("completed"), F.col("rewrite_status")).alias("workspace_status"),
        ladder(text("transcript"), text("transcript"), text("completed"), text("rewrite"), text("rewrite"), text("completed"), text("rewrite")).alias("phase"),
        ladder(F.col("progress"), F.when(auto, half("progress")).otherwise(F.col("progress")), text(100), text(50), 50 + half("rewrite_progress"), text(100), 50 + half("rewrite_progress")).cast("int").alias("progress"),
        F.when(~failed & ~early & (F.col("rewrite_status") == "failed") & mend, F.col("rewrite_error_code")).alias("action_code"),
        F.coalesce(hit, F.lit(False)).alias("cache_hit"),
        F.greatest("updated_ms", F.coalesce("rewrite_updated_ms", "updated_ms")).alias("updated_ms"),
        "request_url", "actual_language", "video_json", "status", "created_ms",
    )


def list_workspaces(workspaces: DataFrame, query: str | None = None, derived: tuple[str, ...] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of workspaces by search and derived status, with ``total`` before paging."""
    rows = workspaces.where(matches(query, None))
    rows = rows.where(F.col("workspace_status").isin(*derived)) if derived else rows
    # One row of totals on the left keeps ``total`` on a page that is past the end; nulls stand for its missing rows.
    page = rows.orderBy(F.desc("created_ms"), F.desc("id")).offset(offset).limit(limit).withColumn("_one", F.lit(1))
    return rows.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1)).join(page, "_one", "left").select(*rows.columns, "total")


def guarded_delete(jobs: DataFrame, rewrites: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All-or-nothing deletion of ``ids`` (id) with their rewrites: jobs left, rewrites left, and what stood against it.

    Missing ids, and jobs or rewrites that still wait or run, stop it; then both tables come back unchanged.
    """
    ids = ids.select("id").distinct()
    missing = ids.join(jobs, "id", "left_anti").select(F.lit("missing").alias("problem"), "id")
    busy = jobs.where(F.col("status").isin(*ACTIVE)).join(ids, "id", "left_semi").select(F.lit("busy_job").alias("problem"), "id")
    of = rewrites.where(F.col("status").isin(*ACTIVE)).join(ids.withColumnRenamed("id", "transcript_job_id"), "transcript_job_id", "left_semi").select(F.lit("busy_rewrite").alias("problem"), "id")
    problems = missing.unionByName(busy).unionByName(of)
    # One row, so that the guard is part of the plan rather than a look at the data beforehand.
    clear = problems.agg((F.count("*") == 0).alias("clear"))
    gone = ids.withColumn("clear", F.lit(True)).join(F.broadcast(clear), "clear").select("id")
    return jobs.join(gone, "id", "left_anti"), rewrites.join(gone.withColumnRenamed("id", "transcript_job_id"), "transcript_job_id", "left_anti"), problems


CHANGE_COLUMNS = ("status", "stage", "progress", "error")


def apply_changes(changes: DataFrame, columns: tuple[str, ...] = CHANGE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Change log (``job_id, seq, ts_ms, set`` map) to current state, and the rows rejected for an unknown column.

    Of each column the latest change that carries it counts, an explicit null included; the automatic flag never
    goes back, progress stays within 0 to 100.
    """
    known = F.array(*[F.lit(c) for c in (*columns, "auto_rewrite_requested")])
    unknown = F.array_except(F.map_keys("set"), known)
    rejected = changes.where(F.size(unknown) > 0).withColumn("unknown", unknown)
    good = changes.where(F.size(unknown) == 0)
    return good.groupBy("job_id").agg(*latest_columns(columns)), rejected


def latest_columns(columns: tuple[str, ...] = CHANGE_COLUMNS) -> list[Column]:
    """Aggregates of a change log that batch and stream share."""
    at = F.struct("ts_ms", "seq")
    out = []
    for c in columns:
        has = F.map_contains_key("set", c)
        value = F.max_by(F.when(has, F.struct(F.element_at("set", F.lit(c)).alias("v"))), F.when(has, at)).getField("v")
        out.append((F.greatest(F.lit(0), F.least(F.lit(100), value.cast("int"))) if c == "progress" else value).alias(c))
    out.append(F.coalesce(F.bool_or(F.element_at("set", F.lit("auto_rewrite_requested")) == "1"), F.lit(False)).alias("auto_rewrite_requested"))
    out.append(F.max("ts_ms").alias("updated_ms"))
    return out


def rewrite_lookups(rewrites: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What plans ask of the rewrites there are: the latest of each transcript, and by content the completed and active ones."""
    have = artifacts.select(F.col("rewrite_id").alias("have"))
    direct = latest_for_source(rewrites).join(have, F.col("id") == F.col("have"), "left").select(F.col("transcript_job_id").alias("d_key"), F.col("id").alias("d_id"), ((F.col("status") != "completed") | F.col("have").isNotNull()).alias("d_usable"))
    cached = latest_by_key(rewrites, ("completed",)).join(have, F.col("id") == F.col("have"), "left_semi").select(F.col("cache_key").alias("c_key"), F.col("id").alias("c_id"))
    return direct, cached, latest_by_key(rewrites, ACTIVE).select(F.col("cache_key").alias("a_key"), F.col("id").alias("a_id"))


def planned_alone(jobs: DataFrame, lookups: tuple[DataFrame, DataFrame, DataFrame], content: DataFrame) -> DataFrame:
    """``job_id, action, rewrite_id, content_key, forced, updated_ms`` of automatic candidates, each as if it were the only one."""
    direct, cached, active = lookups
    j = jobs.where((F.col("status") == "completed") & (F.col("auto_rewrite_requested") == 1)).join(content, F.col("id") == F.col("job_id"), "left")
    j = j.withColumn("forced", F.col("force_refresh") == 1).withColumn("wanted", F.when(~F.col("forced"), F.col("content_key")))
    j = j.join(direct, F.col("id") == F.col("d_key"), "left").join(cached, F.col("wanted") == F.col("c_key"), "left").join(active, F.col("wanted") == F.col("a_key"), "left")
    action = F.when(F.col("d_usable"), "reuse_direct").when(F.col("content_key").isNull(), "source_failure").when(F.col("c_id").isNotNull(), "reuse_cached").when(F.col("a_id").isNotNull(), "reuse_active").otherwise("create")
    rewrite = F.when(F.col("action") == "reuse_direct", F.col("d_id")).when(F.col("action") == "reuse_cached", F.col("c_id")).when(F.col("action") == "reuse_active", F.col("a_id"))
    return j.withColumn("action", action).select(F.col("id").alias("job_id"), "action", rewrite.alias("rewrite_id"), "content_key", "forced", "updated_ms")


def auto_rewrite_plan(jobs: DataFrame, rewrites: DataFrame, artifacts: DataFrame, content: DataFrame) -> DataFrame:
    """What to do for each automatic candidate: ``job_id, action, rewrite_id, content_key``.

    A usable direct rewrite is reused; without source text the failure is recorded; unless forced, a completed rewrite
    of the same content with an artifact, or an active one, is shared. Of those left, the first job of each content
    creates the rewrite, others join it; forced jobs each create their own.
    """
    j = planned_alone(jobs, rewrite_lookups(rewrites, artifacts), content)
    first = j.where("action = 'create' and not forced").groupBy("content_key").agg(F.min(F.struct("updated_ms", "job_id")).getField("job_id").alias("first_id"))
    joins = (F.col("action") == "create") & ~F.col("forced") & (F.col("job_id") != F.col("first_id"))
    return j.join(first, "content_key", "left").select("job_id", F.when(joins, "join_new").otherwise(F.col("action")).alias("action"), "rewrite_id", "content_key")


def cache_outcome(requests: DataFrame, jobs: DataFrame, complete: DataFrame, join_active: bool = False) -> DataFrame:
    """Submitted requests (``request_id, cache_key, force_refresh``) as ``cached``, ``joined`` or ``new``, with the job.

    ``complete`` (job_id) lists jobs whose artifacts are all there; only rewrites join a job that is active.
    """
    done = latest_by_key(jobs).join(complete, F.col("id") == F.col("job_id"), "left_semi").select(F.col("cache_key"), F.col("id").alias("done_id"))
    busy = latest_by_key(jobs, ACTIVE).select("cache_key", F.col("id").alias("busy_id"))
    r = requests.join(done, "cache_key", "left").join(busy, "cache_key", "left")
    free = ~F.col("force_refresh")
    cached, joined = free & F.col("done_id").isNotNull(), free & F.lit(join_active) & F.col("busy_id").isNotNull()
    return r.select("request_id", "cache_key", F.when(cached, "cached").when(joined, "joined").otherwise("new").alias("outcome"), F.when(cached, F.col("done_id")).when(joined, F.col("busy_id")).alias("job_id"))


def source_guard(jobs: DataFrame) -> DataFrame:
    """``id, code`` of jobs (``status, text_path, text``): whether a rewrite may start from them, null if so."""
    body = F.regexp_replace("text", r"^\s*Title:[^\n]*(\n|$)", "")
    code = F.when(F.col("status") != "completed", "TRANSCRIPT_NOT_COMPLETED").when(F.col("text_path").isNull(), "SOURCE_NOT_AVAILABLE").when(F.coalesce(F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit("")) == "", "SOURCE_EMPTY")
    return jobs.select("id", code.alias("code"))


def job_health(jobs: DataFrame) -> DataFrame:
    """Counts by status, stage and error code."""
    return jobs.groupBy("status", "stage", "error_code").agg(F.count("*").alias("n"), F.avg("progress").alias("mean_progress"))


def attention_flags(jobs: DataFrame) -> DataFrame:
    """``id, warnings, attention``: a job's warnings with that of low language confidence, and whether a person should look."""
    w = jobs.select("id", with_low_confidence(F.col("warnings"), F.col("language_confidence")).alias("warnings"))
    return w.select("id", "warnings", needs_attention(F.col("warnings")).alias("attention"))
