"""Streams over several batches, and after a restart, against the same job in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.operators import jobs as op
from cuelattice.streaming import jobs as stream

DONE = "id long, status string, auto_rewrite_requested int, force_refresh int, updated_ms long"


def completed(spark):
    """Jobs of few contents, some forced, some without content, in the order in which they complete."""
    rows = [(i, "completed", 1, int(i % 13 == 0), 1000 + i) for i in range(120)]
    content = [(i, i % 9) for i in range(120) if i % 11]
    rewrites = [(900 + k, 7000 + k, k, s, 5, 5) for k, s in ((1, "completed"), (2, "completed"), (3, "running"), (4, "failed"))] + [(950, 20, 77, "completed", 6, 6), (951, 21, 78, "queued", 6, 6)]
    return (
        spark.createDataFrame(rows, DONE), spark.createDataFrame(content, "job_id long, content_key long"),
        spark.createDataFrame(rewrites, "id long, transcript_job_id long, cache_key long, status string, created_ms long, updated_ms long"), spark.createDataFrame([(901,), (950,)], "rewrite_id long"),
    )


def test_requests_over_batches_and_a_restart_equal_one_plan(spark, tmp_path):
    done, content, rewrites, artifacts = completed(spark)
    want = {r["job_id"]: (r["action"], r["rewrite_id"]) for r in op.auto_rewrite_plan(done, rewrites, artifacts, content).collect()}
    path, before = str(tmp_path), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for part in range(4):
        done.where((F.col("id") >= part * 30) & (F.col("id") < part * 30 + 30)).coalesce(1).write.parquet(f"{path}/in/part={part}")
        if part in (1, 3):  # two runs: the second goes on where the first ended
            live = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
            stream.plan_requests(live, path, rewrites, artifacts, content)
    got = stream.read_requests(spark, path).collect()
    assert {r["job_id"]: (r["action"], r["rewrite_id"]) for r in got} == want and len(got) == 120
    assert {"create", "join_new", "reuse_direct", "reuse_cached", "reuse_active", "source_failure"} == {a for a, _ in want.values()}
    first = {r["content_key"]: r["job_id"] for r in got if r["action"] == "create" and r["creator_id"] is not None}
    assert all(r["creator_id"] == first[r["content_key"]] for r in got if r["action"] == "join_new") and len({r["batch"] for r in got}) == 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_state_of_jobs_is_written_for_changed_jobs_alone(spark, tmp_path):
    rows = [(j, s, 1000 + s, {"progress": str(s), "stage": f"s{s}"} if s % 3 else {"error": None, "status": "running"}) for s in range(8) for j in range(10) if s < 2 or j < 3]
    log = spark.createDataFrame(rows, "job_id long, seq long, ts_ms long, set map<string,string>")
    path = str(tmp_path)
    for s in range(8):
        log.where(F.col("seq") == s).coalesce(1).write.parquet(f"{path}/in/s={s}")
        if s in (4, 7):
            live = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
            states = stream.job_state_stream(live)
            stream.run_to_end(states, path, "update")
            want = op.apply_changes(log.where(F.col("seq") <= s))[0]
            got = stream.read_state(states, path, "job_id")
            assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/out").groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert sizes == [10, 10, 3, 3, 3, 3, 3, 3]
    stream.fold_state(states, path, "job_id")
    assert sorted(map(tuple, stream.read_state(states, path, "job_id").select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert spark.read.parquet(f"{path}/out").count() == 10
