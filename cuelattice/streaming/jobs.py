"""The catalogue as structured streams: current state from changes, and rewrite requests for new content."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelattice.operators.jobs import CHANGE_COLUMNS, latest_columns, planned_alone, rewrite_lookups
from cuelattice.sources.files import staged


def job_state_stream(changes: DataFrame, columns: tuple[str, ...] = CHANGE_COLUMNS) -> DataFrame:
    """Current state of each job from a stream of changes; write it in ``update`` mode, so that a batch gives the jobs it changed.

    Late changes lose to larger (time, number) wherever they arrive, so no watermark is needed; state grows with the
    number of jobs.
    """
    known = F.array(*[F.lit(c) for c in (*columns, "auto_rewrite_requested")])
    return changes.where(F.size(F.array_except(F.map_keys("set"), known)) == 0).groupBy("job_id").agg(*latest_columns(columns))


def auto_rewrite_stream(completed: DataFrame, watermark: str | None = None) -> DataFrame:
    """At most one rewrite request per content key from a stream of completed transcripts (``id, content_key, ts``).

    With a ``watermark`` keys are forgotten after it, which bounds the state; without one they are kept for good.
    """
    wanted = completed.where("content_key is not null")
    if watermark:
        return wanted.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["content_key"])
    return wanted.dropDuplicates(["content_key"])


PLANNED = "job_id long, action string, rewrite_id long, content_key long, creator_id long, updated_ms long"


class FirstOfContent(StatefulProcessor):
    """Keeps for each content the job that creates its rewrite; later jobs of it join that one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.creator = handle.getValueState("creator", "job_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        free = every["free"].astype(bool)
        every["creator_id"] = pd.Series([None] * len(every), dtype="Int64")
        if free.any():
            if self.creator.exists():
                first = self.creator.get()[0]
            else:
                first = int(every[free].sort_values(["updated_ms", "job_id"])["job_id"].iloc[0])
                self.creator.update((first,))
            every.loc[free, "creator_id"] = first
            every.loc[free & (every["job_id"] != first), "action"] = "join_new"
        for c in ("rewrite_id", "content_key"):
            every[c] = every[c].astype("Int64")
        yield every[["job_id", "action", "rewrite_id", "content_key", "creator_id", "updated_ms"]]

    def close(self) -> None:
        pass


def plan_requests(completed: DataFrame, path: str, rewrites: DataFrame, artifacts: DataFrame, content: DataFrame) -> None:
    """Decide for each newly completed transcript of a stream as ``auto_rewrite_plan`` does; decisions go below ``path``.

    The rewrites there are at the start are looked up by joins with tables made once. Who creates the rewrite of a new
    content is state of the stream, a value for each content, so a batch costs its own rows however many went before;
    within one batch the earliest job creates. ``creator_id`` names that job, for it and for those that join.
    A batch is written under its number and replaces what a failed try has left there, so none is counted twice.
    ``read_requests`` gives the decisions.
    """
    spark = completed.sparkSession
    lookups = tuple(staged(t, "lookups") for t in rewrite_lookups(rewrites, artifacts))
    alone = planned_alone(completed, lookups, staged(content, "content"))
    free = (F.col("action") == "create") & ~F.col("forced")
    # Rows that ask no state are dealt over a few hundred keys, as each key of a batch costs a call.
    keyed = alone.withColumn("free", free).withColumn("of", F.when(free, F.concat(F.lit("content "), "content_key")).otherwise(F.concat(F.lit("other "), F.pmod(F.xxhash64("job_id"), F.lit(256))))).drop("forced")
    decided = keyed.groupBy("of").transformWithStateInPandas(FirstOfContent(), PLANNED, "append", "none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/requests/batch={number}")

    with _state_in_rocksdb(spark):
        decided.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """State by key needs this store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PLANNED}, batch int").parquet(f"{path}/requests")


def run_to_end(stream: DataFrame, path: str, mode: str) -> None:
    """Drive a stream over all that is there now; each batch's rows lie below ``path`` under its number.

    A batch that is repeated replaces itself. In ``update`` mode a batch holds the rows it changed, and ``read_state``
    gives the current ones; in ``append`` mode all batches together are the result.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def read_state(stream: DataFrame, path: str, key: str) -> DataFrame:
    """The current row of each ``key``, that of the last batch that changed it: what ``run_to_end`` kept of ``stream`` in ``update`` mode."""
    rows = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/out")
    kept = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("row")).select(key, "row.*")


def fold_state(stream: DataFrame, path: str, key: str) -> None:
    """Batches kept so far as one: the state is written beside them, under the last number, and the others go.

    To be called while the stream is at rest; a batch that comes later has a larger number.
    """
    spark = stream.sparkSession
    numbers = [r["batch"] for r in spark.read.parquet(f"{path}/out").select("batch").distinct().collect()]
    if len(numbers) > 1:
        whole = staged(read_state(stream, path, key), "state")
        whole.write.mode("overwrite").parquet(f"{path}/out/batch={max(numbers)}")
        for n in sorted(numbers)[:-1]:
            whole.limit(0).write.mode("overwrite").parquet(f"{path}/out/batch={n}")
