"""Deterministic views of the given tables as the inputs of the operators, each with the same view as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUE_GAP_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(column):
    return F.unix_millis(F.col(column).cast("timestamp"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as caption cues: a track per user; some cues have a second line, a few inline time stamps."""
    e = table(spark, sf_dir, "events")
    start = _ms("ts")
    lines = F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.concat(F.lit("then "), "event_type"))).when(F.col("event_id") % 3 == 1, F.array(F.concat(F.lit("then "), "event_type"))).otherwise(F.array("event_type"))
    return e.select(
        F.col("user_id").alias("track_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("cue_ord"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 1000000)).alias("end_ms"),
        F.col("event_type").alias("text"),
        lines.alias("lines"),
        (F.col("event_id") % 997 == 0).alias("inline"),
    )


CUES = """
cues as (select user_id as track_id, row_number() over (partition by user_id order by ts, event_id) as cue_ord,
  epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + floor(value * 1000000)::bigint as end_ms, event_type as text,
  case event_id % 3 when 0 then [event_type, 'then ' || event_type] when 1 then ['then ' || event_type] else [event_type] end as lines,
  event_id % 997 = 0 as inline
  from events)
"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``doc_id, title, body``; the first line is the title of every third."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


_STAMP = r"(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{3}"
PARAGRAPHS = "paragraphs as (select doc_id, 'doc ' || doc_id as title, coalesce(text, '') as body from documents)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ASR segments of a track, one after the other, at the speed of speech: 80 milliseconds a character."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text")
    return c.select(
        F.col("conv_id").alias("track_id"),
        F.col("turn").alias("seg_pos"),
        "role",
        "text",
        (F.coalesce(F.sum(length).over(before), F.lit(0)) * 80).alias("start_ms"),
        ((F.coalesce(F.sum(length).over(before), F.lit(0)) + length) * 80).alias("end_ms"),
    )


TURNS = """
turns as (select conv_id as track_id, turn as seg_pos, role, text,
  coalesce(sum(length(text)) over b, 0) * 80 as start_ms, (coalesce(sum(length(text)) over b, 0) + length(text)) * 80 as end_ms
  from conversations window b as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
"""


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which every third begins with the end of the one before, as rolling captions do."""
    t = turns(spark, sf_dir)
    before = F.lag("text").over(Window.partitionBy("track_id").orderBy("seg_pos"))
    again = F.when(F.col("seg_pos") % 3 == 1, F.right(before, (F.col("seg_pos") * 37 + 5).cast("int")))
    return t.withColumn("text", F.concat(F.coalesce(again, F.lit("")), "text"))


ROLLED = (
    TURNS
    + """,
rolled as (select * replace (coalesce(case when seg_pos % 3 = 1 then right(lag(text) over (partition by track_id order by seg_pos), seg_pos * 37 + 5) end, '') || text as text) from turns)
"""
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the turns with times by position and a probability that follows from the word."""
    w = turns(spark, sf_dir).select("track_id", "seg_pos", F.posexplode(F.split("text", r"\s+")).alias("word_idx", "text"), "start_ms").where("text <> ''")
    digit = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 4), 16, 10).cast("long") % 100
    return w.select("track_id", "seg_pos", F.col("word_idx").cast("long").alias("word_idx"), (F.col("start_ms") + F.col("word_idx") * 480).alias("start_ms"), (F.col("start_ms") + F.col("word_idx") * 480 + 400).alias("end_ms"), "text", (digit / 100.0).alias("probability"))


WORDS = (
    TURNS
    + """,
words as (select track_id, seg_pos, (i - 1)::bigint as word_idx, start_ms + (i - 1) * 480 as start_ms, start_ms + (i - 1) * 480 + 400 as end_ms, w as text,
  (('0x' || substr(md5(w), 1, 4))::bigint % 100) / 100.0::double as probability
  from (select track_id, seg_pos, start_ms, unnest(regexp_split_to_array(text, '\\s+')) as w, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) as i from turns) where w <> '')
"""
)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcript jobs: the customer is the cache key."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cache_key"),
        F.concat(F.lit("https://videos.example/"), F.col("o_orderkey").cast("string")).alias("request_url"),
        F.col("o_orderpriority").alias("actual_language"),
        F.concat(F.lit('{"title":"Order '), F.col("o_orderkey").cast("string"), F.lit('"}')).alias("video_json"),
        status.alias("status"),
        F.when(status == "completed", "completed").otherwise(F.substring("o_orderpriority", 1, 1)).alias("stage"),
        (F.col("o_orderkey") % 101).cast("int").alias("progress"),
        (F.col("o_orderkey") % 2).cast("int").alias("auto_rewrite_requested"),
        (F.col("o_orderkey") % 7 == 0).cast("int").alias("force_refresh"),
        F.when(status == "failed", F.concat(F.lit("E"), F.substring("o_orderpriority", 1, 1))).alias("error_code"),
        _ms("o_orderdate").alias("created_ms"),
        (_ms("o_orderdate") + (F.col("o_orderkey") % 5) * 86_400_000).alias("updated_ms"),
    )


JOBS = """
jobs as (select o_orderkey as id, o_custkey as cache_key, 'https://videos.example/' || o_orderkey as request_url, o_orderpriority as actual_language,
  '{"title":"Order ' || o_orderkey || '"}' as video_json,
  case o_orderstatus when 'F' then 'failed' when 'O' then 'running' else 'completed' end as status,
  case when o_orderstatus not in ('F', 'O') then 'completed' else substr(o_orderpriority, 1, 1) end as stage,
  (o_orderkey % 101)::int as progress, (o_orderkey % 2)::int as auto_rewrite_requested, (o_orderkey % 7 = 0)::int as force_refresh,
  case when o_orderstatus = 'F' then 'E' || substr(o_orderpriority, 1, 1) end as error_code,
  epoch_us(o_orderdate) // 1000 as created_ms, epoch_us(o_orderdate) // 1000 + (o_orderkey % 5) * 86400000 as updated_ms
  from orders)
"""


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rewrite jobs of the orders."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("d"), F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("r"), F.max("l_quantity").alias("q"))
    status = F.when(F.col("s") == "O", "running").when(F.col("r") == "R", "failed").otherwise("completed")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("transcript_job_id"),
        (F.col("l_orderkey") % 1000).alias("cache_key"),
        status.alias("status"),
        F.floor("q").cast("int").alias("progress"),
        F.when(status == "failed", F.when(F.col("l_linenumber") % 2 == 0, "GPT_TIMEOUT").otherwise("SOURCE_CHANGED")).alias("error_code"),
        (F.col("l_linenumber") % 4 == 0).alias("error_retryable"),
        _ms("d").alias("created_ms"),
        (_ms("d") + F.col("l_linenumber")).alias("updated_ms"),
    )


REWRITES = """
rewrites as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as transcript_job_id, l_orderkey % 1000 as cache_key,
  case when s = 'O' then 'running' when r = 'R' then 'failed' else 'completed' end as status, floor(q)::int as progress,
  case when s <> 'O' and r = 'R' then case when l_linenumber % 2 = 0 then 'GPT_TIMEOUT' else 'SOURCE_CHANGED' end end as error_code,
  l_linenumber % 4 = 0 as error_retryable, epoch_us(d) // 1000 as created_ms, epoch_us(d) // 1000 + l_linenumber as updated_ms
  from (select l_orderkey, l_linenumber, max(l_shipdate) as d, min(l_linestatus) as s, min(l_returnflag) as r, max(l_quantity) as q from lineitem group by all))
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as suspicious spans: tier from the type, score from the value."""
    e = table(spark, sf_dir, "events")
    tier = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    start = _ms("ts") - F.lit(1704067200000)
    return e.select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("span_id"), F.floor(start / 100).alias("start_ms"),
        (F.floor(start / 100) + F.floor(F.col("value") * 200)).alias("end_ms"), tier.alias("tier"), F.col("value").alias("score"),
    )


SPANS = """
spans as (select user_id as track_id, event_id as span_id, (epoch_us(ts) // 1000 - 1704067200000) // 100 as start_ms,
  (epoch_us(ts) // 1000 - 1704067200000) // 100 + floor(value * 200)::bigint as end_ms,
  case event_type when 'error' then 1 when 'click' then 2 else 3 end as tier, value as score from events)
"""

# Paragraphs with normalised bodies, as sinks write and strict readers read them.
NORMAL_PARAGRAPHS = f"""
paragraph_lines as (select *, string_split(regexp_replace(regexp_replace(nfc_normalize(body), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '<{_STAMP}>', '', 'g'), chr(10)) as ls from paragraphs),
paragraph_kept as (select * exclude ls, list_filter(ls, lambda x, i: not regexp_matches(x, '^\\s*{_STAMP}\\s+-->\\s+{_STAMP}')
  and not (regexp_matches(x, '^\\s*[0-9]+\\s*$') and i < len(ls) and regexp_matches(ls[i + 1], '^\\s*{_STAMP}\\s+-->\\s+{_STAMP}'))) as ls from paragraph_lines),
normal as (select * exclude ls replace (regexp_replace(regexp_replace(array_to_string(list_transform(ls, lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as body) from paragraph_kept)
"""
