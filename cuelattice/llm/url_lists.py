"""URL filtering with dated lists: entries become validity intervals, captures meet those active when they were fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31 00:00:00"


def host_of(url):
    """Lower-case host of a URL column without user, port and final dot; null where there is none."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")
    return F.nullif(F.lower(host), F.lit(""))


def suffixes(host):
    """The host and each parent domain down to two labels, longest first; a host of one label is itself."""
    labels = F.split(host, r"\.")
    count = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (``list_name, pattern, action, entry_ts``) as ``list_name, pattern, valid_from, valid_to``.

    ``add`` opens an interval and ``remove`` closes it, from its own time on; repeated actions change nothing, a
    ``remove`` wins over an ``add`` of the same time, and an entry never removed stays open. Patterns are compared in
    lower case without a leading ``*.`` or dot; entries with a null or empty part, or another action, are left out.
    """
    clean = entries.select(
        "list_name",
        F.regexp_replace(F.lower(F.trim("pattern")), r"^(\*\.|\.)+", "").alias("pattern"),
        F.lower("action").alias("action"),
        F.col("entry_ts").cast("timestamp").alias("entry_ts"),
    ).where("list_name is not null and pattern <> '' and action in ('add', 'remove') and entry_ts is not null")
    # One state per time: salted by nothing, since one pattern of one list has few dates.
    dated = clean.groupBy("list_name", "pattern", "entry_ts").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    w = Window.partitionBy("list_name", "pattern").orderBy("entry_ts")
    changes = dated.withColumn("before", F.lag("on").over(w)).where("before is null or before <> on")
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("entry_ts").over(w), F.lit(OPEN_END).cast("timestamp")))
    return spans.where("on = 1").select("list_name", "pattern", F.col("entry_ts").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (``capture_id, url, fetch_ts``, more columns are ignored) with what was listed when they were fetched.

    Returns one row per distinct capture_id, url and fetch_ts: ``host``, ``n_active`` entries that hold the host or a
    parent domain, ``lists`` in order, ``longest`` (the most specific such pattern) and ``blocked``. Captures without
    a host or time have none active.
    """
    c = captures.select("capture_id", "url", F.col("fetch_ts").cast("timestamp").alias("fetch_ts")).withColumn("host", host_of(F.col("url"))).distinct()
    # Each (host, time) is evaluated once, however many captures share it.
    asked = c.where("host is not null and fetch_ts is not null").select("host", "fetch_ts").distinct()
    active = (
        asked.withColumn("pattern", F.explode(suffixes(F.col("host"))))
        .join(intervals(entries), "pattern")
        .where("valid_from <= fetch_ts and fetch_ts < valid_to")
        .groupBy("host", "fetch_ts")
        .agg(
            F.count("*").alias("n_active"),
            F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"),
            F.max_by("pattern", F.struct(F.length("pattern"), F.col("pattern"))).alias("longest"),
        )
    )
    none = F.coalesce("n_active", F.lit(0).cast("long"))
    return c.join(active, ["host", "fetch_ts"], "left").select("capture_id", "url", "host", "fetch_ts", none.alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "longest", (none > 0).alias("blocked"))
