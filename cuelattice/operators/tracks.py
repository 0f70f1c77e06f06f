"""Track choice and URL hygiene over metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.text import strip

LONGEST_SECONDS = 21_600
# Hosts that carry videos, and what marks a passing failure.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com", "youtu.be")
SHORT_HOSTS = ("youtu.be",)
TRANSIENT = ("429", "too many requests", "timed out", "timeout", "temporarily unavailable", "connection reset", "network is unreachable", "http error 5")


def canonicalise_urls(urls: DataFrame, hosts: tuple[str, ...] = VIDEO_HOSTS, short_hosts: tuple[str, ...] = SHORT_HOSTS) -> DataFrame:
    """``url, video_id, canonical, code``: the item a URL names, or why it names none. Rejects stay as rows."""
    u = strip(F.col("url"))
    part = lambda what: F.try_parse_url(u, F.lit(what))
    host = F.regexp_replace(F.lower(part("HOST")), r"\.+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    path, query = F.coalesce(part("PATH"), F.lit("")), F.coalesce(part("QUERY"), F.lit(""))
    plain = lambda v: F.coalesce(F.try_url_decode(v), v)
    given = lambda k: F.nullif(plain(F.regexp_extract(query, rf"(?:^|&){k}=([^&]+)", 1)), F.lit(""))
    in_path = F.nullif(F.regexp_extract(path, r"(?i)^/+(?:shorts|embed|live|v)/+([^/]+)", 1), F.lit(""))
    first = F.nullif(F.regexp_extract(path, r"^/*([^/]+)", 1), F.lit(""))
    found = F.when(host.isin(*short_hosts), first).otherwise(F.coalesce(given("v"), in_path))
    known = scheme.isin("http", "https") & F.coalesce(host.isin(*hosts), F.lit(False))
    video = F.when(known & found.rlike(r"^[\p{L}\p{N}_\-]{11}$"), found)
    code = F.when(~known, "INVALID_YOUTUBE_URL").when(video.isNotNull(), None).when(given("list").isNotNull() & given("v").isNull(), "PLAYLIST_NOT_SUPPORTED").otherwise("INVALID_YOUTUBE_URL")
    return urls.select("url", video.alias("video_id"), F.when(video.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), video)).alias("canonical"), code.alias("code"))


def normalise_language(value: Column) -> Column:
    """``-`` for ``_``, no ``-orig``, the base in lower case; null where nothing is left."""
    v = F.regexp_replace(F.replace(value, F.lit("_"), F.lit("-")), r"(?i)-orig$", "")
    base = F.substring_index(v, "-", 1)
    return F.when(base != "", F.concat(F.lower(base), F.regexp_replace(v, r"^[^-]*", "")))


def base_language(value: Column) -> Column:
    return F.substring_index(normalise_language(value), "-", 1)


def offered_tracks(offers: DataFrame) -> DataFrame:
    """Language maps (``video_id, source, captions`` map of formats) as rows, without chats and translations."""
    e = offers.select("video_id", "source", F.explode("captions").alias("provider_language", "formats"))
    translated = (F.size("formats") > 0) & F.forall("formats", lambda f: F.coalesce(f.url.contains("tlang="), F.lit(False)))
    return e.where((F.col("provider_language") != "live_chat") & normalise_language(F.col("provider_language")).isNotNull() & ~F.coalesce(translated, F.lit(False))).select("video_id", "source", "provider_language")


def select_track(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """One track per video: ``video_id, source, language, provider_language, code, available``.

    ``tracks`` has ``video_id, source (manual, automatic), provider_language, ord``; ``videos`` has
    ``video_id, requested_language, original_language``. A requested, else the original language is matched (manual
    before automatic; an automatic Korean original first; exact before base); without a request also any original
    track, then the only language there is. All is one ranked minimum per video.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    # Languages are read once for each row before the join; behind it there are only comparisons of columns.
    v = videos.select("video_id", filled("requested_language").isNotNull().alias("asked"), normalise_language(F.coalesce(filled("requested_language"), filled("original_language"))).alias("wanted"))
    v = v.withColumn("wanted", F.lower("wanted")).withColumn("wanted_base", F.substring_index("wanted", "-", 1))
    o = tracks.select("video_id", "source", "provider_language", "ord", F.lower("provider_language").alias("own"), normalise_language(F.col("provider_language")).alias("read"))
    o = o.select("*", F.substring_index("own", "-", 1).alias("own_base"), F.substring_index("read", "-", 1).alias("read_base"), F.coalesce("read", "provider_language").alias("language"), F.col("own").endswith("-orig").alias("orig"), (F.col("source") == "automatic").cast("int").alias("automatic"))
    t = o.join(v, "video_id", "right")
    automatic, asked, code_language = F.col("automatic"), F.col("asked"), F.col("language")
    korean = F.col("orig") & (automatic == 1) & (F.col("wanted_base") == "ko") & (F.col("read_base") == "ko")
    by_language = F.when(korean, 0).when(F.col("own") == F.col("wanted"), 1).when(F.col("own_base") == F.col("wanted_base"), 2)
    t = t.withColumn("rank", F.when(by_language.isNotNull(), automatic * 10 + by_language).when(~asked & F.col("orig"), 100 + automatic))
    rank = F.col("rank")
    at = F.struct(rank.alias("r"), F.col("ord"))
    only = F.struct(automatic.alias("r"), F.col("ord"))
    it = F.struct("source", "language", "provider_language")
    g = t.groupBy("video_id").agg(
        F.min_by(F.when(rank.isNotNull(), it), F.when(rank.isNotNull(), at)).alias("best"),
        F.min_by(F.when(F.col("ord").isNotNull(), it), F.when(F.col("ord").isNotNull(), only)).alias("first"),
        F.array_sort(F.collect_set(F.when(F.col("ord").isNotNull(), code_language))).alias("available"),
        F.first(asked).alias("asked"),
    )
    lone = ~F.col("asked") & (F.size("available") == 1)
    chosen = F.coalesce("best", F.when(lone, F.col("first")))
    code = F.when(chosen.isNotNull(), None).when(F.col("asked"), "LANGUAGE_NOT_AVAILABLE").when(F.size("available") > 1, "LANGUAGE_AMBIGUOUS").otherwise("NO_CAPTIONS")
    return g.withColumn("t", chosen).select("video_id", "t.source", "t.language", "t.provider_language", code.alias("code"), F.when(code.isNotNull(), F.array_join("available", ",")).alias("available"))


def eligibility(videos: DataFrame, longest: int = LONGEST_SECONDS) -> DataFrame:
    """``video_id, code``: the first reason a video (``title, availability, live_status, duration``) can't be used."""
    a = F.lower(F.coalesce("availability", F.lit("")))
    said = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("availability", F.lit("")), F.coalesce("live_status", F.lit(""))))
    live = F.coalesce("live_status", F.lit(""))
    code = (
        F.when(a.isin("private", "needs_auth") | said.contains("private video"), "VIDEO_PRIVATE")
        .when(a.isin("subscriber_only", "premium_only", "needs_subscription"), "MEMBERS_ONLY")
        .when(a.isin("unavailable", "deleted"), "VIDEO_UNAVAILABLE")
        .when(said.contains("age-restricted") | said.contains("sign in to confirm your age"), "AGE_RESTRICTED")
        .when(said.contains("not available in your country") | a.contains("geo"), "GEO_RESTRICTED")
        .when(F.col("duration") > longest, "DURATION_LIMIT_EXCEEDED")
        .when(live.isin("is_live", "is_upcoming"), "LIVE_NOT_FINISHED")
        .when(F.col("duration").isNull() & ~live.isin("post_live", "was_live"), "VIDEO_UNAVAILABLE")
    )
    return videos.select("video_id", code.alias("code"))


def error_taxonomy(errors: DataFrame) -> DataFrame:
    """``error_id, code, retryable`` of free-text download errors (``message``)."""
    m = F.lower(F.coalesce("message", F.lit("")))
    has = lambda *xs: F.lit(False) if not xs else m.rlike("|".join(x.replace(".", r"\.") for x in xs))
    code = (
        F.when(has("private video"), "VIDEO_PRIVATE")
        .when(has("members-only", "members only"), "MEMBERS_ONLY")
        .when(has("sign in to confirm your age", "age-restricted"), "AGE_RESTRICTED")
        .when(has("not available in your country"), "GEO_RESTRICTED")
        .when(has("live event will begin", "is live"), "LIVE_NOT_FINISHED")
        .when(has(*TRANSIENT), "YOUTUBE_RATE_LIMITED")
        .otherwise("YOUTUBE_EXTRACTION_FAILED")
    )
    return errors.select("error_id", code.alias("code"), (code == "YOUTUBE_RATE_LIMITED").alias("retryable"))


def audio_first_route(selected: DataFrame) -> DataFrame:
    """``video_id, route``: automatic Japanese or Korean tracks are transcribed against the caption, others taken as they are."""
    cjk = (F.col("source") == "automatic") & F.substring_index("language", "-", 1).isin("ja", "ko")
    return selected.select("video_id", F.when(F.col("source").isNull(), "audio").when(cjk, "audio_first").otherwise("caption_first").alias("route"))


def language_mismatch(results: DataFrame) -> DataFrame:
    """``video_id, expected, actual, mismatch``: results in another base language than expected."""
    differ = base_language(F.col("expected")) != base_language(F.col("actual"))
    return results.select("video_id", "expected", "actual", F.coalesce(differ, F.lit(False)).alias("mismatch"))
