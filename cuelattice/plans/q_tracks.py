"""Track and URL queries: pages, customers with nation-derived languages, parts as error texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.operators import tracks as op
from cuelattice.plans.views import table

HOSTS = ("thther.example.org", "www.youtube.com", "youtu.be")


def _urls(spark, sf_dir):
    """Page URLs with video forms made from them."""
    p = table(spark, sf_dir, "pages")
    video = F.substring(F.md5(F.col("url").cast("binary")), 1, 11)
    k = F.col("page_id") % 7
    url = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(" https://www.youtube.com/watch?v="), video, F.lit("&t=3"))).when(k == 2, F.concat(F.lit("http://youtu.be/"), video, F.lit("/x")))
        .when(k == 3, F.concat(F.lit("https://WWW.YouTube.com/Shorts/"), video)).when(k == 4, F.lit("https://www.youtube.com/playlist?list=PL1")).when(k == 5, F.concat(F.lit("ftp://youtu.be/"), video)).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v=short"), F.lit("")))
    )
    return p.select("page_id", url.alias("url"))


_URLS = """
u as (select page_id, substr(md5(url), 1, 11) as v, page_id % 7 as k, case page_id % 7 when 0 then url when 1 then ' https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=3' when 2 then 'http://youtu.be/' || substr(md5(url), 1, 11) || '/x'
  when 3 then 'https://WWW.YouTube.com/Shorts/' || substr(md5(url), 1, 11) when 4 then 'https://www.youtube.com/playlist?list=PL1' when 5 then 'ftp://youtu.be/' || substr(md5(url), 1, 11) else 'https://www.youtube.com/watch?v=short' end as url from pages)
"""
_LANGUAGES = ["en", "ko", "ja-JP", "de", "fr_CA", "es-orig", "ko-orig", "_x", "live_chat", "vi"]


def _pick(of):
    return F.element_at(F.array(*[F.lit(x) for x in _LANGUAGES]), (of % len(_LANGUAGES) + 1).cast("int"))


def _tracks(spark, sf_dir):
    """Three offers a customer at most, manual ones first."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", "c_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord")).where("ord < 1 + c_custkey % 3")
    return rows.select(F.col("c_custkey").alias("video_id"), F.when(F.col("ord") == 0, "manual").otherwise("automatic").alias("source"), _pick(F.col("c_nationkey") + F.col("ord") * 3).alias("provider_language"), "ord").where("provider_language not in ('_x', 'live_chat')")


def _videos(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("video_id"), F.when(F.col("c_custkey") % 4 == 0, _pick(F.col("c_custkey"))).alias("requested_language"), F.when(F.col("c_custkey") % 3 == 0, _pick(F.col("c_custkey") + 1)).alias("original_language"))


_L = "[" + ", ".join(f"'{x}'" for x in _LANGUAGES) + "]"
_NORM = "case when split_part(regexp_replace(replace({0}, '_', '-'), '(?i)-orig$', ''), '-', 1) = '' then null else lower(split_part(regexp_replace(replace({0}, '_', '-'), '(?i)-orig$', ''), '-', 1)) || regexp_replace(regexp_replace(replace({0}, '_', '-'), '(?i)-orig$', ''), '^[^-]*', '') end"
_SELECT = f"""
with t as (select c_custkey as video_id, o as ord, case when o = 0 then 'manual' else 'automatic' end as source, {_L}[(c_nationkey + o * 3) % 10 + 1] as pl from customer, (values (0), (1), (2)) x(o) where o < 1 + c_custkey % 3),
k as (select * from t where pl not in ('_x', 'live_chat')),
v as (select c_custkey as video_id, case when c_custkey % 4 = 0 then {_L}[c_custkey % 10 + 1] end as req, case when c_custkey % 3 = 0 then {_L}[(c_custkey + 1) % 10 + 1] end as orig from customer),
j as (select v.video_id, v.req, coalesce(v.req, v.orig) as want, k.ord, k.source, k.pl, case when k.source = 'automatic' then 1 else 0 end as auto from v left join k using (video_id)),
n as (select *, {_NORM.format("want")} as lang, {_NORM.format("pl")} as lpl from j),
r as (select *, case when pl is null then null
    when pl like '%-orig' and auto = 1 and split_part(lang, '-', 1) = 'ko' and split_part(lpl, '-', 1) = 'ko' then auto * 10
    when lower(pl) = lower(lang) then auto * 10 + 1 when split_part(lower(pl), '-', 1) = split_part(lower(lang), '-', 1) then auto * 10 + 2
    when req is null and pl like '%-orig' then 100 + auto end as rnk from n),
g as (select video_id, any_value(req) as req, arg_min(ord, rnk * 10 + ord) filter (rnk is not null) as best, arg_min(ord, auto * 10 + ord) filter (ord is not null) as fst, list_sort(list(distinct lpl) filter (lpl is not null)) as av from r group by video_id),
c as (select *, coalesce(best, case when req is null and len(av) = 1 then fst end) as pick from g)
select c.video_id, r.source, r.lpl as language, r.pl as provider_language,
  case when pick is not null then null when c.req is not null then 'LANGUAGE_NOT_AVAILABLE' when len(coalesce(av, [])) > 1 then 'LANGUAGE_AMBIGUOUS' else 'NO_CAPTIONS' end as code,
  case when pick is null then coalesce(array_to_string(av, ','), '') end as available
from c left join r on r.video_id = c.video_id and r.ord = c.pick
"""


def _metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("video_id"), F.when(k % 23 == 0, "Private video").when(k % 29 == 0, "This is Age-restricted").otherwise("x").alias("title"),
        F.when(k % 13 == 0, "subscriber_only").when(k % 17 == 0, "geo_blocked").when(k % 19 == 0, "Deleted").otherwise("public").alias("availability"),
        F.when(k % 7 == 0, "is_live").when(k % 5 == 0, "was_live").alias("live_status"), F.when(k % 10 != 0, F.col("o_totalprice").cast("long") % 30000).alias("duration"),
    )


def _errors(spark, sf_dir):
    texts = ["ERROR: Private video", "HTTP Error 429: Too Many", "Join this: members-only", "This live event will begin soon", "http error 503", "blue bolt broke", "Not available in your country", "Sign in to confirm your age"]
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("error_id"), F.concat(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 8 + 1).cast("int")), F.lit(" "), "event_type").alias("message"))


def _offers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    one = lambda url: F.array(F.struct(F.lit(url).alias("url")))
    captions = F.map_from_arrays(F.array(F.lit("en"), F.lit("vi"), F.lit("live_chat"), F.concat(F.lit("x"), F.col("c_nationkey").cast("string"))), F.array(one("a"), F.when(F.col("c_custkey") % 2 == 0, one("a?tlang=vi")).otherwise(one("a")), one("a"), F.filter(one("z"), lambda x: F.lit(False))))
    return op.offered_tracks(c.select(F.col("c_custkey").alias("video_id"), F.lit("automatic").alias("source"), captions.alias("captions")))


def _languages(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("video_id"), op.normalise_language(_pick(F.col("c_nationkey"))).alias("language"))


def _mismatch(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return op.language_mismatch(c.select(F.col("c_custkey").alias("video_id"), _pick(F.col("c_custkey")).alias("expected"), _pick(F.col("c_nationkey")).alias("actual")))


QUERIES = {
    "canonicalise_urls": lambda s, d: op.canonicalise_urls(_urls(s, d), HOSTS),
    "normalise_language": _languages,
    "offered_tracks": _offers,
    "select_track": lambda s, d: op.select_track(_tracks(s, d), _videos(s, d)),
    "eligibility": lambda s, d: op.eligibility(_metadata(s, d)),
    "error_taxonomy": lambda s, d: op.error_taxonomy(_errors(s, d)),
    "audio_first_route": lambda s, d: op.audio_first_route(op.select_track(_tracks(s, d), _videos(s, d))),
    "language_mismatch": _mismatch,
}

ORACLE_SQL = {
    "canonicalise_urls": f"""with {_URLS} select url, case when k in (1, 2, 3) then v end as video_id, case when k in (1, 2, 3) then 'https://www.youtube.com/watch?v=' || v end as canonical,
      case when k in (1, 2, 3) then null when k = 4 then 'PLAYLIST_NOT_SUPPORTED' else 'INVALID_YOUTUBE_URL' end as code from u""",
    "normalise_language": f"select c_custkey as video_id, {_NORM.format('l')} as language from (select c_custkey, {_L}[c_nationkey % 10 + 1] as l from customer)",
    "offered_tracks": "select c_custkey as video_id, 'automatic' as source, l as provider_language from (select c_custkey, unnest(case when c_custkey % 2 = 0 then ['en', 'x' || c_nationkey] else ['en', 'vi', 'x' || c_nationkey] end) as l from customer)",
    "select_track": _SELECT,
    "eligibility": """select o_orderkey as video_id, case when o_orderkey % 23 = 0 then 'VIDEO_PRIVATE' when o_orderkey % 13 = 0 then 'MEMBERS_ONLY' when o_orderkey % 17 <> 0 and o_orderkey % 19 = 0 then 'VIDEO_UNAVAILABLE'
      when o_orderkey % 29 = 0 then 'AGE_RESTRICTED' when o_orderkey % 17 = 0 then 'GEO_RESTRICTED' when o_orderkey % 10 <> 0 and trunc(o_totalprice)::bigint % 30000 > 21600 then 'DURATION_LIMIT_EXCEEDED'
      when o_orderkey % 7 = 0 then 'LIVE_NOT_FINISHED' when o_orderkey % 10 = 0 and o_orderkey % 5 <> 0 then 'VIDEO_UNAVAILABLE' end as code from orders""",
    "error_taxonomy": """select event_id as error_id, ['VIDEO_PRIVATE', 'YOUTUBE_RATE_LIMITED', 'MEMBERS_ONLY', 'LIVE_NOT_FINISHED', 'YOUTUBE_RATE_LIMITED', 'YOUTUBE_EXTRACTION_FAILED', 'GEO_RESTRICTED', 'AGE_RESTRICTED'][event_id % 8 + 1] as code, event_id % 8 in (1, 4) as retryable from events""",
    "audio_first_route": f"with sel as ({_SELECT}) select video_id, case when source is null then 'audio' when source = 'automatic' and split_part(language, '-', 1) in ('ja', 'ko') then 'audio_first' else 'caption_first' end as route from sel",
    "language_mismatch": f"""select video_id, expected, actual, coalesce(split_part({_NORM.format('expected')}, '-', 1) <> split_part({_NORM.format('actual')}, '-', 1), false) as mismatch
      from (select c_custkey as video_id, {_L}[c_custkey % 10 + 1] as expected, {_L}[c_nationkey % 10 + 1] as actual from customer)""",
}
