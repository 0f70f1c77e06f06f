"""One registered query for each training-data operator, over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm import ann, decontaminate, hard_negatives, html_text, near_dup, packing, periodic, quality, simhash, token_files, toxicity, url_lists, warc
from cuelattice.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text", "n_chars"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The end-of-document identifier of the byte-level vocabulary.
END_OF_TEXT = 50256


def op2_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()

    def encode_factory():
        tokenizer = packing.tokenizer_at(path)
        return lambda texts: [tokenizer.ids(t).astype("<u2").tobytes() for t in texts]

    blocks = token_files.flat_blocks(table(spark, sf_dir, "documents"), encode_factory, END_OF_TEXT)
    return token_files.documents_of(blocks, END_OF_TEXT)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    payload = F.element_at("headers", "WARC-Source-Payload-Digest").alias("source_payload_digest")
    return records.select("record_id", "record_type", "target_uri", "warc_date", "refers_to", "content_type", "content_length", "block_digest", payload, F.sha2("block", 256).alias("block_sha256"))


def _stable(text, modulus: int):
    """A number from a text that DuckDB computes alike."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % modulus


def dated_entries(pages: DataFrame) -> DataFrame:
    """Blocklist history derived from the hosts of all pages: each host, and each parent domain, is listed and unlisted."""
    host = url_lists.host_of(F.col("url"))
    hosts = pages.select(host.alias("h")).where("h is not null").distinct()
    patterns = hosts.select("h").unionByName(hosts.select(F.regexp_replace("h", r"^[^.]*\.", "").alias("h"))).distinct()
    day = _stable(F.col("h"), 300)
    history = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.lit("add").alias("action"), (day + 5).alias("day")),
        F.struct(F.lit("remove").alias("action"), (day + 10 + _stable(F.concat("h", F.lit("x")), 40)).alias("day")),
        F.struct(F.lit("add").alias("action"), (day + 90).alias("day")),
    )
    lists = F.when(_stable(F.concat("h", F.lit("l")), 2) == 0, "malware").otherwise("adult")
    e = patterns.select(F.col("h").alias("pattern"), lists.alias("list_name"), F.explode(history).alias("e"))
    return e.select("list_name", "pattern", "e.action", F.timestamp_seconds(F.lit(1704067200) + F.col("e.day") * 86400).alias("entry_ts"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(400)) * 86400).alias("fetch_ts"))
    out = url_lists.evaluate(captures, dated_entries(pages))
    return out.select(F.col("capture_id").alias("page_id"), "host", F.unix_seconds("fetch_ts").alias("fetch_s"), "n_active", "lists", F.coalesce("longest", F.lit("")).alias("longest"), "blocked")


OP10_SQL = """
with c as (
  select distinct page_id, url, 1704067200 + ((page_id * 7919) % 400) * 86400 as fetch_s,
    nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '')), '') as host
  from pages),
hosts as (select distinct host as h from c where host is not null),
patterns as (select h from hosts union select regexp_replace(h, '^[^.]*\\.', '') from hosts),
days as (select h, case when ('0x' || substr(md5(h || 'l'), 1, 8))::bigint % 2 = 0 then 'malware' else 'adult' end as list_name,
    ('0x' || substr(md5(h), 1, 8))::bigint % 300 as d, ('0x' || substr(md5(h || 'x'), 1, 8))::bigint % 40 as x from patterns),
spans as (
  select h, list_name, d as valid_from, d + 10 + x as valid_to from days
  union all select h, list_name, d + 90, 1000000 from days),
active as (
  select c.page_id, c.url, c.fetch_s, count(*) as n_active, string_agg(distinct s.list_name, ',' order by s.list_name) as lists, arg_max(s.h, length(s.h)) as longest
  from c join spans s on (c.host = s.h or ends_with(c.host, '.' || s.h))
    and (strpos(s.h, '.') > 0 or c.host = s.h)
    and 1704067200 + s.valid_from * 86400 <= c.fetch_s and c.fetch_s < 1704067200 + s.valid_to * 86400
  group by all)
select c.page_id, c.host, c.fetch_s, coalesce(a.n_active, 0) as n_active, coalesce(a.lists, '') as lists, coalesce(a.longest, '') as longest, a.n_active is not null as blocked
from c left join active a using (page_id, url, fetch_s)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, list_dot_product(a.v, b.v)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over w as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.alike and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 10
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents; where crc32(doc_id) divides by ten, words from some place on repeat those that begin there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), at), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # The longest; of equal ones the first by start, then period, is the largest when those are negated.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(digest, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op4_quality": op4_quality,
    "op7_packing": op7_packing,
    "op5_decontamination": op5_decontamination,
    "op9_html_text": op9_html_text,
    "op2_separators": op2_separators,
    "op3_nearest": op3_nearest,
    "op8_warc": op8_warc,
    "op10_url_lists": op10_url_lists,
    "op6_near_duplicates": op6_near_duplicates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL: dict[str, str] = {"op10_url_lists": OP10_SQL, "op11_hard_negatives": OP11_SQL}
