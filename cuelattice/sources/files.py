"""Caption files, transcripts, documents and catalogue rows in and out of DataFrames."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelattice.functions.text import SPACE, clean_markup, nfkc, strip
from cuelattice.operators.docs import normalise_bodies, single_line
from cuelattice.sources.named_files import file_name, read_named, write_named

STAMP = r"(?:(\d{1,}):)?(\d{1,2}):(\d{2})[.,](\d{3})"
TIMING = rf"^\s*{STAMP}\s*-->\s*{STAMP}(?:\s.*)?$"
INLINE = r"<(?:\d{1,}:)?\d{1,2}:\d{2}[.,]\d{3}>"
TRANSCRIPT_SCHEMA = (
    "schema_version int, video struct<id:string,title:string>, language string, source string, "
    "segments array<struct<index:int,start_ms:long,end_ms:long,text:string,words:array<struct<start_ms:long,end_ms:long,text:string,probability:double>>>>, "
    "warnings array<string>, reconciliation struct<items:array<struct<decision:string,decision_reason:string,corrected_words:int>>>, _corrupt string"
)
SOURCES = ("manual_caption", "automatic_caption", "audio")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cuelattice-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read again, where several parts of one job use it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ms(line: Column, first: int) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, TIMING, first + i), F.lit("")).cast("long"), F.lit(0))
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3)


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """Caption files below ``path`` as ``path, value``, a whole file each: the input of ``ingest_caption_lines``.

    A file is one recording's captions, so it fits a row; files are dealt over tasks by size.
    """
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def ingest_caption_lines(files: DataFrame) -> DataFrame:
    """Caption files (``path, value``: a whole file) as cues ``path, cue_ord, start_ms, end_ms, lines, inline``.

    Files are cut into runs of lines that aren't blank. Timing lines that open a run, or stand before its text, each
    replace the one before; what follows in the run is the text of the last. A timing line without text yet takes a
    whole next run that doesn't begin with a timing line. Whether a run is taken so depends on the run before only
    through an alternation, which counting from the last certain run resolves. Cues without text or time are dropped.
    """
    text = F.regexp_replace("value", "^\\x{FEFF}", "")
    lines = files.select("path", F.posexplode(F.split(text, r"\R")).alias("n", "line"))
    lines = lines.withColumn("blank", strip(F.col("line")) == "").withColumn("line_", strip(F.col("line"))).withColumn("timing", F.col("line_").rlike(TIMING)).withColumn("line", F.when(F.col("timing"), F.col("line_")).otherwise(F.col("line"))).drop("line_")
    w = Window.partitionBy("path").orderBy("n")
    opens = (~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))).cast("int")
    lines = lines.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    r = Window.partitionBy("path", "run")
    first_t = F.min(F.when(F.col("timing"), F.col("n"))).over(r)
    lines = lines.withColumn("first_t", first_t)
    after = F.min(F.when((F.col("n") > F.col("first_t")) & ~F.col("timing"), F.col("n"))).over(r)
    lines = lines.withColumn("text_from", after).withColumn("run_from", F.min("n").over(r))
    runs = lines.groupBy("path", "run", "first_t", "text_from", "run_from").agg(F.max("n").alias("run_to"), F.max(F.when(F.col("timing") & (F.coalesce(F.col("n") < F.col("text_from"), F.lit(True))), F.struct("n", "line"))).alias("live"))
    order = Window.partitionBy("path").orderBy("run")
    starts = F.coalesce(F.col("first_t") == F.col("run_from"), F.lit(False))
    ends = F.col("first_t").isNotNull() & F.col("text_from").isNull()
    runs = runs.withColumn("starts", starts).withColumn("ends", ends).withColumn("certain", F.col("starts") | ~F.col("ends"))
    runs = runs.withColumn("base", F.last(F.when(F.col("certain"), F.struct((F.col("starts") & F.col("ends")).alias("p"), F.col("run").alias("at"))), True).over(order))
    distance = F.col("run") - F.coalesce("base.at", F.lit(0))
    pending = F.coalesce("base.p", F.lit(False)) != (F.pmod(distance, F.lit(2)) == 1)
    runs = runs.withColumn("pending", F.when(F.col("certain"), F.col("starts") & F.col("ends")).otherwise(pending))
    runs = runs.withColumn("taken", F.coalesce(F.lag("pending").over(order), F.lit(False)) & ~F.col("starts"))
    owner = F.when(F.col("taken"), F.lag("live").over(order)).when(F.col("text_from").isNotNull(), F.col("live"))
    begin = F.when(F.col("taken"), F.col("run_from")).otherwise(F.col("text_from"))
    own = runs.withColumn("owner", owner).withColumn("begin", begin).where("owner is not null").select("path", "run", F.col("owner.n").alias("cue_ord"), F.col("owner.line").alias("stamp"), "begin")
    body = lines.select("path", "run", "n", "line").join(own, ["path", "run"]).where("n >= begin").withColumn("clean", clean_markup(F.col("line")))
    cues = body.groupBy("path", "cue_ord", "stamp").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("clean") != "", F.struct("n", "clean")))), lambda x: x.clean).alias("lines"), F.bool_or(F.col("line").rlike(INLINE)).alias("inline")
    )
    cues = cues.select("path", "cue_ord", _ms(F.col("stamp"), 1).alias("start_ms"), _ms(F.col("stamp"), 5).alias("end_ms"), "lines", "inline")
    return cues.where((F.size("lines") > 0) & (F.col("end_ms") > F.col("start_ms")))


def format_stamp(ms: Column, comma: str = ",") -> Column:
    m = F.greatest(ms, F.lit(0))
    return F.format_string(f"%02d:%02d:%02d{comma}%03d", F.floor(m / 3_600_000), F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60, m % 1000)


def export_transcripts(segments: DataFrame) -> DataFrame:
    """``track_id, srt, txt, json`` of ordered segments (``seg_pos, start_ms, end_ms, text``, and ``title``, which may be null or lack).

    Only titles go to Python: without the column no task needs a worker for them.
    """
    w = Window.partitionBy("track_id").orderBy("seg_pos")
    s = segments.withColumn("i", F.row_number().over(w))
    block = F.concat(F.col("i").cast("string"), F.lit("\n"), format_stamp(F.col("start_ms")), F.lit(" --> "), format_stamp(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    s = s.withColumn("s", F.struct("i", block.alias("block"), "text", "start_ms", "end_ms"))
    titled = ["title"] if "title" in segments.columns else []
    g = s.groupBy("track_id", *titled).agg(F.array_sort(F.collect_list("s")).alias("s"))
    head = F.lit("")
    if titled:
        title = strip(F.regexp_replace(nfkc(F.coalesce("title", F.lit(""))), rf"{SPACE}+", " "))
        head = F.when(title == "", "").otherwise(F.concat(F.lit("Title: "), title, F.lit("\n\n")))
    plain = F.transform("s", lambda x: F.struct(x.i.alias("index"), x.start_ms.alias("start_ms"), x.end_ms.alias("end_ms"), x.text.alias("text")))
    return g.select(
        "track_id", F.concat(head, F.array_join(F.transform("s", lambda x: x.block), "\n")).alias("srt"), F.concat(head, strip(F.array_join(F.transform("s", lambda x: x.text), " ")), F.lit("\n")).alias("txt"),
        F.to_json(F.struct(F.lit(3).alias("schema_version"), *titled, plain.alias("segments"))).alias("json"),
    )


def write_transcripts(exported: DataFrame, path: str) -> None:
    """Exports (``track_id, srt, txt, json``, and ``title`` and ``language`` where there are such columns) as named files below ``path``.

    Each transcript has three files, ``Title.<track>.<language>`` with their endings; one pass writes them all and lists
    them in the manifest, from which ``read_transcripts`` reads.
    """
    own = lambda c: F.col(c) if c in exported.columns else None
    key = F.col("track_id").cast("string")
    stem = file_name(own("title"), key, *[x for x in (own("language"),) if x is not None])
    kinds = F.array(*[F.struct(F.lit(f".{k}").alias("ending"), F.col(k).alias("value")) for k in ("srt", "txt", "json")])
    files = exported.select(stem.alias("stem"), key.alias("key"), F.explode(kinds).alias("f"))
    write_named(files.select(F.concat("stem", "f.ending").alias("name"), "key", "f.value"), path)


def read_transcripts(spark: SparkSession, path: str, kind: str = "srt") -> DataFrame:
    """``path, track_id, value`` of the transcripts of one kind below ``path``, a whole file each; ids are as they were written."""
    return read_named(spark, path, f".{kind}").select(F.col("name").alias("path"), F.col("key").alias("track_id"), "value")


def write_documents(exported: DataFrame, path: str) -> DataFrame:
    """Documents that can be written (``doc_id, content, code``) as named text files below ``path``, and the others as rows.

    Exports are staged: asked for files and for refusals, and filtered by code, each text would be normalised four times.
    """
    exported = staged(exported.select("doc_id", "content", "code"), "exported")
    good = exported.where("code is null").select(F.col("doc_id").cast("string").alias("key"), F.col("content").alias("value"))
    write_named(good.select(F.concat(file_name(F.regexp_extract("value", r"\ATitle: ([^\n]*)", 1), F.col("key")), F.lit(".txt")).alias("name"), "key", "value"), path)
    return exported.where("code is not null").select("doc_id", "code")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents below ``path`` as ``doc_id, content``, whole; ids are as they were written."""
    return read_named(spark, path, ".txt").select(F.col("key").alias("doc_id"), F.col("value").alias("content"))


def export_documents(docs: DataFrame, longest_title: int = 100) -> DataFrame:
    """``doc_id, content, code``: title line and normalised body as text, or why a document can't be written; null counts as empty."""
    given = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
    clean = normalise_bodies(given).withColumn("line", single_line(F.regexp_replace("title", r"\ATitle:", "")))
    code = F.when(F.col("line") == "", "TITLE_EMPTY").when(strip(F.col("title")).contains("\n"), "TITLE_MULTILINE").when(F.length("line") > longest_title, "TITLE_TOO_LONG").when(F.col("body") == "", "BODY_EMPTY")
    content = F.concat(F.lit("Title: "), "line", F.lit("\n\n"), "body", F.lit("\n"))
    return clean.select("doc_id", F.when(code.isNull(), content).alias("content"), code.alias("code"))


def read_text_documents(files: DataFrame, strict: bool = True) -> DataFrame:
    """``doc_id, title, body, code`` of text files (``doc_id, content``).

    Strict files begin with a ``Title:`` line, and their bodies are normalised. Otherwise the first such line anywhere
    counts, in any case, a file without one has an empty title, and bodies are trimmed alone. Line ends of all kinds
    count; a null file is an empty one.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"\A\x{FEFF}+", ""), r"\r\n?", "\n")
    line = r"\ATitle:([^\n]*)(?:\n|\z)" if strict else r"(?im)^\s*title:[ \t]*([^\n]*)$\n?"
    f = files.select("doc_id", text.alias("content"))
    title = single_line(F.regexp_extract("content", line, 1))
    f = f.select("doc_id", title.alias("title"), (~F.col("content").rlike(line) | (title == "")).alias("lacking"), strip(_without_first(F.col("content"), line)).alias("body"))
    f = normalise_bodies(f) if strict else f
    code = F.when(F.lit(strict) & F.col("lacking"), "SOURCE_TITLE_MISSING").when(F.col("body") == "", "SOURCE_EMPTY")
    return f.select("doc_id", F.when(code.isNull() | F.lit(not strict), F.col("title")).alias("title"), F.when(code.isNull(), F.col("body")).alias("body"), code.alias("code"))


def _without_first(text: Column, pattern: str) -> Column:
    at, found = F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def read_transcript_artifacts(spark: SparkSession, path: str, manifest: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON transcripts below ``path``: those that hold what they must, and the rest with the reason.

    With ``manifest``, the folder is one that ``write_named`` wrote, and nothing is listed.
    """
    keep = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if manifest:
        d = read_named(spark, path, ".json").select(F.from_json("value", TRANSCRIPT_SCHEMA, keep).alias("d")).select("d.*")
    else:
        d = spark.read.schema(TRANSCRIPT_SCHEMA).options(multiLine=True, **keep).json(path)
    reason = F.when(F.col("_corrupt").isNotNull(), "MALFORMED").when(F.col("segments").isNull() | F.col("language").isNull(), "FIELD_MISSING").when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "SOURCE_UNKNOWN")
    d = d.withColumn("reason", reason)
    return d.where("reason is null").drop("reason", "_corrupt"), d.where("reason is not null")


JOB_JSON = {"video_json": "struct<title:string,duration:long>", "warnings_json": "array<string>", "error_json": "struct<code:string,retryable:boolean>", "artifacts_json": "map<string,string>"}


def load_catalogue(rows: DataFrame, json_columns: dict[str, str] | None = None, flags: tuple[str, ...] = ("force_refresh", "auto_rewrite_requested")) -> DataFrame:
    """Catalogue rows with their JSON text columns parsed and 0/1 flags as booleans."""
    for c, kind in (json_columns or JOB_JSON).items():
        if c in rows.columns:
            rows = rows.withColumn(c.removesuffix("_json"), F.from_json(c, kind)).drop(c)
    return rows.withColumns({c: F.col(c) == 1 for c in flags if c in rows.columns})


def catalogue_rows(jobs: DataFrame, json_columns: dict[str, str] | None = None, flags: tuple[str, ...] = ("force_refresh", "auto_rewrite_requested")) -> DataFrame:
    """What ``load_catalogue`` reads: structures as JSON text, booleans as 0 and 1."""
    for c in json_columns or JOB_JSON:
        name = c.removesuffix("_json")
        if name in jobs.columns:
            jobs = jobs.withColumn(c, F.to_json(name)).drop(name)
    return jobs.withColumns({c: F.col(c).cast("int") for c in flags if c in jobs.columns})


def evolve_schema(parts: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Old and new rows as one table: columns that old ones lack get their default."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items() if v is not None})


def read_evolved(spark: SparkSession, path: str, declared: dict[str, tuple[str, object]]) -> DataFrame:
    """Parquet folders of all versions below ``path`` as one table of the ``declared`` columns (name: type and default).

    Schemas of the files are merged; a column that a file lacks, or that is null, has its default, one that no file has
    too, and columns that aren't declared are left out.
    """
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    value = lambda c, kind, default: F.coalesce(F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind), F.lit(default).cast(kind))
    return rows.select(*[value(c, kind, default).alias(c) for c, (kind, default) in declared.items()])


def ingest_asr_segments(segments: DataFrame) -> DataFrame:
    """Recogniser output (``track_id, ord, start, end`` in seconds, ``text, words``) as segments in milliseconds.

    Texts, and words, are trimmed of white space of all kinds and empty ones dropped; half milliseconds go to the even one; an end is after its start (of a
    word: at least 1); empty word lists become null, as do probabilities that aren't numbers.
    """
    ms = lambda x: F.bround(x * 1000).cast("long")
    s = segments.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("start_ms", F.greatest(F.lit(0), ms(F.col("start"))))
    spoken = F.filter(F.transform("words", lambda w: w.withField("word", strip(w.word))), lambda w: w.word != "")
    words = F.transform("spoken", lambda w: F.struct(F.greatest(F.lit(0), ms(w.start)).alias("start_ms"), F.greatest(F.lit(1), ms(w.end)).alias("end_ms"), w.word.alias("text"), w.probability.try_cast("double").alias("probability")))
    index = F.row_number().over(Window.partitionBy("track_id").orderBy("ord"))
    s = s.withColumn("spoken", spoken)
    return s.select("track_id", index.alias("index"), "start_ms", F.greatest(F.col("start_ms") + 1, ms(F.col("end"))).alias("end_ms"), "text", F.when(F.size("spoken") > 0, words).alias("words"))


def shift_window_segments(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Window-local times moved to the track's timeline, in segments and their words."""
    by = windows.select("track_id", "win", F.col("start_ms").alias("by"))
    moved = F.transform("words", lambda w: F.struct((w.start_ms + F.col("by")).alias("start_ms"), (w.end_ms + F.col("by")).alias("end_ms"), w.text.alias("text"), w.probability.alias("probability")))
    s = segments.join(by, ["track_id", "win"])
    return s.withColumn("words", moved).withColumn("start_ms", F.col("start_ms") + F.col("by")).withColumn("end_ms", F.col("end_ms") + F.col("by")).drop("by")


def artifact_manifest_check(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``id, usable``: whether all files in a job's ``artifacts`` map are in ``manifest`` (path); no files, not usable."""
    paths = jobs.select("id", F.explode_outer("artifacts").alias("kind", "path"))
    found = manifest.select("path").distinct().withColumn("there", F.lit(True))
    return paths.join(found, "path", "left").groupBy("id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("usable"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` as ``path, length``; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def rewrite_artifact_check(rewrites: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """``id, usable``: whether a rewrite's one file (``artifact_path``) lies inside ``root`` and is in ``manifest``."""
    base = root.rstrip("/") + "/"
    inside = F.col("artifact_path").startswith(base) & ~F.array_contains(F.split("artifact_path", "/"), "..")
    found = manifest.select(F.col("path").alias("artifact_path")).distinct().withColumn("there", F.lit(True))
    return rewrites.join(found, "artifact_path", "left").select("id", F.coalesce(inside & F.col("there"), F.lit(False)).alias("usable"))
