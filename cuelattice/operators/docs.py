"""Document corpus: clean-up, splitting and grouping, rules, seams and verdicts."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.functions.text import SPACE, bare, borders, comparable, content_hash, distinct_in_order, first_fingerprint, length_bounds, length_ratio, lowered, nfc, normalized_length, small_batches, strip, winnowed

CHUNK_CHARS = 25_000
TITLE_CHARS = 100
REPEATED_CHARS, COPIED_CHARS = 24, 160
PASS_SCORE = 80.0
TAIL_CHARS, SEAM_CHARS = 800, 2_000
SEAM_RATIO = (0.85, 1.15)

# Stands between paragraphs while a body is compared: no body holds it, since control signs are taken out.
_PART = "\x01"
_STAMP = r"(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{3}"
TIMING_LINE = rf"^\s*{_STAMP}\s+-->\s+{_STAMP}(?:\s.*)?$"
# White space within a line, and a timing line, for patterns over whole texts.
_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"
_TIMED = rf"{_IN_LINE}*{_STAMP}{_IN_LINE}+-->{_IN_LINE}+{_STAMP}(?:{_IN_LINE}.*)?$"
# Rules for rewritten text, by code, as Java patterns.
RULES = {
    "BODY_HAS_MARKDOWN": r"(?m)^\s*(?:#{1,6}\s|```|[-*+]\s+)",
    "BODY_HAS_URL": r"(?i)(?:https?://|www\.)\S+",
    "BODY_HAS_TIMESTAMP": TIMING_LINE,
    "BODY_HAS_STAGE_DIRECTION": r"(?iu)\[(?:music|applause|laughter|pause|sfx|nhạc|vỗ tay|cười)\]",
    "BODY_HAS_EMOJI": r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}]",
    "BODY_HAS_UI_PREAMBLE": r"(?iu)^\s*(?:here(?:'s| is)|below is|dưới đây là|以下(?:は|が)|こちらが).{0,80}(?:script|rewrite|nội dung|kịch bản|書き直し|台本)",
    "BODY_HAS_OUTPUT_MARKER": r"<<<[A-Z][A-Z0-9_]*>>>|(?im)^\s*(?:title|script|body|section)\s*:",
}


def normalise_bodies(docs: DataFrame, column: str = "body") -> DataFrame:
    """``docs`` with a clean ``column``: composed characters, no control signs, time stamps, timing lines or cue numbers.

    A line of digits goes only if a timing line follows. Runs of spaces and tabs become one space, lines lose white
    space of every kind at their ends, runs of blank lines become one and none stay at either end.
    """
    text = F.regexp_replace(nfc(F.coalesce(column, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"<{_STAMP}>", ""), r"\r\n?", "\n")
    # Whole-text patterns whose lines end at \\n alone; what stands within a line is never crossed.
    for pattern, by in (
        (rf"(?dmU)^{_IN_LINE}*\d+{_IN_LINE}*\n(?={_TIMED})", ""), (rf"(?dmU)^{_TIMED}\n?", ""), (r"[ \t]+", " "), (rf"(?dmU)^{_IN_LINE}+|{_IN_LINE}+$", ""), (r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return docs.withColumn(column, text)


# Where a chunk may end, best first: a paragraph, a line, a sentence with its closing signs and space, a word.
_BREAKS = tuple(re.compile(f"(?s).*{p}") for p in (r"\n\n", r"\n", r"[.!?。！？][\"'”’）)]*\s*", r"\s"))


def _cut(text: str, limit: int) -> int:
    """Where to end the first chunk: at the last break of the best kind in its second half, else at the limit."""
    window = text[max(1, limit // 2) : limit]
    for kind in _BREAKS:
        if m := kind.match(window):
            return max(1, limit // 2) + m.end()
    return limit


def split_text(text: str, limit: int) -> list[str]:
    out = []
    while len(text) > limit:
        n = _cut(text, limit)
        out.append(text[:n])
        text = text[n:]
    return [*out, text] if text else out


def chunk_documents(docs: DataFrame, limit: int = CHUNK_CHARS, column: str = "body") -> DataFrame:
    """``doc_id, chunk_idx, text``: lossless pieces of at most ``limit`` characters; an empty document has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for k, c in enumerate(split_text(t or "", limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "text"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(column).alias("text")).mapInPandas(run, f"doc_id {kind}, chunk_idx int, text string")


def _greedy_bins(pieces: Column, limit: int, joint: int) -> Column:
    """First places of the bins of pieces in order: a new bin where the sum with ``joint`` per seam would pass ``limit``.

    The fold carries two numbers and the list of places where bins begin, which grows by bins and not by pieces.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(limit + 1).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(acc, piece):
        n = F.length(piece.text).cast("long")
        fits = (acc.at > 0) & (acc.used + joint + n <= limit)
        starts = F.when(fits, acc.starts).otherwise(F.array_append(acc.starts, acc.at))
        return F.struct((acc.at + 1).alias("at"), F.when(fits, acc.used + joint + n).otherwise(n).cast("long").alias("used"), starts.alias("starts"))

    return F.aggregate(pieces, start, step, lambda acc: F.array_append(acc.starts, acc.at))


def pack_segments(segments: DataFrame, limit: int = CHUNK_CHARS, joint: int = 1) -> DataFrame:
    """Ordered pieces (``doc_id, idx, text``) in groups of at most ``limit``: ``doc_id, group_idx, indexes, text, n_chars``.

    A piece over the limit is a group alone (chunk it afterwards); ``joint`` is what a seam costs.
    """
    ordered = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s"))
    edges = ordered.withColumn("edges", _greedy_bins(F.col("s"), limit, joint))
    bins = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.slice("s", F.get("edges", i) + 1, F.get("edges", i + 1) - F.get("edges", i)))
    groups = edges.select("doc_id", F.posexplode(bins).alias("group_idx", "g"))
    text = F.array_join(F.transform("g", lambda x: x.text), " " * joint if joint else "\n\n")
    return groups.select("doc_id", "group_idx", F.transform("g", lambda x: x.idx).alias("indexes"), text.alias("text"), F.length(text).alias("n_chars"))


def group_sections(sections: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """Ordered sections in groups by the length of their bodies alone; bodies are joined by a blank line."""
    return pack_segments(sections, limit, joint=0)


def choose_chunk_source(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """``doc_id, source``: ``segments`` where their texts have the body's length without white space, else ``body``."""
    total = segments.groupBy("doc_id").agg(F.sum(normalized_length(F.col("text"))).alias("n"))
    same = F.coalesce(F.col("n") == normalized_length(F.col("body")), F.lit(False))
    return docs.join(total, "doc_id", "left").select("doc_id", F.when(same, "segments").otherwise("body").alias("source"))


def _compact(text: str) -> str:
    return "".join(text.casefold().split())


def _folded(text: str) -> tuple[str, list[int]]:
    """A text as it is compared, and for each raw length how long the comparable form of that beginning is."""
    out, ends = [], [0]
    for c in text:
        out.append("" if c.isspace() else c.casefold())
        ends.append(ends[-1] + len(out[-1]))
    return "".join(out), ends


def repeated_chars(before: str, text: str, least: int) -> int:
    """The longest equal raw length whose end in ``before`` and beginning in ``text`` compare alike, from ``least`` on.

    Only lengths at which the comparable forms overlap are looked at; raw lengths differ from those by white space.
    """
    if _compact(text[:least]) not in _compact(before):
        return 0  # no beginning of ``least`` characters or more can stand at its end
    a, a_ends = _folded(before)
    b, b_ends = _folded(text)
    best = 0
    for k in (*borders(a, b), 0):
        ends = {len(before) - i for i in range(bisect.bisect_left(a_ends, len(a) - k), bisect.bisect_right(a_ends, len(a) - k))}
        heads = range(bisect.bisect_left(b_ends, k), bisect.bisect_right(b_ends, k))
        best = max([best, *(n for n in heads if n in ends)])
    return best if best >= least else 0


#: What parts paragraphs: a blank line, or one that holds white space alone.
BLANK = r"\n\s*\n"


def drop_repeated_paragraphs(docs: DataFrame, separator: str = BLANK, column: str = "body", least: int = REPEATED_CHARS) -> DataFrame:
    """Bodies without paragraphs, and beginnings of paragraphs, that repeat what the last kept paragraph said.

    ``separator`` is a pattern; kept paragraphs are joined by a blank line, or by a line break where that alone parts
    them. Compared without case and white space; a repeated beginning has at least ``least`` characters. Each paragraph
    depends on the last one kept, so a document is read in order.
    """
    small_batches(docs.sparkSession)
    joint = "\n" if separator == "\n" else "\n\n"

    @F.pandas_udf(T.StringType())
    def fold(bodies: pd.Series) -> pd.Series:
        def one(body: str) -> str:
            kept: list[str] = []
            for p in (x.strip() for x in re.split(separator, body)):
                if not p or (kept and _compact(p) == _compact(kept[-1])):
                    continue
                rest = p[repeated_chars(kept[-1], p, least) :].lstrip() if kept else p
                if rest:
                    kept.append(rest)
            return joint.join(kept)

        return bodies.map(one, na_action="ignore")

    return docs.withColumn(column, fold(F.coalesce(column, F.lit(""))))


def single_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def _bare_length(column: str) -> Column:
    """``normalized_length`` of text that is normalised already."""
    return F.length(F.regexp_replace(column, SPACE, ""))


def _long_parts(column: str, separator: str, least: int) -> Column:
    """Comparable forms of the parts of a text that have at least ``least`` characters without white space, as they are written.

    Folding case may lengthen a text (ß), so what was written is counted. The fold needs Python for some texts, so it is
    asked once, over the whole text, and parted after.
    """
    parted = F.regexp_replace(column, separator, _PART)
    both = F.zip_with(F.split(F.regexp_replace(parted, SPACE, ""), _PART), F.split(comparable(parted), _PART), lambda x, y: F.when(F.length(x) >= least, y))
    return F.array_compact(both)


def _length_rule(source: Column, output: Column) -> Column:
    bounds = length_bounds(source)
    return F.when(source == 0, "SOURCE_EMPTY").when(output < bounds.getField("least"), "OUTPUT_TOO_SHORT").when(output > bounds.getField("most"), "OUTPUT_TOO_LONG")


def _published(docs: DataFrame) -> DataFrame:
    """Documents as they would be published: ``doc_id, title, body, raw_source, source``."""
    clean = drop_repeated_paragraphs(normalise_bodies(docs.select("doc_id", "title", "body", F.col("source_body").alias("raw_source")), "body"))
    return normalise_bodies(clean.withColumn("source", F.col("raw_source")), "source")


def validate_lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, errors`` of ``validate_documents`` for the length rule alone, which is all that choosing a candidate asks for."""
    clean = _published(docs).select("doc_id", _bare_length("source").alias("source"), _bare_length("body").alias("output"))
    return clean.select("doc_id", F.array_compact(F.array(_length_rule(F.col("source"), F.col("output")))).alias("errors"))


def validate_documents(docs: DataFrame) -> DataFrame:
    """Rules for rewrites (``doc_id, title, body, source_body``): ``errors`` in rule order, ``warnings``, lengths and ratio.

    Bodies and sources are normalised first and bodies lose repeated paragraphs, so rules and lengths are those of what
    would be published; lengths are without white space. A paragraph that the source holds whole is a warning.
    """
    clean = _published(docs)
    title = single_line(F.regexp_replace(F.coalesce("title", F.lit("")), r"^Title:", ""))
    # One struct for each row, so that what many rules use is worked out once.
    once = F.struct("body", F.col("title").alias("raw_title"), title.alias("title"), _bare_length("source").alias("source_length"), _bare_length("body").alias("output_length"), comparable(F.coalesce("raw_source", F.lit(""))).alias("whole"))
    staged = clean.select("doc_id", F.explode(F.array(once)).alias("s")).select("doc_id", "s.*")
    source, output = F.col("source_length"), F.col("output_length")
    checks = [
        F.when(F.col("title") == "", "TITLE_EMPTY"),
        F.when(strip(F.col("raw_title")).contains("\n"), "TITLE_MULTILINE"),
        F.when(F.length("title") > TITLE_CHARS, "TITLE_TOO_LONG"),
        F.when(F.col("body") == "", "BODY_EMPTY"),
        _length_rule(source, output),
        *[F.when(F.col("body").rlike(p), code) for code, p in RULES.items()],
    ]
    copied = F.exists(_long_parts("body", BLANK, COPIED_CHARS), lambda x: F.col("whole").contains(x))
    errors = F.array_distinct(F.array_compact(F.array(*checks)))
    warnings = F.when(copied, F.array(F.lit("SOURCE_BLOCK_COPIED"))).otherwise(F.array().cast("array<string>"))
    return staged.select("doc_id", "title", "source_length", "output_length", length_ratio(output, source, 0.0).alias("length_ratio"), errors.alias("errors"), warnings.alias("warnings"))


def rule_rollup(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def copied_blocks(outputs: DataFrame, sources: DataFrame, least: int = COPIED_CHARS, separator: str = BLANK, key_chars: int = 32) -> DataFrame:
    """``doc_id, source_id, n_blocks``: paragraphs of outputs that a source holds, over the corpus.

    Compared in lower case and without white space, as SQL has both, so copies with other line ends or in languages
    without spaces are told too. Sources are winnowed: of hashes of ``key_chars`` characters the smallest of every
    window that spans ``least`` characters is kept, about two of a window's width. A paragraph of at least ``least``
    characters brings the one of its first window, which any source that holds it has kept too; containment decides.
    Texts join only the pairs so found.
    """
    small_batches(outputs.sparkSession)
    k = min(key_chars, max(1, least // 2))
    given = outputs.select("doc_id", F.coalesce("body", F.lit("")).alias("body"))
    long = F.filter(F.transform(F.split("body", separator), bare), lambda x: F.length(x) >= least)
    parts = given.select("doc_id", F.explode(F.transform(long, lowered)).alias("p"))
    parts = parts.select("doc_id", "p", first_fingerprint(F.col("p"), least, k).alias("key"))
    whole = sources.select("source_id", lowered(bare(F.coalesce("text", F.lit("")))).alias("whole")).where(F.length("whole") >= least)
    keys = whole.select("source_id", F.explode(winnowed("whole", least, k)).alias("key")).distinct()
    met = parts.join(keys, "key").select("doc_id", "source_id", "p").distinct().join(whole, "source_id").where(F.col("whole").contains(F.col("p")))
    return met.groupBy("doc_id", "source_id").agg(F.count("*").alias("n_blocks"))


def tail_window(text: Column, n: int = SEAM_CHARS) -> Column:
    """The end of a text from a sentence or word start in its outer half."""
    w = F.right(text, F.lit(n))
    outer = F.left(w, F.lit(n // 2))
    sentence, word = F.regexp_instr(outer, F.lit(r"(?<=[.!?。！？])\s")), F.regexp_instr(outer, F.lit(r"\s"))
    at = F.when(sentence > 0, sentence).when(word > 0, word).otherwise(0)
    return F.when(F.length(text) <= n, text).otherwise(F.substring(w, at + 1, F.lit(n)))


def head_window(text: Column, n: int = SEAM_CHARS) -> Column:
    """The beginning of a text up to a sentence or word end in its outer half."""
    w = F.left(text, F.lit(n))
    inner, outer = F.left(w, F.lit(n // 2)), F.substring(w, n // 2 + 1, n)
    sentence, word = F.regexp_extract(outer, r"(?s)^.*[.!?。！？](?=\s)", 0), F.regexp_extract(outer, r"(?s)^.*(?=\s)", 0)
    return F.when(F.length(text) <= n, text).otherwise(F.when(sentence != "", F.concat(inner, sentence)).when(word != "", F.concat(inner, word)).otherwise(w))


def seam_pairs(groups: DataFrame, n: int = SEAM_CHARS) -> DataFrame:
    """``doc_id, group_idx, tail, head`` for each group and the one after it."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("group_idx"))
    return groups.withColumn("next", after).where("next is not null").select("doc_id", "group_idx", tail_window(F.col("text"), n).alias("tail"), head_window(F.col("next"), n).alias("head"))


def seam_check(seams: DataFrame) -> DataFrame:
    """Splice revised windows back and say what is wrong: ``previous``, ``next`` (new texts), ``errors``.

    ``seams``: ``previous_text, tail, new_tail, next_text, head, new_head, tail_hash, head_hash`` (hashes of the windows
    the revision was made from). Stale or shifted windows, rule breaks on either side, and lengths that left the
    allowed ratio are errors.
    """
    stale = (F.sha2(F.col("tail").cast("binary"), 256) != F.col("tail_hash")) | (F.sha2(F.col("head").cast("binary"), 256) != F.col("head_hash"))
    held = F.endswith("previous_text", "tail") & F.startswith("next_text", "head")
    before = F.concat(F.expr("left(previous_text, length(previous_text) - length(tail))"), F.col("new_tail"))
    after = F.concat(F.col("new_head"), F.expr("substring(next_text, length(head) + 1)"))
    ratio = (F.length("new_tail") + F.length("new_head")) / (F.length("tail") + F.length("head"))
    rules = lambda text, prefix: [F.when(text.rlike(p), prefix + code) for code, p in RULES.items()]
    errors = F.array_compact(F.array(F.when(stale, "SEAM_STALE"), F.when(~held, "SEAM_SHIFTED"), F.when((ratio < SEAM_RATIO[0]) | (ratio > SEAM_RATIO[1]), "SEAM_RATIO"), *rules(before, "PREVIOUS_"), *rules(after, "NEXT_")))
    return seams.select("*", before.alias("previous"), after.alias("next"), errors.alias("errors"))


def section_context(sections: DataFrame, tail: int = TAIL_CHARS) -> DataFrame:
    """Each section with the end of the one before, the summary of the one after, its number and how many there are."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return sections.select(
        "doc_id", "idx", F.row_number().over(w).alias("number"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"),
        F.coalesce(F.right(F.lag("body").over(w), F.lit(tail)), F.lit("")).alias("previous_tail"), F.coalesce(F.lead("summary").over(w), F.lit("")).alias("next_summary"),
    )


def representative_rows(rows: DataFrame) -> DataFrame:
    """The first, middle and last row of each document, each once."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1
    return rows.withColumn("_n", n).withColumn("_at", at).where((F.col("_at") == 0) | (F.col("_at") == F.floor(F.col("_n") / 2)) | (F.col("_at") == F.col("_n") - 1)).drop("_n", "_at")


# JSON values whose text is the same to every reader; objects that hold others are read in Python.
_PLAIN_JSON = ("STRING", "BOOLEAN", "BIGINT", "VOID")


def json_fields(text: Column) -> Column:
    """Struct ``fields`` (map of strings; null for a list), ``found`` of the JSON value at the first bracket of ``text``.

    Null where no value begins there that ``try_parse_json`` reads, or an object that holds more than strings, whole
    numbers, booleans and nulls; nulls are left out.
    """
    value = F.try_parse_json(F.regexp_extract(text, r"(?s)[{\[].*", 0))
    held = F.try_variant_get(value, "$", "map<string,variant>")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    fields = F.transform_values(F.map_filter(held, lambda _, x: kind(x) != "VOID"), lambda _, x: F.try_variant_get(x, "$", "string"))
    plain = F.forall(F.map_values(held), lambda x: kind(x).isin(*_PLAIN_JSON))
    is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    return F.when(plain | is_list, F.struct(F.when(~is_list, fields).alias("fields"), F.lit(True).alias("found")))


def extract_structured_replies(replies: DataFrame) -> DataFrame:
    """``request_id, fields`` (map) and ``code`` (null, ``NO_STRUCTURE``, ``NOT_OBJECT`` or ``FIELD_MISSING``) of text replies.

    The first bracket from which a JSON value can be read decides: an object gives the fields, a list is ``NOT_OBJECT``.
    Only without any such value do ``<<<NAME>>>`` markers count, and of a repeated one the last. ``required`` (array)
    fields must be there and not empty. Texts with a bracket that ``json_fields`` can't read are sent to Python.
    """

    @F.pandas_udf("struct<fields:map<string,string>,found:boolean>")
    def decoded(s: pd.Series) -> pd.DataFrame:
        def first(text):
            decoder = json.JSONDecoder()
            for m in re.finditer(r"[{\[]", text or ""):
                try:
                    value, _ = decoder.raw_decode(text, m.start())
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items() if v is not None}, True
                return None, True
            return None, False

        got = [first(t) for t in s]
        return pd.DataFrame({"fields": pd.Series([g[0] for g in got], dtype=object), "found": [g[1] for g in got]})

    fenced = F.regexp_replace(F.regexp_replace(strip(F.col("response")), r"(?s)\A```[^\n]*\n", ""), r"(?s)```\s*\z", "")
    text = F.when(strip(F.col("response")).rlike(r"\A```[^\n]*\n"), strip(fenced)).otherwise(strip(F.col("response")))
    pieces = lambda group: F.regexp_extract_all("response", F.lit(r"(?s)<<<([A-Z][A-Z0-9_]*)>>>(.*?)(?=<<<[A-Z][A-Z0-9_]*>>>|\z)"), F.lit(group))
    names, values = F.transform(pieces(1), lambda x: F.lower(x)), F.transform(pieces(2), strip)
    r = replies.withColumn("_t", text).withColumn("_v", json_fields(F.col("_t"))).withColumn("_names", names).withColumn("_values", values)
    r = r.withColumn("_j", F.coalesce("_v", decoded(F.when(F.col("_v").isNull() & F.col("_t").rlike(r"[{\[]"), F.col("_t")))))
    # A later marker of a name replaces an earlier one.
    last = F.filter(F.arrays_zip("_names", "_values"), lambda x, i: ~F.array_contains(F.slice("_names", i + 2, F.greatest(F.size("_names") - i - 1, F.lit(0))), x["_names"]))
    markers = F.when(F.size("_names") > 0, F.map_from_entries(F.transform(last, lambda x: F.struct(x["_names"], x["_values"]))))
    r = r.withColumn("fields", F.when(F.col("_j.found"), F.col("_j.fields")).otherwise(markers))
    lacks = F.exists("required", lambda k: F.coalesce(F.element_at("fields", k), F.lit("")) == "")
    code = F.when(F.col("_j.found") & F.col("_j.fields").isNull(), "NOT_OBJECT").when(F.col("fields").isNull(), "NO_STRUCTURE").when(lacks, "FIELD_MISSING")
    return r.select("request_id", "fields", code.alias("code"))


# What is asked for where a verdict fails.
RESTORE_LANGUAGE = "Restore the source language throughout the draft."
REMOVE_CLAIMS, RESTORE_POINTS = "Remove unsupported claims: ", "Restore missing points: "
RESOLVE_ALL = "Resolve every failed validator rubric item."
# How replies say yes and no.
YES = ("true", "yes", "y", "1", "pass", "passed", "ok", "ready", "match", "matched", "はい", "合格", "一致", "準備完了")
NO = ("false", "no", "n", "0", "fail", "failed", "ng", "not ready", "not_ready", "mismatch", "unmatched", "いいえ", "不合格", "不一致", "未準備")


def as_bool(value: Column) -> Column:
    v = F.lower(strip(value))
    return F.when(v.isin(*YES), True).when(v.isin(*NO), False)


def coerce_verdicts(raw: DataFrame, booleans: tuple[str, ...] = ("passed", "language_match", "tts_ready"), scores: tuple[str, ...] = ("style_score", "coverage_score"), lists: tuple[str, ...] = ("unsupported_claims", "missing_points")) -> DataFrame:
    """String verdict columns typed; ``bad_field`` names the first that can't be read (null if all can)."""
    out, bad = raw, F.lit(None).cast("string")
    for c in reversed((*booleans, *scores)):
        read = as_bool(F.col(c)) if c in booleans else F.col(c).try_cast("double")
        read = read if c in booleans else F.when((read >= 0) & (read <= 100), read)
        out, bad = out.withColumn(f"_{c}", read), F.when(F.col(f"_{c}").isNull(), c).otherwise(bad)
    out = out.withColumn("bad_field", bad)
    for c in (*booleans, *scores):
        out = out.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    for c in lists:
        out = out.withColumn(c, F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != ""))
    return out


def judge(verdicts: DataFrame, least: float = PASS_SCORE) -> DataFrame:
    """``doc_id, section, passed, repairs``: all booleans true, both scores high enough, no issue and no local error."""
    some = lambda c: F.size(c) > 0
    ok = F.col("passed") & F.col("language_match") & F.col("tts_ready") & (F.col("style_score") >= least) & (F.col("coverage_score") >= least)
    ok = ok & ~some("unsupported_claims") & ~some("missing_points") & ~some("local_errors")
    asked = F.concat(
        F.col("targeted_repairs"), F.col("local_errors"),
        F.array_compact(F.array(
            F.when(~F.col("language_match"), RESTORE_LANGUAGE),
            F.when(some("unsupported_claims"), F.concat(F.lit(REMOVE_CLAIMS), F.array_join("unsupported_claims", "; "))),
            F.when(some("missing_points"), F.concat(F.lit(RESTORE_POINTS), F.array_join("missing_points", "; "))),
        )),
    )
    repairs = F.when(~ok & (F.size(asked) == 0), F.array(F.lit(RESOLVE_ALL))).otherwise(asked)
    return verdicts.select("doc_id", "section", ok.alias("passed"), repairs.alias("repairs"))


def aggregate_verdicts(verdicts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per document: all passed, lowest scores (100 without sections), issues in first-seen order, length ratio."""
    inorder = lambda c: distinct_in_order(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", F.col(c).alias("x")))), lambda s: s.x)))
    per = verdicts.groupBy("doc_id").agg(
        F.bool_and("passed").alias("passed"), F.min("style_score").alias("style_score"), F.min("coverage_score").alias("coverage_score"),
        F.bool_and("language_match").alias("language_match"), F.bool_and("tts_ready").alias("tts_ready"),
        inorder("unsupported_claims").alias("unsupported_claims"), inorder("missing_points").alias("missing_points"),
    )
    nothing = F.array().cast("array<string>")
    return lengths.join(per, "doc_id", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(True)).alias(c) for c in ("passed", "language_match", "tts_ready")], *[F.coalesce(c, F.lit(100.0)).alias(c) for c in ("style_score", "coverage_score")],
        *[F.coalesce(c, nothing).alias(c) for c in ("unsupported_claims", "missing_points")], length_ratio(F.col("output_length"), F.col("source_length")).alias("length_ratio"),
    )


def choose_candidate(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """``doc_id, chosen``: the candidate, unless only it breaks the length rule (both validated)."""
    broken = lambda c: F.arrays_overlap(c, F.array(F.lit("OUTPUT_TOO_SHORT"), F.lit("OUTPUT_TOO_LONG")))
    both = current.select("doc_id", F.col("errors").alias("now")).join(candidate.select("doc_id", F.col("errors").alias("then")), "doc_id")
    return both.select("doc_id", F.when(broken("then") & ~broken("now"), "current").otherwise("candidate").alias("chosen"))


def validation_label(validation_passed: Column, status: Column) -> Column:
    return F.when(validation_passed, "pass").when(~validation_passed, "review").when(status.isin("queued", "running"), "running").otherwise("not_rated")


def stale_sources(rewrites: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id, changed``: whether the text now has another hash than when the rewrite was made."""
    now = sources.select("doc_id", content_hash("text").alias("now"))
    return rewrites.join(now, "doc_id", "left").select("doc_id", (~F.col("source_hash").eqNullSafe(F.col("now"))).alias("changed"))

