"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Only the histogram of piece lengths (at most ``SEQUENCE`` entries, however large the corpus) reaches the driver. There
each bin is filled greedily with the largest length that still fits; then its smallest piece gives way to two unpacked
pieces that fill the widened gap more tightly. One such pattern is used as many times as its lengths last. Pieces find
their place by rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved, small_batches

SEQUENCE = 2048
END_OF_DOCUMENT = 0
# Fixed value: how a byte-level vocabulary of this kind parts a text before merging.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# Characters beyond these are looked at one by one before the fast way is taken.
_BEYOND_LATIN = re.compile("[^\\x00-\u024f]")
_PLAIN_SETUP = {"normalizer": None, "post_processor": None, "truncation": None, "padding": None}
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "ignore_merges": False}


def _byte_of() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TextTokenizer:
    """Ids of whole texts as the ``tokenizers`` library gives them, as little-endian unsigned 32-bit numbers.

    Where the file is a plain byte-level vocabulary, ``tiktoken`` merges the same bytes by the same ranks at a fraction
    of the cost. The libraries may part texts differently only where they class a character differently, so each
    character is tried in both once; texts that hold one on which they differ, or the string of a special token, go
    through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast()
        self.alike: dict[str, bool] = {}
        self.latin = self.fast is not None and all(self._same(chr(i)) for i in range(0x250))

    def _fast(self):
        import tiktoken

        setup = json.loads(self.tokenizer.to_str())
        model, parts = setup["model"], setup["pre_tokenizer"] or {}
        if any(setup.get(k) != v for k, v in _PLAIN_SETUP.items()) or any(model.get(k, v) != v for k, v in _PLAIN_MODEL.items()):
            return None
        if parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
            return None
        byte_of, special = _byte_of(), set(self.special)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        return tiktoken.Encoding("plain", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _same(self, c: str) -> bool:
        got = self.alike.get(c)
        if got is None:
            probe = f"a{c}a {c}{c} 1{c}1 {c}.{c}\n{c} {c}a {c}1"
            got = self.alike[c] = np.array_equal(self._exact(probe), self.fast.encode_to_numpy(probe, disallowed_special=()))
        return got

    def ids(self, text: str) -> np.ndarray:
        if not self.latin or any(s in text for s in self.special):
            return self._exact(text)
        if not text.isascii() and not all(map(self._same, set(_BEYOND_LATIN.findall(text)))):
            return self._exact(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_tokenizers: dict[str, TextTokenizer] = {}


def tokenizer_at(path: str) -> TextTokenizer:
    """One tokenizer for each worker process, so that it is read once."""
    if path not in _tokenizers:
        _tokenizers[path] = TextTokenizer(path)
    return _tokenizers[path]


def cut(total: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: whole sequences, the first of them the shorter rest."""
    if total <= size:
        return [(0, total)]
    first = total % size
    starts = ([0] if first else []) + list(range(first, total, size))
    return [(s, first if first and i == 0 else size) for i, s in enumerate(starts)]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, ended by token ``END_OF_DOCUMENT``."""
    end = np.array([END_OF_DOCUMENT], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_at(tokenizer_path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = tokenizer.ids(text).tobytes() + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    out.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Slots in order of (length, rank): pieces of that length from that rank on go to ``sequence``, +1 each, at ``offset``."""

    keys: np.ndarray
    ranks: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    bins: int


def best_two_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, from how many pieces have each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    index = np.arange(size + 1)
    out = []
    below = np.maximum.accumulate(np.where(left > 0, index, 0))  # the largest length left, up to each length
    while below[size]:
        taken: Counter = Counter()
        gap, bin_ = size, []

        def fit(most: int) -> int:
            n = int(below[most])
            while n and left[n] - taken[n] <= 0:
                n = int(below[n - 1])
            return n

        while gap and (n := fit(gap)):
            bin_.append(n)
            taken[n] += 1
            gap -= n
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            taken[small] -= 1
            a = np.flatnonzero(left[: room // 2 + 1] > 0)
            best = (small, 0, 0)
            hoped = a + below[room - a]
            for i in np.argsort(-hoped, kind="stable").tolist():
                if hoped[i] <= best[0]:
                    break  # no pair still to be tried can fill the gap more tightly
                x = int(a[i])
                if left[x] - taken[x] <= 0:
                    continue
                taken[x] += 1
                y = fit(room - x)
                taken[x] -= 1
                if y and x + y > best[0]:
                    best = (x + y, y, x)
            if best[1]:
                bin_[-1:] = best[1:]
                taken.update(best[1:])
            else:
                taken[small] += 1
        times = min(int(left[n]) // k for n, k in taken.items() if k)
        out.append((tuple(bin_), times))
        for n, k in taken.items():
            left[n] -= k * times
        below = np.maximum.accumulate(np.where(left > 0, index, 0))
    return out


def make_plan(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    used: Counter = Counter()
    rows, sequence = [], 0
    for bin_, times in best_two_fit(counts, size):
        offset = 0
        for n in bin_:
            rows.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    rows.sort()
    k, r, s, o = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 4
    return Plan(k, r, s, o, sequence)


def pack(cut_pieces: DataFrame, size: int = SEQUENCE, salt_rows: int = 256, most_salts: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length``, more columns stay).

    Ranks within a length are counted in salted groups, so that one frequent length is spread over many tasks.
    """
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(counts, size))
    salts = F.broadcast(spark.createDataFrame([(n, min(most_salts, -(-c // salt_rows))) for n, c in counts.items()], "length long, salts int"))
    dealt = cut_pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    return _placed(dealt.drop("salts"), plan)


def _placed(dealt: DataFrame, plan) -> DataFrame:
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = plan.value
        both = p.keys * (1 << 48) + p.ranks
        at = np.searchsorted(both, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": p.sequences[at] + rank.to_numpy() - p.ranks[at], "offset": p.offsets[at]})

    return ranked.withColumn("at", place("length", "rank")).select(*[c for c in dealt.columns if c != "salt"], "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of every document, with its place in a sequence of at most ``size`` tokens.

    Null and empty texts are the end token alone; repeated rows are packed each; null ids are kept.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(saved(pieces(docs, tokenizer_path, size), "pieces"), size).select(*columns)
