"""Documents in flat, unindexed token files, found by their end-of-document identifiers.

Blocks of a file are searched independently with vector operations; each yields how many separators it holds, where
they lie and how many tokens it has. A prefix scan over these few numbers per block, by groups of blocks and then over
the groups, gives every block the number of documents and tokens before it and the place of the last separator, so
that documents that span blocks come out whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelattice.llm.common import saved, small_batches

BLOCK_BYTES = 1 << 20
# What one task reads of a file in one go, block by block.
RANGE_BYTES = 1 << 27
# Blocks per group of the two-level scan.
GROUP = 1024
_TYPES = {2: "<u2", 4: "<u4"}


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files below ``path`` as rows ``file, block, payload`` of at most ``block_bytes`` each, in file order.

    Spark lists the files; each of their ranges is opened, read from its own offset and cut into blocks by some task,
    so no file is held whole and no name goes to the driver. Empty files have no row; a file that doesn't hold whole
    tokens is an error.
    """
    block_bytes -= block_bytes % width
    range_bytes = max(block_bytes, range_bytes - range_bytes % block_bytes)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))).alias("range"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for name, length, number in zip(pdf["file"], pdf["length"], pdf["range"], strict=True):
                if length % width:
                    raise ValueError(f"{name} has {length} bytes, no whole tokens of {width} bytes")
                at, end = number * range_bytes, min(length, (number + 1) * range_bytes)
                store, where = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_file(where) as f:
                    f.seek(at)
                    while at < end:
                        payload = f.read(min(block_bytes, end - at))
                        yield pd.DataFrame({"file": [name], "block": [at // block_bytes], "payload": [payload]})
                        at += len(payload)

    return ranges.repartition("file", "range").mapInPandas(read, "file string, block long, payload binary")


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """``file, block, tokens, at``: how many tokens each block has, and where in it the separators are."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.frombuffer(p, dtype=_TYPES[width]) for p in pdf["payload"]]
            yield pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "tokens": [len(x) for x in found], "at": [np.flatnonzero(x == separator).astype(np.int32) for x in found]})

    return blocks.select("file", "block", F.coalesce("payload", F.lit(b"")).alias("payload")).mapInPandas(scan, "file string, block long, tokens long, at array<int>")


def documents_of(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """``file, doc, start, tokens`` of every document; ``tokens`` is without the separator.

    Two separators in a row enclose an empty document; tokens after the last separator of a file are a document too.
    A null payload is an empty block; numbering starts at 0 in each file.
    """
    scanned = saved(scan_blocks(blocks, separator, width), "separators").withColumn("grp", F.floor(F.col("block") / GROUP))
    own = scanned.select("file", "block", "grp", "tokens", "at", F.size("at").cast("long").alias("n"), F.try_element_at("at", F.lit(-1)).alias("last"))
    groups = own.groupBy("file", "grp").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    before_group = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("file", "grp", F.coalesce(F.sum("tokens").over(before_group), F.lit(0)).alias("group_tokens"), F.coalesce(F.sum("n").over(before_group), F.lit(0)).alias("group_docs"))
    before = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("tokens_before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, ["file", "grp"])
    placed = placed.withColumn("first", F.col("group_tokens") + F.col("tokens_before")).withColumn("doc", F.col("group_docs") + F.col("docs_before"))
    # The last separator before each block, first within its group, then from the groups before.
    ends = placed.withColumn("end", F.col("first") + F.col("last"))
    last_in_group = ends.groupBy("file", "grp").agg(F.max("end").alias("group_end"))
    carried = last_in_group.select("file", "grp", F.max("group_end").over(before_group).alias("carried"))
    ends = ends.withColumn("within", F.max("end").over(before)).join(carried, ["file", "grp"])
    ends = ends.withColumn("previous", F.coalesce("within", "carried", F.lit(-1).cast("long")))
    whole = ends.select("file", "doc", "previous", F.posexplode("at").alias("i", "p"), "at", "first").select(
        "file",
        (F.col("doc") + F.col("i")).alias("doc"),
        F.when(F.col("i") == 0, F.col("previous") + 1).otherwise(F.col("first") + F.get("at", F.col("i") - 1) + 1).alias("start"),
        (F.col("first") + F.col("p")).alias("end"),
    )
    tail = ends.groupBy("file").agg(F.max(F.col("first") + F.col("tokens")).alias("end"), F.max(F.coalesce("end", F.lit(-1).cast("long"))).alias("last"), F.sum("n").alias("doc"))
    tail = tail.where("last + 1 < end").select("file", "doc", (F.col("last") + 1).alias("start"), "end")
    return whole.unionByName(tail).select("file", "doc", "start", (F.col("end") - F.col("start")).alias("tokens"))


def flat_blocks(docs: DataFrame, encode_factory, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts as flat token files: one file for each input partition, cut into blocks without regard to documents.

    ``encode_factory()`` gives a function from a list of texts to the bytes of their ids, ``width`` bytes an id.
    """
    end = np.array([separator], dtype=_TYPES[width]).tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, buffer, block, name = encode_factory(), bytearray(), 0, None
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                name = name or f"part-{part['part'].iloc[0]:06d}"
                buffer += b"".join(x + end for x in encode(list(part["text"])))
                full = len(buffer) // block_bytes
                if full:
                    yield pd.DataFrame({"file": name, "block": range(block, block + full), "payload": [bytes(buffer[i * block_bytes : (i + 1) * block_bytes]) for i in range(full)]})
                    block += full
                    del buffer[: full * block_bytes]
        if buffer:
            yield pd.DataFrame({"file": [name], "block": [block], "payload": [bytes(buffer)]})

    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return texts.mapInPandas(write, "file string, block long, payload binary")
