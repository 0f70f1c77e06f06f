"""A data source of small named text files with a manifest: ``spark.read`` and ``df.write`` of format ``named_files``.

Each row (``name, key, value``) is one file. A writer task puts its files below the folder under temporary names, moves
each into place, and lists them in a part of the manifest of its own; the commit names the parts that count. A task that is
repeated, after an executor was lost or by speculation, moves the same contents to the same names, and only the list of the
attempt that Spark commits counts. Readers take one partition for each part of the manifest, so no folder is ever listed,
and ``key`` comes back as it was written. Files that no committed part names aren't read.

Files are opened through ``pyarrow.fs``, so a folder may lie wherever that reaches and all executors see it.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cuelattice.functions.text import SPACE, nfkc, small_batches

SCHEMA = "name string, key string, value string"
MANIFEST, COMMITS = "_manifest", "_commits"
# Names that some file systems keep for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)))
TITLE_CHARS = 100
# Whole files that go to or come from Python at once: long recordings have megabytes.
FILES_AT_ONCE = 200
# Bytes of files that come from Python at once: of 200 long recordings all would be hundreds of megabytes.
READ_AT_ONCE = 4 << 20


def safe_title(title: Column) -> Column:
    """A title as the beginning of a file name: runs of signs that file systems refuse become ``_``; never empty."""
    plain = F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(title, F.lit(""))), rf"{SPACE}+", " "), r"\A | \z", "")
    trim = lambda c: F.regexp_replace(c, r"\A[ .]+|[ .]+\z", "")
    short = F.regexp_replace(F.left(trim(F.regexp_replace(plain, r'[<>:"/\\|?*\x00-\x1f]+', "_")), F.lit(TITLE_CHARS)), r"[ .]+\z", "")
    named = F.when(short == "", "untitled").otherwise(short)
    return F.when(F.upper(named).isin(*RESERVED), F.concat(F.lit("_"), named)).otherwise(named)


def file_name(title: Column | None, key: Column, *more: Column) -> Column:
    """``Title.<key>.<more>``: the stem of one document's file; without titles (None) Python isn't asked. Keys that hold a path's signs get a digest, so that none meet."""
    odd = key.rlike(r'[<>:"/\\|?*\x00-\x1f]')
    kept = F.when(odd, F.concat(F.regexp_replace(key, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit("-"), F.left(F.sha2(key.cast("binary"), 256), F.lit(12)))).otherwise(key)
    return F.concat_ws(".", F.lit("untitled") if title is None else safe_title(title), kept, *more)


def _store(path: str):
    """The file system of a folder and the folder's place in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            return fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return fs.LocalFileSystem(), path


def _put(files, at: str, data: bytes) -> None:
    """Write beside, then move: a reader never sees half a file."""
    beside = f"{posixpath.dirname(at)}/_part-{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        out.write(data)
    files.move(beside, at)


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int


@dataclass
class Part(InputPartition):
    part: str


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        files, root = _store(self.path)
        files.create_dir(f"{root}/{MANIFEST}", recursive=True)
        count, folders, part = 0, {root}, f"{uuid.uuid4().hex}.jsonl"
        # The list is written as files are, and moved into place when it is whole.
        with files.open_output_stream(f"{root}/{MANIFEST}/_part-{part}") as listed:
            for r in rows:
                at = posixpath.normpath(f"{root}/{r['name']}")
                if not at.startswith(f"{root}/") or posixpath.basename(at).startswith("_part-"):
                    raise ValueError(f"a file can't be named {r['name']!r}")
                if (folder := posixpath.dirname(at)) not in folders:
                    files.create_dir(folder, recursive=True)
                    folders.add(folder)
                data = (r["value"] or "").encode("utf-8")
                _put(files, at, data)
                listed.write(f"{json.dumps({'name': r['name'], 'key': r['key'], 'bytes': len(data)}, ensure_ascii=False)}\n".encode())
                count += 1
        files.move(f"{root}/{MANIFEST}/_part-{part}", f"{root}/{MANIFEST}/{part}")
        return Written(part, count)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _store(self.path)
        parts = [m.part for m in messages if m is not None and m.files]
        kept = [] if self.overwrite else committed(self.path)
        files.create_dir(root, recursive=True)
        _put(files, f"{root}/{COMMITS}", "".join(f"{x}\n" for x in [*kept, *parts]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing names the files of a write that failed; its parts of the manifest go."""
        files, root = _store(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{MANIFEST}/{m.part}")


def committed(path: str) -> list[str]:
    """Parts of the manifest that count: as many as tasks have written."""
    from pyarrow import fs

    files, root = _store(path)
    if files.get_file_info(f"{root}/{COMMITS}").type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{root}/{COMMITS}") as f:
        return f.read().decode().split()


class NamedFilesReader(DataSourceReader):
    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def partitions(self) -> list[Part]:
        return [Part(p) for p in committed(self.path)] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """Files as batches of at most ``READ_AT_ONCE`` bytes, or of one longer file; the list is read as they are."""
        files, root = _store(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["name", "key", "value"])

        if not partition.part:
            return
        with files.open_input_stream(f"{root}/{MANIFEST}/{partition.part}") as f:
            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                x = json.loads(line)
                if not x["name"].endswith(self.ending):
                    continue
                if rows and (size + x["bytes"] > READ_AT_ONCE or len(rows) >= FILES_AT_ONCE):
                    yield batch()
                    rows, size = [], 0
                with files.open_input_stream(f"{root}/{x['name']}") as one:
                    rows.append((x["name"], x["key"], one.read()))
                size += x["bytes"]
        if rows:
            yield batch()


class NamedFiles(DataSource):
    """Options: ``path``, the folder; ``ending``, for reading only files whose names end so."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NamedFilesReader:
        return NamedFilesReader(self.options["path"].rstrip("/"), self.options.get("ending", ""))

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"].rstrip("/"), overwrite)


def write_named(rows: DataFrame, path: str) -> None:
    """``rows`` (name, key, value) as files below ``path``, added to those that are there."""
    small_batches(rows.sparkSession, FILES_AT_ONCE)
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select(F.col("name").cast("string"), F.col("key").cast("string"), F.col("value").cast("string")).write.format("named_files").mode("append").save(path)


def read_named(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """``name, key, value`` of the files below ``path`` that writes have committed, whole."""
    small_batches(spark, FILES_AT_ONCE)
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("ending", ending).load(path)
