"""Recursive file listing by Spark jobs, and content reading by path.

Spark's ``binaryFile`` format drops names that start with ``.`` or ``_`` and zero-byte files, all of
which are part of a source tree, so directories are listed here: one job for each level of the trees.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..materialize import materialize
from ..operators.packing import packed
from ..operators.predicates import DEFAULT_EXCLUDED_DIRS
from ..ship import ship_package
from .tables import describe_files

_ENTRIES = "root string, path string, is_dir boolean, size bigint, mtime timestamp"
_ARROW = pa.schema(
    [
        ("root", pa.string()),
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("size", pa.int64()),
        ("mtime", pa.timestamp("us", tz="UTC")),
    ]
)
_BATCH_ROWS = 10_000
_BATCH_BYTES = 32 << 20
#: File bytes that one task reads, unless a single file has more.
TASK_BYTES = 128 << 20


def _list_dir(directory: str) -> Iterator[tuple[str, bool, int, datetime]]:
    """(path, is_directory, size, mtime) per entry; links and unreadable entries are left out."""
    if "://" in directory:
        from pyarrow import fs

        scheme, _, bare = directory.partition("://")
        store, inner = fs.FileSystem.from_uri(directory)
        lead = directory[: len(directory) - len(inner)] if directory.endswith(inner) else f"{scheme}://"
        try:
            infos = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        except OSError:
            return
        for info in infos:
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield lead + info.path, info.type == fs.FileType.Directory, info.size or 0, info.mtime
        return
    try:
        entries = os.scandir(directory)
    except OSError:
        return
    with entries:
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, True, 0, datetime.fromtimestamp(0, timezone.utc)
                elif entry.is_file(follow_symlinks=False):
                    stat = entry.stat(follow_symlinks=False)
                    when = datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, timezone.utc)
                    yield entry.path, False, stat.st_size, when
            except OSError:
                continue


def _list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each directory, a batch at a time however many it has."""
    for batch in batches:
        rows: list[tuple] = []
        for root, directory in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
            for path, is_dir, size, mtime in _list_dir(directory):
                rows.append((root, path, is_dir, size, mtime))
                if len(rows) >= _BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, _ARROW, strict=True)], schema=_ARROW
    )


def scan_corpus(
    spark: SparkSession,
    roots: list[str],
    *,
    prune_default_dirs: bool = True,
    max_depth: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """``files`` without content. Each level of the trees is one job over its directories, dealt to ``tasks`` tasks by a hash of the
    path and written to the shared folder; the driver holds the roots only. Excluded directories are never entered, links and
    unreadable directories are left out. Roots are paths that every executor can see, or URIs that ``pyarrow.fs`` knows."""
    ship_package(spark)
    parts = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = [(top, top) for top in dict.fromkeys(r.rstrip("/") or "/" for r in roots)]
    level, depth = spark.createDataFrame(tops, "root string, path string"), 0
    listed: list[DataFrame] = []
    while True:
        entries = materialize(level.repartition(parts, "path").mapInArrow(_list_all, _ENTRIES), "listing")
        listed.append(entries.filter(~F.col("is_dir")))
        below = entries.filter("is_dir")
        if prune_default_dirs:
            below = below.filter(~F.substring_index("path", "/", -1).isin(DEFAULT_EXCLUDED_DIRS))
        depth += 1
        if (max_depth is not None and depth > max_depth) or below.isEmpty():
            break
        level = below.select("root", "path")
    files = listed[0]
    for more in listed[1:]:
        files = files.unionByName(more)
    return describe_files(files.select(F.col("root").alias("corpus_id"), "root", "path", "size", "mtime"))


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_stream(inner)
    return open(path, "rb")


def _read_bytes(path: str, binary: bool) -> tuple[bytes | None, bool | None]:
    """A file's bytes and whether it is binary, from its first bytes; of a binary file that isn't wanted, nothing but these is read."""
    try:
        with _open(path) as stream:
            head = stream.read(text.BINARY_SNIFF_BYTES)
            if b"\0" not in head:
                return head + stream.read(), False
            return (head + stream.read() if binary else None), True
    except OSError:
        return None, None


def _attach(batches: Iterator[pa.RecordBatch], binary: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, held, blobs, kinds = 0, 0, [], []
        for i, path in enumerate(batch.column("path").to_pylist()):
            blob, kind = _read_bytes(path, binary)
            blobs.append(blob)
            kinds.append(kind)
            held += len(blob or b"")
            if held >= _BATCH_BYTES or i == batch.num_rows - 1:
                part = batch.slice(start, i + 1 - start)
                part = part.append_column("content", pa.array(blobs, type=pa.large_binary()))
                yield part.append_column("is_binary", pa.array(kinds, type=pa.bool_()))
                start, held, blobs, kinds = i + 1, 0, [], []


def with_content(files: DataFrame, partitions: int | None = None, task_bytes: int | None = TASK_BYTES, binary: bool = True) -> DataFrame:
    """Read the bytes of the files that are left after the metadata filters.

    Adds ``is_binary`` and ``content`` (text); an unreadable file keeps its row with null in both. Files are dealt to tasks by their
    sizes, at most ``task_bytes`` to one unless a file is larger, or to a number of ``partitions``, or, with neither, left
    where they are. Without ``binary``, binary files keep null content and only their first bytes are read.
    """
    if partitions:
        files = files.repartition(partitions)
    elif task_bytes:
        files = packed(files, "size", task_bytes)
    ship_package(files.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    raw = files.mapInArrow(lambda batches: _attach(batches, binary), f"{schema}, content binary, is_binary boolean")
    return raw.withColumn("content", text.bytes_to_text(F.col("content")))
